"""What the four tools work on: the tables of a corpus with the columns derived from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import classify
from storyloom.functions import text as tx

#: Names of the games as titles show them.
LABELS = {"game_a": "A", "game_b": "B"}
#: Columns of documents beyond the summary; all are optional.
MORE = ("wiki_role", "mission_title", "story_key", "kind", "canonical_name")


@dataclass(frozen=True)
class Corpus:
    """Tables and the version they are of. ``lines`` are as delivered; what is not there is None.

    ``index`` is a table of ``index.build``; without it candidates are found by scanning the lines.
    """

    documents: DataFrame
    lines: DataFrame
    version: str = "0" * 64
    entities: DataFrame | None = None
    alias_lines: DataFrame | None = None
    relations: DataFrame | None = None
    timelines: DataFrame | None = None
    i18n: DataFrame | None = None
    i18n_catalog: DataFrame | None = None
    index: DataFrame | None = None
    games: tuple[str, ...] = ("game_a", "game_b")
    labels: dict[str, str] = field(default_factory=lambda: dict(LABELS))

    def described(self) -> DataFrame:
        """The documents with all columns of a summary, missing ones null, and those derived from them.

        game, resource_type, content_type, collection_name as told publicly; ``tags``, ``role``, ``title``, ``titles`` (all
        that a title search looks at), ``uid``.
        """
        d = complete(self.documents, (*classify.SUMMARY, *MORE))
        c = {n: F.col(n) for n in d.columns}
        role = classify.wiki_role(c["document_kind"], F.coalesce(c["wiki_role"], F.lit("")), F.coalesce(c["path"], F.lit("")), c["document_type"], c["character_name"])
        kind = classify.filled(c["kind"], c["document_kind"])
        stated = F.nullif(c["resource_type"], F.lit(""))
        titles = [c[n] for n in ("display_title", "story_name", "activity_name", "character_name", "story_code", "part_label", "collection_name", "mission_title", "story_key")]
        return d.withColumns({
            "__title": classify.natural_title(c, self.labels),
            "role": role,
            "tags": tags(c, role, stated),
            "titles": tx.search_form(F.concat_ws("\n", *titles)),
            "uid": tx.document_uid(c["document_id"]),
            "__collection": classify.collection_name(c["collection_name"], c["mission_title"], c["activity_name"], c["story_name"]),
            "__game": classify.game(c["game"], c["document_id"], c["source_ref_prefix"]),
            "__resource": classify.resource_type(c["document_type"], c["document_kind"], c["document_category"], role, stated),
            "__content": classify.content_type(c["document_type"], kind, c["content_type"]),
        }).drop("game", "resource_type", "content_type", "collection_name").withColumnsRenamed({
            "__title": "title", "__collection": "collection_name", "__game": "game", "__resource": "resource_type", "__content": "content_type",
        })

    def once(self, lines: DataFrame) -> DataFrame:
        """Lines once each: of redelivered ones that with the smallest line_id, where there is one."""
        own = [c for c in lines.columns if c not in ("document_id", "line_number")]
        key = F.col("line_id") if "line_id" in own else F.struct(*[c for c in own if not lines.schema[c].dataType.simpleString().startswith("map")])
        one = lines.groupBy("document_id", "line_number").agg(F.min_by(F.struct(*own), key).alias("__one"))
        return one.select("document_id", "line_number", "__one.*")


def complete(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """``df`` with the wanted columns it lacks as null texts."""
    return df.withColumns({c: F.lit(None).cast("string") for c in wanted if c not in df.columns})


#: What else a stated type answers to.
ALSO = {
    "original_story": ("story",), "character_profile": ("character_bundle",), "character_module": ("character_bundle",), "character_voice": ("character_bundle",), "operator_record": ("character_bundle",),
    "character_wiki": ("reviewed_wiki", "wiki"), "story_wiki": ("reviewed_wiki", "wiki"), "character_activity_wiki": ("reviewed_wiki", "wiki"), "knowledge": ("reviewed_wiki", "wiki"),
}


def tags(c: dict[str, Column], role: Column, stated: Column) -> Column:
    """Every requested type a document answers to: by its rules, as it states, and what its stated type stands for."""
    ruled = classify.resource_tags(c["document_type"], c["document_kind"], c["document_category"], role)
    more = F.create_map(*[x for k, v in ALSO.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])[stated]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(ruled, F.coalesce(F.when(stated.isNotNull(), F.array(stated)), none), F.coalesce(more, none)))
