"""Entity names: alias groups, multi-pattern matching, span selection, relation hints.

Alias groups are small reviewed tables; their size is checked before they are sent to the workers, and beyond it the
names are joined by their first three signs, or all of a shorter name, instead. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns an automaton is built of at most; larger sets are joined by their heads.
MOST_PATTERNS = 200_000


def alias_groups(entities: DataFrame) -> DataFrame:
    """(canonical, aliases, games): per canonical name its aliases, itself among them, and its games, sorted.

    A name that is canonical in another game is no alias; null and empty aliases are dropped.
    """
    each = entities.where(F.length("canonical_name") > 0).select(
        F.col("canonical_name").alias("canonical"), "game",
        F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("canonical_name"))).alias("alias"),
    )
    each = each.withColumn("alias", F.trim("alias")).where(F.length("alias") > 0)
    owners = entities.select(F.col("canonical_name").alias("alias"), F.col("game").alias("__game"), F.col("canonical_name").alias("__owner")).distinct()
    taken = each.join(owners, "alias").where((F.col("__owner") != F.col("canonical")) | (~F.col("__game").eqNullSafe(F.col("game"))))
    each = each.join(taken.select("canonical", "alias").distinct(), ["canonical", "alias"], "left_anti").unionByName(each.where("alias = canonical"))
    return each.groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("game")).alias("games"))


def attached(groups: DataFrame, listed: DataFrame, line: str = "text", others: DataFrame | None = None) -> DataFrame:
    """Groups with the aliases of listed lines, names set apart by semicolons: to the first group that holds the line's first name.

    A line whose first name no group holds makes a group of its own, with the other lines of that name. ``others`` are
    names (name) that belong to another game's characters and are no aliases.
    """
    names = F.array_distinct(F.filter(F.transform(F.split(line, ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 0))
    lines = listed.select(names.alias("names")).where(F.size("names") > 0).withColumn("first", F.get("names", F.lit(0)))
    owners = alias_table(groups).withColumnsRenamed({"alias": "first", "canonical": "owner"})
    each = lines.join(owners, "first", "left").select(F.coalesce("owner", "first").alias("canonical"), F.explode("names").alias("alias"))
    each = each.unionByName(lines.join(owners, "first", "left_anti").select(F.col("first").alias("canonical"), F.col("first").alias("alias")))
    if others is not None:
        barred = others.select(F.col("name").alias("alias")).distinct()
        each = each.where("alias = canonical").unionByName(each.where("alias != canonical").join(barred, "alias", "left_anti"))
    both = each.withColumn("game", F.lit(None).cast("string")).unionByName(_long(groups))
    return both.groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("game")).alias("games"))


def _long(groups: DataFrame) -> DataFrame:
    each = groups.select("canonical", "games", F.explode("aliases").alias("alias"))
    return each.select("canonical", "alias", F.explode_outer("games").alias("game"))


def expand(groups: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """For each requested name the aliases of the first group that holds it, or itself alone; bounded by the request."""
    wanted = list(dict.fromkeys(names))
    held = groups.where(F.arrays_overlap("aliases", F.array(*[F.lit(n) for n in wanted]))) if wanted else groups.limit(0)
    rows = held.select("canonical", "aliases", F.array_intersect("aliases", F.array(*[F.lit(n) for n in wanted])).alias("asked")).orderBy("canonical").collect() if wanted else []
    out: dict[str, list[str]] = {}
    for n in wanted:
        row = next((r for r in rows if n in r.asked), None)
        out[row.canonical if row else n] = list(row.aliases) if row else [n]
    return out


def alias_table(groups: DataFrame) -> DataFrame:
    """(alias, canonical): each alias with the first group that has it, in order of the canonical name."""
    each = groups.select("canonical", F.explode("aliases").alias("alias"))
    return each.groupBy("alias").agg(F.min("canonical").alias("canonical"))


class Automaton:
    """Many patterns in one pass over a text, by a compiled matcher."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.lengths = [len(p) for p in patterns]
        self.matcher = ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for k, p in enumerate(patterns):
            if p:
                same.setdefault(p, []).append(k)
        for p, numbers in same.items():
            self.matcher.add_word(p, numbers)
        self.matcher.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(pattern number, start, end) of every occurrence."""
        if not len(self.matcher):
            return
        for last, numbers in self.matcher.iter(text):
            for k in numbers:
                yield k, last + 1 - self.lengths[k], last + 1


_automata: dict[int, Automaton] = {}


def _automaton(patterns: list[tuple[str, str]]) -> Automaton:
    """The worker's automaton of these patterns, built once for all its tasks; only the latest few are kept."""
    key = hash(tuple(patterns))
    if key not in _automata:
        if len(_automata) >= 4:
            _automata.pop(next(iter(_automata)))
        _automata[key] = Automaton([a for a, _ in patterns])
    return _automata[key]


def select_spans(found: list[tuple[int, int, str]], whole: int) -> list[tuple[int, int, str]]:
    """Of (start, end, canonical) the longest leftmost: contained ones go, equal spans of other names and overlaps stay.

    One-sign matches count only where they are the whole text.
    """
    kept: list[tuple[int, int, str]] = []
    reach: list[tuple[int, int]] = []
    for start, end, name in sorted(set(found), key=lambda m: (m[0], m[0] - m[1], m[2])):
        if end - start == 1 and whole != 1:
            continue
        # by this order only spans that reach farthest so far can contain it
        while reach and reach[-1][1] <= start:
            reach.pop()
        if any(a <= start and end <= b and (a, b) != (start, end) for a, b in reach):
            continue
        kept.append((start, end, name))
        if not reach or (start, end) != reach[-1]:
            reach = [(a, b) for a, b in reach if b > end] + [(start, end)]
    return kept


def mentions(texts: DataFrame, key: str, text: str, aliases: DataFrame, select: bool = True) -> DataFrame:
    """(key, canonical, alias, start, stop) of the aliases (alias, canonical) that occur in the texts."""
    rows = aliases.select("alias", "canonical").where(F.length("alias") > 0).distinct().orderBy("alias", "canonical").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        return _mentions_by_trigram(texts, key, text, aliases, select)
    spark = texts.sparkSession
    patterns = spark.sparkContext.broadcast([(r.alias, r.canonical) for r in rows])
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(patterns.value)
        for batch in batches:
            out: list[tuple] = []
            for k, t in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                if not t:
                    continue
                found = [(s, e, patterns.value[p][1]) for p, s, e in automaton.find(t)]
                for s, e, name in select_spans(found, len(t)) if select else sorted(set(found)):
                    out.append((k, name, t[s:e], s, e))
            cols = list(zip(*out)) or [()] * 5
            types = (batch.schema[0].type, pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "canonical", "alias", "start", "stop"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, canonical string, alias string, start int, stop int")


def _mentions_by_trigram(texts: DataFrame, key: str, text: str, aliases: DataFrame, select: bool = False) -> DataFrame:
    """As ``mentions`` for pattern sets of any size: an equality join on the first three signs, or all of fewer."""
    width = lambda n: F.least(n, F.lit(3))
    rows = texts.where(F.length(text) > 0).select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(1), F.length("__text"))).alias("__at"))
    left = F.length("__text") - F.col("__at") + 1
    pieces = pieces.withColumn("__width", F.explode(F.sequence(F.lit(1), width(left)))).withColumn("__head", F.substr("__text", "__at", "__width"))
    names = aliases.select("alias", "canonical").where(F.length("alias") > 0).distinct()
    names = names.select("*", width(F.length("alias")).alias("__width")).withColumn("__head", F.substr("alias", F.lit(1), "__width"))
    hit = pieces.join(names, ["__width", "__head"]).where(F.substr(F.col("__text"), F.col("__at"), F.length("alias")) == F.col("alias"))
    start = (F.col("__at") - 1).cast("int")
    hit = hit.select("__row", F.col("__key").alias(key), F.length("__text").alias("__whole"), "canonical", "alias", start.alias("start"), (start + F.length("alias")).alias("stop"))
    if not select:
        return hit.select(key, "canonical", "alias", "start", "stop")
    kind = texts.schema[key].dataType.simpleString()
    found = hit.groupBy("__row", key, "__whole").agg(F.collect_list(F.struct("start", "stop", "canonical", "alias")).alias("__found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, whole, spans in zip(*(batch[c].to_pylist() for c in range(3))):
                words = {(x["start"], x["stop"]): x["alias"] for x in spans}
                kept = select_spans([(x["start"], x["stop"], x["canonical"]) for x in spans], whole)
                out += [(k, name, words[s, e], s, e) for s, e, name in kept]
            cols = list(zip(*out)) or [()] * 5
            types = (batch.schema[0].type, pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "canonical", "alias", "start", "stop"])

    return found.select(key, "__whole", "__found").mapInArrow(run, f"`{key}` {kind}, canonical string, alias string, start int, stop int")


def containment(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase_key: str, phrase: str) -> DataFrame:
    """(phrase_key, key): texts that hold a phrase verbatim, each pair once."""
    named = phrases.select(F.col(phrase).alias("alias"), F.col(phrase_key).cast("string").alias("canonical"))
    kind = phrases.schema[phrase_key].dataType.simpleString()
    hits = mentions(texts, key, text, named, select=False)
    return hits.select(F.col("canonical").cast(kind).alias(phrase_key), key).distinct()


def relations(installed: DataFrame, bundled: DataFrame) -> DataFrame:
    """Two catalogues of (id, a, b) merged: installed rows win by id."""
    both = installed.withColumn("__p", F.lit(0)).unionByName(bundled.withColumn("__p", F.lit(1)))
    return both.groupBy("id").agg(F.min_by(F.struct("a", "b"), "__p").alias("r")).select("id", "r.a", "r.b")


def relation_hints(texts: DataFrame, key: str, text: str, catalogue: DataFrame) -> DataFrame:
    """(key, a, b): reviewed relations of which either name occurs in the text."""
    names = catalogue.select(F.explode(F.array("a", "b")).alias("alias"), F.col("id").cast("string").alias("canonical"))
    hits = mentions(texts, key, text, names, select=False).select(key, F.col("canonical").alias("id")).distinct()
    return hits.join(catalogue.withColumn("id", F.col("id").cast("string")), "id").select(key, "a", "b")


def gated_relations(catalogue: DataFrame, games: tuple[str, ...] | list[str], needed: tuple[str, ...] = ("game_a", "game_b")) -> DataFrame:
    """The relations, or none unless all the games they go between are enabled."""
    return catalogue if set(needed) <= set(games) else catalogue.limit(0)


def retrieval_context(texts: DataFrame, key: str, text: str, groups: DataFrame, catalogue: DataFrame | None = None, most: int = 16) -> DataFrame:
    """(key, context): what is known of the names in each text: a line for each entity with its other names, and for each
    relation, escaped so that no name can pass for markup; at most ``most`` of each, in order."""
    from storyloom.functions.text import escape

    table = groups.select("canonical", F.explode("aliases").alias("alias"))
    named = mentions(texts, key, text, table).select(key, "canonical").distinct().join(groups, "canonical")
    others = F.array_join(F.slice(F.filter("aliases", lambda a: a != F.col("canonical")), 1, most), "、")
    line = F.concat(F.lit("- "), escape(F.col("canonical")), F.when(others == "", "").otherwise(F.concat(F.lit("："), escape(others))))
    lines = named.select(key, F.struct(F.lit(0).alias("kind"), line.alias("line")).alias("l"))
    if catalogue is not None:
        hints = relation_hints(texts, key, text, catalogue)
        lines = lines.unionByName(hints.select(key, F.struct(F.lit(1).alias("kind"), F.concat(F.lit("- "), escape(F.col("a")), F.lit(" / "), escape(F.col("b"))).alias("line")).alias("l")))
    sorted_ = F.array_sort(F.collect_set("l"))
    kept = F.concat(F.slice(F.filter("all", lambda x: x["kind"] == 0), 1, most), F.slice(F.filter("all", lambda x: x["kind"] == 1), 1, most))
    return lines.groupBy(key).agg(sorted_.alias("all")).select(key, F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("context"))
