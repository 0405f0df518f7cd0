"""The registry of queries: every operator over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import classify, fuzzytime
from storyloom.functions import text as tx
from storyloom.operators import entities, localisation, read, search, sections, session, shred, snapshot, timeline
from storyloom.plans.oracle import ORACLE as ORACLE
from storyloom.sources import corpus
from storyloom.sources.tables import materialise, scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: What the queries look for; also stated in the SQL.
WORD, TERMS, SHORT, SPEAKER = "reactor", ["storm", "lamps"], "xo", "Moxorjo"
TAGS = ("概述", "生平", "相关活动", "概要", "overview", "notes")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- nested records ------------------------------------------------------------------------------------------------
@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each leaf of the tree row > event > source > reference."""
    return shred.timeline_leaves(table(spark, d, "activity_timelines").select("row_id", "events"))


def _timeline_table(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shred.timeline_tables(table(spark, d, "activity_timelines"))[name]

    run.__doc__ = f"The flat table of {name} of the chronology records."
    run.__name__ = f"p1_{name}"
    return run


for _name in ("activities", "events", "sources", "references"):
    query(_timeline_table(_name))


# --- search --------------------------------------------------------------------------------------------------------
def _hits(spark: SparkSession, d: str, word: str = WORD) -> tuple[DataFrame, DataFrame]:
    """Lines as delivered with their search form, and the matching ones once each with place and score."""
    form = tx.plain_form(F.col("text"))
    lines = corpus.delivered(spark, d, "text", "line_type").withColumn("form", form)
    hits = corpus.lines(spark, d, "text", "line_type", where=F.contains(form, F.lit(word))).withColumn("start", search.literal_start(form, word))
    return lines, hits.withColumn("score", search.score(F.col("start"), 1000, F.when(F.col("line_type") == "dialogue", 50).otherwise(0)))


@query
def search_literal_passages(spark: SparkSession, d: str) -> DataFrame:
    _, hits = _hits(spark, d)
    return search.passages(hits).select("document_id", *big("first", "last", "hits", "score", "rank", "cut"))


@query
def search_regex_lines(spark: SparkSession, d: str) -> DataFrame:
    start, length = search.regex_match(F.col("text"), "[0-9]{4} lamps")
    t = corpus.lines(spark, d, "text", where=start.isNotNull()).select("document_id", "line_number", start.alias("start"), length.alias("length"))
    return t.select("document_id", *big("line_number", "start", "length"))


@query
def search_speaker_filter(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.lines(spark, d, "text", "line_type", "speaker_raw", where=F.col("speaker_raw") == SPEAKER)
    return t.select("document_id", *big("line_number"), tx.line_content(F.col("line_type"), F.col("speaker_raw"), F.col("text")).alias("content"))


@query
def search_metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    on = [
        classify.game(F.col("game"), F.col("document_id")) == "game_a",
        classify.part(F.col("part_type")) == "before",
        classify.activity_match(classify.activity_aliases(F.col("activity_id"), F.col("activity_name")), "守夜人"),
    ]
    return r.where(classify.all_of(on)).select("document_id", "activity_name")


@query
def search_resource_tags(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    role = classify.wiki_role(F.col("document_kind"), F.lit(""), F.lit(""))
    tags = classify.resource_tags(F.col("document_type"), F.col("document_kind"), F.col("document_category"), role)
    return r.select("document_id", F.explode(tags).alias("tag"))


@query
def search_title_hits(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    title = F.lower(F.concat_ws("\n", "display_title", "activity_name", "story_code"))
    exact = F.coalesce(F.lower("display_title") == "kx-1", F.lit(False)) | F.coalesce(F.lower("story_code") == "kx-1", F.lit(False))
    return r.where(title.contains("kx-1")).select("document_id", exact.cast("bigint").alias("exact"))


@query
def search_context_terms(spark: SparkSession, d: str) -> DataFrame:
    lines, hits = _hits(spark, d)
    found = search.context_terms(lines, hits.select("document_id", "line_number", "start"), TERMS)
    return found.select("document_id", *big("line_number"), F.array_join(F.transform("term_lines", lambda x: x.cast("string")), ",").alias("term_lines"))


@query
def search_context_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose extent takes in the lines of the context terms."""
    lines, hits = _hits(spark, d)
    found = search.context_terms(lines, hits.select("document_id", "line_number", "score"), TERMS)
    return search.passages(found).select("document_id", *big("first", "last", "hits", "score", "rank", "cut"))


@query
def search_entity_mention(spark: SparkSession, d: str) -> DataFrame:
    """Stored entity occurrences whose name stands near the word in the text."""
    said = F.concat_ws(": ", "speaker_raw", "text")
    t = corpus.lines(spark, d, "text", "speaker_raw", "entity_occurrences", where=F.contains(said, F.lit("the")) & (F.size("entity_occurrences") > 0))
    t = t.withColumn("text", said).withColumn("start", search.literal_start(F.col("text"), "the")).select("document_id", "line_number", "text", "start", F.explode("entity_occurrences").alias("o"))
    gap = search.near_hit(F.col("text"), F.col("o.raw_name"), F.col("start"), F.col("start") + 3)
    t = t.select("document_id", "line_number", "o.entity_id", "o.raw_name", gap.alias("distance")).where("distance IS NOT NULL")
    return t.groupBy("document_id", "line_number", "entity_id", "raw_name").agg(F.min("distance").alias("distance")).select("document_id", *big("line_number"), "entity_id", "raw_name", *big("distance"))


@query
def search_match_cap24(spark: SparkSession, d: str) -> DataFrame:
    _, hits = _hits(spark, d, "e")
    return search.first_matches(hits).select("document_id", *big("line_number", "start"))


@query
def search_score_docs(spark: SparkSession, d: str) -> DataFrame:
    _, hits = _hits(spark, d)
    return hits.groupBy("document_id").agg(F.max("score").cast("bigint").alias("score"), F.count(F.lit(1)).alias("lines"))


@query
def search_interleave_order(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    return search.interleave(r, "game", ["document_id"], ["game_b", "game_a"]).select("document_id", "ordinal")


@query
def search_page_anchor(spark: SparkSession, d: str) -> DataFrame:
    """The page after a known candidate, by what its documents would show."""
    one = corpus.delivered(spark, d, "text").groupBy("document_id", "line_number").agg(F.min(F.struct("line_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))).alias("l"))
    sizes = one.groupBy("document_id").agg(F.sum("l.n").alias("chars"))
    r = search.interleave(corpus.documents(spark, d), "game", ["document_id"], ["game_a", "game_b"])
    c = r.join(sizes, "document_id", "left").select("document_id", "ordinal", F.coalesce("chars", F.lit(0)).alias("chars"))
    return search.page(c, after=20).select("document_id", *big("ordinal", "running"))


@query
def search_excerpt_roles(spark: SparkSession, d: str) -> DataFrame:
    lines, hits = _hits(spark, d)
    out = search.excerpts(lines, search.passages(hits), hits)
    return out.select("document_id", *big("rank", "line_number"), "role", "text")


@query
def search_highlight(spark: SparkSession, d: str) -> DataFrame:
    _, hits = _hits(spark, d)
    return hits.select("document_id", *big("line_number"), tx.highlight(F.col("text"), WORD).alias("marked"))


@query
def search_anchor_line(spark: SparkSession, d: str) -> DataFrame:
    return search.anchor_lines(corpus.delivered(spark, d, "text", "line_type")).select("document_id", *big("line_number"))


@query
def search_evidence_kind(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    role = classify.wiki_role(F.col("document_kind"), F.lit(""), F.lit(""))
    kind = classify.resource_type(F.col("document_type"), F.col("document_kind"), F.col("document_category"), role)
    content = classify.content_type(F.col("document_type"), F.col("document_kind"))
    return r.groupBy(kind.alias("resource_type"), content.alias("content_type")).agg(F.count(F.lit(1)).alias("n"))


@query
def search_normal_form(spark: SparkSession, d: str) -> DataFrame:
    """Literal matches on the compatibility form, which full-width text meets as well."""
    start = search.literal_start(tx.search_form(F.col("text")), "quaxor")
    t = corpus.delivered(spark, d, "text").withColumn("start", start).where("start IS NOT NULL")
    return corpus.one_delivery(t).select("document_id", *big("line_number", "start"))


@query
def preview_cost(spark: SparkSession, d: str) -> DataFrame:
    lines, hits = _hits(spark, d)
    shown = search.excerpts(lines, search.passages(hits), hits)
    cost = shown.groupBy("document_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"))
    return cost.withColumn("fits", (F.col("chars") <= 600).cast("bigint"))


# --- requests ------------------------------------------------------------------------------------------------------
def _corpus(spark: SparkSession, d: str):
    from storyloom.tools.corpus import Corpus

    return Corpus(corpus.documents(spark, d), table(spark, d, "search_lines"), entities=table(spark, d, "entities"), timelines=table(spark, d, "activity_timelines"), i18n=table(spark, d, "i18n"), i18n_catalog=table(spark, d, "i18n_catalog"))


@query
def request_scope(spark: SparkSession, d: str) -> DataFrame:
    """The documents a request's filters leave."""
    from storyloom.tools import requests, search as tool

    r = requests.search_request({"resource_types": ["operator_record"], "games": ["game_a", "game_b"], "content_types": ["dialogue", "knowledge"]})
    return tool.scope(_corpus(spark, d), r).select("document_id", "game", "resource_type", "content_type")


@query
def request_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The documents a literal request looks at, in order."""
    from storyloom.tools import requests, search as tool

    return tool.candidates(_corpus(spark, d), requests.search_request({"query": WORD})).select("document_id", "ordinal")


@query
def request_matches(spark: SparkSession, d: str) -> DataFrame:
    """The lines a request with context terms matches."""
    from storyloom.tools import requests, search as tool

    c, r = _corpus(spark, d), requests.search_request({"query": WORD, "context_terms": ["storm"]})
    found = tool.matches(c, r, tool.scope(c, r))
    return found.select("document_id", *big("line_number", "start", "score", "low", "high"))


@query
def request_items(spark: SparkSession, d: str) -> DataFrame:
    """What a request for a speaker shows of each document."""
    from storyloom.tools import requests, search as tool

    c, r = _corpus(spark, d), requests.search_request({"speakers": [SPEAKER]})
    return tool.items(c, r, tool.scope(c, r)).select("document_id", "field", "kind", *big("first", "last", "hits", "score", "rank"))


@query
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    """The fixed fields of every document that the table has, the empty text for what is missing."""
    own = ("document_id", "display_title", "document_type", "document_kind", "document_category", "activity_id", "activity_name", "story_code", "part_type", "previous_document_id", "next_document_id", "collection_name", "path")
    described = _corpus(spark, d).described()
    return described.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own if c != "collection_name"])


@query
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a stored index of grams: written once, read by the grams asked for."""
    from storyloom.operators import index

    path = scratch(spark, "index")
    texts = corpus.delivered(spark, d, "text").select("document_id", "text").where(F.length("text") > 0)
    index.build(texts, path, sizes=(3,), form=F.lower("text"))
    return index.documents_with(index.load(spark, path), tx.query_ngrams("crystal"))


@query
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each speaker's grams stand in, and the length of their packed lists."""
    from storyloom.operators import index

    texts = corpus.delivered(spark, d, "speaker_raw").select("document_id", F.col("speaker_raw").alias("text")).where(F.length("text") > 0)
    lists = index.postings(index.grams(texts, F.lower("text"), (2,)))
    return lists.groupBy("gram").agg(F.sum("n").alias("documents"))


@query
def index_key_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Whether the files of an index hold ranges of grams that do not overlap, and all rows."""
    from pyspark.sql import Window as W

    from storyloom.operators import index

    path = scratch(spark, "index")
    texts = corpus.documents(spark, d).select("document_id", F.col("display_title").alias("text")).where(F.length("text") > 0)
    index.build(texts, path, sizes=(3,), form=F.lower("text"), files=4)
    spans = index.key_ranges(index.load(spark, path))
    after = F.lead("first").over(W.orderBy("first"))  # a row for each file
    return spans.withColumn("next", after).agg(F.sum("rows").alias("rows"), F.count_if(F.col("next") <= F.col("last")).alias("overlaps"))


# --- grams ---------------------------------------------------------------------------------------------------------
@query
def gram_postings(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.delivered(spark, d, "text")
    return search.postings(lines, F.lower("text")).groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"))


@query
def gram_division(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.delivered(spark, d, "text")
    return search.candidates(lines, F.lower("text"), WORD)


@query
def gram_union_title(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    titles = r.where(F.lower("display_title").contains("kx-1"))
    return search.candidates(corpus.delivered(spark, d, "text"), F.lower("text"), "crystal", titles, r.where(F.col("game") == "game_a"))


@query
def short_literal_scan(spark: SparkSession, d: str) -> DataFrame:
    return search.candidates(corpus.delivered(spark, d, "text"), F.lower("text"), SHORT)


# --- entities ------------------------------------------------------------------------------------------------------
@query
def phrase_containment(spark: SparkSession, d: str) -> DataFrame:
    phrases = table(spark, d, "canonical_names").where(F.col("field") == "text")
    return entities.containment(table(spark, d, "search_lines").select("line_id", "text"), "line_id", "text", phrases, "name_id", "name")


@query
def longest_span_select(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities")
    names = e.select(F.substring("canonical_name", 1, 2).alias("alias"), F.col("entity_id").alias("canonical")).unionAll(e.select("canonical_name", "entity_id"))
    texts = e.select("entity_id", F.concat_ws("\n", "canonical_name", "description", "history_summary").alias("text"))
    return entities.mentions(texts, "entity_id", "text", names).select("entity_id", "canonical", *big("start", "stop"))


@query
def alias_closure(spark: SparkSession, d: str) -> DataFrame:
    g = entities.alias_groups(table(spark, d, "entities"))
    return g.select("canonical", F.array_join("aliases", "|").alias("aliases"), F.array_join("games", "|").alias("games"))


@query
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    return entities.alias_table(entities.alias_groups(table(spark, d, "entities")))


@query
def relation_hints(spark: SparkSession, d: str) -> DataFrame:
    """Activities that come after one another in the list of agreed names, as relations, found in record titles."""
    n = table(spark, d, "canonical_names").where(F.col("field") == "activity_name")
    pairs = n.select(F.col("name_id").alias("id"), F.col("name").alias("a")).join(n.select((F.col("name_id") - 1).alias("id"), F.col("name").alias("b")), "id")
    return entities.relation_hints(corpus.documents(spark, d).where("activity_name IS NOT NULL"), "document_id", "activity_name", pairs)


@query
def preferred_duplicate(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d).where("display_title IS NOT NULL")
    return read.preferred(r, "display_title", "line_count", "document_id").select("document_id", "display_title", *big("kept"))


# --- functions -----------------------------------------------------------------------------------------------------
@query
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(tx.plain_form(F.col("text"))).alias("form"), F.length(tx.plain_form(F.col("text"))).cast("bigint").alias("n"))


@query
def normalise_compatible(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.normalize(F.col("text")).alias("form"))


@query
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("<color=#fff>"), F.col("text"), F.lit("</color><br/><@x.y>end</>"))
    return table(spark, d, "i18n").select("row_id", tx.strip_markup(marked).alias("bare"))


@query
def stage_code(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    return r.select("document_id", tx.stage_code(F.col("story_code"), compatible=False).alias("code"), tx.stage_code(F.lower("display_title"), relaxed=True, compatible=False).alias("relaxed"))


@query
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    """Ranks within a game in natural order: digits by value."""
    r = corpus.documents(spark, d).select("document_id", "game")
    ranks = search.ranked(r, "game", [tx.natural_key(F.col("document_id")).alias("k"), "document_id"])
    return ranks.select("document_id", "game", (F.col("rank") + 1).cast("bigint").alias("rank"))


@query
def document_uid(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    return r.select("document_id", tx.document_uid(F.col("document_id")).alias("uid"), classify.game(F.lit(None).cast("string"), F.col("document_id")).alias("game"))


@query
def natural_title(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    c = {n: F.col(n) for n in r.columns}
    label = F.when(c["game"] == "game_b", "B").otherwise("A")
    title = classify.story_title(label, c["activity_name"], c["story_code"], F.lit(None).cast("string"), classify.part(c["part_type"]), c["document_category"], c["sequence_index"], c["display_title"])
    return r.select("document_id", title.alias("title"))


@query
def classify_parts(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    segment = classify.record_segment(F.col("document_category"), F.col("document_id"))
    aliases = F.array_join(classify.activity_aliases(F.concat(F.lit("main_"), F.col("sequence_index").cast("string")), F.col("activity_name")), "|")
    return r.select("document_id", classify.part(F.col("part_type")).alias("part"), segment.alias("segment"), aliases.alias("aliases"))


@query
def render_line(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.lines(spark, d, "text", "speaker_raw")
    shown = tx.rendered_line(F.col("line_number"), F.col("speaker_raw"), F.col("text"))
    return t.select("document_id", *big("line_number"), shown.alias("shown"), tx.tokens_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


@query
def escape_clip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", tx.escape(F.col("text")).alias("escaped"), tx.clip(F.col("text"), 40).alias("clipped"))


# --- sections and reading ------------------------------------------------------------------------------------------
@query
def tag_sections(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.text_lines(table(spark, d, "documents").select("doc_id", "text"))
    return sections.sections(lines, TAGS, "doc_id").select("doc_id", "name", *big("start", "stop"))


@query
def section_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.text_lines(table(spark, d, "documents").select("doc_id", "text"))
    found = sections.lines_in(lines, sections.sections(lines, TAGS, "doc_id"), "doc_id")
    return found.select("doc_id", *big("line_number"), "name")


@query
def joined_lines_hash(spark: SparkSession, d: str) -> DataFrame:
    return read.integrity(corpus.lines(spark, d, "text", whole=True))


@query
def read_around(spark: SparkSession, d: str) -> DataFrame:
    anchors = search.anchor_lines(corpus.delivered(spark, d, "text", "line_type"))
    return read.around(corpus.delivered(spark, d).select("document_id", "line_number").distinct(), anchors, 1, 2).select("document_id", *big("line_number"))


@query
def read_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return read.budget_prefix(corpus.lines(spark, d, "text", whole=True), 10, 600).select("document_id", *big("line_number", "running"))


@query
def read_stream_positions(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d).where("activity_id IS NOT NULL")
    s = read.stream(r, "activity_id", ["sequence_index", tx.natural_key(F.col("document_id")), "document_id"])
    return s.select("activity_id", "document_id", *big("ordinal", "first", "last"))


@query
def read_stream_page(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d).where("activity_id IS NOT NULL")
    s = read.stream(r, "activity_id", ["sequence_index", tx.natural_key(F.col("document_id")), "document_id"])
    return read.stream_page(s, "activity_id", 11, 25).select("activity_id", "document_id", *big("start", "stop"))


@query
def read_stream_orders(spark: SparkSession, d: str) -> DataFrame:
    """The stream of a customer's orders with their lines; orders without lines keep their place."""
    counted = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("line_count"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(counted, "o_orderkey", "left")
    return read.stream(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select(*big("o_custkey", "o_orderkey", "ordinal", "first", "last"))


@query
def read_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return read.adjacent(corpus.documents(spark, d)).select("document_id", "previous_status", "next_status", "previous_title", "next_title")


@query
def read_redirect(spark: SparkSession, d: str) -> DataFrame:
    return read.redirect(corpus.documents(spark, d), F.coalesce(F.col("document_kind") == "synopsis", F.lit(False)), ["activity_id", "story_code"])


@query
def lookup_unique(spark: SparkSession, d: str) -> DataFrame:
    return read.lookup(corpus.documents(spark, d), F.col("display_title"))


@query
def ambiguous_groups(spark: SparkSession, d: str) -> DataFrame:
    """Stage codes that more than one activity uses, so a code alone is ambiguous."""
    r = corpus.documents(spark, d).where(F.length("story_code") > 0)
    g = r.groupBy("game", "story_code").agg(F.countDistinct("activity_id").alias("activities"), F.count(F.lit(1)).alias("documents"))
    return g.where("activities > 1")


@query
def hydrate_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents by metadata, then their lines: the filter runs before the join."""
    r = corpus.documents(spark, d).where((F.col("game") == "game_b") & ~classify.is_training(F.col("document_id"))).select("document_id")
    lines = table(spark, d, "search_lines").select("document_id", "line_number", "line_id")
    return corpus.one_delivery(lines.join(r, "document_id", "left_semi")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def pack_order(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    place = classify.rank(F.col("source"), ("story", "record", "profile", "voice", "wiki"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", "n", place.cast("bigint").alias("rank"))


# --- chronology ----------------------------------------------------------------------------------------------------
@query
def timeline_year_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = timeline.events(table(spark, d, "activity_timelines"))
    return timeline.search(e, low=1030, high=1050).select("row_id", "event_pos", "event_id", "year_start", "year_end")


@query
def timeline_parse_time(spark: SparkSession, d: str) -> DataFrame:
    """Labels made from the stream's times, read back as fuzzy time."""
    t = table(spark, d, "events")
    year = (F.col("user_id") % 200 + 1000).cast("int")
    kinds = [
        F.concat(year.cast("string"), F.lit("年 "), F.month("ts").cast("string"), F.lit("月 "), F.dayofmonth("ts").cast("string"), F.lit("日 "), F.date_format("ts", "H:mm")),
        F.concat(F.floor(year / 100).cast("string"), F.lit("世纪 "), (F.col("user_id") % 10 * 10).cast("string"), F.lit("年代")),
        F.concat(F.floor(year / 100).cast("string"), F.lit("世纪")),
        F.concat(year.cast("string"), F.lit(" 年秋 清晨")),
        F.lit("年代不详"),
    ]
    k = (F.col("event_id") % 5).cast("int")
    label = F.element_at(F.array(*kinds), k + 1)
    t = t.select("event_id", label.alias("label")).withColumn("b", fuzzytime.bounds(F.col("label")))
    t = t.withColumn("o", fuzzytime.order_key(F.col("label"), F.col("b.start")))
    return t.select("event_id", "label", *[F.col(f"b.{x}").cast("bigint").alias(x) for x in ("start", "end")], *[F.col(f"o.{x}").cast("bigint").alias(x) for x in ("year", "month", "day", "minute")])


@query
def timeline_merge(spark: SparkSession, d: str) -> DataFrame:
    m = timeline.merge(timeline.events(table(spark, d, "activity_timelines")))
    return m.select("key", "event_id", "time_text", "event", F.array_join("activities", "|").alias("activities"), "deliveries")


@query
def timeline_merge_log(spark: SparkSession, d: str) -> DataFrame:
    """Merging on the event stream: one row for each user and day, its types gathered."""
    t = table(spark, d, "events")
    g = t.groupBy("user_id", F.to_date("ts").cast("string").alias("day"))
    return g.agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("types"), F.count(F.lit(1)).alias("n"))


@query
def timeline_activity_infer(spark: SparkSession, d: str) -> DataFrame:
    """Words that are exactly the name of an activity stand for it."""
    t, words = table(spark, d, "activity_timelines"), "白石渡口 RE-4"
    e = timeline.events(t)
    found = timeline.search(e, words, exact=True) if timeline.names_activity(t, words) else timeline.search(e, words=words)
    return found.select("row_id", "event_pos", "event_id", "activity_name")


@query
def timeline_words(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "activity_timelines")
    e = timeline.with_sources(timeline.events(t), t)
    return timeline.search(e, words="反应堆", names=["波", "莫"]).select("row_id", "event_pos", "event")


@query
def timeline_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Records by the markers of their events: how many rows deliver each."""
    e = timeline.events(table(spark, d, "activity_timelines")).where(F.col("event_id").rlike("^tle_[0-9a-f]{24}$"))
    return e.groupBy("event_id").agg(F.countDistinct("row_id").alias("rows"))


@query
def timeline_marker(spark: SparkSession, d: str) -> DataFrame:
    """The events a marker in a text names."""
    e = timeline.events(table(spark, d, "activity_timelines"))
    return timeline.by_marker(e, "年表出处:tle_0057923ece109afde7761193, tle_011f3d2f73bbbe11c173d960").select("row_id", "event_pos", "event_id")


@query
def timeline_shown_times(spark: SparkSession, d: str) -> DataFrame:
    """The times of events as they are shown."""
    e = timeline.events(table(spark, d, "activity_timelines"))
    shown = fuzzytime.display(F.col("time_text"), F.col("time_section"), F.col("time_year_start").try_cast("int"), F.col("time_year_end").try_cast("int"))
    return e.select("row_id", "event_pos", shown.alias("shown"))


# --- localisation --------------------------------------------------------------------------------------------------
@query
def i18n_exact(spark: SparkSession, d: str) -> DataFrame:
    """Every form with the places and texts of its language it stands at word for word."""
    e = localisation.dictionary(table(spark, d, "i18n")).withColumn("form", tx.plain_form(F.col("text")))
    return e.groupBy("lang", "form").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("text_id").alias("texts"))


@query
def i18n_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The places a sentence stands at word for word."""
    e = localisation.dictionary(table(spark, d, "i18n"))
    return localisation.exact(e, "fenwensil found the dark engine inside the cold store in the ninth month.", tx.plain_form(F.col("text"))).select("text_id", "lang", "text_offset", "row_id")


@query
def i18n_document_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that refer to a line of a document."""
    found = localisation.by_line(table(spark, d, "i18n_catalog"), "official:story:th_127", 5)
    return found.select("text_id", *big("line_start", "line_end"), "field")


@query
def i18n_literal(spark: SparkSession, d: str) -> DataFrame:
    e = localisation.dictionary(table(spark, d, "i18n"))
    return localisation.literal(e, "the engine", F.lower("text")).select("text_id", "lang", "text_offset", "row_id")


@query
def i18n_missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return localisation.missing_ids(table(spark, d, "i18n_catalog"), localisation.dictionary(table(spark, d, "i18n")))


@query
def i18n_align(spark: SparkSession, d: str) -> DataFrame:
    texts = localisation.documents(localisation.dictionary(table(spark, d, "i18n")))
    return localisation.aligned(texts, ["CN", "EN", "DE", "FR"], 100, 200)


@query
def i18n_by_line(spark: SparkSession, d: str) -> DataFrame:
    """How many texts cover each referenced document."""
    r = table(spark, d, "i18n_catalog").select("text_id", F.explode("refs").alias("r"))
    return r.groupBy("r.document_id").agg(F.countDistinct("text_id").alias("texts"), F.min("r.line_start").cast("bigint").alias("first"), F.max("r.line_end").cast("bigint").alias("last"))


@query
def i18n_broken_refs(spark: SparkSession, d: str) -> DataFrame:
    out = localisation.broken_references(table(spark, d, "i18n_catalog"), corpus.documents(spark, d))
    return out.select("text_id", "document_id", *big("line_start", "line_end"))


@query
def i18n_page_fold(spark: SparkSession, d: str) -> DataFrame:
    """A page of a reader: at most 20 texts within a budget of signs."""
    texts = localisation.documents(localisation.dictionary(table(spark, d, "i18n"))).where(F.col("lang") == "CN")
    return localisation.page(texts, 4000, 20).select(*big("ord"), "text_id", *big("shown"))


# --- sessions ------------------------------------------------------------------------------------------------------
def _intervals(spark: SparkSession, d: str) -> DataFrame:
    """The log as read intervals of 1 to 10 lines."""
    t = table(spark, d, "events").withColumn("start", F.get_json_object("props", "$.k").cast("int"))
    return t.select("event_id", "user_id", "event_type", "start", (F.col("start") + F.col("event_id") % 10).cast("int").alias("stop"))


@query
def session_reset(spark: SparkSession, d: str) -> DataFrame:
    s = session.session_sizes(table(spark, d, "events"), "user_id", "ts")
    return s.select("user_id", *big("session", "entries"), F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


@query
def session_query_dedup(spark: SparkSession, d: str) -> DataFrame:
    q = session.first_queries(table(spark, d, "events"), "user_id", F.concat_ws(":", "event_type", "props"), "ts")
    return q.select("user_id", "signature", F.col("first_ts").cast("string").alias("first_ts"), "times")


@query
def coverage_merge(spark: SparkSession, d: str) -> DataFrame:
    return session.merged(_intervals(spark, d), ["user_id"]).select("user_id", *big("start", "stop"))


@query
def coverage_visible(spark: SparkSession, d: str) -> DataFrame:
    """Intervals read in views that the lines of clicks still show."""
    i = _intervals(spark, d)
    stored = session.merged(i.where(F.col("event_id") % 2 == 0), ["user_id"])
    seen = i.where(F.col("event_id") % 2 == 1).select("user_id", F.explode(F.sequence("start", "stop")).alias("line"))
    return session.visible(stored, seen, ["user_id"]).select("user_id", *big("start", "stop"))


@query
def coverage_split(spark: SparkSession, d: str) -> DataFrame:
    """Of the lines asked for at even event_ids, those read at odd ones already, and the new ones."""
    i = _intervals(spark, d)
    out = session.split(i.where(F.col("event_id") % 2 == 0), i.where(F.col("event_id") % 2 == 1), ["user_id"])
    return out.select("user_id", "kind", *big("start", "stop"))


@query
def coverage_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers of documents as runs."""
    lines = corpus.delivered(spark, d, "text").where(F.length(F.trim("text")) > 0)
    return session.ranges(lines, ["document_id"], "line_number").select("document_id", *big("start", "stop"))


@query
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """``session_reset`` as a stream over the same file, run to its end."""
    from storyloom.streaming import sessions as streaming

    log = streaming.read_log(spark, d, "events.parquet", table(spark, d, "events"))
    folder = scratch(spark, "sessions")
    out = streaming.run_once(streaming.session_sizes(log, "user_id", "ts"), folder.rsplit("/", 1)[-1], folder, "complete")
    return out.select("user_id", F.col("w.start").alias("first"), "last", "entries")


# --- snapshots -----------------------------------------------------------------------------------------------------
@query
def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    names = ("search_records", "search_lines", "activity_timelines", "i18n", "i18n_catalog", "read_chunks", "entities", "documents", "canonical_names")
    return snapshot.totals({n: table(spark, d, n) for n in names})


@query
def corpus_status(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.documents(spark, d)
    return r.groupBy("game", "document_type").agg(F.count(F.lit(1)).alias("documents"), F.sum("line_count").cast("bigint").alias("lines"), F.countDistinct("activity_id").alias("activities"))


@query
def corpus_problems(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.problems(corpus.documents(spark, d), corpus.lines(spark, d))


@query
def missing_required(spark: SparkSession, d: str) -> DataFrame:
    """Customers none of whose orders is there."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("custkey"))
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("bigint").alias("custkey"))
    return snapshot.missing(c, o, "custkey")


@query
def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The records, written and read again."""
    back = materialise(corpus.documents(spark, d), "snapshot")
    return back.select("document_id", "display_title", *big("line_count"))


@query
def snapshot_digest(spark: SparkSession, d: str) -> DataFrame:
    """The order-free digest of the records before and after a round trip agree."""
    r = corpus.documents(spark, d)
    a, b = snapshot.row_digest(r), snapshot.row_digest(materialise(r, "digest"))
    return a.join(b.withColumnsRenamed({"digest": "again", "rows": "rows_again"}), F.col("rows") == F.col("rows_again")).select("rows", (F.col("digest") == F.col("again")).cast("bigint").alias("same"))
