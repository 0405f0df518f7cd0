"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import align, mixing, oneform, pieces, sentences, spans, tokens
from storyloom.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _lines(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "search_lines").select(*columns)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence pairs of two languages that render the same statement."""
    return align.found(table(spark, d, "i18n"), table(spark, d, "i18n_catalog"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Stretches without a natural boundary that are over the limit."""
    return pieces.long_stretches(table(spark, d, "read_chunks"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All items in pieces under the limit."""
    return pieces.pieces(table(spark, d, "read_chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that look like an agreed name but are typed otherwise."""
    lines = spread(_lines(spark, d, "line_id", "speaker_raw", "text"))
    return oneform.found(lines, table(spark, d, "activity_timelines").select("row_id", "activity_name"), table(spark, d, "canonical_names"))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    """All values of the three fields in one consistent form."""
    lines = spread(_lines(spark, d, "line_id", "speaker_raw", "text"))
    return oneform.unified(lines, table(spark, d, "activity_timelines").select("row_id", "activity_name"), table(spark, d, "canonical_names"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that share at least 120 signs verbatim."""
    return spans.found(table(spark, d, "search_records"), _lines(spark, d, "document_id", "line_id", "line_number", "text"))


def p5_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each record stands in another one."""
    return spans.coverage(table(spark, d, "search_records"), _lines(spark, d, "document_id", "line_id", "line_number", "text"))


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of each record that stand in another one."""
    return spans.stretches(table(spark, d, "search_records"), _lines(spark, d, "document_id", "line_id", "line_number", "text"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tokens.with_ids(docs, "text"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of every mix."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn for every mix."""
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Places of all sentences."""
    return sentences.found(spread(table(spark, d, "documents").select("doc_id", "text")))


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    """All sentences with their places."""
    return sentences.sentences(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p2_found, p3_found, p3_pieces, p4_found, p4_unified, p5_found, p5_shared, p5_spans, p6_ids, p7_shares, p7_mix, p8_found, p8_sentences)
}

#: The whole texts of items, laid together sign by sign, and where their boundaries are.
_ITEMS = """c AS (SELECT item_id, text_offset, text, unnest(range(0, length(text))) AS k FROM read_chunks WHERE item_id IS NOT NULL AND text_offset >= 0 AND length(text) > 0),
s AS (SELECT item_id, text_offset + k AS pos, max(substr(text, (k + 1)::BIGINT, 1)) AS sign FROM c GROUP BY 1, 2),
n AS (SELECT item_id, max(pos) + 1 AS size FROM s GROUP BY item_id HAVING max(pos) + 1 > 800),
b AS (SELECT item_id, 0 AS place FROM n UNION SELECT item_id, pos + 1 FROM s SEMI JOIN n USING (item_id) WHERE sign IN (' ', chr(9), chr(10), '\u3000', '。', '！', '？', '；') UNION SELECT item_id, size FROM n),
g AS (SELECT item_id, place, lead(place) OVER (PARTITION BY item_id ORDER BY place) - place AS gap FROM b),
l AS (SELECT item_id, place FROM g WHERE gap > 800)"""
#: Texts of records, all their windows of 120 signs, and those that stand in several records.
_WINDOWS = """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, line_number ORDER BY line_id) AS k FROM search_lines WHERE line_number IS NOT NULL) WHERE k = 1),
w AS (SELECT document_id, string_agg(coalesce(text, ''), chr(10) ORDER BY line_number) AS t FROM one GROUP BY document_id),
r AS (SELECT record_id, display_title, coalesce(t, '') AS t FROM search_records LEFT JOIN w USING (document_id)),
i AS (SELECT record_id, t, unnest(range(1, length(t) - 118)) AS i FROM r WHERE length(t) >= 120),
win AS (SELECT record_id, i, md5(substr(t, i::BIGINT, 120)) AS h FROM i),
sh AS (SELECT h FROM win GROUP BY h HAVING count(DISTINCT record_id) > 1),
hit AS (SELECT DISTINCT record_id, i, h FROM win SEMI JOIN sh USING (h)),
far AS (SELECT record_id, i, lag(i) OVER (PARTITION BY record_id ORDER BY i) AS last FROM (SELECT DISTINCT record_id, i FROM hit)),
isl AS (SELECT record_id, i, sum(CASE WHEN i - last <= 120 THEN 0 ELSE 1 END) OVER (PARTITION BY record_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM far),
st AS (SELECT record_id, min(i) - 1 AS start_pos, max(i) + 119 AS end_pos FROM isl GROUP BY record_id, g)"""
ORACLE: dict[str, str] = {
    "p3_found": f"WITH {_ITEMS} SELECT item_id, place::BIGINT AS stretch_offset FROM l UNION ALL SELECT item_id, -1 FROM n ANTI JOIN l USING (item_id)",
    "p5_found": f"WITH {_WINDOWS} SELECT DISTINCT a.record_id AS record_id_a, b.record_id AS record_id_b FROM (SELECT DISTINCT record_id, h FROM hit) a JOIN (SELECT DISTINCT record_id, h FROM hit) b ON a.h = b.h AND a.record_id < b.record_id",
    "p5_spans": f"WITH {_WINDOWS} SELECT record_id, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos FROM st",
    "p5_shared": f"""WITH {_WINDOWS}, q AS (SELECT record_id, sum(end_pos - start_pos) AS n FROM st GROUP BY record_id)
SELECT record_id, display_title, length(t)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars FROM r LEFT JOIN q USING (record_id)""",
}
