"""Reading documents and ordered collections: selection, budgets, streams, neighbours, integrity, unique lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_LINES = 500
MOST_SIGNS = 100_000


def around(lines: DataFrame, at: DataFrame, before: int, after: int) -> DataFrame:
    """Lines of each document from ``before`` lines before to ``after`` lines after the line ``at`` names for it."""
    spans = at.select("document_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_number") - before), F.col("line_number") + after)).alias("line_number")).distinct()
    return lines.join(spans, ["document_id", "line_number"], "left_semi")


def budget_prefix(lines: DataFrame, most_lines: int, most_signs: int, size: Column | None = None) -> DataFrame:
    """The longest prefix of every document within both budgets, with ``running`` signs.

    The first line over the budget stops the read, even if a later one would fit.
    """
    by = W.partitionBy("document_id").orderBy("line_number").rowsBetween(W.unboundedPreceding, 0)
    size = F.length(F.coalesce("text", F.lit(""))) if size is None else size
    t = lines.withColumns({"running": F.sum(size).over(by), "__n": F.count(F.lit(1)).over(by)})
    # sizes are not negative, so the running sum never falls and the filter keeps a prefix
    return t.where((F.col("running") <= most_signs) & (F.col("__n") <= most_lines)).drop("__n")


def stream(documents: DataFrame, collection: str, order: list, count: str = "line_count") -> DataFrame:
    """Documents of each collection with the stream positions of their lines: (first, last) from 1; empty ones have last < first."""
    by = W.partitionBy(collection).orderBy(*order)
    before = F.coalesce(F.sum(count).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return documents.withColumns({"ordinal": F.row_number().over(by) - 1, "first": before + 1, "last": before + F.coalesce(F.col(count), F.lit(0))})


def stream_page(streamed: DataFrame, collection: str, position: int, most: int) -> DataFrame:
    """The parts of documents on a page of ``most`` lines from ``position`` on: (…, start, stop) within the document."""
    end = position + most - 1
    on = streamed.where((F.col("last") >= position) & (F.col("first") <= end) & (F.col("last") >= F.col("first")))
    start = F.greatest(F.lit(position), "first") - F.col("first") + 1
    stop = F.least(F.lit(end), "last") - F.col("first") + 1
    return on.withColumns({"start": start, "stop": stop})


def adjacent(documents: DataFrame, previous: str = "previous_document_id", following: str = "next_document_id") -> DataFrame:
    """Each document with whether the neighbours it names are there: null link, dangling link, or their title."""
    titles = documents.select(F.col("document_id").alias("__id"), F.col("display_title").alias("__title"))
    out = documents.select("document_id", previous, following)
    for link, name in ((previous, "previous"), (following, "next")):
        out = out.join(titles.withColumnsRenamed({"__id": link, "__title": f"{name}_title"}).withColumn(f"__{name}", F.lit(1)), link, "left")
        status = F.when(F.col(link).isNull(), "none").when(F.col(f"__{name}") == 1, "there").otherwise("dangling")
        out = out.withColumn(f"{name}_status", status).drop(f"__{name}")
    return out


def redirect(documents: DataFrame, is_short: Column, key: list[str]) -> DataFrame:
    """Short forms lead to the full story of the same key, the smallest id if there are several; others to themselves."""
    full = documents.where(~is_short).groupBy(*key).agg(F.min("document_id").alias("__full"))
    short = documents.withColumn("__short", is_short).join(full, key, "left")
    return short.select("document_id", F.when(F.col("__short"), F.coalesce("__full", "document_id")).otherwise(F.col("document_id")).alias("target"))


def lookup(documents: DataFrame, name: Column) -> DataFrame:
    """Names with how many documents bear them and, where it is one, its id; null and empty names are left out."""
    named = documents.select(name.alias("name"), "document_id").where(F.length("name") > 0)
    out = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id"))
    return out.withColumn("document_id", F.when(F.col("n") == 1, F.col("document_id")))


def preferred(documents: DataFrame, name: str, richness: str, key: str) -> DataFrame:
    """Of documents of one name the richest, smallest key on ties; ``kept`` marks it."""
    best = F.row_number().over(W.partitionBy(name).orderBy(F.desc(richness), key))
    return documents.withColumn("kept", (best == 1).cast("int"))


def joined(lines: DataFrame) -> DataFrame:
    """(document_id, n, text): all lines of a document joined by line feeds; null texts are empty."""
    ordered = F.array_sort(F.collect_list(F.struct("line_number", F.coalesce("text", F.lit("")).alias("text"))))
    whole = lines.groupBy("document_id").agg(ordered.alias("l"))
    return whole.select("document_id", F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def integrity(lines: DataFrame) -> DataFrame:
    """(document_id, sha256) of the joined lines."""
    return joined(lines).select("document_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def verify(lines: DataFrame, stated: DataFrame) -> DataFrame:
    """Documents whose lines do not give the stated sha256, or that have no lines; none is the good result."""
    return stated.join(integrity(lines).withColumnRenamed("sha256", "found"), "document_id", "left").where("found IS NULL OR found != sha256")
