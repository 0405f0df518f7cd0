"""Localised texts: dictionaries by language, lookup by text, aligned projections and their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import chunk, language


def dictionary(i18n: DataFrame) -> DataFrame:
    """(text_id, lang, text_offset, row_id, text): each sentence once, the smallest row_id of equal places.

    Rows with a null in any of these are left out.
    """
    rows = i18n.select("text_id", language(F.col("lang")).alias("lang"), "text_offset", "row_id", "text").dropna()
    one = rows.groupBy("text_id", "lang", "text_offset").agg(F.min("row_id").alias("row_id"), F.min_by("text", "row_id").alias("text"))
    return one


def documents(entries: DataFrame, joint: str = " ") -> DataFrame:
    """(text_id, lang, n, text): whole texts per language, sentences in order."""
    ordered = F.array_sort(F.collect_list(F.struct("text_offset", "row_id", "text")))
    whole = entries.groupBy("text_id", "lang").agg(ordered.alias("l"))
    return whole.select("text_id", "lang", F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: F.coalesce(x["text"], F.lit(""))), joint).alias("text"))


def exact(entries: DataFrame, words: str, form: Column) -> DataFrame:
    """Entries whose form is the words."""
    return entries.where(form == words)


def literal(entries: DataFrame, words: str, form: Column) -> DataFrame:
    """Entries whose form holds the words."""
    return entries.where(F.contains(form, F.lit(words)))


def missing_ids(catalogue: DataFrame, entries: DataFrame) -> DataFrame:
    """(text_id, lang) the catalogue lists and the dictionary lacks."""
    listed = catalogue.select("text_id", F.explode("languages").alias("l")).select("text_id", language(F.col("l")).alias("lang")).distinct()
    return listed.join(entries.select("text_id", "lang").distinct(), ["text_id", "lang"], "left_anti")


def aligned(texts: DataFrame, languages: list[str], offset: int = 0, width: int = 200) -> DataFrame:
    """(text_id, and per language its status and a window of its text): one aggregation, no join per language."""
    out = texts.groupBy("text_id").agg(*[F.min(F.when(F.col("lang") == x, F.col("text"))).alias(x) for x in languages])
    cols: list[Column] = [F.col("text_id")]
    for x in languages:
        c = chunk(F.col(x), offset, width)
        cols += [c["status"].alias(f"{x.lower()}_status"), c["text"].alias(f"{x.lower()}_text")]
    return out.select(*cols)


def by_line(catalogue: DataFrame, document_id: str, line: int | None = None) -> DataFrame:
    """text_ids whose references cover a document, or one line of it, in order of the reference."""
    r = catalogue.select("text_id", F.explode("refs").alias("r")).where(F.col("r.document_id") == document_id)
    if line is not None:
        r = r.where((F.col("r.line_start") <= line) & (F.col("r.line_end") >= line))
    return r.select("text_id", "r.line_start", "r.line_end", "r.field").orderBy("line_start", "field", "text_id")


def broken_references(catalogue: DataFrame, records: DataFrame) -> DataFrame:
    """References to documents that are not there or to lines beyond their end; none is the good result."""
    r = catalogue.select("text_id", F.explode("refs").alias("r")).select("text_id", "r.document_id", "r.line_start", "r.line_end")
    r = r.join(records.select("document_id", "line_count"), "document_id", "left")
    return r.where("line_count IS NULL OR line_start < 1 OR line_end < line_start OR line_end > line_count").select("text_id", "document_id", "line_start", "line_end")


def page(texts: DataFrame, budget: int, most: int, languages: int = 1) -> DataFrame:
    """The records of a page: each may show budget // (languages + 1) of what is left; stops at a text that is longer.

    The fold runs over at most ``most`` records, gathered in order of text_id.
    """
    head = texts.orderBy("text_id").limit(most)
    rows = head.groupBy().agg(F.array_sort(F.collect_list(F.struct("text_id", F.length("text").alias("n")))).alias("r"))
    start = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("stopped"), F.array().cast("array<struct<text_id:string,shown:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        width = F.floor(acc["left"] / (languages + 1)).cast("int")
        shown = F.least(width, x["n"])
        halt = acc["stopped"] | (acc["left"] < 100)
        item = F.struct(x["text_id"].alias("text_id"), shown.alias("shown"))
        return F.when(halt, F.struct(acc["left"].alias("left"), F.lit(True).alias("stopped"), acc["out"].alias("out"))).otherwise(
            F.struct((acc["left"] - shown).alias("left"), (x["n"] > width).alias("stopped"), F.array_append(acc["out"], item).alias("out"))
        )

    folded = rows.select(F.aggregate("r", start, step, lambda a: a["out"]).alias("o"))
    return folded.select(F.posexplode("o").alias("ord", "o")).select((F.col("ord") + 1).alias("ord"), "o.text_id", "o.shown")


