"""The corpus tables as the operators read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.sources.tables import table


def one_delivery(lines: DataFrame) -> DataFrame:
    """Each (document_id, line_number) once: of redelivered lines the one with the smallest line_id.

    Lines without a document or number are left out. Partial aggregation runs before the shuffle, so a line delivered
    many times is one row by then.
    """
    keys = ["document_id", "line_number"]
    rest = [c for c in lines.columns if c not in keys]
    one = lines.dropna(subset=keys).groupBy(*keys).agg(F.min_by(F.struct(*rest), "line_id").alias("__one"))
    return one.select(*keys, *[F.col(f"__one.{c}").alias(c) for c in rest]).select(*lines.columns)


def delivered(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Lines as delivered, with the named columns besides document_id, line_number and line_id."""
    own = ["document_id", "line_number", "line_id", *[c for c in columns if c not in ("document_id", "line_number", "line_id")]]
    return table(spark, d, "search_lines").select(*own).dropna(subset=["document_id", "line_number"])


def lines(spark: SparkSession, d: str, *columns: str, where: Column | None = None, whole: bool = False) -> DataFrame:
    """Lines once each, with the named columns besides document_id, line_number and line_id.

    ``where`` is a condition on the content of a line. It runs before the fold, as what is delivered again has the same
    content; so only lines that match are shuffled. With ``whole`` the lines are partitioned by document ahead of the
    fold, which serves whatever is done by document after it, so the text moves once.
    """
    rows = delivered(spark, d, *columns)
    rows = rows if where is None else rows.where(where)
    return one_delivery(rows.repartition("document_id") if whole else rows)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_records")


def text_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_number from 1, text): the lines of whole texts; null texts have none."""
    split = F.split(F.col(text), r"\r\n|\n|\r")
    return documents.where(F.col(text).isNotNull()).select(key, F.posexplode(split).alias("p", "text")).select(key, (F.col("p") + 1).alias("line_number"), "text")
