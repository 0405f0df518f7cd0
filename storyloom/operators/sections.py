"""Tagged sections of documents as line intervals, and lines within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A section of this name ends only at its own closing tag.
CONTAINER = "所有相关的活动剧情总结"


def sections(lines: DataFrame, names: list[str] | tuple[str, ...], key: str = "document_id", container: str = CONTAINER) -> DataFrame:
    """(key, name, start, stop): lines strictly between an opening tag alone on its line and what ends it.

    A section ends at its own closing tag, at the next known opening tag or at any closing tag; the container only at
    its own; one that nothing ends runs to the last line. Empty sections are dropped.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    opened = F.regexp_extract(text, "^<([^/<>][^<>]*)>$", 1)
    closed = F.regexp_extract(text, "^</([^<>]+)>$", 1)
    t = lines.select(key, "line_number", F.nullif(opened, F.lit("")).alias("opened"), F.nullif(closed, F.lit("")).alias("closed"))
    t = t.withColumn("opened", F.when(F.col("opened").isin(list(names)), F.col("opened")))
    last = lines.groupBy(key).agg(F.max("line_number").alias("__last"))
    t = t.where("opened IS NOT NULL OR closed IS NOT NULL")  # the windows see tag lines only
    after = W.partitionBy(key).orderBy("line_number").rowsBetween(1, W.unboundedFollowing)
    # the container's own closing tag is the next one of that name
    own = F.min(F.when(F.col("closed") == container, F.col("line_number"))).over(after)
    following = F.min("line_number").over(after)
    t = t.withColumn("__end", F.when(F.col("opened") == container, own).otherwise(following)).where("opened IS NOT NULL")
    t = t.join(last, key)
    out = t.select(key, F.col("opened").alias("name"), (F.col("line_number") + 1).alias("start"), (F.coalesce(F.col("__end") - 1, "__last")).alias("stop"))
    return out.where("start <= stop")


def lines_in(lines: DataFrame, intervals: DataFrame, key: str = "document_id") -> DataFrame:
    """Each line with the smallest interval it lies in: (key, line_number, name). Intervals are unrolled, not crossed."""
    rolled = intervals.select(key, "name", "start", "stop", F.explode(F.sequence("start", "stop")).alias("line_number"))
    least = rolled.groupBy(key, "line_number").agg(F.min(F.struct((F.col("stop") - F.col("start")).alias("size"), F.col("start"), F.col("name"))).alias("s"))
    return lines.select(key, "line_number").join(least, [key, "line_number"]).select(key, "line_number", F.col("s.name").alias("name"))


def intersect(a: DataFrame, b: DataFrame, key: str = "document_id") -> DataFrame:
    """Overlaps of two sets of intervals within a document."""
    x = a.select(key, F.col("name").alias("name_a"), F.col("start").alias("s1"), F.col("stop").alias("e1"))
    y = b.select(key, F.col("name").alias("name_b"), F.col("start").alias("s2"), F.col("stop").alias("e2"))
    both = x.join(y, key).select(key, "name_a", "name_b", F.greatest("s1", "s2").alias("start"), F.least("e1", "e2").alias("stop"))
    return both.where("start <= stop")


#: A line that opens the part of an activity in a shared document, and the lines that close one.
ACTIVITY_OPENS = r"^<活动名称>\s*(.+?)\s*</活动名称>$"
ACTIVITY_ENDS_WITH, ACTIVITY_ENDS_BEFORE = "</相关内容>", "</所有相关的活动剧情总结>"


def activity_ranges(lines: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, name, start, stop): the lines of each activity in documents that hold several.

    A range starts at the line that names the activity. It ends before the next such line or the end of the container,
    with the end of its own content, or at the last line. The windows see marker lines only.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    name = F.nullif(F.trim(F.regexp_extract(text, ACTIVITY_OPENS, 1)), F.lit(""))
    ends = F.when(text == ACTIVITY_ENDS_WITH, F.col("line_number")).when((text == ACTIVITY_ENDS_BEFORE) | name.isNotNull(), F.col("line_number") - 1)
    t = lines.select(key, "line_number", name.alias("name"), ends.alias("__end")).where("__end IS NOT NULL")
    nearest = F.first("__end").over(W.partitionBy(key).orderBy("line_number").rowsBetween(1, W.unboundedFollowing))
    last = lines.groupBy(key).agg(F.max("line_number").alias("__last"))
    out = t.withColumn("__stop", nearest).where("name IS NOT NULL").join(last, key)
    return out.select(key, "name", F.col("line_number").alias("start"), F.coalesce("__stop", "__last").alias("stop")).where("start <= stop")
