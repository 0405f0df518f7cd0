"""Chronology search: events by activity, years, words and entities; order and merging of repeated events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.classify import activity_aliases, activity_match
from storyloom.functions.fuzzytime import bounds, label_of, order_key, overlaps
from storyloom.functions.text import search_form
from storyloom.operators.shred import TIMELINE, reconstruct, shred


def events(timelines: DataFrame) -> DataFrame:
    """Events with year bounds and sort key, from the delivered records: unreadable ones have none."""
    leaves = ["event_id", "time.text", "time.year_start", "time.year_end", "time.section", "event"]
    keys = ["row_id", "activity_id", "activity_name"]
    shredded = shred(timelines, "events", TIMELINE, keys, ["events/#", *["events/" + x.replace(".", "/") for x in leaves]])
    flat = reconstruct(shredded, TIMELINE, "events", keys, leaves)
    flat = flat.withColumn("__label", label_of(F.col("time_text"), F.col("time_section")))
    y = bounds(F.col("__label"), F.col("time_year_start").try_cast("int"), F.col("time_year_end").try_cast("int"))
    flat = flat.withColumn("__b", y).withColumns({"year_start": F.col("__b.start"), "year_end": F.col("__b.end")})
    return flat.withColumn("order", order_key(F.col("__label"), F.col("year_start"))).drop("__b", "__label")


def with_sources(found: DataFrame, timelines: DataFrame) -> DataFrame:
    """Events with ``source_texts``, the texts of their sources in order, joined by line feeds."""
    shredded = shred(timelines, "events", TIMELINE, ["row_id"], ["events/#", "events/sources/#", "events/sources/text"])
    flat = reconstruct(shredded, TIMELINE, "events.sources", ["row_id"], ["text"])
    texts = flat.where(F.length("text") > 0).groupBy("row_id", "event_pos").agg(F.array_sort(F.collect_list(F.struct("source_pos", "text"))).alias("s"))
    joined = texts.select("row_id", "event_pos", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("source_texts"))
    return found.join(joined, ["row_id", "event_pos"], "left")


def merge(found: DataFrame, key: Column | None = None) -> DataFrame:
    """Each event once: by event_id, else by label and text in search form; the first in order stays, activities are gathered.

    Order within an event is that of ``order``, row and position.
    """
    plain = lambda c: F.coalesce(search_form(F.col(c)), F.lit(""))
    k = key if key is not None else F.coalesce(F.nullif("event_id", F.lit("")), F.concat_ws("\0", plain("time_text"), plain("event")))
    place = F.struct("order", "row_id", "events_pos" if "events_pos" in found.columns else "event_pos")
    names = F.array_sort(F.collect_set(F.when(F.length("activity_name") > 0, F.col("activity_name"))))
    kept = [c for c in ("event_id", "time_text", "time_section", "time_year_start", "time_year_end", "event", "year_start", "year_end", "order", "activity_name") if c in found.columns]
    grouped = found.withColumn("key", k).groupBy("key").agg(F.min_by(F.struct(*kept), place).alias("e"), names.alias("activities"), F.count(F.lit(1)).alias("deliveries"))
    return grouped.select("key", "e.*", "activities", "deliveries")


def search(
    found: DataFrame, activity: list[str] | str | None = None, words: str | None = None, names: list[str] | None = None, low: int | None = None, high: int | None = None, exact: bool = False
) -> DataFrame:
    """Events by any of several activities, year interval, words and any of several names.

    Words and names are looked for without case in the event, its label and, where ``with_sources`` gave them, the texts
    of its sources. Years are asked first, as they need no text.
    """
    out = found.where(overlaps(F.col("year_start"), F.col("year_end"), low, high)) if low is not None or high is not None else found
    wanted = [activity] if isinstance(activity, str) else activity or []
    if wanted:
        aliases = activity_aliases(F.col("activity_id"), F.col("activity_name"))
        out = out.where(reduce(lambda a, b: a | b, [activity_match(aliases, w, exact) for w in wanted]))
    hay = search_form(F.concat_ws("\n", *[c for c in ("event", "time_text", "source_texts") if c in found.columns]))
    if words or names:
        out = out.withColumn("__hay", hay)
        if words:
            out = out.where(F.contains("__hay", F.lit(words.lower())))
        if names:
            out = out.where(reduce(lambda a, b: a | b, [F.contains("__hay", F.lit(n.lower())) for n in names]))
        out = out.drop("__hay")
    return out


def names_activity(timelines: DataFrame, words: str) -> bool:
    """The words are exactly an alias of some activity: then they mean it and are no text filter."""
    aliases = activity_aliases(F.col("activity_id"), F.col("activity_name"))
    return not timelines.where(activity_match(aliases, words, exact=True)).limit(1).isEmpty()


def by_marker(found: DataFrame, text: str) -> DataFrame:
    """Events whose provenance marker ``tle_`` with 24 hex digits stands in a text."""
    import re

    return found.where(F.col("event_id").isin(re.findall(r"tle_[0-9a-f]{24}", text)))
