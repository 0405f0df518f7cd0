"""Reading sessions: resets after idling, repeated queries, coverage of lines already read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDLE_SECONDS = 6 * 3600
#: Sessions, queries of a session, and documents of a session that are held.
MOST_SESSIONS = 256
MOST_QUERIES = 256
MOST_DOCUMENTS = 96
#: Up to this many lines a stored interval counts as visible only in full, beyond it from this share on.
SHORT_INTERVAL = 8
VISIBLE_PERCENT = 90


def sessions(log: DataFrame, key: str, ts: str, idle: int = IDLE_SECONDS, order: str | None = None) -> DataFrame:
    """``log`` with ``session`` from 1: a new one after more than ``idle`` seconds without an entry of the key."""
    by = W.partitionBy(key).orderBy(ts, *([order] if order else []))
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(by)
    new = F.when(gap <= idle, 0).otherwise(1)
    return log.withColumn("__new", new).withColumn("session", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__new")


def versioned_sessions(log: DataFrame, key: str, ts: str, version: str, idle: int = IDLE_SECONDS) -> DataFrame:
    """As ``sessions``, with a new one also where the data version is another than the last one the key said."""
    by = W.partitionBy(key).orderBy(ts)
    known = F.last(version, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(by)
    new = F.when((gap <= idle) & ~F.coalesce(F.col(version) != known, F.lit(False)), 0).otherwise(1)
    return log.withColumn("__new", new).withColumn("session", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__new")


def live(log: DataFrame, key: str, ts: str, now: object, idle: int = IDLE_SECONDS, most: int = MOST_SESSIONS) -> DataFrame:
    """(key, last) of the sessions still held at a time: those not idle for too long, of these the latest ``most``."""
    last = log.where(F.col(ts) <= F.lit(now)).groupBy(key).agg(F.max(ts).alias("last"))
    age = F.lit(now).cast("timestamp").cast("double") - F.col("last").cast("timestamp").cast("double")
    return last.where(age <= idle).orderBy(F.desc("last"), key).limit(most)


def latest(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """Of each key the latest ``most`` rows, as a store with that many places keeps them."""
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__k") <= most).drop("__k")


def shown_markers(history: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line): the line markers ``L<digits>`` at the start of lines in shown texts, each once."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\W*L(\d{1,9})(?=\s)"), F.lit(1))
    return history.select(key, F.explode(found).alias("line")).select(key, F.col("line").cast("int").alias("line")).distinct()


def session_sizes(log: DataFrame, key: str, ts: str, idle: int = IDLE_SECONDS) -> DataFrame:
    """(key, session, entries, first, last)."""
    s = sessions(log, key, ts, idle)
    return s.groupBy(key, "session").agg(F.count(F.lit(1)).alias("entries"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def first_queries(log: DataFrame, key: str, signature: Column, ts: str) -> DataFrame:
    """Each query of a key once, with when it came first and how often."""
    return log.groupBy(key, signature.alias("signature")).agg(F.min(ts).alias("first_ts"), F.count(F.lit(1)).alias("times"))


def merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, stop): intervals of whole numbers united where they overlap or touch."""
    by = W.partitionBy(*keys).orderBy("start", "stop")
    farthest = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    t = intervals.where("start <= stop").withColumn("__new", F.when(F.col("start") <= farthest + 1, 0).otherwise(1))
    t = t.withColumn("__island", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return t.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__island")


def ranges(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, start, stop): runs of consecutive line numbers."""
    return merged(lines.select(*keys, F.col(line).alias("start"), F.col(line).alias("stop")).distinct(), keys)


def visible(stored: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Stored intervals that are still visible: all lines seen of a short one, most of a long one."""
    unrolled = stored.select(*keys, "start", "stop", F.explode(F.sequence("start", "stop")).alias("__line"))
    marks = seen.select(*keys, F.col("line").alias("__line"), F.lit(1).alias("__seen")).distinct()
    counted = unrolled.join(marks, [*keys, "__line"], "left").groupBy(*keys, "start", "stop").agg(F.count("__seen").alias("__n"))
    size = F.col("stop") - F.col("start") + 1
    enough = F.when(size <= SHORT_INTERVAL, F.col("__n") == size).otherwise(F.col("__n") * 100 >= size * VISIBLE_PERCENT)
    return counted.where(enough).drop("__n")


def split(requested: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, start, stop): the requested lines that are shown already (``reused``) and those that are not (``new``).

    ``shown`` holds intervals that do not overlap, as ``merged`` gives them; work is on interval ends, not lines.
    """
    want = merged(requested, keys)
    have = merged(shown, keys)
    both = want.join(have.withColumnsRenamed({"start": "s", "stop": "e"}), keys, "left")
    reused = both.where("s <= stop AND e >= start").select(*keys, F.lit("reused").alias("kind"), F.greatest("start", "s").alias("start"), F.least("stop", "e").alias("stop"))
    # new: the gaps between what is reused, and before and after it, within each requested interval
    cut = both.where("s <= stop AND e >= start").groupBy(*keys, "start", "stop").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("h"))
    edges = F.concat(F.array(F.struct((F.col("start") - 1).alias("s"), (F.col("start") - 1).alias("e"))), F.col("h"), F.array(F.struct((F.col("stop") + 1).alias("s"), (F.col("stop") + 1).alias("e"))))
    gaps = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda k: F.struct((F.element_at("edges", k)["e"] + 1).alias("start"), (F.element_at("edges", k + 1)["s"] - 1).alias("stop"))),
        lambda g: g["start"] <= g["stop"],
    )
    partly = cut.withColumn("edges", edges).select(*keys, F.explode(gaps).alias("g")).select(*keys, F.lit("new").alias("kind"), "g.start", "g.stop")
    whole = want.join(cut.select(*keys, "start", "stop"), [*keys, "start", "stop"], "left_anti").select(*keys, F.lit("new").alias("kind"), "start", "stop")
    return reused.unionByName(partly).unionByName(whole)
