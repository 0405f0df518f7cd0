"""Structured full-text search over lines: matches, predicates, passages, scores, order and pages.

All steps are DataFrame expressions; a request only chooses among them. Scores are whole thousandths. Every order has
explicit tie breaks. Null texts match nothing; a document without matches has no passage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions.saferegex import safe_pattern
from storyloom.functions.text import ngrams, query_ngrams
from storyloom.sources.tables import materialise

#: Lines between two hits of one passage, passages of a document, literal matches of a document, lines of context.
GAP = 2
PASSAGES = 3
MATCHES = 24
NEAR_LINES = 3
NEAR_SIGNS = 256
#: Documents on a page, documents looked at for one, and signs shown on it.
PAGE = 12
SCAN = 256
PAGE_SIGNS = 12_000


def literal_start(form: Column, query: str) -> Column:
    """Place of the first match from 0, null if there is none; ``form`` and the query are in search form."""
    at = F.instr(form, query) - 1
    return F.when(at >= 0, at)


def regex_match(text: Column, pattern: str) -> tuple[Column, Column]:
    """(place from 0, length) of the first match of a safe pattern, case-sensitive; null if there is none."""
    p = safe_pattern(pattern)
    # the signs before the match, as Spark counts places of patterns in UTF-16 units
    before = F.regexp_extract(text, f"(?s)^(.*?)(?-s:{p})", 1)
    hit = text.rlike(p)
    return F.when(hit, F.length(before)), F.when(hit, F.length(F.regexp_substr(text, F.lit(p))))


def score(start: Column, base: int = 1000, bonus: Column | int = 0) -> Column:
    """Thousandths: the base, less 5 for each sign before the match up to 200, plus a bonus, within 0 and 1000."""
    bonus = F.lit(bonus) if isinstance(bonus, int) else bonus
    return F.greatest(F.lit(0), F.least(F.lit(1000), F.lit(base) - F.least(F.lit(200), F.coalesce(start, F.lit(0)) * 5) + bonus)).cast("int")


def first_matches(hits: DataFrame, most: int = MATCHES) -> DataFrame:
    """The first matches of each document by line."""
    rank = F.row_number().over(W.partitionBy("document_id").orderBy("line_number"))
    return hits.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def passages(hits: DataFrame, most: int = PASSAGES, gap: int = GAP) -> DataFrame:
    """Passages of neighbouring hits: (document_id, first, last, hits, score, rank, cut), and what the hits carry.

    ``hits`` has document_id, line_number, score, and may have ``low`` and ``high``, the lines its context terms
    reach. A hit joins the passage before it if it starts at most ``gap`` lines after the farthest line so far, and is in
    the same ``section`` and ``range`` (names with their first lines), where it has such. The best passages are kept;
    ``cut`` is 1 where there were more. With ``section`` and ``range`` the passage has them too.
    """
    if "low" not in hits.columns:
        hits = hits.withColumns({"low": F.col("line_number"), "high": F.col("line_number")})
    scopes = [c for c in ("section", "range") if c in hits.columns]
    by = W.partitionBy("document_id").orderBy("line_number")
    # the farthest line of the passage so far: lines of passages before it are never beyond its start
    farthest = F.max("high").over(by.rowsBetween(W.unboundedPreceding, -1))
    same = reduce(lambda a, b: a & b, [F.lag(c).over(by).eqNullSafe(F.col(c)) for c in scopes], F.lit(True))
    new = F.when((F.col("low") - farthest <= gap) & same, 0).otherwise(1)
    islands = hits.withColumn("__new", new).withColumn("passage", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    found = islands.groupBy("document_id", "passage").agg(
        F.min_by("low", "line_number").alias("first"), F.max("high").alias("last"), F.count(F.lit(1)).alias("hits"), F.max("score").alias("score"), *[F.first(c).alias(c) for c in scopes]
    )
    best = W.partitionBy("document_id").orderBy(F.desc("score"), "first")
    found = found.withColumn("rank", F.row_number().over(best))
    found = found.withColumn("cut", (F.count(F.lit(1)).over(W.partitionBy("document_id")) > most).cast("int"))
    return found.where(F.col("rank") <= most).drop("passage")


def context_terms(lines: DataFrame, hits: DataFrame, terms: list[str], form: str = "form", reach: int = NEAR_LINES) -> DataFrame:
    """Hits with every term in some line at most ``reach`` away, with ``term_lines``, ``low`` and ``high``.

    Hits that have a ``range`` (start, stop) look for terms within it only.

    Only lines that hold a term are joined, on blocks of ``reach`` + 1 lines, so the join is an equality.
    """
    term_rows = None
    for k, t in enumerate(terms):
        one = lines.where(F.contains(F.col(form), F.lit(t))).select("document_id", F.col("line_number").alias("__line"), F.lit(k).alias("__term"))
        term_rows = one if term_rows is None else term_rows.unionAll(one)
    if term_rows is None:
        return hits.withColumns({"term_lines": F.array().cast("array<int>"), "low": F.col("line_number"), "high": F.col("line_number")})
    size = reach + 1
    block = F.floor(F.col("__line") / size)
    term_rows = term_rows.withColumn("__block", F.explode(F.array(block - 1, block, block + 1)))
    own = hits.withColumn("__block", F.floor(F.col("line_number") / size))
    near = own.join(term_rows, ["document_id", "__block"]).where(F.abs(F.col("__line") - F.col("line_number")) <= reach)
    if "range" in hits.columns:  # within the range of the hit, where it has one
        near = near.where(F.coalesce(F.col("__line").between(F.col("range.start"), F.col("range.stop")), F.lit(True)))
    first = near.groupBy(*hits.columns, "__term").agg(F.min("__line").alias("__line"))
    every = first.groupBy(*hits.columns).agg(F.array_sort(F.collect_set("__line")).alias("term_lines"), F.countDistinct("__term").alias("__n"))
    every = every.where(F.col("__n") == len(set(range(len(terms))))).drop("__n")
    reached = {"low": F.least("line_number", F.array_min("term_lines")), "high": F.greatest("line_number", F.array_max("term_lines"))}
    return every.withColumns(reached)


def positions(text: Column, word: Column) -> Column:
    """All places (from 0) at which a word starts in a text, overlaps included."""
    n = F.length(text) - F.length(word)
    places = F.when((n >= 0) & (F.length(word) > 0), F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substr(text, i + 1, F.length(word)) == word)


def near_hit(text: Column, alias: Column, start: Column, end: Column, reach: int = NEAR_SIGNS) -> Column:
    """The least gap between the hit [start, end) and an occurrence of the alias, null if over ``reach``."""
    gap = lambda i: F.greatest(F.lit(0), i - end, start - (i + F.length(alias)))
    least = F.array_min(F.transform(positions(text, alias), gap))
    return F.when(least <= reach, least)


def useful_aliases(aliases: Column) -> Column:
    """Aliases of one sign are dropped unless there is no longer one."""
    longer = F.filter(aliases, lambda a: F.length(a) > 1)
    return F.when(F.size(longer) > 0, longer).otherwise(F.coalesce(aliases, F.array().cast("array<string>")))


def ranked(df: DataFrame, group: str, order: list, name: str = "rank") -> DataFrame:
    """``df`` with the rank from 0 of each row within its group; no task holds a whole group.

    The rows are range-partitioned by the order and ranked within each range; the sizes of the ranges, one row for each
    range and group, give what comes before. ``order`` must tell all rows apart.
    """
    t = df.withColumn("__order", F.struct(*order))
    # written once, as ranges are sampled anew with every run
    t = materialise(t.repartitionByRange("__order").withColumn("__range", F.spark_partition_id()), "ranked")
    sizes = t.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    by = W.partitionBy(group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # over a row for each range
    before = sizes.select(F.col(group).alias("__g"), "__range", F.coalesce(F.sum("__n").over(by), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy(group, "__range").orderBy("__order")) - 1
    t = t.withColumn("__own", own).withColumnRenamed("__range", "__r")
    out = t.join(F.broadcast(before), (F.col(group).eqNullSafe(F.col("__g"))) & (F.col("__r") == F.col("__range")))
    return out.withColumn(name, F.col("__before") + F.col("__own")).drop("__order", "__r", "__own", "__g", "__range", "__before")


def interleave(documents: DataFrame, group: str, order: list, wanted: list[str]) -> DataFrame:
    """Documents of the wanted groups in turns, each by ``order``; other groups after all. Adds ``ordinal`` from 0.

    The turn is a rank within the group; the ordinal counts whole turns before it from the sizes of the groups, so no
    window runs over all rows.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in wanted]), F.col(group)).cast("int")
    place = F.when(F.coalesce(place, F.lit(0)) == 0, len(wanted) + 1).otherwise(place)
    d = documents.withColumn("__g2", F.when(place > len(wanted), "").otherwise(F.col(group))).withColumn("__p", place)
    d = ranked(d, "__g2", order, "__turn")
    sizes = {r["__g2"]: r["n"] for r in d.groupBy("__g2").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each wanted group
    known = [sizes.get(g, 0) for g in wanted]
    turn, p = F.col("__turn"), F.col("__p")
    before = sum((F.least(turn, F.lit(n)) for n in known), F.lit(0))
    same = sum((F.when((F.lit(k + 1) < p) & (turn < n), 1).otherwise(0) for k, n in enumerate(known)), F.lit(0))
    ordinal = F.when(p > len(wanted), F.lit(sum(known)) + turn).otherwise(before + same)
    return d.withColumn("ordinal", ordinal.cast("bigint")).drop("__g2", "__p", "__turn")


def page(candidates: DataFrame, after: int = -1, documents: int = PAGE, scan: int = SCAN, signs: int = PAGE_SIGNS) -> DataFrame:
    """One page of candidates (ordinal, chars): the longest run after ``after`` within the limits, at least one document.

    Only the ``scan`` next candidates are looked at, found by their ordinals; the page is a prefix of them.
    """
    window = candidates.where((F.col("ordinal") > after) & (F.col("ordinal") <= after + scan))
    by = W.orderBy("ordinal")  # at most ``scan`` rows
    window = window.withColumns({"place": F.row_number().over(by), "running": F.sum("chars").over(by.rowsBetween(W.unboundedPreceding, 0))})
    fits = ((F.col("running") <= signs) | (F.col("place") == 1)) & (F.col("place") <= documents)
    return window.withColumn("__ok", F.min(fits.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0))).where("__ok = 1").drop("__ok")


def excerpts(lines: DataFrame, found: DataFrame, hits: DataFrame, around: int = 1) -> DataFrame:
    """Lines of the passages with ``around`` lines to either side: (document_id, rank, line_number, role, text).

    Lines a passage shows as a hit are ``match``, as a context term of one ``constraint``, others ``context``. Lines
    delivered several times come once, that with the smallest line_id where it is given; they are folded after the join.
    """
    spans = found.select("document_id", "rank", F.explode(F.sequence(F.greatest(F.lit(1), F.col("first") - around), F.col("last") + around)).alias("line_number"))
    marked = hits.select("document_id", "line_number", F.lit(1).alias("__hit")).distinct()
    order = "line_id" if "line_id" in lines.columns else "text"
    own = lines.select("document_id", "line_number", "text", F.col(order).alias("__order"))
    shown = own.join(spans, ["document_id", "line_number"]).groupBy("document_id", "rank", "line_number").agg(F.min_by("text", "__order").alias("text"))
    out = shown.join(marked, ["document_id", "line_number"], "left")
    role = F.when(F.col("__hit") == 1, "match")
    if "term_lines" in hits.columns:
        terms = hits.select("document_id", F.explode("term_lines").alias("line_number"), F.lit(1).alias("__term")).distinct()
        out = out.join(terms, ["document_id", "line_number"], "left")
        role = role.when(F.col("__term") == 1, "constraint")
    return out.select("document_id", "rank", "line_number", role.otherwise("context").alias("role"), "text")


def anchor_lines(lines: DataFrame) -> DataFrame:
    """The line a document is opened at: its first line of dialogue, else its first line with text."""
    shown = lines.where(F.length(F.trim("text")) > 0)
    first = F.min(F.struct((F.coalesce(F.col("line_type"), F.lit("")) != "dialogue").alias("other"), "line_number")).alias("a")
    return shown.groupBy("document_id").agg(first).select("document_id", F.col("a.line_number").alias("line_number"))


# --- grams ---------------------------------------------------------------------------------------------------------
def postings(lines: DataFrame, form: Column, sizes: tuple[int, ...] = (3,)) -> DataFrame:
    """(gram, document_id), each once: the grams of every line."""
    return lines.select("document_id", F.explode(ngrams(form, sizes)).alias("gram")).distinct()


def divide(index: DataFrame, grams: list[str]) -> DataFrame:
    """Documents that hold every gram."""
    wanted = list(dict.fromkeys(grams))
    held = index.where(F.col("gram").isin(wanted)).groupBy("document_id").agg(F.countDistinct("gram").alias("n"))
    return held.where(F.col("n") == len(wanted)).select("document_id")


def candidates(lines: DataFrame, form: Column, query: str, titles: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Documents that may match a literal: by grams from three signs on, by scanning below; with title hits, in scope."""
    if len(query) >= 3:
        grams = query_ngrams(query)
        some = reduce(lambda a, b: a | b, [F.contains(form, F.lit(g)) for g in grams])
        found = divide(postings(lines.where(some), form), grams)  # without a stored index: only lines that hold a gram
    else:
        found = lines.where(F.contains(form, F.lit(query))).select("document_id").distinct()
    if titles is not None:
        found = found.unionByName(titles.select("document_id")).distinct()
    return found if scope is None else found.join(scope.select("document_id"), "document_id", "left_semi")
