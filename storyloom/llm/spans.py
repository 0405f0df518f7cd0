"""Long exact spans shared between records, by prefix-partitioned suffix trees.

A tree over all suffixes of a corpus does not fit anywhere, and most suffixes share nothing. So:

1. Exact copies are folded: only one text of each class goes on.
2. Of each text those suffixes are taken that start at a minimiser: the smallest hash among ``span - k + 1``
   neighbouring k-grams, with k half the span. Any stretch of ``span`` signs holds a whole minimising k-gram, and the
   same one in every record, so nothing is lost and one suffix in about thirty remains.
3. Suffixes whose k-gram stands in one record only are dropped. The others carry ``span`` signs to the right and
   ``span - k`` to the left, enough to decide on ``span`` signs in all; they are cut in the pass that holds the text.
4. They are partitioned by prefixes of variable length, k signs to begin with. A group over the budget is at the top of
   the tree: it parts first at the depth that its first and last suffix in order have in common. Members equal in a
   prefix of that depth, or of the ``STEP`` next ones, that also agree in what is left of ``span`` to the left, share a
   span; beyond, the suffixes go on in groups by their longer prefixes. This ends with groups that fit in memory, or at
   ``span`` signs, after at most ``(span - k) / STEP`` rounds.
5. Of a group within the budget the suffix tree is built (sorted suffixes, their common prefixes, internal nodes from a
   stack), and its deep internal nodes are read from the root down, in the same way.

Records that share a span are known by node membership, not by pairs; a node that only has records which a node above it
holds together is left out, and nodes of the same records count as one. Pairs are only formed where they are asked for.

Defined results: a record without lines or text has the empty text and shares nothing; a null text of a line is empty;
each line_number counts once (of several the smallest line_id), lines without one are left out; repeats within one
record do not count; columns besides those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from storyloom.sources.tables import materialise

SPAN = 120
#: Suffixes of one prefix that one tree may hold; larger groups get longer prefixes.
BUDGET = 2000
#: Depths taken in one round below the place a group over the budget parts at.
STEP = 8
#: Groups over the budget whose depths are broadcast (16 bytes each) to their suffixes; more are joined by shuffle.
MOST_SENT = 50_000
#: Records of a node that are paired in one task.
PAIR_BLOCK = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def record_texts(records: DataFrame, lines: DataFrame) -> DataFrame:
    """(record_id, text): each record's line texts in line_number order, joined by a line feed."""
    lines = lines.where(F.col("line_number").isNotNull() & F.col("document_id").isNotNull())
    one = F.struct("line_number", "line_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = lines.groupBy("document_id").agg(F.array_sort(F.collect_list(one)).alias("l"))
    once = F.expr("filter(l, (x, i) -> i = 0 OR l[i - 1].line_number != x.line_number)")
    whole = whole.select("document_id", F.array_join(F.transform(once, lambda x: x["text"]), "\n").alias("text"))
    joined = records.select("record_id", "document_id").join(whole, "document_id", "left")
    return joined.select("record_id", F.coalesce("text", F.lit("")).alias("text"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, w: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best(x[i : i + w]) for every i at which the window fits, in linear time."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, fill, x.dtype)]).reshape(-1, w)
    forth = best.accumulate(padded, axis=1).ravel()[:n]
    back = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return best(back[: n - w + 1], forth[w - 1 :])


def minimisers(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of every k-gram that is smallest among some w neighbouring ones of its text."""
    coded = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    length = np.array([len(c) for c in coded])
    signs = np.concatenate(coded) if coded else np.empty(0, np.uint32)
    n = len(signs)
    none = np.empty(0, np.int64)
    if n < k + w - 1:
        return none, none, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _BASE))])
        undo = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _BASE_INVERSE))])
        total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(signs.astype(np.uint64) + np.uint64(1)) * power)])
        grams = _mix((total[k:] - total[:-k]) * undo[: n - k + 1]) | np.uint64(1)
    low = _sliding(grams, w, np.minimum, np.iinfo(np.uint64).max)
    owner = np.repeat(np.arange(len(texts)), length)
    low[owner[: len(low)] != owner[w + k - 2 : w + k - 2 + len(low)]] = 0  # windows over two texts
    edge = np.zeros(w - 1, np.uint64)
    reach = _sliding(np.concatenate([edge, low, edge]), w, np.maximum, 0)
    at = np.flatnonzero(reach == grams)
    first = np.cumsum(length) - length
    return owner[at], at - first[owner[at]], grams[at]


def _anchors(texts: DataFrame, k: int, w: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["rep"].to_numpy()
            all_texts = batch["text"].to_pylist()
            start = 0
            while start < len(all_texts):  # bounded pieces of work, whatever the sizes of the texts
                stop, size = start, 0
                while stop < len(all_texts) and (stop == start or size + len(all_texts[stop]) < 2_000_000):
                    size += len(all_texts[stop])
                    stop += 1
                number, pos, h = minimisers(all_texts[start:stop], k, w)
                arrays = [pa.array(h.view(np.int64)), pa.array(ids[start:stop][number]), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "rep", "pos"])
                start = stop

    return texts.select("rep", "text").mapInArrow(run, "h bigint, rep bigint, pos int")


def _common(a: str, b: str) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    low, high = 0, n
    while low < high:  # the longest prefix in common, by halving
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def tree_nodes(rights: list[str], least: int) -> Iterator[tuple[int, list[int]]]:
    """Internal nodes (depth, members) of the suffix tree of ``rights``, of at least that depth, from a stack.

    Equal suffixes form a node of their full length.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    stack: list[tuple[int, int]] = []  # (depth, first place in the order)
    for k in range(1, len(order) + 1):
        lcp = _common(rights[order[k - 1]], rights[order[k]]) if k < len(order) else -1
        first = k - 1
        while stack and stack[-1][0] > lcp:
            depth, first = stack.pop()
            if depth >= least:
                yield depth, order[first:k]
        if lcp >= 0 and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, first))


def group_sets(reps: list[int], lefts: list[str], rights: list[str], span: int, least: int) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """Of one group of suffixes the sets of members that share a span, and (member, signs to the left, to the right).

    The extent of a member is the union over all nodes it is in, which is one stretch, as all of them hold its start.
    """
    sets: list[list[int]] = []
    held: list[set[int]] = [set() for _ in reps]
    before, after = [0] * len(reps), [0] * len(reps)
    for depth, members in sorted(tree_nodes(rights, least), key=lambda n: n[0]):
        need = span - depth
        fit = [m for m in members if len(lefts[m]) >= need]
        if len(fit) < 2 or len({reps[m] for m in fit}) < 2:
            continue
        back = {m: lefts[m][::-1] for m in fit}
        fit.sort(key=back.__getitem__)
        best = dict.fromkeys(fit, 0)
        for step in (1, -1):  # the longest common left with a member of another record stands next to it
            run = fit[::step]
            other, common = None, 0
            for a, b in zip(run, run[1:]):
                c = _common(back[a], back[b])
                if reps[a] != reps[b]:
                    other, common = a, c
                else:
                    common = min(common, c)
                if other is not None:
                    best[b] = max(best[b], common)
        classes: dict[str, list[int]] = {}
        for m in fit:
            classes.setdefault(back[m][:need], []).append(m)
        for own in classes.values():
            if len({reps[m] for m in own}) < 2:
                continue
            for m in own:
                before[m], after[m] = max(before[m], need, best[m]), max(after[m], depth)
            if not set.intersection(*(held[m] for m in own)):  # no node above has all of them
                for m in own:
                    held[m].add(len(sets))
                sets.append(own)
    return sets, [(m, before[m], after[m]) for m in range(len(reps)) if after[m]]


def _suffixes(kept: DataFrame, texts: DataFrame, span: int, k: int) -> DataFrame:
    """(h, rep, pos, l, r): the kept suffixes with what stands to either side, in time proportional to the texts."""
    places = kept.groupBy("rep").agg(F.collect_list(F.struct("h", "pos")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, text, at in zip(batch["rep"].to_pylist(), batch["text"], batch["at"]):
                whole = text.as_py()
                h, pos = at.values.field("h"), at.values.field("pos").to_pylist()
                left = [whole[max(0, p - span + k) : p] for p in pos]
                right = [whole[p : p + span] for p in pos]
                arrays = [h, pa.array([rep] * len(pos), pa.int64()), pa.array(pos, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "rep", "pos", "l", "r"])

    return texts.select("rep", "text").join(places, "rep").mapInArrow(run, "h bigint, rep bigint, pos int, l string, r string")


@F.arrow_udf(IntegerType())
def _depth(first: pa.Array, last: pa.Array) -> pa.Array:
    return pa.array([_common(a, b) for a, b in zip(first.to_pylist(), last.to_pylist())], pa.int32())


def _partition(suffixes: DataFrame, span: int, k: int, budget: int, every: bool) -> tuple[DataFrame, DataFrame | None]:
    """Suffixes (h, rep, pos, l, r) in groups within the budget, and the nodes (node, rep, start) above them.

    ``every`` gives all depths down to where a group parts, which the extents need; for who shares the last one does.
    """
    small, nodes, more = None, None, suffixes.withColumn("from", F.lit(k))
    while True:
        large = more.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > budget).select("h")
        large = materialise(large, "large")
        n = large.count()
        send = F.broadcast if n <= MOST_SENT else lambda df: df
        fit = (more.join(send(large), "h", "left_anti") if n else more).drop("from")
        small = fit if small is None else small.unionByName(fit)
        if not n:
            return small, nodes.distinct() if nodes is not None else None
        rest = more.join(send(large), "h")
        ends = rest.groupBy("h").agg(F.min("r").alias("first"), F.max("r").alias("last"), F.min("rep").alias("a"), F.max("rep").alias("b"))
        ends = ends.where("a < b").select("h", F.least(_depth("first", "last"), F.lit(span)).alias("depth"))
        here = materialise(rest.join(send(ends), "h"), "here")
        depths = F.sequence(F.least("from", "depth") if every else F.col("depth"), F.least(F.lit(span), F.col("depth") + STEP - 1))
        at = here.withColumn("to", F.explode(depths)).withColumn("i", span - F.col("to")).where((F.length("l") >= F.col("i")) & (F.length("r") >= F.col("to")))
        window = F.concat(F.col("l").substr(F.length("l") - F.col("i") + 1, F.col("i")), F.col("r").substr(F.lit(1), F.col("to")))
        at = at.select(F.unhex(F.md5(window.cast("binary"))).alias("node"), "rep", (F.col("pos") - F.col("i")).alias("start"))
        nodes = at if nodes is None else nodes.unionAll(at)
        below = F.col("depth") + STEP
        more = here.where((F.length("r") >= below) & (below <= span))
        more = more.select(F.xxhash64("h", F.col("r").substr(F.lit(1), below)).alias("h"), "rep", "pos", "l", "r", below.alias("from"))


def shared(texts: DataFrame, span: int = SPAN, budget: int = BUDGET, extents: bool = False) -> DataFrame:
    """(node, rep): the records of every node of at least ``span`` signs; or with ``extents`` (rep, start, stop).

    ``texts`` has rep (BIGINT, unique) and text; what a record shares is the union of its extents.
    """
    k = span // 2
    w = span - k + 1
    anchors = materialise(_anchors(texts.where(F.length("text") >= span), k, w), "anchors")
    many = anchors.groupBy("h").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("h")
    suffixes = materialise(_suffixes(anchors.join(many, "h"), texts, span, k), "suffixes")
    small, above = _partition(suffixes, span, k, budget, extents)
    grouped = small.groupBy("h").agg(F.collect_list(F.struct("rep", "pos", "l", "r")).alias("s"))
    schema = "rep bigint, start int, stop int" if extents else "node binary, rep bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a long stretch has many suffixes, and each gives the same records
        for batch in batches:
            out: list[tuple] = []
            if len(seen) > 100_000:
                seen.clear()
            for group in batch["s"]:
                s = group.values
                reps, pos, lefts, rights = (s.field(x).to_pylist() for x in ("rep", "pos", "l", "r"))
                sets, wide = group_sets(reps, lefts, rights, span, k)
                if extents:
                    out += [(reps[m], pos[m] - before, pos[m] + after) for m, before, after in wide]
                else:
                    for own in sets:
                        each = np.unique(np.array([reps[m] for m in own], np.int64))
                        if (name := hashlib.md5(each.tobytes()).digest()) not in seen:
                            seen.add(name)
                            out += [(name, r) for r in each.tolist()]
            cols = list(zip(*out)) or [()] * (3 if extents else 2)
            kinds = (pa.int64(), pa.int32(), pa.int32()) if extents else (pa.binary(), pa.int64())
            names = ["rep", "start", "stop"] if extents else ["node", "rep"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    out = grouped.select("s").mapInArrow(run, schema)
    if above is None:
        return out.distinct()
    if extents:
        several = above.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("node")
        wide = above.join(several, "node", "left_semi").select("rep", "start", (F.col("start") + span).cast("int").alias("stop"))
        return out.unionByName(wide).distinct()
    # nodes of the same records get the same name: a sum of hashes, which is added up before the shuffle
    above = above.select("node", "rep").distinct()
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "rep").cast("decimal(38,0)")).cast("string")
    named = above.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.unhex(F.md5(F.concat_ws(",", part(1), part(2)).cast("binary"))).alias("own"))
    return out.unionByName(above.join(named.where("a < b"), "node").select(F.col("own").alias("node"), "rep")).distinct()


def _folded(records: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts of one record of each class of exact copies (rep, text), and all records (record_id, rep, copies, n_chars)."""
    texts = record_texts(records, lines).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = materialise(texts, "texts")
    classes = texts.groupBy("digest").agg(F.min("record_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = texts.select("record_id", "digest", F.length("text").alias("n_chars")).join(classes, "digest")
    members = materialise(members.select("record_id", "rep", "copies", "n_chars"), "members")
    reps = members.where("record_id = rep").select("rep")
    return texts.select(F.col("record_id").alias("rep"), "text").join(reps, "rep", "left_semi"), members


def found(records: DataFrame, lines: DataFrame, span: int = SPAN, budget: int = BUDGET) -> DataFrame:
    """(record_id_a, record_id_b), smaller id first: records whose texts share at least ``span`` signs verbatim.

    A node of many records is paired in blocks, so that no task has more than a block against all of them.
    """
    texts, members = _folded(records, lines)
    nodes = shared(texts, span, budget)
    belongs = nodes.join(members.select("rep", "record_id"), "rep").select("node", "record_id")
    copies = members.where((F.col("copies") > 1) & (F.col("n_chars") >= span))
    belongs = belongs.unionByName(copies.select(F.col("rep").cast("string").cast("binary").alias("node"), "record_id"))
    belongs = materialise(belongs, "belongs")
    blocks = belongs.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    belongs = belongs.join(blocks, "node")
    a = belongs.select("node", F.pmod(F.xxhash64("record_id"), "blocks").cast("int").alias("block"), F.col("record_id").alias("record_id_a"))
    b = belongs.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("record_id").alias("record_id_b"))
    return a.join(b, ["node", "block"]).where("record_id_a < record_id_b").select("record_id_a", "record_id_b").distinct()


def stretches(records: DataFrame, lines: DataFrame, span: int = SPAN, budget: int = BUDGET) -> DataFrame:
    """(record_id, start_pos, end_pos): the longest stretches of each record that are made up of shared spans.

    A record with an exact copy is one stretch, if it is long enough. Overlapping spans are united; those of one record
    are sorted in one task, as its text was.
    """
    texts, members = _folded(records, lines)
    return _stretches(texts, members, span, budget)


def _stretches(texts: DataFrame, members: DataFrame, span: int, budget: int) -> DataFrame:
    pieces = shared(texts, span, budget, extents=True)
    by = W.partitionBy("rep").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    islands = pieces.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    islands = islands.groupBy("rep", "island").agg(F.min("start").alias("start_pos"), F.max("stop").alias("end_pos"))
    whole = (F.col("copies") > 1) & (F.col("n_chars") >= span)
    parts = members.where(~whole).select("record_id", "rep").join(islands, "rep").select("record_id", *[F.col(c).cast("bigint") for c in ("start_pos", "end_pos")])
    return parts.unionByName(members.where(whole).select("record_id", F.lit(0).cast("bigint").alias("start_pos"), F.col("n_chars").cast("bigint").alias("end_pos")))


def coverage(records: DataFrame, lines: DataFrame, span: int = SPAN, budget: int = BUDGET) -> DataFrame:
    """(record_id, display_title, n_chars, shared_chars): how much of each record's text is shared with another."""
    texts, members = _folded(records, lines)
    sums = _stretches(texts, members, span, budget).groupBy("record_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared"))
    out = members.join(sums, "record_id", "left").join(records.select("record_id", "display_title"), "record_id")
    return out.select("record_id", "display_title", F.col("n_chars").cast("bigint").alias("n_chars"), F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared_chars"))
