"""Splitting long items into pieces under a size limit, at natural boundaries, with an overlap.

An item is put together from its chunks in blocks of bounded size, so no task ever holds more than one block of an
item, however long it is. In each block the text is cut into atomic segments at all natural boundaries; adjacent
segments are merged over a heap, weakest boundary first, while the combined size plus the overlap fits the limit.
Two blocks meet at a natural boundary near the block's edge where there is one.

Defined results
---------------
* positions and sizes are code points; chunks with a null or empty text, null item or null offset carry nothing;
  an item without any text has no row.
* repeated and overlapping chunks are laid over each other; where they differ, the greater text wins.
* positions no chunk covers are read as U+FFFD, which is no boundary.
* an item within the limit comes out as one piece; ``shared`` is 0 for the first piece of an item.
* a stretch without boundary longer than the limit is cut at the limit, as there is no better place.
* columns besides item_id, text_offset and text are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.sources.tables import materialise

LIMIT = 800
OVERLAP = 80
#: Code points of an item in one task, and how far before a block's edge a natural boundary is looked for.
BLOCK = 1 << 16
MARGIN = 1 << 13

#: A natural boundary lies after each of these.
BOUNDARY = re.compile("[ \t\n　。！？；]")
#: Strength of the boundary after a segment, by what it ends with; the first that matches counts.
STRENGTH = (
    (re.compile(r"\n[ \t　\r]*\n$"), 6),
    (re.compile(r"\n$"), 5),
    (re.compile(r"[。！？][”’」』）》]*$|[.!?…][\"'”’»)\]]*[ \t　]$"), 4),
    (re.compile(r"；$|[;:][ ]$"), 3),
    (re.compile(r"[,，、][ ]$|[\t　]$"), 2),
)
WEAKEST = 1


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    shared: int


def lay(parts: list[tuple[int, str]], start: int, end: int) -> str:
    """The text from ``start`` to ``end`` of parts (offset, text) laid over each other."""
    parts = sorted(set(parts))
    out, at = [], start
    for offset, text in parts:
        if offset + len(text) <= at or offset >= end:
            continue
        if offset > at:
            out.append("�" * (offset - at))
            at = offset
        out.append(text[at - offset : end - offset])
        at = min(end, offset + len(text))
    return "".join(out)


def boundaries(text: str) -> list[int]:
    return [m.end() for m in BOUNDARY.finditer(text)]


def stretches(text: str) -> list[tuple[int, int]]:
    """Neighbouring boundaries, or the text's ends, as (start, end); together they are the whole text."""
    cuts = boundaries(text)
    if text and (not cuts or cuts[-1] != len(text)):
        cuts.append(len(text))
    return list(zip([0, *cuts], cuts))


def strength(text: str, end: int) -> int:
    tail = text[max(0, end - 8) : end]
    return next((n for pattern, n in STRENGTH if pattern.search(tail)), WEAKEST)


def merge(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Segments after merging, and the stretches that had to be cut where there is no boundary.

    Adjacent pairs wait in a heap, the weakest boundary first, then the smaller pair. A pair whose combined size plus the
    overlap is over the limit is dropped for good: neither side ever shrinks. Neither does a stretch over the limit, which
    no merging can bring under it, so it is cut before.
    """
    ends: list[int] = []
    starts: list[int] = []
    hard: list[tuple[int, int]] = []
    for a, b in stretches(text):
        if b - a > limit:
            hard.append((a, b))
        while b - a > limit:  # no boundary in reach: cut hard, leaving room for the overlap
            starts.append(a), ends.append(a + limit - overlap)
            a += limit - overlap
        starts.append(a), ends.append(b)
    n, room = len(starts), limit - overlap
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(strength(text, ends[k]), ends[k + 1] - starts[k], k, k + 1) for k in range(n - 1) if ends[k + 1] - starts[k] <= room]
    heapq.heapify(heap)
    while heap:
        power, size, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or ends[b] - starts[a] != size:
            continue
        ends[a], alive[b] = ends[b], False
        right[a] = right[b]
        if right[a] < n:
            left[right[a]] = a
            if (size := ends[right[a]] - starts[a]) <= room:
                heapq.heappush(heap, (strength(text, ends[a]), size, a, right[a]))
        if left[a] >= 0 and (size := ends[a] - starts[left[a]]) <= room:
            heapq.heappush(heap, (strength(text, starts[a]), size, left[a], a))
    return [(starts[k], ends[k]) for k in range(n) if alive[k]], hard


def cut(text: str, before: str = "", limit: int = LIMIT, overlap: int = OVERLAP) -> list[Piece]:
    """Pieces of ``text``; the first one may share signs with ``before``, the text that precedes it.

    A piece's ``start`` counts its shared signs, which are at most ``overlap`` and begin at a natural boundary if one
    lies in that reach.
    """
    whole, base = before + text, len(before)
    segments = [(0, len(text))] if not before and len(text) <= limit else merge(text, limit, overlap)[0]
    out = []
    for a, b in segments:
        a, b = a + base, b + base
        reach = min(overlap, a, limit - (b - a))
        if reach > 0:
            m = BOUNDARY.search(whole, a - reach - 1 if a > reach else 0, a - 1)
            shared = a - m.end() if m else reach
        else:
            shared = 0
        out.append(Piece(a - shared - base, b - base, shared))
    return out


def _regions(parts: list[tuple[int, str]], block: int, size: int, margin: int) -> tuple[int, str, str, bool, bool, bool] | None:
    """Of one block: start of its region, text before it, its text, whether a stretch is cut at its start and end, and
    whether the item goes on."""
    low, edge = block * size, (block + 1) * size
    begin = max(0, low - margin) if block else 0
    text = lay(parts, begin, edge)
    own = low - begin  # signs of the block before

    def last(upto: int) -> tuple[int, bool]:
        found = None
        for m in BOUNDARY.finditer(text, max(0, upto - margin), upto):
            found = m.end()
        return (found, False) if found is not None else (upto, True)

    start, torn = last(own) if block else (0, False)
    full = len(text) == edge - begin
    end, torn_end = last(len(text)) if full else (len(text), False)
    if start >= end:
        return None
    return begin + start, text[:start], text[start:end], torn, torn_end, full


def _blocks(chunks: DataFrame, size: int, margin: int) -> DataFrame:
    """One row for each block of each item with the parts of chunks in it, and in the margin before it."""
    c = chunks.select("item_id", F.col("text_offset").cast("bigint").alias("o"), F.col("text").alias("t"))
    c = c.where("item_id IS NOT NULL AND o >= 0 AND length(t) > 0")
    c = c.withColumn("block", F.explode(F.expr(f"sequence(o div {size}, (o + length(t) - 1 + {margin}) div {size})")))
    low = F.greatest(F.col("o"), F.col("block") * size - margin)
    high = F.least(F.expr("o + length(t)"), (F.col("block") + 1) * size)
    part = F.struct(low.cast("bigint").alias("o"), F.expr("t").substr((low - F.col("o") + 1).cast("int"), (high - low).cast("int")).alias("t"))
    return c.where(high > low).select("item_id", "block", part.alias("p")).groupBy("item_id", "block").agg(F.collect_set("p").alias("parts"))


def _parts(value: pa.Scalar) -> list[tuple[int, str]]:
    return [(p["o"], p["t"]) for p in value.as_py()]


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """(item_id, text_offset, n_chars, shared, text): every item's pieces; reading order is that of text_offset."""
    if not 0 <= overlap < limit < margin <= block:
        raise ValueError("0 <= overlap < limit < margin <= block must hold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, b, parts in zip(batch["item_id"].to_pylist(), batch["block"].to_pylist(), batch["parts"]):
                if (region := _regions(_parts(parts), b, block, margin)) is None:
                    continue
                at, before, text, *_ = region
                whole = before + text
                for p in cut(text, before, limit, overlap):
                    x = whole[len(before) + p.start : len(before) + p.end]
                    rows.append((item, at + p.start, len(x), p.shared, x))
            types = (batch.schema.field("item_id").type, pa.int64(), pa.int32(), pa.int32(), pa.string())
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item_id", "text_offset", "n_chars", "shared", "text"])

    kind = chunks.schema["item_id"].dataType.simpleString()
    return _blocks(chunks, block, margin).mapInArrow(run, f"item_id {kind}, text_offset bigint, n_chars int, shared int, text string")


def long_stretches(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """(item_id, stretch_offset) of the stretches over the limit that ``merge`` had to cut; -1 for items over it without any."""
    if not 0 <= overlap < limit < margin <= block:
        raise ValueError("0 <= overlap < limit < margin <= block must hold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, found = [], []
            for item, b, parts in zip(batch["item_id"].to_pylist(), batch["block"].to_pylist(), batch["parts"]):
                if (region := _regions(_parts(parts), b, block, margin)) is None:
                    continue
                at, _, text, torn, torn_end, more = region
                if at == 0:
                    if len(text) <= limit and not more:
                        continue  # the whole item
                    items.append(item), found.append(-1)
                hard = {a for a, _ in merge(text, limit, overlap)[1]}
                if torn:  # a stretch torn at a block's edge is longer than the margin, and counted where it starts
                    hard.discard(0)
                if torn_end and not (torn and not boundaries(text)):
                    hard.add(([0] + boundaries(text))[-1])
                items += [item] * len(hard)
                found += [at + a for a in sorted(hard)]
            kind = batch.schema.field("item_id").type
            yield pa.RecordBatch.from_arrays([pa.array(items, kind), pa.array(found, pa.int64())], names=["item_id", "stretch_offset"])

    kind = chunks.schema["item_id"].dataType.simpleString()
    rows = materialise(_blocks(chunks, block, margin).mapInArrow(run, f"item_id {kind}, stretch_offset bigint"), "stretches")
    without = rows.groupBy("item_id").agg(F.max("stretch_offset").alias("stretch_offset")).where("stretch_offset = -1")
    return rows.where("stretch_offset >= 0").unionByName(without)
