"""A stored index of grams, and the posting lists of its exchange format.

The index is a Parquet table (gram, document_id, ordinal), sorted by gram over range partitions, so that the minimum and
maximum of each file and row group say where a gram can be: a lookup reads those alone. Grams are ordered by their UTF-8
bytes, which is the order of Spark's strings. ``postings`` gives the same as lists of ascending numbers, ``encode`` and
``decode`` write and read such a list as gaps in variable-length integers.

Defined results: null and empty texts have no grams; a gram of a size the index was not built for is an error, as no
answer could be told from an empty one; rows that are delivered again add nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from storyloom.functions.text import ngrams, search_form
from storyloom.operators.search import divide, ranked

SIZES = (1, 2, 3)


class SizeUnsupported(ValueError):
    """The index has no grams of this size."""


def varint(n: int) -> bytes:
    """A number from 0 on in groups of seven bits, the lowest first."""
    if n < 0:
        raise ValueError("numbers from 0 on")
    out = bytearray()
    while True:
        low, n = n & 0x7F, n >> 7
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, place behind it)."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("the number is cut off or too long")
        byte, at = data[at], at + 1
        n |= (byte & 0x7F) << shift
        if byte < 0x80:
            return n, at
        shift += 7


def encode(numbers: Iterable[int]) -> bytes:
    """Distinct numbers, ascending, as their count and the gaps between them."""
    own = sorted(set(numbers))
    return varint(len(own)) + b"".join(varint(b - a) for a, b in zip([0, *own], own))


def decode(data: bytes) -> list[int]:
    count, at = read_varint(data)
    out, last = [], 0
    for _ in range(count):
        gap, at = read_varint(data, at)
        last += gap
        out.append(last)
    if at != len(data):
        raise ValueError("more bytes than numbers")
    return out


@F.arrow_udf(BinaryType())
def encoded(lists: pa.Array) -> pa.Array:
    return pa.array([None if x is None else encode(x) for x in lists.to_pylist()], pa.binary())


def texts_of(documents: DataFrame, lines: DataFrame, fields: tuple[str, ...] = ("display_title", "activity_name", "story_code")) -> DataFrame:
    """(document_id, text) of all that is indexed: titles, texts and speakers, each for itself."""
    own = [documents.select("document_id", F.col(c).alias("text")) for c in fields if c in documents.columns]
    own += [lines.select("document_id", F.col(c).alias("text")) for c in ("text", "speaker_raw") if c in lines.columns]
    out = own[0]
    for df in own[1:]:
        out = out.unionByName(df)
    return out.where(F.length("text") > 0)


def grams(texts: DataFrame, form: Column | None = None, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(gram, document_id), each once."""
    return texts.select("document_id", F.explode(ngrams(search_form(F.col("text")) if form is None else form, sizes)).alias("gram")).distinct().select("gram", "document_id")


def build(texts: DataFrame, path: str, sizes: tuple[int, ...] = SIZES, form: Column | None = None, files: int | None = None) -> None:
    """Write the index of (document_id, text) to ``path``; its sizes are kept in its folder's name ``sizes=…``."""
    g = grams(texts, form, sizes)
    g = g.repartitionByRange(files, "gram") if files else g.repartitionByRange("gram")
    g.sortWithinPartitions("gram", "document_id").write.mode("overwrite").parquet(f"{path}/sizes={''.join(map(str, sizes))}")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def supported(index: DataFrame) -> tuple[int, ...]:
    """The sizes an index was built for, from its folder."""
    if "sizes" not in index.columns:
        return SIZES
    row = index.select(F.max("sizes").alias("s")).first()
    return tuple(int(c) for c in str(row.s)) if row.s is not None else SIZES


def documents_with(index: DataFrame, wanted: list[str]) -> DataFrame:
    """(document_id) of the documents that hold every gram; the filter on grams reaches the scan."""
    sizes = set(supported(index))
    if missing := sorted({len(g) for g in wanted} - sizes):
        raise SizeUnsupported(f"no grams of {missing} signs")
    return divide(index, wanted)


def key_ranges(index: DataFrame) -> DataFrame:
    """(file, first, last, rows): the span of grams in each file."""
    return index.groupBy(F.input_file_name().alias("file")).agg(F.min("gram").alias("first"), F.max("gram").alias("last"), F.count(F.lit(1)).alias("rows"))


def postings(index: DataFrame) -> DataFrame:
    """(gram, n, block, numbers, packed): ascending document numbers of each gram, in blocks of one range of numbers.

    Documents are numbered from 0 by id. A gram that all documents hold has a list for each block, so none is unbounded.
    """
    ids = index.select("document_id").distinct().withColumn("all", F.lit(0))
    numbered = ranked(ids, "all", ["document_id"], "number").select("document_id", "number")
    own = index.join(numbered, "document_id").withColumn("block", F.floor(F.col("number") / 65_536).cast("int"))
    lists = own.groupBy("gram", "block").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    return lists.select("gram", "block", F.size("numbers").alias("n"), "numbers", encoded("numbers").alias("packed"))
