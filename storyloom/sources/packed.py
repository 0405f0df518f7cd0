"""Packed assets: gzip files whose sizes and hash are stated beforehand, and the JSON lines in them.

Files are read by Spark's binary source, checked and unpacked on the executors, a bounded piece at a time, so a file that
unpacks to more than it states is refused before it fills memory. Gzip can't be split; the lines are spread after it.

Defined results: blank lines are skipped; a line that is no JSON object fails the read (or is dropped and counted, with
``lenient``); an asset that is missing, altered or of another size fails the read with its name.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Limits of one asset.
MOST_PACKED, MOST_PLAIN = 64 << 20, 128 << 20
PIECE = 1 << 16
SHA = re.compile(r"[0-9a-f]{64}")
V = TypeVar("V")


class AssetError(ValueError):
    """An asset is not what its descriptor says."""


def unpack(name: str, data: bytes, packed_size: int, plain_size: int, sha256: str) -> bytes:
    """The plain bytes of an asset that is exactly as stated."""
    if not (0 < packed_size <= MOST_PACKED and 0 < plain_size <= MOST_PLAIN and SHA.fullmatch(sha256 or "")):
        raise AssetError(f"{name}: not a valid descriptor")
    if len(data) != packed_size or hashlib.sha256(data).hexdigest() != sha256:
        raise AssetError(f"{name}: was altered")
    reader, out = zlib.decompressobj(wbits=31), bytearray()
    try:
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            while piece and len(out) <= plain_size:
                out += reader.decompress(piece, plain_size + 1 - len(out))
                piece = reader.unconsumed_tail
    except zlib.error as e:
        raise AssetError(f"{name}: {e}") from e
    if len(out) != plain_size or not reader.eof or reader.unused_data:
        raise AssetError(f"{name}: does not unpack to the stated size")
    return bytes(out)


def lines_of(spark: SparkSession, folder: str, assets: list[dict], lenient: bool = False) -> DataFrame:
    """(asset, row, json): the JSON lines of the assets {path, compressed_size, uncompressed_size, sha256} in ``folder``.

    Only the stated files are read. Paths must stay inside the folder.
    """
    stated = {}
    for a in assets:
        parts = str(a["path"]).split("/")
        if any(p in ("", ".", "..") for p in parts) or "\\" in a["path"]:
            raise AssetError(f"{a['path']}: leads out of the folder")
        stated[a["path"]] = (int(a["compressed_size"]), int(a["uncompressed_size"]), a["sha256"])
    if not stated:
        return spark.createDataFrame([], "asset string, row bigint, json string")
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").load([f"{root}/{p}" for p in stated])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"]):
                name = next(p for p in stated if path.endswith("/" + p))
                plain = unpack(name, data.as_py(), *stated[name])
                rows, texts = [], []
                for k, line in enumerate(plain.split(b"\n")):
                    if not (line := line.strip()):
                        continue
                    text = line.decode("utf-8", "replace" if lenient else "strict")
                    if not text.startswith(("{", "[")):
                        if lenient:
                            continue
                        raise AssetError(f"{name}: line {k + 1} is no record")
                    rows.append(k), texts.append(text)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.int64()), pa.array(texts, pa.string())], names=["asset", "row", "json"])

    return files.select("path", "content").repartition(len(stated)).mapInArrow(run, "asset string, row bigint, json string")


def records(spark: SparkSession, folder: str, assets: list[dict], schema: str | StructType, lenient: bool = False) -> DataFrame:
    """The records of packed JSON lines, by a stated schema; (asset, row) tell where each stood."""
    lines = lines_of(spark, folder, assets, lenient)
    read = F.from_json("json", schema, {"mode": "PERMISSIVE" if lenient else "FAILFAST"})
    return lines.select("asset", "row", read.alias("r")).select("asset", "row", "r.*")


def dictionary_rows(spark: SparkSession, folder: str, language: str, asset: dict) -> DataFrame:
    """(lang, text_id, text) of a language's packed dictionary, whose lines are pairs."""
    pairs = lines_of(spark, folder, [asset]).select(F.from_json("json", "array<string>", {"mode": "FAILFAST"}).alias("p"))
    bad = F.raise_error(F.lit(f"{asset['path']}: a row is no pair of texts"))
    return pairs.select(F.lit(language).alias("lang"), F.when(F.size("p") == 2, F.col("p")[0]).otherwise(bad).alias("text_id"), F.col("p")[1].alias("text"))


def text_rows(lines: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """Records that stand as JSON in the lines of a document; lines that are none, or lack ``events``, are skipped."""
    read = lines.withColumn("__r", F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    return read.where("__r.events IS NOT NULL").select(*[c for c in lines.columns if c != text], "__r.*")


class Cache:
    """The latest values by key, within a number of entries and of bytes; for decoded assets of one process.

    A value larger than all the room is handed out and not kept.
    """

    def __init__(self, entries: int = 24, room: int = 64 << 20, size: Callable[[object], int] = len):
        self.entries, self.room, self.size = entries, room, size
        self.held: OrderedDict[object, tuple[object, int]] = OrderedDict()
        self.used = self.hits = self.misses = 0

    def get(self, key: object, make: Callable[[], V]) -> V:
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][0]
        self.misses += 1
        value = make()
        n = self.size(value)
        if n <= self.room:
            self.held[key] = (value, n)
            self.used += n
            while self.used > self.room or len(self.held) > self.entries:
                self.used -= self.held.popitem(last=False)[1][1]
        return value

    def stats(self) -> dict[str, int]:
        return {"entries": len(self.held), "bytes": self.used, "hits": self.hits, "misses": self.misses}
