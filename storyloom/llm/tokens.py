"""Encoding with a public byte-level BPE vocabulary through a sentencepiece model made from it.

The model is serialised directly from the vocabulary: every token becomes a piece whose bytes are written as one
visible sign each, its score is the negative rank, so the merges come in the order of the ranks; normalisation is
the identity. A text is cut into pre-tokens by the vocabulary's pattern, each pre-token is byte-mapped and encoded;
``decode`` inverts the mapping. No special tokens are recognised or added.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; a text of any
length is encoded whole; repeated rows are encoded each for itself; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies are; a parameter of every function here.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-token pattern of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens a worker remembers; bounds its memory, not the result.
REMEMBER = 300_000
#: Signs encoded in one turn.
TURN = 1_000_000


def byte_signs() -> list[str]:
    """One visible sign for each byte: itself if it prints in Latin-1, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _float(field: int, x: float) -> bytes:
    import struct

    return _varint(field << 3 | 5) + struct.pack("<f", x)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a ``.tiktoken`` file by rank."""
    with open(path, "rb") as f:
        rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError(f"{path}: ranks are not 0, 1, 2 and so on")
    return [t for _, t in rows]


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; ids are the ranks, the unknown piece has the next free id."""
    signs = byte_signs()
    pieces = b""
    for rank, token in enumerate(tokens):
        text = "".join(signs[b] for b in token).encode()
        pieces += _block(1, _block(1, text) + _float(2, -float(rank)) + _number(3, 1))
    pieces += _block(1, _block(1, b"<unk>") + _float(2, 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(k, -1) for k in (41, 42, 43))
    normal = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + _block(2, trainer) + _block(3, normal)


class Encoder:
    """A loaded model with its pre-token pattern; ``encode`` and ``decode`` are inverse for valid texts."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pre = regex.compile(PATTERN).findall
        signs = byte_signs()
        self.to_signs = {b: s for b, s in enumerate(signs)}
        self.to_byte = {s: b for b, s in enumerate(signs)}
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of several texts; the model is called once for all their new pre-tokens, as each call is dear."""
        known, cut = self.known, [self.pre(t) if t else () for t in texts]
        new = {w for words in cut for w in words if w not in known}
        if len(known) + len(new) > REMEMBER:
            known.clear()
            new = {w for words in cut for w in words}
        if new:
            order = list(new)
            mapped = [w.encode("utf-8").decode("latin-1").translate(self.to_signs) for w in order]
            known.update(zip(order, self.model.encode(mapped, num_threads=1)))
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]

    def in_turns(self, texts: list[str | None], most: int = TURN) -> Iterator[list[list[int]]]:
        """``encode_many`` in turns of about ``most`` signs, so that long texts do not add up in memory."""
        start, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t) if t else 0
            if size >= most or k + 1 == len(texts):
                yield self.encode_many(texts[start : k + 1])
                start, size = k + 1, 0

    def decode(self, ids: list[int]) -> str:
        signs = "".join(self.model.id_to_piece(i) for i in ids)
        return bytes(self.to_byte[s] for s in signs).decode("utf-8")


_encoders: dict[int, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """The worker's encoder of this model, loaded once."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encoder(name: str = "byte_bpe_50k", path: str = TOKENIZERS) -> Encoder:
    return _encoder(model_bytes(read_ranks(f"{path}/{name}.tiktoken")))


def _model(spark: SparkSession, name: str, path: str):
    """The model as a broadcast variable; its size (about 1 MB) depends on the vocabulary alone."""
    return spark.sparkContext.broadcast(model_bytes(read_ranks(f"{path}/{name}.tiktoken")))


def with_ids(df: DataFrame, text: str, out: str = "ids", name: str = "byte_bpe_50k", path: str = TOKENIZERS) -> Column:
    """A column with the token ids of the column ``text``, for use on ``df``."""
    model = _model(df.sparkSession, name, path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(model.value)
        for texts in batches:
            turns = [pa.array(x, pa.list_(pa.int32())) for x in encoder.in_turns(texts.to_pylist())]
            yield pa.concat_arrays(turns) if turns else pa.array([], pa.list_(pa.int32()))

    return ids(F.col(text)).alias(out)


def token_counts(df: DataFrame, text: str, out: str = "tokens", name: str = "byte_bpe_50k", path: str = TOKENIZERS) -> Column:
    """As ``with_ids``, but only the number of ids; they are not carried on."""
    model = _model(df.sparkSession, name, path)

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(model.value)
        for texts in batches:
            yield pa.array([len(x) for turn in encoder.in_turns(texts.to_pylist()) for x in turn], pa.int64())

    return count(F.col(text)).alias(out)
