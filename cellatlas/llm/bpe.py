"""Byte-level BPE by a sentencepiece model that is serialised straight from a vocabulary of ranks.

Each byte becomes one character, so a piece is a string of such characters; its score is its rank, negated, and
sentencepiece merges what has the highest score first: the merges that the ranks stand for. Ids are the ranks. The
unknown piece, which the format asks for, stands behind them all and can't occur, as all 256 bytes are pieces.

A pre-token that is an entry of the vocabulary is one piece, the entry itself: its id is read from the ranks, without
the model, which gives the same for each of the entries (tested for all). All others go through the model.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import appended, documents, slices, texts

RANKS = "byte_bpe_50k.tiktoken"
_PRETOKENS, _CHUNKS = 1 << 16, 1 << 18  # in each half


class _Spaces(Exception):
    """White space meets a space."""


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next ones from 256 on."""
    out, n = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, _, rank = line.partition(b" ")
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: the ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def serialised(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces with scores, a BPE trainer spec, an identity normaliser."""
    char = byte_characters()
    pieces = [_field(1, _field(1, "".join(map(char.__getitem__, t)).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)))
    normaliser = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join([*pieces, unknown, trainer, normaliser])


class Recent(dict):
    """What was met lately: when it is full it becomes the older half, and what is met again comes over from there."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def again(self, key: str) -> bytes | None:
        x = self.older.get(key)
        if x is not None:
            self.put(key, x)
        return x

    def put(self, key: str, x: bytes) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) < 64:
            self[key] = x


class Codec:
    """Encodes and decodes texts; keeps the ids of pre-tokens it has met, within a bound."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialised(self.tokens))
        self.split = regex.compile(pattern).findall
        self.space = regex.compile(r"\s").match
        self.chars = [byte_characters()[b] for b in range(256)]
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.met, self.met_chunks = Recent(_PRETOKENS), Recent(_CHUNKS)
        back = {c: bytes([b]) for b, c in enumerate(self.chars)}
        self.pieces = [b"".join(back[c] for c in self.model.IdToPiece(i)) for i in range(len(self.tokens))]

    def pretoken(self, word: str) -> bytes:
        if (ids := self.met.again(word)) is not None:
            return ids
        raw = word.encode("utf-8")
        ids = self.whole.get(raw)
        if ids is None:
            ids = np.asarray(self.model.EncodeAsIds("".join(map(self.chars.__getitem__, raw))), "<u4").tobytes()
        self.met.put(word, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        met, new = self.met_chunks, self.chunk
        try:
            return b"".join([self.pretokens(first) if first or not rest else new(first), *[met.get(x) or new(x) for x in rest]])
        except _Spaces:
            return self.pretokens(text)

    def pretokens(self, text: str) -> bytes:
        met, new = self.met, self.pretoken
        return b"".join([met.get(w) or new(w) for w in self.split(text)])

    def chunk(self, chunk: str) -> bytes:
        """What follows a space, up to the next one: no match spans its ends, unless white space meets the space there."""
        if not chunk or self.space(chunk[0]) or self.space(chunk[-1]):
            raise _Spaces
        ids = self.met_chunks.again(chunk)
        if ids is None:
            ids = self.pretokens(f" {chunk}")
            self.met_chunks.put(chunk, ids)
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(path: str, known: dict[str, Codec] = {}) -> Codec:  # noqa: B006  one for each worker process
    if path not in known:
        known[path] = Codec(path)
    return known[path]


def encoded(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """df with ids (array<int>) and decoded (binary, by way of the ids). Null and empty texts have no ids and no bytes.

    The vocabulary is read on each executor from `path`; public_tokenizers gives it by default. Columns of these
    names give way, others stay. A text is encoded whole, however long it is; merges that tie go from the left. Repeated
    rows get the same each, an empty table gives an empty one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path or public_tokenizers.path(RANKS))
        for batch in slices(batches, column=text):
            ids = [codec.encode(x) for x in texts(batch, text)]
            yield appended(batch, {"ids": pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), "decoded": pa.array(map(codec.decode, ids), pa.binary())})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in ("ids", "decoded"))
    return df.mapInArrow(encode, f"{kept}, ids array<int>, decoded binary")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of every whole text of documents, and of what they decode to, a row for a row.

    Nulls, empty and long texts, ties, repeated rows and empty tables as encoded states; of other columns none is read.
    """
    out = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(public_tokenizers.path(RANKS))
        for batch in slices(batches):
            n, ids_sha, decoded_sha = [], [], []
            for text in texts(batch):
                ids = codec.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield appended(batch, {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(decoded_sha)}, ("text",))

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(encode, out)
