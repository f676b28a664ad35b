"""Packing documents into sequences along a space-filling curve.

A document's token ids are hashed into a vector of counts, which fixed random directions project to a few dimensions.
The place on the Hilbert curve through these dimensions is its key, so documents of like words follow each other. The
whole corpus in that order is one stream of tokens, cut every `length` tokens: only the last sequence has padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_characters
from .common import documents, partitions, slices, texts, written

VOCABULARY = "word_bpe_49k.json"
LENGTH, END = 4096, 2
HASHED, DIMS, BITS, SEED = 256, 3, 13, 11
WEIGHT = 1024  # tokens for which a document counts once where ranges are made even
KNOWN = 1 << 18  # parts whose ids a worker process keeps, twice at most
#: What the plain pattern below stands for: a file with these settings is read that way, any other by the library alone.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Texts of these characters only have tokens that a plain pattern finds, and lower case letter by letter.
_UNUSUAL = re.compile(r"[^\n\t\x20-\x7eÀ-ÖØ-öø-ÿ]")
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Words(dict):
    """The ids (16 bits each, as they lie in memory) of the parts that a text falls into.

    When it is full it becomes the older half, and what is met again comes over from there.
    """

    def __init__(self, path: str, known: int = KNOWN):
        self.known = known
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        with open(path, encoding="utf-8") as file:
            how = json.load(file)
        self.plain = how["normalizer"] == NORMALIZER and how["pre_tokenizer"] == PRE_TOKENIZER and how["model"]["type"] == "BPE"
        self.model, self.chars = self.tokenizer.model, byte_characters()
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.known:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(part) or array("H", [t.id for t in self.model.tokenize(part if part.isascii() else "".join(map(self.chars.__getitem__, part.encode())))]).tobytes()
        if len(part) < 64:
            self[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not self.plain or _UNUSUAL.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.frombuffer(b"".join(map(self.__getitem__, _PARTS.findall(text.lower()))), np.uint16)


@cache
def _words(path: str, known: int) -> Words:
    """One for each worker process."""
    return Words(path, known)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of x, whose columns are whole numbers of `bits` bits.

    Gray-code rotations are undone from the highest bit down, column by column, over all rows at once.
    """
    x = x.astype(np.int64).copy()
    rows, dims = x.shape
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            on = (x[:, d] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(rows, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    out = np.zeros(rows, np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[:, d] >> level & 1)
    return out


@cache
def _directions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    cell = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64) % HASHED
    return cell, rng.standard_normal((HASHED, DIMS))


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert keys, of DIMS * BITS bits, of these documents."""
    cell, directions = _directions()
    counts = np.stack([np.bincount(cell[x], minlength=HASHED) for x in ids]) if ids else np.zeros((0, HASHED))
    norm = np.sqrt((counts**2).sum(1, keepdims=True))
    place = counts @ directions / np.maximum(norm, 1)
    grid = np.clip((place + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(grid, BITS)


def packed(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END, known: int = KNOWN, with_ids: bool = True) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` ids (array<int>).

    A document is its ids and then `end`; null and empty texts are one id, and long ones are cut into as many pieces as
    they need. Ranges of the curve go to one partition each; the low bits of the sort key are a hash of `key`, so equal
    documents, however many, are spread over ranges too, and what ties in both goes by key and size. A narrow sum gives
    where in the stream each range begins. Repeated rows are packed as often as they occur; an empty table gives no
    piece; other columns are not read. `path` names a tokenizer file of the tokenizers library with at most 2^16 ids.
    `known` bounds the memory of words that a worker process has met.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    source = df.select(F.col(key).alias("key"), F.shiftrightunsigned(F.xxhash64(key), 40).alias("tie"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path or public_tokenizers.path(VOCABULARY), known)
        for batch in slices(batches):
            ids = [np.append(words.encode(x), np.uint16(end)) for x in texts(batch)]
            place = curve_keys(ids) << 24 | batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], names=["key", "place", "n", "ids"])

    rows = written(source.mapInArrow(encode, f"key {kind}, place bigint, n bigint, ids binary"), "tokens")
    p = max(1, partitions(spark))
    weighed = rows.select("place", F.explode(F.array_repeat(F.lit(0), F.ceil(F.col("n") / WEIGHT).cast("int"))))  # a long document counts more than once
    found = weighed.agg(F.percentile_approx("place", F.array(*[F.lit(i / p) for i in range(1, p)]), 20 * p)).first()[0] if p > 1 else None
    edges = sorted(set(found or []))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(np.searchsorted(edges, batch.column(batch.schema.get_field_index("place")).to_numpy(), "right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, at], names=[*batch.schema.names, "part"])

    sums = rows.select("place", "n").mapInArrow(ranged, "place bigint, n bigint, part int").groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row for each partition
    begin, total = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        begin[r["part"]] = total
        total += r["n"]

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for batch in batches:
            out = []
            for k, n, raw, own in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "n", "ids", "part")), strict=True):
                if own != part:
                    part, at = own, begin[own]
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                while start < n:
                    size = min(n - start, length - at % length)
                    piece = ids[start : start + size]
                    out.append((k, start, size, zlib.crc32(piece.tobytes()), n, at // length, at % length, *([piece.astype(np.int32)] if with_ids else ())))
                    start, at = start + size, at + size
            kinds = [batch.schema.field("key").type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, *names])

    dealt = rows.mapInArrow(ranged, f"key {kind}, place bigint, n bigint, ids binary, part int").repartitionById(p, "part")
    return dealt.sortWithinPartitions("part", "place", "key", "n").mapInArrow(cut, ", ".join([f"`{key}` {kind}", *(f"{n} {'array<int>' if n == 'ids' else 'bigint'}" for n in names)]))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents, without their ids, which the query is not asked for.

    Nulls, empty and long texts, ties, repeated rows, empty tables and other columns as packed states.
    """
    return packed(documents(spark, sf_dir), with_ids=False)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, so the result is the training sequences themselves.

    Its worker processes have served the stages before, so they keep fewer words than in the query.
    """
    return packed(docs, known=KNOWN // 4)
