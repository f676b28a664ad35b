"""Lempel-Ziv phrase fingerprints: the set of a text's LZ78 phrases as its smallest hashes.

Two texts that compress well together share phrases. A fingerprint holds the SIZE smallest of the phrases' 32-bit
hashes, and the share of common ones among the smallest of both estimates the Jaccard index of the sets; sets of at
most SIZE phrases are compared exactly.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, slices, texts, written
from .shingles import mixed

SIZE = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEPT: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base as 64-bit numbers, kept up to the length of usual texts."""
    own = _KEPT.get(base)
    if own is None or len(own) < n:
        own = np.full(max(n, 1 << 16), base, np.uint64)
        own[0] = 1
        own = np.cumprod(own)
        if n <= 1 << 20:
            _KEPT[base] = own
    return own[:n]


def parse(text: str, seen: dict, node: dict | None = None, made: list | None = None) -> list[int]:
    """The ends of text's phrases: the longest one seen so far and a character more.

    `seen` is a trie of dictionaries by character, which the phrases go into, so that a character costs one lookup
    however long its phrase is. With `node` the first phrase goes on from there; `made` gets what was added.
    """
    ends: list[int] = []
    node, i = seen if node is None else node, 0
    for c in text:
        i += 1
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            ends.append(i)
            if made is not None:
                made.append((node, c))
            node = seen
    return ends


def open_phrase(text: str, seen: dict) -> dict:
    """Where in the trie the characters stand that no phrase has ended behind."""
    for c in text:
        seen = seen[c]
    return seen


def hashes(text: str, start: int, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases of text that end at `ends`, the first from `start` on; they don't tell its place."""
    if not ends:
        return np.zeros(0, np.uint32)
    x = np.frombuffer(text[start : ends[-1]].encode("utf-32-le"), np.uint32).astype(np.uint64)
    sums = np.zeros(len(x) + 1, np.uint64)
    x += np.uint64(1)
    x *= _powers(_INVERSE, len(x))
    np.cumsum(x, out=sums[1:])
    at = np.array([start, *ends], np.int64) - start
    own = (sums[at[1:]] - sums[at[:-1]]) * _powers(_BASE, len(x))[at[:-1]]  # as if the phrase began the text
    return (mixed(own) >> np.uint64(32)).astype(np.uint32)


def smallest(own: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The `size` smallest of the different ones, in order."""
    if len(own) > 4 * size:
        few = np.unique(np.partition(own, 2 * size)[: 2 * size])
        if len(few) >= size:
            return few[:size]
    return np.unique(own)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Of the `size` smallest of both, the share that both have; 1 for two empty sets."""
    every = np.sort(np.concatenate([a, b]))
    if not len(every):
        return 1.0
    again = every[1:] == every[:-1]
    both = every[np.concatenate([[True], ~again])][:size]
    return float(np.count_nonzero(every[1:][again] <= both[-1])) / len(both)


class Parsed(NamedTuple):
    sketch: np.ndarray
    edited: np.ndarray
    digest: bytes


def sketch(text: str, size: int = SIZE) -> np.ndarray:
    return smallest(hashes(text, 0, parse(text, {})), size)


def parsed(text: str, after: str, size: int = SIZE) -> Parsed:
    """The sketch of a text, and of that text with its last third replaced by the beginning of the one after it.

    Both begin alike, so what they share is parsed once.
    """
    third = len(text) // 3
    cut, other = len(text) - third, after[:third]
    seen: dict = {}
    ends = parse(text[:cut], seen)
    n, left = len(ends), ends[-1] if ends else 0
    node, made = open_phrase(text[left:cut], seen), []
    ends += [cut + e for e in parse(text[cut:], seen, node, made)]
    whole = hashes(text, 0, ends)
    for parent, c in reversed(made):
        del parent[c]
    own = hashes(text[left:cut] + other, 0, [cut - left + e for e in parse(other, seen, node)])
    return Parsed(smallest(whole, size), smallest(np.concatenate([whole[:n], own]), size), hashlib.sha256((text[:cut] + other).encode()).digest())


_SCHEMA = "kind string, part int, id {0}, n_chars long, edited_sha256 binary, own binary, edited binary, near_edited double, near_next double, body binary"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), kind, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _done(key, text: str, found: Parsed, after: np.ndarray, size: int) -> tuple:
    return ("done", None, key, len(text), found.digest, found.sketch.astype(">u4").tobytes(), found.edited.astype(">u4").tobytes(), likeness(found.sketch, found.edited, size), likeness(found.sketch, after, size), None)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, text) with the text compressed, for the shuffle."""
    z = zstandard.ZstdCompressor(3)
    for b in slices(batches):
        body = pa.array([z.compress(t.encode()) for t in texts(b)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), body], names=["id", "h", "body"])


def _streamed(batches: Iterator[pa.RecordBatch], kind: pa.DataType, size: int) -> Iterator[pa.RecordBatch]:
    """A partition's documents in their order: each is done when the sketch of the one behind it is known.

    The first and the last also come out with their texts, as they meet the neighbouring partitions.
    """
    gc.disable()  # tries have no cycles, and looking for some takes long
    part, unzip = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
    out, last, waiting = [], None, None  # last: (id, body, text); waiting: (id, text, Parsed) for the sketch behind it
    for b in slices(batches, column="body"):
        for key, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            text = unzip.decompress(body).decode() if body else ""
            if last is None:
                out.append(("first", part, key, len(text), None, sketch(text, size).astype(">u4").tobytes(), None, None, None, body))
            else:
                found = parsed(last[2], text, size)
                if waiting:
                    out.append(_done(*waiting, found.sketch, size))
                waiting = (last[0], last[2], found)
            last = (key, body, text)
            if len(out) >= 500:
                yield _batch(out, kind)
                out = []
    if last:
        own = sketch(last[2], size)
        if waiting:
            out.append(_done(*waiting, own, size))
        out.append(("last", part, last[0], len(last[2]), None, own.astype(">u4").tobytes(), None, None, None, last[1]))
        yield _batch(out, kind)
    gc.enable()


def _met(batches: Iterator[pa.RecordBatch], kind: pa.DataType, size: int) -> Iterator[pa.RecordBatch]:
    """(id, body, body of the next, sketch of the next): the last documents of partitions."""
    unzip = zstandard.ZstdDecompressor()
    plain = lambda x: unzip.decompress(x).decode() if x else ""
    for b in slices(batches, column="body"):
        rows = [_done(key, plain(body), parsed(plain(body), plain(other), size), np.frombuffer(after, ">u4").astype(np.uint32), size) for key, body, other, after in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
        if rows:
            yield _batch(rows, kind)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each document beside the
    next one, by descending key; the one after the last is the first.

    The edited text has the last third (rounded down) of its code points replaced by the first as many of the next
    document, or all of them. A fingerprint is the base64 text of at most `size` 32-bit numbers, empty for an empty
    text; equal texts have equal ones. Null texts are empty; null keys come last; rows of one key are in the order of a
    hash of their texts, and rows that repeat key and text are equal, so it doesn't matter which comes first. A single
    document is its own next one. Texts are read whole; an empty table gives no row. Other columns are not read.

    Documents are sorted over partitions with their texts compressed, and stream through; only the first and the last
    of each partition are met by a join, from the written table. No task holds more than a few texts.
    """
    own = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("text"))
    name = dict(own.dtypes)["id"]
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
    packed = own.mapInArrow(_packed, f"id {name}, h long, body binary")
    order = [F.desc_nulls_last("id"), F.col("h")]
    schema = _SCHEMA.format(name)
    found = written(packed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda x: _streamed(x, kind, size), schema), "phrases")
    ends = found.filter("kind <> 'done'")
    first, last = ends.filter("kind = 'first'"), ends.filter("kind = 'last'")
    along = Window.orderBy("part")  # a row a partition, without texts
    turns = first.select("part").withColumn("then", F.coalesce(F.lead("part").over(along), F.min("part").over(Window.partitionBy(F.lit(1)))))
    behind = first.select(F.col("part").alias("then"), F.col("body").alias("other"), F.col("own").alias("after"))
    pairs = last.join(turns, "part").join(behind, "then").select("id", "body", "other", "after")
    every = found.filter("kind = 'done'").unionByName(pairs.mapInArrow(lambda x: _met(x, kind, size), schema))
    return every.select(F.col("id").alias(key), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.base64("own").alias("fingerprint"), F.base64("edited").alias("edited_fingerprint"), "near_edited", "near_next")


def decoded(fingerprint: str) -> np.ndarray:
    """The numbers of a fingerprint."""
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Nulls, ties, repeated rows, empty and long texts and empty tables as `fingerprints` states.
    """
    return fingerprints(documents(spark, sf_dir))
