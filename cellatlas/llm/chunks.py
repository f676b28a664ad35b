"""Content-defined chunks of payloads: a rolling gear hash cuts, equal chunks are kept once, recipes rebuild.

A payload's recipe lists the digests of its chunks in order. Chunks that more than one payload has lie in a table by
digest; all others lie with the payload's own record, so that a payload that shares nothing is read back from one row
and only what is shared moves between executors. Which chunks are shared is told by a Bloom filter of bounded size: a
false positive only puts a chunk into the table by digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, partitions, slices, written

LEAST, MASK, MOST = 512, 0xFFE00000, 8192  # bytes of a chunk, and the hash bits that are zero at a cut: one in 2048
UNIT = 192
ENTRY = 36  # bytes of a recipe for one chunk
BLOOM_BITS = 1 << 26
_SEEN = 1 << 16
#: The gear of each byte, by a rule that any implementation can follow.
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear" + bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


class Chunk(NamedTuple):
    digest: bytes
    body: bytes


def cuts(payload: bytes) -> list[int]:
    """The ends of the chunks. The hash of a place comes from the 32 bytes before it: each adds its gear, shifted by its distance."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    found = (np.flatnonzero((h & np.uint32(MASK)) == 0) + 1).tolist()
    ends, start, n = [], 0, len(payload)
    while n - start > LEAST:
        i = bisect_left(found, start + LEAST)
        end = min(start + MOST, n, found[i] if i < len(found) else n)
        ends.append(end)
        start = end
    if start < n or not n:
        ends.append(n)
    return ends


def chunked(payload: bytes) -> list[Chunk]:
    out, start = [], 0
    for end in cuts(payload):
        body = payload[start:end]
        out.append(Chunk(hashlib.sha256(body).digest(), body))
        start = end
    return out


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % UNIT or UNIT * (not raw))


class Bloom:
    """Two bits of a key, from its first bytes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = len(words) * 64 - 1

    @staticmethod
    def places(digests: list[bytes], mask: int) -> np.ndarray:
        return np.frombuffer(b"".join(d[:16] for d in digests), "<u8") & np.uint64(mask)

    def __contains__(self, digest: bytes) -> bool:
        a, b = struct.unpack_from("<QQ", digest)
        a, b = a & self.mask, b & self.mask
        return bool(self.words[a >> 6] >> np.uint64(a & 63) & np.uint64(1)) and bool(self.words[b >> 6] >> np.uint64(b & 63) & np.uint64(1))


def bloom(digests: DataFrame, n: int) -> Bloom:
    """A filter of the column `digest`: bits are joined where the rows are, and at most BLOOM_BITS come to the driver."""
    bits = min(BLOOM_BITS, max(1 << 12, 1 << (16 * max(n, 1)).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            p = Bloom.places(batch.column(0).to_pylist(), bits - 1)
            np.bitwise_or.at(own, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at].view(np.int64))], names=["at", "word"])

    rows = digests.select("digest").mapInArrow(words, "at int, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return Bloom(out)


class Store(NamedTuple):
    """recipes: key, n_bytes, media, recipe, lengths, own, n_shared; shared: digest, body.

    recipe: for each chunk its length (32 bits, little-endian; below 0 if it lies in `shared`) and its digest; lengths:
    the lengths once more, as Spark reads them; own: a zstandard frame of the bodies that lie here, null if none does;
    body: a frame of one chunk.
    """

    recipes: DataFrame
    shared: DataFrame


def store(df: DataFrame, key: str, text: str, payload: Callable[[str | None], bytes] = payload_of) -> Store:
    """Chunks the payloads of all rows and writes them, equal chunks once.

    A null text has the payload of the empty one. Rows may repeat, and keys too. Payloads that are equal have one
    media id, the digest of their bytes.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([c.digest for x in batch.column(1).to_pylist() for c in chunked(payload(x))], pa.binary())], names=["digest"])

    counted = source.mapInArrow(digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n"))
    shared = written(counted.filter("n > 1").select("digest"), "shared-digests")
    known = df.sparkSession.sparkContext.broadcast(bloom(shared, shared.count()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen, press = known.value, set(), zstandard.ZstdCompressor(level=6, write_checksum=False)
        for batch in slices(batches):
            rows, bodies = [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = payload(x)
                own, n_shared = [], 0
                found = chunked(whole)
                lengths = []
                for c in found:
                    if c.digest in common:
                        n_shared += 1
                        lengths.append(-len(c.body))
                        if c.digest not in seen:
                            if len(seen) >= _SEEN:
                                seen.clear()
                            seen.add(c.digest)
                            bodies.append((c.digest, press.compress(c.body)))
                    else:
                        lengths.append(len(c.body))
                        own.append(c.body)
                rows.append((k, len((x or "").encode()), hashlib.sha256(whole).digest(), b"".join(struct.pack("<i", n) + c.digest for n, c in zip(lengths, found, strict=True)), lengths, press.compress(b"".join(own)) if own else None, n_shared))
            n, m = len(rows), len(bodies)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (batch.schema.field(0).type, pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.int32())
            arrays = [pa.array([*c, *[None] * m], t) for c, t in zip(columns, kinds, strict=True)]
            tail = [pa.array([*[None] * n, *(b[i] for b in bodies)], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*arrays, *tail, pa.array([False] * n + [True] * m)], names=["key", "n_bytes", "media", "recipe", "lengths", "own", "n_shared", "digest", "body", "is_chunk"])

    kind = dict(source.dtypes)["key"]
    both = written(source.mapInArrow(split, f"key {kind}, n_bytes bigint, media binary, recipe binary, lengths array<int>, own binary, n_shared int, digest binary, body binary, is_chunk boolean"), "chunks")
    spark = df.sparkSession

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # a digest's rows follow each other
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keep = [x != y for x, y in zip(ids, [last, *ids], strict=False)]
            last = ids[-1] if ids else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    pieces = both.filter("is_chunk").select("digest", "body").repartition(partitions(spark), "digest").sortWithinPartitions("digest").mapInArrow(once, "digest binary, body binary")
    return Store(both.filter("NOT is_chunk").drop("digest", "body", "is_chunk"), written(pieces, "chunk-store"))


class Rebuilt(NamedTuple):
    payload: bytes
    stored: bytes  # as they were read back: the recipe, the own frame, and the frames of shared chunks in their order
    n_chunks: int


def _joined(recipe: bytes, lengths: list[int], own: bytes | None, shared: dict[int, bytes], media: bytes) -> Rebuilt:
    if struct.unpack(f"<{len(lengths)}i", b"".join(recipe[i : i + 4] for i in range(0, len(recipe), ENTRY))) != tuple(lengths):
        raise ValueError(f"media {media.hex()} has a recipe that differs from its lengths")
    press = zstandard.ZstdDecompressor()
    private = press.decompress(own, max_output_size=sum(x for x in lengths if x > 0)) if own else b""
    parts, at = [], 0
    for i, n in enumerate(lengths):
        if n > 0:
            parts.append(private[at : at + n])
            at += n
        else:
            parts.append(press.decompress(shared[i], max_output_size=-n) if n else b"")
    payload = b"".join(parts)
    if hashlib.sha256(payload).digest() != media:
        raise ValueError(f"media {media.hex()} was not rebuilt as it was stored")
    return Rebuilt(payload, b"".join([recipe, own or b"", *(shared[i] for i, n in enumerate(lengths) if n < 0)]), len(lengths))


def rebuilt(kept: Store, of: Callable[[Rebuilt], tuple], fields: str, kinds: list[pa.DataType]) -> DataFrame:
    """For each row of the recipes its key, n_bytes, media and what `of` makes of the bytes as they were read back.

    Media without shared chunks are read row by row. Of the others, equal ones are rebuilt once: their shared chunks
    are joined by digest (a hot digest is a skewed side of that join, which Spark splits) and gathered by media id.
    A payload that differs from what was stored is an error.
    """
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    spark = kept.recipes.sparkSession
    key_kind = dict(kept.recipes.dtypes)["key"]

    def made(rows: list[tuple], keys: list[pa.Array], key_names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*key_names, *names])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="own"):
            x = batch.to_pydict()
            rows = [of(_joined(r, n, o, {}, m)) for r, n, o, m in zip(x["recipe"], x["lengths"], x["own"], x["media"], strict=True)]
            yield made(rows, [batch.column(0), batch.column(1), batch.column(2)], ["key", "n_bytes", "media"])

    single = kept.recipes.filter("n_shared = 0").select("key", "n_bytes", "media", "recipe", "lengths", "own").mapInArrow(alone, f"key {key_kind}, n_bytes bigint, media binary, {fields}")
    mixed = kept.recipes.filter("n_shared > 0")
    # equal media have equal recipes; one record of each, the narrow part first
    heads = mixed.select("media", "recipe", "lengths", "own")
    p = partitions(spark)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keep = []
            for x in ids:
                keep.append(x not in seen)
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(x)
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = "media binary, recipe binary, lengths array<int>, own binary"
    heads = written(heads.mapInArrow(once, schema).dropDuplicates(["media"]), "heads")
    needed = heads.select("media", F.posexplode("lengths").alias("at", "n"), "recipe").filter("n < 0").select("media", "at", F.expr(f"substring(recipe, at * {ENTRY} + 5, 32)").alias("digest"))
    parts = needed.join(kept.shared, "digest").select("media", "at", "body", F.lit(None).cast("binary").alias("recipe"), F.lit(None).cast("array<int>").alias("lengths"), F.lit(None).cast("binary").alias("own"))
    rows = parts.unionByName(heads.select("media", F.lit(-1).alias("at"), F.lit(None).cast("binary").alias("body"), "recipe", "lengths", "own"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, bodies = None, {}

        def close() -> list[tuple]:
            return [] if head is None else [(head[0], *of(_joined(head[1], head[2], head[3], bodies, head[0])))]

        for batch in batches:
            out = []
            x = batch.to_pydict()
            for m, at, body, recipe, lengths, own in zip(x["media"], x["at"], x["body"], x["recipe"], x["lengths"], x["own"], strict=True):
                if at < 0:
                    out += close()
                    head, bodies = (m, recipe, lengths, own), {}
                else:
                    bodies[at] = body
            yield made([r[1:] for r in out], [pa.array([r[0] for r in out], pa.binary())], ["media"])
        out = close()
        yield made([r[1:] for r in out], [pa.array([r[0] for r in out], pa.binary())], ["media"])

    media = rows.repartition(p, "media").sortWithinPartitions("media", "at").mapInArrow(gathered, f"media binary, {fields}")
    return single.unionByName(mixed.select("key", "n_bytes", "media").join(media, "media").select("key", "n_bytes", "media", *names))


def described(x: Rebuilt) -> tuple:
    """Size, digest and tail of the payload, size and digest of what is stored for it, and features of its bytes."""
    counts = np.bincount(np.frombuffer(x.payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(x.payload)
    mean = float((counts * np.arange(256)).sum() / len(x.payload))
    feature = f"chunks={x.n_chunks};mean={mean:.4f};entropy={float(-(share * np.log2(share)).sum()) + 0:.4f}"
    return len(x.payload), hashlib.sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-16:]), len(x.stored), hashlib.sha256(x.stored).hexdigest(), feature


def op4_chunks(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as chunks of bytes, read back and described, a row for a row.

    The stored form of a payload is its recipe, its own frame and the frames of its shared chunks. Null and empty texts
    have one payload, 192 spaces; long ones are chunked whole. Equal texts have equal values, whichever row comes first,
    and are stored once where their chunks are shared; repeated rows are repeated. An empty table gives an empty result;
    of other columns none is read.
    """
    fields = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    found = rebuilt(store(documents(spark, sf_dir), "doc_id", "text"), described, fields, kinds)
    return found.select(F.col("key").alias("doc_id"), "n_bytes", *(f.split(" ")[0] for f in fields.split(", ")))
