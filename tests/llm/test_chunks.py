import hashlib
import struct
import zlib

import numpy as np
import pytest
import zstandard

from cellatlas.llm import chunks as C
from llm.conftest import SF


def plain_cuts(data: bytes) -> list[int]:
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (h << 1) + int(C.GEAR[b]) & 0xFFFFFFFF
        n = i + 1 - start
        if n >= C.MOST or n >= C.LEAST and h & C.MASK == 0 and len(data) - start > C.LEAST:
            ends.append(i + 1)
            start = i + 1
    return ends + [len(data)] * (start < len(data) or not data)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000, 40_000])
def test_cuts_as_a_rolling_hash(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert C.cuts(data) == plain_cuts(data)
    assert b"".join(c.body for c in C.chunked(data)) == data
    assert C.cuts(b"a" * n)[-1] == n


def test_an_insertion_leaves_later_chunks():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    one, two = ({c.digest for c in C.chunked(x)} for x in (data, data[:100] + b"new" + data[100:]))
    assert len(one & two) >= len(one) - 3


def test_query(spark, texts):
    rows = C.op4_chunks(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_text = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = C.payload_of(texts[r["doc_id"]])
        assert payload.rstrip(b" ") == raw.rstrip(b" ") and len(payload) % 192 == 0 and len(payload) - len(raw) < 193
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        rest = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert by_text.setdefault(raw, rest) == rest


def test_padding():
    assert C.payload_of(None) == b" " * 192 == C.payload_of("")
    assert C.payload_of("a" * 192) == b"a" * 192
    assert len(C.payload_of("a" * 193)) == 384


def test_damage_is_an_error(spark):
    docs = spark.createDataFrame([(1, "abc" * 500), (2, "abc" * 500)], "doc_id bigint, text string")
    kept = C.store(docs, "doc_id", "text")
    bad = C.Store(kept.recipes.selectExpr("key", "n_bytes", "unhex(repeat('00', 32)) AS media", "recipe", "lengths", "own", "n_shared"), kept.shared)
    with pytest.raises(Exception, match="was not rebuilt"):
        C.rebuilt(bad, C.described, "a bigint, b string, c bigint, d bigint, e string, f string", [C.pa.int64(), C.pa.string(), C.pa.int64(), C.pa.int64(), C.pa.string(), C.pa.string()]).collect()


def test_shared_chunks_are_kept_once(spark):
    body = np.random.default_rng(5).integers(32, 127, 30_000, dtype=np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(i, f"{i} {body} {i}") for i in range(6)], "doc_id bigint, text string").repartition(3)
    kept = C.store(docs, "doc_id", "text")
    digests = [bytes(r["digest"]) for r in kept.shared.collect()]
    assert len(digests) == len(set(digests)) > 5
    assert kept.recipes.filter("n_shared > 0").count() == 6


def test_stored_bytes(spark, texts):
    """media_bytes and media_sha256 are of bytes that lie in the store: opened here, they give the payload again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = C.store(docs, "doc_id", "text")
    frames = {bytes(r["digest"]): bytes(r["body"]) for r in kept.shared.collect()}
    fields = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    kinds = [C.pa.int64(), C.pa.string(), C.pa.int64(), C.pa.int64(), C.pa.string(), C.pa.string()]
    told = {r["key"]: r for r in C.rebuilt(kept, C.described, fields, kinds).collect()}
    press, mixed = zstandard.ZstdDecompressor(), 0
    for r in kept.recipes.collect():
        recipe, own = bytes(r["recipe"]), bytes(r["own"] or b"")
        entries = [(struct.unpack_from("<i", recipe, i)[0], recipe[i + 4 : i + 36]) for i in range(0, len(recipe), 36)]
        stored = recipe + own + b"".join(frames[d] for n, d in entries if n < 0)
        assert (told[r["key"]]["media_bytes"], told[r["key"]]["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        private, payload = press.decompress(own, max_output_size=1 << 24) if own else b"", b""
        for n, d in entries:
            body = press.decompress(frames[d], max_output_size=-n) if n < 0 else private[:n]
            private = private if n < 0 else private[n:]
            assert hashlib.sha256(body).digest() == d
            payload += body
        assert payload == C.payload_of(texts[r["key"]]) and private == b""
        mixed += any(n < 0 for n, _ in entries)
    assert mixed and len(told) == len(texts)
