import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cellatlas.llm import packing as K
from llm.conftest import SF


def test_query(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path(K.VOCABULARY))
    t.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in K.op9_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    full = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        full += at == 4096
    assert full >= len(sequences) - 1


def test_unusual_texts():
    t = Tokenizer.from_file(public_tokenizers.path(K.VOCABULARY))
    t.encode_special_tokens = True
    words = K.Words(public_tokenizers.path(K.VOCABULARY))
    for text in ("It's ÀÉÎ don't 42nd!! <|endoftext|>", "Σας İ ß", "é x", "a\x1cb", " ", "ŒUVRE ª º", "", "I'LL'S 's", "x" * 500):
        assert words.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = K.hilbert(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_copies_are_neighbours_and_ranges_even(spark):
    docs = [(i, f"alpha beta gamma {i}" if i % 2 else "one and the same text") for i in range(400)]
    rows = K.packed(spark.createDataFrame(docs, "doc_id bigint, text string"), length=64).orderBy("sequence_id", "offset").collect()
    same = [r["doc_id"] % 2 for r in rows]
    assert sum(a != b for a, b in zip(same, same[1:], strict=False)) <= 6


def test_another_tokenizer_file(tmp_path):
    """Files with other settings are read by the library alone."""
    how = json.load(open(public_tokenizers.path(K.VOCABULARY), encoding="utf-8"))
    how["normalizer"] = {"type": "NFC"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(how), encoding="utf-8")
    t = Tokenizer.from_file(str(path))
    t.encode_special_tokens = True
    words = K.Words(str(path))
    assert not words.plain and K.Words(public_tokenizers.path(K.VOCABULARY)).plain
    assert words.encode("Some Text it's").tolist() == t.encode("Some Text it's", add_special_tokens=False).ids


def test_order_along_the_curve(spark, texts):
    """The sequences follow the Hilbert keys of the documents, as projected once more here."""
    words = K.Words(public_tokenizers.path(K.VOCABULARY))
    key = {i: int(K.curve_keys([np.append(words.encode(t or ""), np.uint16(2))])[0]) for i, t in texts.items()}
    rows = K.op9_packing(spark, SF).orderBy("sequence_id", "offset").collect()
    order = [key[r["doc_id"]] for r in rows]
    assert order == sorted(order) and len(set(order)) > 50
    directions = np.random.default_rng(K.SEED).standard_normal((K.HASHED, K.DIMS))
    ids = words.encode(texts[rows[0]["doc_id"]] or "")
    counts = np.zeros(K.HASHED)
    for x in [*ids.tolist(), 2]:
        counts[(x * 0x9E3779B97F4A7C15 % 2**64 >> 56) % K.HASHED] += 1
    grid = np.clip((counts @ directions / max(1, np.sqrt((counts**2).sum())) + 3) / 6 * (1 << K.BITS), 0, (1 << K.BITS) - 1)
    assert int(K.hilbert(grid[None, :], K.BITS)[0]) == order[0]
