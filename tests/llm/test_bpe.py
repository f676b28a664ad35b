import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cellatlas.llm import bpe as B
from llm.conftest import SF

PATH = public_tokenizers.path(B.RANKS)


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return B.Codec(PATH), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_tiktoken(both):
    codec, other = both
    rng = random.Random(1)
    pool = "".join(map(chr, [*range(0x250), 0x200B, 0x2028, 0x3000, 0x180E, 0x300, 0x4E00, 0x1F600, 0xFEFF, 0x660, 0x2460, 0xE0100])) + " " * 300 + "\n" * 50
    for _ in range(5000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 30)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_special_strings_and_long_runs(both):
    codec, other = both
    for text in ("<|endoftext|> x", "a" * 20_000, " " * 5000, "\n \n  x ", ""):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_query(spark, texts, both):
    for r in B.op8_bpe(spark, SF).collect():
        text = texts[r["doc_id"]] or ""
        ids = both[1].encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_operator_keeps_columns(spark, odd):
    out = B.encoded(odd)
    assert out.columns == [*(c for c in odd.columns if c not in ("ids", "decoded")), "ids", "decoded"]
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in out.collect())


def test_model_gives_each_entry_itself(both):
    """What is read from the ranks is what the model says, for every entry of the vocabulary."""
    codec, _ = both
    pieces = ["".join(map(codec.chars.__getitem__, t)) for t in codec.tokens]
    assert [codec.model.EncodeAsIds(p) for p in pieces] == [[i] for i in range(len(pieces))]


def test_small_caches_change_nothing(both):
    codec, other = both
    few = B.Codec(PATH)
    few.met, few.met_chunks = B.Recent(7), B.Recent(5)
    rng = random.Random(2)
    for _ in range(300):
        text = " ".join(rng.choice(["alpha", "beta!", "gamma-ray", "δέλτα", "x1", "", "\n"]) + str(rng.randrange(9)) for _ in range(20))
        assert few.encode(text) == codec.encode(text) == np.array(other.encode_ordinary(text), "<u4").tobytes()
    assert len(few.met) <= 7 and len(few.met.older) <= 7
