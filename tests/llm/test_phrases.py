"""Phrase fingerprints against the plain parse, character by character, and sets of Python numbers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cellatlas.llm import phrases as P
from llm.conftest import ODD, SF

MASK = (1 << 64) - 1


def phrases(text):
    seen, s = set(), 0
    for e in range(1, len(text) + 1):
        if text[s:e] not in seen:
            seen.add(text[s:e])
            s = e
    return seen


def mixed(x):
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & MASK
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ (x >> 33)


INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def number(phrase):
    total, power = 0, 1
    for c in phrase:
        total, power = (total + (ord(c) + 1) * power) & MASK, power * INVERSE & MASK
    return mixed(total) >> 32


def lowest(text):
    return sorted({number(p) for p in phrases(text)})[: P.SIZE]


def near(a, b):
    both = sorted({*a, *b})[: P.SIZE]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def expected(rows):
    """By id: the rows' values, from (id, text) in descending order of ids, nulls last."""
    out = {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other = lowest(text), lowest(edited)
        out.setdefault(key, []).append((len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, near(own, other), near(own, lowest(after))))
    return out


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"], P.decoded(r["fingerprint"]).tolist(), P.decoded(r["edited_fingerprint"]).tolist(), r["near_edited"], r["near_next"]))
    return out


def same(found, wanted):
    assert found.keys() == wanted.keys()
    for k, rows in wanted.items():
        for a, b in zip(sorted(found[k]), sorted(rows), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])


@pytest.mark.parametrize("seed", range(40))
def test_parse(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab" if seed % 2 else "abcdefgh é😀") for _ in range(rng.randint(0, 3000)))
    text += "word " * rng.choice([0, 500])
    ends = P.parse(text, {})
    assert {text[s:e] for s, e in zip([0, *ends], ends)} == phrases(text) and len(ends) == len(phrases(text))
    assert P.sketch(text).tolist() == lowest(text)


@pytest.mark.parametrize("n", [1, 2, 3, 40, 5000])
def test_edited(n):
    rng = random.Random(n)
    text, after = ("".join(rng.choice("abc \n") for _ in range(m)) for m in (n, n // 2))
    found = P.parsed(text, after)
    edited = text[: n - n // 3] + after[: n // 3]
    assert (found.sketch.tolist(), found.edited.tolist(), found.digest.hex()) == (lowest(text), lowest(edited), hashlib.sha256(edited.encode()).hexdigest())


def test_long_repetition():
    """A million characters of one word: phrases grow to thousands of characters, and a character costs no more."""
    ends = P.parse("word " * 200_000, {})
    assert len(ends) < 10_000 and ends[-1] - ends[-2] > 500


def test_query(spark, texts):
    rows = sorted(((i, t or "") for i, t in texts.items()), reverse=True)
    found = P.op12_phrases(spark, SF)
    same(by_id(found), expected(rows))
    assert "\n" not in found.agg(F.max("fingerprint")).first()[0]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions(spark, texts, parts):
    """Neighbours in other partitions, empty partitions among them, are found."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = sorted(((i, (t or "")[:300]) for i, t in texts.items()), reverse=True)[:20]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        same(by_id(P.fingerprints(df)), expected(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_odd_rows(odd):
    """Nulls, repeated rows, blanks and a long text; rows of one id have equal texts here."""
    rows = sorted(((i, t or "") for i, t in ODD), key=lambda r: (r[0] is None, -(r[0] or 0)))
    same(by_id(P.fingerprints(odd)), expected(rows))


def test_few(spark):
    one = spark.createDataFrame([(7, "abcabcabd")], "doc_id bigint, text string")
    same(by_id(P.fingerprints(one)), expected([(7, "abcabcabd")]))
    assert P.fingerprints(one.limit(0)).collect() == []


def test_telling(spark, texts):
    """A near copy is nearer than a text of the same language, which is nearer than one of another."""
    a = "the quick brown fox jumps over the lazy dog while the sun sets behind the old stone mill near the river " * 3
    assert P.likeness(P.sketch(a + "one"), P.sketch(a + "two")) > 0.9
    assert P.likeness(P.sketch(a), P.sketch("1234567890 " * 20)) < 0.1
