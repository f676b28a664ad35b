"""Hard negatives against all pairs in plain numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellatlas.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=5):
    """All rows of the result from (vec_id, vector, label), in order."""
    own = []
    for n, (i, v, y) in enumerate(rows):
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((n, i, y, [math.floor(256 * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    tie = lambda i: math.inf if i is None else i
    out = []
    for a in own:
        if a[1] is None or a[1] % every:
            continue
        scored = sorted(((-dot(a[3], b[3]), tie(b[1]), b[0], b[1], b[2] == a[2]) for b in own if b[0] != a[0]))
        for p in [x for x in scored if x[4]][:positives]:
            hits = [x for x in scored if not x[4] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:negatives]
            out += [(a[1], p[3], r, x[3], -p[0], -x[0]) for r, x in enumerate(hits, 1)]
    return sorted(out, key=str)


def found(spark, rows, every=10):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS q", "2 AS ask", "3 AS number", "4 AS place")
    return sorted((tuple(r) for r in N.hard_negatives(df, F.col("vec_id") % every == 0).collect()), key=str)


def drawn(seed, n, dims=16, labels=3, scale=0.2):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, scale, dims).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_random_vectors(spark):
    rows = drawn(1, 700)
    assert found(spark, rows) == brute(rows) != []


def test_groups_of_copies(spark):
    """A third of the rows is one vector, with three labels; copies are positives and negatives of each other."""
    rows = drawn(2, 400)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, y) for i, v, y in rows]
    assert found(spark, rows) == brute(rows) != []


def test_odd_rows(spark):
    rows = drawn(3, 120, dims=4, scale=1.0)
    rows += [(None, [0.5, 0.5, 0.5, 0.5], 1), (None, [0.5, 0.5, 0.5, 0.5], 2), (10, None, 1), (20, [1.0, None, 0.0, 0.0], 1), (30, [float("nan"), 1.0, 1.0, 1.0], 1)]
    rows += [(40, [float("inf"), 1.0, 1.0, 1.0], 1), (50, [1.0, 1.0, 1.0, 1.0], None), (60, [], 1), (70, [1.0], 1), (80, [0.5] * 7, 2), (-10, [0.5] * 5, 0), (90, [1e4, -1e4, 1e4, 0.0], 0)]
    rows += rows[:11]
    assert found(spark, rows) == brute(rows) != []


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 0.0], 1)]) == []
    assert found(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)]) == []
    assert found(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.5, 0.0], 2)]) == [(0, 1, 1, 2, 65536, 58880)]
    assert found(spark, [(0, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold(seed):
    """Every score lies within its looked-up score plus or minus anchor norm times stored norm, and few rows do so far off."""
    rng = np.random.default_rng(seed)
    rows = np.floor(rng.normal(0, 300, (500, 64))).astype(np.int32)
    books = N.codebooks(rows[:300])
    codes, norm = N.coded(rows, books)
    there = books[np.arange(32)[None, :], codes].reshape(500, -1).astype(np.float64)
    scores, about = rows[:50] @ rows.T.astype(np.int64), rows[:50] @ there.T
    bound = np.sqrt((rows[:50].astype(np.float64) ** 2).sum(1))[:, None] * norm[None, :]
    assert (np.abs(scores - about) <= bound).all()
    assert (bound < 0.2 * np.sqrt((rows[:50].astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt((rows.astype(np.float64) ** 2).sum(1))[None, :]).mean() > 0.9


def test_blocks(spark, monkeypatch):
    """Anchors and rows dealt over many blocks give the same."""
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "SLICE", 50)
    rows = drawn(5, 300)
    assert found(spark, rows, 5) == brute(rows, 5)
