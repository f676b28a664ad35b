"""Name joins by indexes against the same rule over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cellatlas.functions import text as T
from cellatlas.operators import names

ODD = ["", " ", "t", "T", "T cell", "t cells", "CD8+ T-cell", "CD8 T cell", "B", "b cell, naive", "naive B cell", "cell", "Cells", "NK", "monocyte", "Classical monocyte", "  padded name ", "a_b", "A-B", "wnt/beta signaling", "WNT signaling", "beta signaling pathway", "İstanbul", "é", None]


def some(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "cell", "type", "x", "yy", "like"]
    return ODD + [rng.choice([" ", "-", "_", "/"]).join(rng.sample(words, rng.randint(1, 5))) for _ in range(n)]


@pytest.fixture(scope="module")
def sides(spark):
    return tuple(spark.createDataFrame([(x,) for x in some(s)], "name string") for s in (1, 2))


ALIASES = {"T cell": ["lymphocyte", "cd8"], "wnt": ["beta", "frizzled"]}
RULES = [
    (names.alike, T.alike, {}),
    (names.alike, T.alike, {"least": 0.8}),
    (names.pathways_alike, T.pathways_alike, {}),
    (names.pathways_alike, T.pathways_alike, {"aliases": ALIASES}),
    (names.clusters_alike, T.clusters_alike, {}),
    (names.clusters_alike, T.clusters_alike, {"aliases": ALIASES}),
]


@pytest.mark.parametrize("join, rule, more", RULES)
def test_same_rows(sides, join, rule, more):
    left, right = sides
    a, b = left.select(F.col("name").alias("a")).distinct(), right.select(F.col("name").alias("b")).distinct()
    wanted = {tuple(r) for r in a.join(b, rule(F.col("a"), F.col("b"), **more)).collect()}
    found = join(left, right, **more)
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == wanted and len(rows) == len(wanted) > 20


def test_no_nested_loop(sides, capsys):
    names.alike(*sides).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan
