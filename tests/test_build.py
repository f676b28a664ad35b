"""Variable genes and components against numpy, and the whole build from counts to an engine over the catalog."""

import numpy as np
import pytest

from cellatlas.edge.engine import Engine
from cellatlas.operators import build, components, trend
from cellatlas.operators.encode import hashing_encoder


@pytest.fixture(scope="module")
def matrix():
    """Three kinds of cells, each with ten genes of its own, as counts."""
    rng = np.random.default_rng(4)
    rate = np.full((90, 60), 0.3)
    for g in range(3):
        rate[g * 30 : (g + 1) * 30, g * 10 : (g + 1) * 10] = 30
    return rng.poisson(rate).astype(float)


@pytest.fixture(scope="module")
def atlas(spark, matrix):
    rows = [(int(i), f"g{j:02d}", float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    cells = [(i, "a" if i % 2 else "b") for i in range(len(matrix))]
    return spark.createDataFrame(rows, "cell_id bigint, gene string, value double"), spark.createDataFrame(cells, "cell_id bigint, side string")


def plain_trend(x, y, span):
    """The local parabola at each point's own place, by numpy's least squares, linear between the knots."""
    order = np.argsort(x, kind="stable")
    q = max(3, int(len(x) * span + 1e-5))
    fit = {}
    for i in order:
        d = np.abs(x - x[i])
        near = np.argsort(d, kind="stable")[:q]
        h = d[near].max() or 1
        w = np.where(d[near] < h, (1 - (d[near] / h) ** 3) ** 3, 0)
        a = np.stack([np.ones(q), x[near] - x[i], (x[near] - x[i]) ** 2], 1)
        fit[i] = np.linalg.lstsq(a * np.sqrt(w)[:, None], y[near] * np.sqrt(w), rcond=None)[0][0]
    return np.array([fit[i] for i in range(len(x))])


def test_trend(spark, matrix, atlas):
    """With a knot at each gene the trend is the local regression itself, and the variances are numpy's."""
    found = trend.genes_by_trend(*atlas, genes=60, count=1000).toPandas().set_index("gene").sort_index()
    n = len(matrix)
    mean, var = matrix.mean(0), matrix.var(0, ddof=1)
    assert np.allclose(found["mean"], mean) and np.allclose(found["variance"], var)
    expected = 10 ** plain_trend(np.log10(mean), np.log10(var), 0.3)
    assert np.allclose(found["expected"], expected, rtol=1e-6)
    cut = np.minimum(matrix, mean + np.sqrt(expected) * np.sqrt(n))
    assert np.allclose(found["normalized"], (n * mean**2 + (cut**2).sum(0) - 2 * mean * cut.sum(0)) / ((n - 1) * expected), rtol=1e-6)
    assert sorted(found["rank"]) == list(range(1, 61)) and found.sort_values("rank")["normalized"].is_monotonic_decreasing


def test_trend_of_odd_genes(spark):
    """Genes that don't vary, one gene, no gene."""
    cells = spark.createDataFrame([(i,) for i in range(4)], "cell_id bigint")
    flat = spark.createDataFrame([(i, "flat", 2.0) for i in range(4)], "cell_id bigint, gene string, value double")
    assert [(r["gene"], r["normalized"]) for r in trend.genes_by_trend(flat, cells).collect()] == [("flat", 0.0)]
    assert trend.genes_by_trend(flat.limit(0), cells).collect() == []
    one = spark.createDataFrame([(0, "x", 1.0), (1, "flat", 1.0), (0, "flat", 1.0), (2, "flat", 1.0), (3, "flat", 1.0)], "cell_id bigint, gene string, value double")
    assert {r["gene"]: r["normalized"] for r in trend.genes_by_trend(one, cells).collect()} == {"x": pytest.approx(1.0), "flat": 0.0}


@pytest.mark.parametrize("dims", [3, 60])
def test_components(spark, matrix, atlas, dims):
    expr, cells = atlas
    more = cells.unionByName(spark.createDataFrame([(1000, "a")], cells.schema))  # a cell without a value
    x = np.concatenate([matrix, np.zeros((1, 60))])
    found = components.principal_components(components.scaled(expr, trend.gene_moments(expr, more), 2.0), more, dims)
    s = np.minimum((x - x.mean(0)) / x.std(0, ddof=1), 2.0)
    s -= s.mean(0)
    values, vectors = np.linalg.eigh(s.T @ s / (len(s) - 1))
    values, vectors = values[::-1][:dims], vectors[:, ::-1][:, :dims]
    weights = np.stack(found.loadings.toPandas().sort_values("gene")["weights"])
    assert np.allclose(found.variances, values, atol=1e-8)
    assert np.allclose(np.linalg.svd(weights.T @ vectors)[1], 1, atol=1e-6)  # the same subspace
    scores = np.stack(found.scores.toPandas().sort_values("cell_id")["pca"])
    assert np.allclose(scores, s @ weights, atol=1e-8)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 5)) * [5, 4, 3, 2, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found, variances = components.vector_components(df, dims=2)
    y = np.stack(found.toPandas().sort_values("id")["pca"])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1][:2]
    assert np.allclose(variances, values) and np.allclose(y.var(0, ddof=1), values)


def test_components_of_nothing(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cell_id bigint")
    none = spark.createDataFrame([], "cell_id bigint, gene string, value double")
    found = components.principal_components(none, cells)
    assert [tuple(r) for r in found.scores.orderBy("cell_id").collect()] == [(1, []), (2, [])] and len(found.variances) == 0
    assert components.principal_components(none, cells.limit(0)).scores.collect() == []
    vectors, variances = components.vector_components(spark.createDataFrame([], "id long, vec array<double>"))
    assert vectors.collect() == [] and len(variances) == 0


def test_build(spark, atlas, tmp_path):
    """Cells that come without clusters: the three kinds are found, and an engine answers from what was written."""
    expr, cells = atlas
    sets = spark.createDataFrame([("own", g, f"set {g}", j, f"g{g * 10 + j:02d}") for g in range(3) for j in range(10)], "collection string, set_ord int, set_name string, gene_ord int, gene string")
    tables = build.build(str(tmp_path), expr, cells, sets=sets, encoder=lambda: hashing_encoder(32), dims=5, genes=60, k=10)
    kinds = {r["cell_id"] // 30: set() for r in tables["cells"].collect()}
    for r in tables["cells"].collect():
        kinds[r["cell_id"] // 30].add(r["cluster_id"])
    assert sorted(len(k) for k in kinds.values()) == [1, 1, 1] and len(set.union(*kinds.values())) == 3
    assert tables["terms"].filter("rank = 1").count() == 3 and tables["manifest"].count() == 1
    engine = Engine.load(spark, str(tmp_path), ("meta", "cells", "synonyms", "terms", "sets"), encoder=hashing_encoder(32))
    best = engine.by_genes(["g00", "g03", "g07"]).first()
    assert {best["cluster_id"]} == kinds[0]
    assert engine.query("g10 g11 cells").count() == 3 and engine.proportions().count() == 3
    assert tables["clusters"].filter("vec IS NULL OR cell_vec IS NULL").count() == 0
