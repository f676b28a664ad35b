"""Plot data by hand, and a layout that keeps neighbours."""

import numpy as np
import pytest

from cellatlas.operators import components, graph, layout, plots, stats


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([("a", 0.9, None), ("b", 0.5, 0.7), ("c", None, None)], "cluster_id string, semantic double, hybrid double")


def test_waterfall(results):
    assert rows(plots.waterfall(results)) == [("a", 0.9, 1), ("b", 0.7, 2), ("c", 0.0, 3)]
    assert rows(plots.waterfall(results, "none", "never")) == [("a", 0.0, 1), ("b", 0.0, 2), ("c", 0.0, 3)]


def test_profile(spark, results):
    """The metric that no result has is left out; with none at all, the first is shown as 0."""
    assert rows(plots.profile(results, ["semantic", "expression", "hybrid"])) == [("a", 0, "semantic", 0.9), ("a", 1, "hybrid", 0.0), ("b", 0, "semantic", 0.5), ("b", 1, "hybrid", 0.7), ("c", 0, "semantic", 0.0), ("c", 1, "hybrid", 0.0)]
    none = results.filter("cluster_id = 'c'")
    assert rows(plots.profile(none)) == [("c", 0, "semantic", 0.0)]
    assert rows(plots.profile(none.select("cluster_id"))) == [("c", 0, "semantic", 0.0)]
    assert rows(plots.coverage(results, "cluster_id", ["semantic", "hybrid", "x"])) == [("a", "semantic", 0.9), ("b", "hybrid", 0.7), ("b", "semantic", 0.5)]


def test_scatter_and_split(spark, results):
    a = spark.createDataFrame([("a", 0.9), ("b", 0.2)], "cluster_id string, score double")
    b = spark.createDataFrame([("b", 0.4), ("c", 0.1)], "cluster_id string, score double")
    assert rows(plots.scatter(a, b, a.limit(1))) == [("a", 0.9, 0.0, True), ("b", 0.2, 0.4, False), ("c", 0.0, 0.1, False)]
    found = spark.createDataFrame([("X", 1), ("y", 2), ("Z", 3), ("X", 9)], "gene string, rank int")
    known = spark.createDataFrame([("Y",), ("Q",)], "gene_u string")
    assert rows(plots.discovery_split(found, known)) == [("X", "context-shifted", 2), ("Z", "context-shifted", 3), ("y", "expected", 1)]


def test_landscapes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 4)) * [4, 2, 1, 0.1]
    df = spark.createDataFrame([(f"c{i}", v.tolist(), v[::-1].tolist() if i else None) for i, v in enumerate(x)], "cluster_id string, vec array<double>, other array<double>")
    found = plots.landscapes(df, df.limit(2), texts="vec", cells="other").toPandas()
    own = found[found["space"] == "texts"].sort_values("cluster_id", key=lambda c: c.str[1:].astype(int))
    assert len(own) == 12 and (found["space"] == "cells").sum() == 11 and own["retrieved"].sum() == 2
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1][:2]
    assert np.allclose([own["x"].var(), own["y"].var()], values)
    genes = spark.createDataFrame([("c1", "G", 2.0), ("c2", "G", -3.0)], "cluster_id string, gene string, logfc double")
    sets = plots.retrieval_plots(df, df.select("cluster_id").limit(2), genes, "hybrid", texts="vec")
    assert {k: v.count() for k, v in sets.items()} == {"landscapes": 12, "gene_evidence": 1, "similarity": 2, "gene_heatmap": 2, "profile": 2}


def test_numbered(spark):
    df = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 7)], "k string, id long")
    found = stats.numbered(df, "k", "id").collect()
    assert sorted(r["place"] for r in found if r["k"] == "a") == list(range(1, 201)) and [r["place"] for r in found if r["k"] == "b"] == [1]


def purity(points, labels, k=8):
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return (labels[np.argsort(d, 1)[:, :k]] == labels[:, None]).mean()


def test_layout(spark):
    """Eight groups in twelve dimensions: in two, more of a vertex's neighbours are of its group than by components."""
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 3, (8, 12))
    labels = np.arange(160) % 8
    x = middle[labels] + rng.normal(0, 1.3, (160, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    near = graph.neighbours(df, 8).select("id", "other")
    start, _ = components.vector_components(df)
    at = layout.graph_layout(near, start, rounds=25).toPandas().sort_values("id")
    flat = np.stack(start.toPandas().sort_values("id")["pca"])
    kept, before = purity(at[["x", "y"]].to_numpy(), labels), purity(flat, labels)
    assert kept > before + 0.05 and kept > 0.9, (kept, before)


def test_layout_of_little(spark):
    none = spark.createDataFrame([], "id string, other string")
    assert layout.graph_layout(none, rounds=2).collect() == []
    pair = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "a")], "id string, other string")
    first, second = (rows(layout.graph_layout(pair, rounds=3)) for _ in range(2))
    assert first == second and [r[0] for r in first] == ["a", "b"]
