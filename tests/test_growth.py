"""Steps that must not grow faster than their input, where the result doesn't."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellatlas.operators import components, genesets, graph, trend
from cellatlas.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_inner_products(spark, monkeypatch):
    """Blocks give each pair once, the smaller key first."""
    x = np.random.default_rng(5).normal(size=(90, 4))
    rows = spark.createDataFrame([(100 - i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    for size in (20, 1000):
        monkeypatch.setattr(components, "PAIRED", size)
        found = {(r["a"], r["b"]): r["product"] for r in components.inner_products(rows, "k", "v").collect()}
        assert len(found) == components.inner_products(rows, "k", "v").count() == 90 * 91 // 2
        assert all(a <= b and abs(p - x[100 - a] @ x[100 - b]) < 6e-6 for (a, b), p in found.items())
    assert components.inner_products(rows.limit(0), "k", "v").collect() == []


def test_products_meet_in_blocks(spark):
    """Pairs of cells aren't joined row by row, and the values behind the components were written once."""
    found = plan(registry.queries()["component_products"](spark, SF))
    assert "CoGroup" in found and "NestedLoop" not in found and "lineitem" not in found and "zip_with" not in found


def fitted(points, span, count):
    """The trend at knots as its definition says it: all distances of a knot in order."""
    points = sorted(points, key=lambda p: (p[1], p[0]))
    m, q = len(points), max(int(len(points) * span + 1e-5), 3)
    step = lambda r: r * (min(m, count) - 1) // max(m - 1, 1)
    out = {}
    for x0 in {p[1] for r, p in enumerate(points) if r == 0 or step(r) != step(r - 1)}:
        near = sorted((abs(x - x0), g, x, y) for g, x, y in points)[:q]
        h = near[-1][0] or 1.0
        u, y = np.array([(x - x0) / h for _, _, x, _ in near]), np.array([y for *_, y in near])
        w = np.where(np.abs([n[0] for n in near]) < h, (1 - np.abs(u) ** 3) ** 3, 0)
        a = np.stack([u**0, u, u**2], 1)[:, : 3 if len(set(u[w > 0])) > 2 else 2 if len(set(u[w > 0])) == 2 else 1]
        out[x0] = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]
    return out


def test_knots(spark):
    """Means with many ties, at some knots more of them than the genes that count there."""
    rng = np.random.default_rng(8)
    means = np.concatenate([np.full(40, 2.0), rng.integers(1, 9, 30) / 4, rng.uniform(0.1, 3, 50)])
    genes = [(f"g{i:03d}", float(m), float(v)) for i, (m, v) in enumerate(zip(means, rng.uniform(0.5, 2, 120)))]
    wanted = fitted([(g, np.log10(m), np.log10(v)) for g, m, v in genes], 0.3, 12)
    df = spark.createDataFrame(genes, "gene string, mean double, variance double").repartition(5)
    found = {round(r["x"], 12): r["fit"] for r in trend.knots(df, 0.3, 12).collect()}
    assert found.keys() == {round(x, 12) for x in wanted}
    assert all(abs(found[round(x, 12)] - y) < 1e-8 for x, y in wanted.items())


def test_knots_meet_genes_in_sums(spark):
    """No rows of knots and genes are shuffled or ordered; values are not read again where none is cut."""
    found = plan(registry.queries()["genes_by_trend"](spark, SF))
    assert "lineitem" not in found and "x0" not in found and "l_quantity" not in found


def test_some_genes_are_cut(spark):
    """One gene has a value to cut, another none."""
    rng = np.random.default_rng(2)
    rows = [(i, f"g{j}", float(rng.uniform(1, 1 + j / 10))) for i in range(40) for j in range(1, 40) if (i + j) % 3] + [(39, "one", 56.0), (38, "one", 1.0)]
    cells = spark.createDataFrame([(i,) for i in range(40)], "cell_id bigint")
    expr = spark.createDataFrame(rows, "cell_id bigint, gene string, value double")
    found = trend.genes_by_trend(expr, cells).collect()
    cut = 0
    for r in found:
        x = np.array([dict((c, v) for c, g, v in rows if g == r["gene"]).get(i, 0.0) for i in range(40)])
        y = np.minimum(x, r["mean"] + np.sqrt(r["expected"]) * np.sqrt(40))
        cut += bool((y < x).any())
        assert abs(r["normalized"] - ((y - r["mean"]) ** 2).sum() / (39 * r["expected"])) < 1e-8 * max(1, r["normalized"])
    assert 0 < cut < len(found) == 40


def brute(points, k):
    x, ids = np.array([v for _, v in points]), [i for i, _ in points]
    out = {}
    for n, i in enumerate(ids):
        d = np.sqrt(((x - x[n]) ** 2).sum(1))
        out[i] = [(ids[j], d[j]) for j in sorted(range(len(ids)), key=lambda j: (d[j], ids[j])) if j != n][:k]
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_meet(spark, monkeypatch, kind):
    """Vectors without structure: small blocks give what all pairs give, and vectors aren't shuffled for each block."""
    monkeypatch.setattr(graph, "BLOCK", 8 * 12 * 30)  # 30 rows
    monkeypatch.setattr(graph, "TASK", 50)
    calls, met = [], graph._met
    monkeypatch.setattr(graph, "_met", lambda *a: calls.append(a) or met(*a))
    x = np.random.default_rng(6).normal(size=(260, 12))
    x[::9] = x[0]  # equal vectors
    x[5] += 1e3  # far from everything
    points = [(i if kind == "long" else f"k{i}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(points, f"id {kind}, vec array<double>").repartition(3)
    found = {}
    for r in graph.neighbours(df, 4, size=20).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((r["other"], r["distance"]))
    wanted = brute(points, 4)
    assert {i: [o for o, _ in v] for i, v in found.items()} == {i: [o for o, _ in v] for i, v in wanted.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for i in wanted for a, b in zip(found[i], wanted[i]))
    assert len(calls) == 1  # rows met in their own lists only


def test_blocks_without_far_lists(spark, monkeypatch):
    """Groups far from each other: blocks meet, but only lists near enough are compared."""
    monkeypatch.setattr(graph, "VISITS", 0)
    rng = np.random.default_rng(7)
    x = rng.normal(0, 50, (12, 5))[np.arange(300) % 12] + rng.normal(size=(300, 5))
    points = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(points, "id long, vec array<double>")
    found = {}
    for r in graph.neighbours(df, 3, size=10).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["other"])
    assert found == {i: [o for o, _ in v] for i, v in brute(points, 3).items()}


def test_tail_without_a_table(spark):
    """Chances against whole numbers, also where the universe is large, from columns of one row each."""
    cases = [(1, 1, 1, 1), (3, 10, 7, 20), (2, 18, 5, 20), (1, 200, 133, 20000), (9, 200, 133, 20000), (3, 40, 900, 7_000_000), (5, 20, 20, 20)]

    def exact(hits, drawn, size, total):
        ways = sum(math.comb(size, k) * math.comb(total - size, drawn - k) for k in range(hits, min(drawn, size) + 1) if drawn - k <= total - size)
        return ways / math.comb(total, drawn)

    df = spark.createDataFrame(cases, "hits long, drawn long, size long, total long")
    found = df.select("*", genesets.hypergeometric_tail(*[F.col(c) for c in df.columns]).alias("p")).collect()
    assert all(r["p"] == pytest.approx(exact(*list(r)[:4]), rel=1e-7) for r in found)


def test_statistics_are_made_once(spark):
    """Markers and the universe read one table, and no row holds a number for each gene."""
    found = plan(registry.queries()["over_representation"](spark, SF))
    assert "lineitem" not in found and "collect_list" not in found


def test_values_lie_by_gene(spark):
    """The statistics of sparse genes shuffle values once, by gene, and cells meet orders instead of values."""
    df = registry.queries()["gene_stats_sparse"](spark, SF)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(gene") == 1 and "Exchange hashpartitioning(cluster_id#" not in physical.split("HashAggregate", 1)[0]


def test_neighbours_of_communities_are_searched_once(spark, monkeypatch):
    """Both queries read written pairs of ids, not the joins of vectors that give them."""
    edges, both = [], graph._both
    monkeypatch.setattr(graph, "_both", lambda e: edges.append(plan(e)) or both(e))
    for name in ("community_detection", "community_modularity"):
        edges.clear()
        registry.queries()[name](spark, SF)
        assert edges and all("Join" not in p and "Window" not in p and "distance" not in p for p in edges)


def test_equal_vectors_are_found_by_ids(spark, monkeypatch):
    """Vectors don't order or join rows to tell equal ones; floats stay floats; 0.0 equals -0.0."""
    tables, plain = {}, graph.Stages.table
    monkeypatch.setattr(graph.Stages, "table", lambda st, df, name="stage": tables.setdefault(name, (plan(df), df.dtypes)) and plain(st, df, name))
    points = [(i, [float(i % 7), 0.0 if i % 2 else -0.0]) for i in range(30)]
    found = {}
    for r in graph.neighbours(spark.createDataFrame(points, "id long, vec array<float>"), 2).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["other"])
    assert "Window" not in tables["kept"][0] and dict(tables["kept"][1])["v"] == "array<float>"
    assert found == {i: [o for o, _ in v] for i, v in brute(points, 2).items()}
