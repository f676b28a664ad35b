"""Queries over cells that come without clusters: variable genes, components, neighbours, communities."""

from __future__ import annotations

from ..operators import components, graph, trend
from ..sources.staged import Stages
from .base import query, rounded
from .fixture import CELLS, DENSE, SPARSE

MOMENTS = """mom AS (SELECT gene, CAST(n AS DOUBLE) AS n, s / n AS mean, greatest((q - s * (s / n)) / (n - 1), 0) AS variance FROM (SELECT gene, sum(value) AS s, sum(value * value) AS q FROM expr GROUP BY 1), (SELECT count(*) AS n FROM cells))"""
_DET = "s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)"
TREND = f"""pts AS (SELECT gene, x, y, row_number() OVER (ORDER BY x, gene) AS r, count(*) OVER () AS m FROM (SELECT gene, log10(mean) AS x, log10(variance) AS y FROM mom WHERE variance > 0 AND mean > 0)),
chosen AS (SELECT DISTINCT x AS x0, greatest(floor(m * 0.3 + 1e-5), 3) AS q FROM pts WHERE r = 1 OR floor((r - 1) * (least(m, 200) - 1) / greatest(m - 1, 1)) <> floor((r - 2) * (least(m, 200) - 1) / greatest(m - 1, 1))),
near AS (SELECT x0, x, y, d, CASE WHEN max(d) OVER (PARTITION BY x0) > 0 THEN max(d) OVER (PARTITION BY x0) ELSE 1 END AS h FROM (SELECT x0, q, x, y, abs(x - x0) AS d, row_number() OVER (PARTITION BY x0 ORDER BY abs(x - x0), gene) AS place FROM chosen CROSS JOIN pts) WHERE place <= q),
weighed AS (SELECT x0, (x - x0) / h AS u, y, CASE WHEN d < h THEN power(1 - power(abs((x - x0) / h), 3), 3) ELSE 0 END AS w FROM near),
sums AS (SELECT x0 AS x, {", ".join(f"sum(w * power(u, {i})) AS s{i}" for i in range(5))}, {", ".join(f"sum(w * y * power(u, {i})) AS t{i}" for i in range(3))} FROM weighed GROUP BY 1),
knots AS (SELECT x, CASE WHEN {_DET} > 1e-9 * s0 * s0 * s0 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / ({_DET}) WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 THEN (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS fit FROM sums),
spans AS (SELECT x, fit, lead(x) OVER (ORDER BY x) AS x2, lead(fit) OVER (ORDER BY x) AS fit2 FROM knots),
fitted AS (SELECT mom.*, power(10, CASE WHEN x2 IS NULL THEN fit ELSE fit + (pts.x - spans.x) / (x2 - spans.x) * (fit2 - fit) END) AS expected FROM mom LEFT JOIN pts USING (gene) LEFT JOIN spans ON pts.x >= spans.x AND (x2 IS NULL OR pts.x < x2)),
cut AS (SELECT gene, sum(least(value, mean + sqrt(expected) * sqrt(n))) AS s, sum(power(least(value, mean + sqrt(expected) * sqrt(n)), 2)) AS q FROM expr JOIN fitted USING (gene) GROUP BY 1),
normal AS (SELECT gene, mean, variance, expected, coalesce((n * mean * mean + q - 2 * mean * s) / ((n - 1) * expected), 0) AS normalized FROM fitted JOIN cut USING (gene))"""


@query("SELECT gene, round(mean, 6) AS mean, round(variance, 6) AS variance, round(expected, 6) AS expected, round(normalized, 6) AS normalized FROM normal ORDER BY normalized DESC, gene LIMIT 3000", CELLS, SPARSE, MOMENTS, TREND)
def genes_by_trend(a):
    return rounded(trend.genes_by_trend(a.sparse_by_gene, a.cells).drop("rank"))


SCALED = """sc AS (SELECT cell_id, gene, least((value - mean) / sd, 10) + mean / sd AS v FROM expr JOIN (SELECT gene, mean, CASE WHEN variance > 0 THEN sqrt(variance) ELSE 1 END AS sd FROM mom) USING (gene)),
mg AS (SELECT gene, sum(v) / (SELECT count(*) FROM cells) AS m FROM sc GROUP BY 1),
prod AS (SELECT a.gene AS g, b.gene AS h, sum(a.v * b.v) AS p FROM sc a JOIN sc b USING (cell_id) GROUP BY 1, 2),
cov AS (SELECT a.gene AS g, b.gene AS h, (coalesce(p, 0) - (SELECT count(*) FROM cells) * a.m * b.m) / ((SELECT count(*) FROM cells) - 1) AS c FROM mg a CROSS JOIN mg b LEFT JOIN prod ON g = a.gene AND h = b.gene),
square AS (SELECT a.g, b.h, sum(a.c * b.c) AS c FROM cov a JOIN cov b ON a.h = b.g GROUP BY 1, 2)"""


def _scaled(a):
    dense = Stages(a.spark).table(a.dense, "values")  # moments, sums and rows read it
    return components.scaled(dense, trend.gene_moments(dense, a.cells))


@query("SELECT 1 AS power, round((SELECT sum(c) FROM cov WHERE g = h), 5) AS total UNION ALL SELECT 2, round((SELECT sum(c) FROM square WHERE g = h), 5) UNION ALL SELECT 3, round((SELECT sum(a.c * b.c) FROM square a JOIN cov b ON a.g = b.h AND a.h = b.g), 4)", CELLS, DENSE, MOMENTS, SCALED)
def component_variances(a):
    """Sums of powers of all components' variances, which must be the traces of the covariance's powers."""
    found = components.principal_components(_scaled(a), a.cells, 1 << 20).variances
    return a.spark.createDataFrame([(k, round(float((found**k).sum()), 5 if k < 3 else 4)) for k in (1, 2, 3)], "power int, total double")


@query(
    """, x AS (SELECT c.cell_id, m.gene, coalesce(v, 0) - m AS v FROM cells c CROSS JOIN mg m LEFT JOIN sc ON sc.cell_id = c.cell_id AND sc.gene = m.gene WHERE c.cell_id % 50 = 0)
SELECT a.cell_id AS a, b.cell_id AS b, round(sum(a.v * b.v), 5) AS product FROM x a JOIN x b USING (gene) WHERE a.cell_id <= b.cell_id GROUP BY 1, 2""",
    CELLS,
    DENSE,
    MOMENTS,
    SCALED,
)
def component_products(a):
    """Inner products of cells' scores in all components, which must be those of the centred cells: every fiftieth cell."""
    own = components.principal_components(_scaled(a), a.cells, 1 << 20).scores.filter("cell_id % 50 = 0")
    return components.inner_products(own, "cell_id", "pca")


# Communities: the rounds of graph.modular_communities, one after the other

ROUNDS, LEVELS, NEAR = 5, 2, 5
_KNN = f"""v AS (SELECT vec_id AS id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), d AS (SELECT a.id, b.id AS other, sum(power(CAST(a.x AS DOUBLE) - b.x, 2)) AS d FROM v a JOIN v b ON a.i = b.i AND a.id <> b.id GROUP BY 1, 2),
knn AS MATERIALIZED (SELECT id, other FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), other) AS r FROM d) WHERE r <= {NEAR}),
e0 AS MATERIALIZED (SELECT DISTINCT *, 1 AS w FROM (SELECT id, other FROM knn UNION ALL SELECT other, id FROM knn)),
total AS (SELECT CAST(sum(w) AS DOUBLE) AS t FROM e0)"""


def _moves_sql(nodes: str, edges: str, out: str) -> list[str]:
    """CTEs from `nodes` (id, c, k) over `edges` to `out`, as graph._moved does it."""
    own, now = [], nodes
    for t in range(ROUNDS):
        near = f"SELECT e.id, n.c, w FROM {edges} e JOIN {now} n ON n.id = e.other WHERE e.id <> e.other UNION ALL SELECT id, c, 0 FROM {now}"
        gain = f"(SELECT t FROM total) * x.w - CAST(n.k AS DOUBLE) * (s.k - CASE WHEN x.c = n.c THEN n.k ELSE 0 END)"
        own.append(f"{out}_g{t} AS MATERIALIZED (SELECT x.id, x.c, n.c AS mine, n.k, {gain} AS gain FROM (SELECT id, c, sum(w) AS w FROM ({near}) GROUP BY 1, 2) x JOIN {now} n ON n.id = x.id JOIN (SELECT c, sum(k) AS k FROM {now} GROUP BY 1) s ON s.c = x.c)")
        best = f"SELECT id, mine, k, c, gain, max(CASE WHEN c = mine THEN gain END) OVER (PARTITION BY id) AS now, row_number() OVER (PARTITION BY id ORDER BY gain DESC, c) AS r FROM {out}_g{t}"
        own.append(f"{out}_n{t} AS MATERIALIZED (SELECT id, CASE WHEN gain > now AND substr(md5(id || '|{t}'), 1, 1) < '8' THEN c ELSE mine END AS c, k FROM ({best}) WHERE r = 1)")
        now = f"{out}_n{t}"
    own.append(f"{out} AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY c) AS c, k FROM {now})")
    return own


def _communities_sql() -> list[str]:
    own = [_KNN, "s0 AS MATERIALIZED (SELECT id, id AS c, CAST(sum(w) AS BIGINT) AS k FROM e0 GROUP BY 1)", "of0 AS (SELECT id, id AS node FROM s0)"]
    for i in range(LEVELS):
        own += _moves_sql(f"s{i}", f"e{i}", f"m{i}")
        own += [f"i{i} AS MATERIALIZED (SELECT e.id, e.other, e.w FROM e{i} e JOIN m{i} a ON a.id = e.id JOIN m{i} b ON b.id = e.other WHERE a.c = b.c)", f"r{i} AS (SELECT id, id AS c, k FROM m{i})"]
        own += _moves_sql(f"r{i}", f"i{i}", f"p{i}")
        own += [
            f"of{i + 1} AS MATERIALIZED (SELECT o.id, p.c AS node FROM of{i} o JOIN p{i} p ON p.id = o.node)",
            f"s{i + 1} AS MATERIALIZED (SELECT p.c AS id, min(w.name) AS c, CAST(sum(p.k) AS BIGINT) AS k FROM p{i} p JOIN m{i} m ON m.id = p.id JOIN (SELECT m.c, min(p.c) AS name FROM p{i} p JOIN m{i} m ON m.id = p.id GROUP BY 1) w ON w.c = m.c GROUP BY 1)",
            f"e{i + 1} AS MATERIALIZED (SELECT a.c AS id, b.c AS other, CAST(sum(e.w) AS BIGINT) AS w FROM e{i} e JOIN p{i} a ON a.id = e.id JOIN p{i} b ON b.id = e.other GROUP BY 1, 2)",
        ]
    own.append(f"found AS MATERIALIZED (SELECT o.id, min(o.id) OVER (PARTITION BY s.c) AS community FROM of{LEVELS} o JOIN s{LEVELS} s ON s.id = o.node)")
    return own


COMMUNITIES = _communities_sql()


def _near(a):
    """The neighbours' ids, written once: edges are read in both directions."""
    st = Stages(a.spark)
    return st.table(graph.neighbours(a.table("embeddings"), NEAR, "vec_id", "embedding").select("id", "other"), "near")


@query("SELECT id, community FROM found", *COMMUNITIES)
def community_detection(a):
    return graph.modular_communities(_near(a), rounds=ROUNDS, levels=LEVELS)


@query(
    """SELECT round(sum(inside / t - power(k / t, 2)), 6) AS modularity FROM (SELECT a.community, sum(CASE WHEN a.community = b.community THEN 1 ELSE 0 END) AS inside, CAST(count(*) AS DOUBLE) AS k FROM e0 JOIN found a USING (id) JOIN found b ON b.id = other GROUP BY 1), total""",
    *COMMUNITIES,
)
def community_modularity(a):
    near = _near(a)
    return rounded(graph.modularity(near, graph.modular_communities(near, rounds=ROUNDS, levels=LEVELS)))
