"""Queries of plot data, outside baselines, whole sessions, and statistics that are kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evalkit, genesets, interact, meta, plots, profile, rank, state
from ..sources.staged import shared_folder
from .base import query, rounded
from .fixture import CELLS, DENSE, META, PAIRS, SETS, SPARSE, STATS, VECTORS

COSINES = """q AS (SELECT vec_id AS qid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IN (0, 100)),
ql AS (SELECT qid, sqrt(sum(CAST(x AS DOUBLE) * x)) AS len FROM q GROUP BY 1),
cs AS (SELECT qid, label AS cluster_id, sum(x / len * v) AS score FROM q JOIN ql USING (qid) JOIN cents USING (i) GROUP BY 1, 2),
two AS (SELECT CAST(a.cluster_id AS BIGINT) AS cluster_id, a.score AS semantic, b.score AS expression, a.rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, cluster_id) AS rank FROM cs WHERE qid = 0) a JOIN (SELECT * FROM cs WHERE qid = 100) b USING (cluster_id))"""


def _scores(a, qid):
    return rank.semantic_ranking(a.vector_queries.filter(F.col("qid") == qid), a.vectors, None).drop("qid")


def _results(a):
    return _scores(a, 0).select("cluster_id", F.col("score").alias("semantic")).join(_scores(a, 100).select("cluster_id", F.col("score").alias("expression")), "cluster_id")


@query("SELECT cluster_id, round(semantic, 6) AS semantic, round(expression, 6) AS expression, rank <= 3 AS retrieved FROM two", VECTORS, COSINES)
def plot_scatter(a):
    one = _scores(a, 0)
    return rounded(plots.scatter(one, _scores(a, 100), one.filter("rank <= 3")))


@query("SELECT cluster_id, CAST(0 AS BIGINT) AS place, 'semantic' AS metric, round(semantic, 6) AS value FROM two UNION ALL SELECT cluster_id, 1, 'expression', round(expression, 6) FROM two", VECTORS, COSINES)
def plot_profile(a):
    return rounded(plots.profile(_results(a)))


@query("SELECT cluster_id, round(semantic, 6) AS similarity, rank AS place FROM two", VECTORS, COSINES)
def plot_waterfall(a):
    """Results without a hybrid score are shown by the other one."""
    return rounded(plots.waterfall(_results(a)))


@query("SELECT cluster_id, 'semantic' AS mode, round(semantic, 6) AS coverage FROM two UNION ALL SELECT cluster_id, 'expression', round(expression, 6) FROM two", VECTORS, COSINES)
def plot_coverage(a):
    return rounded(plots.coverage(_results(a), "cluster_id", ["semantic", "hybrid", "expression"]))


SPLIT = """top AS (SELECT gene, row_number() OVER (ORDER BY abs(round(logfc, 9)) DESC, gene) AS rank FROM stats WHERE cluster_id = 'NATION_3'), known AS (SELECT DISTINCT p_name AS gene FROM part WHERE p_partkey % 4 = 0)"""


@query("SELECT gene, CASE WHEN k THEN 'expected' ELSE 'context-shifted' END AS kind, row_number() OVER (ORDER BY CASE WHEN k THEN 0 ELSE 1 END, rank, gene) AS place FROM (SELECT *, gene IN (SELECT gene FROM known) AS k FROM top WHERE rank <= 30)", CELLS, DENSE, STATS, SPLIT)
def plot_split(a):
    own = a.dense_stats.filter("cluster_id = 'NATION_3'").withColumn("logfc", F.round("logfc", 9))
    return plots.discovery_split(rank.top_genes(own), a.table("part").filter("p_partkey % 4 = 0").select(F.upper("p_name").alias("gene_u")))


@query(
    """, qv AS (SELECT vec_id AS qid, CASE WHEN vec_id % 200 = 0 THEN embedding END AS e FROM embeddings WHERE vec_id % 100 = 0), qx AS (SELECT qid, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM qv WHERE e IS NOT NULL),
ln AS (SELECT qid, sqrt(sum(CAST(x AS DOUBLE) * x)) AS len FROM qx GROUP BY 1), cl AS (SELECT label, sqrt(sum(v * v)) AS len FROM cents GROUP BY 1),
sc AS (SELECT qv.qid, cl.label AS cluster_id, any_value(e IS NULL) AS random, sum(x * v) / ((any_value(ln.len) + 1e-8) * (any_value(cl.len) + 1e-8)) AS score FROM qv CROSS JOIN cl LEFT JOIN ln USING (qid) LEFT JOIN cents ON cents.label = cl.label LEFT JOIN qx ON qx.qid = qv.qid AND qx.i = cents.i GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, CASE WHEN score IS NULL THEN md5(qid || '|' || cluster_id) END, cluster_id) AS rank FROM sc)
SELECT qid, CAST(cluster_id AS BIGINT) AS cluster_id, rank, round(score, 6) AS score, random FROM rk WHERE rank <= 5""",
    VECTORS,
)
def outside_baseline(a):
    """Every second query has no vector, as if the model couldn't be read, and says so."""
    own = a.table("embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.when(F.col("vec_id") % 200 == 0, F.col("embedding").cast("array<double>")).alias("vec"))
    return rounded(rank.baseline_ranking(own, a.vectors, 5))


@query("SELECT CAST(label AS BIGINT) AS label, count(*) AS cells, min(id) AS first, max(id) AS last, CAST(sum(id) AS BIGINT) AS ids, any_value(m) AS mean FROM (SELECT label, vec_id AS id FROM embeddings) JOIN (SELECT label, round(sum(m), 6) AS m FROM means GROUP BY 1) USING (label) GROUP BY 1", VECTORS)
def pooled_vectors(a):
    """Means as they are, and the cells of each group as rows, whose places have no gap."""
    vectors, members = profile.pooled(a.table("embeddings"), "label", "embedding", "vec_id")
    own = members.groupBy("label").agg(F.max("place").alias("cells"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.sum("vec_id").alias("ids"))
    return rounded(own.join(vectors.select("label", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("mean")), "label"))


@query("SELECT cluster_id, CASE WHEN cluster_id = 'NATION_3' THEN 'third' WHEN length(cluster_id) > 8 THEN substr(cluster_id, 1, 7) || '.' ELSE cluster_id END AS short FROM clusters", CELLS)
def display_names(a):
    return a.clusters.select("cluster_id", T.short_name(F.col("cluster_id"), 8, {"NATION_3": "third"}).alias("short"))


@query("SELECT count(DISTINCT col) > 0 AS has_conditions, max(col) AS condition_column, string_agg(DISTINCT value, ',' ORDER BY value) AS condition_values, (SELECT count(*) FROM clusters) AS n_clusters FROM meta WHERE col = (SELECT col FROM meta WHERE contains('market segment', col) GROUP BY col_ord, col HAVING count(DISTINCT value) BETWEEN 2 AND 10 ORDER BY col_ord LIMIT 1)", CELLS, META)
def capability_record(a):
    found = meta.capabilities(a.clusters, a.meta, a.spark.createDataFrame([(0, "disease"), (1, "market segment")], "kw_ord int, kw string"))
    return found.withColumn("condition_values", F.array_join("condition_values", ","))


# Sessions

SESSION = """bysize AS (SELECT cluster_id, row_number() OVER (ORDER BY n_in DESC, cluster_ord) AS rank FROM sizes JOIN clusters USING (cluster_id)),
tg AS (SELECT cluster_id, gene, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(round(logfc, 9)) DESC, gene) AS r FROM stats),
lg AS (SELECT gene FROM tg JOIN bysize USING (cluster_id) WHERE rank <= 3 AND r <= 30)"""
_TEXT = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"
SAID = rf"""said AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all({_TEXT}, '\b([A-Z][A-Z0-9-]{{1,15}})\s*\(ENSG\d+', 1), regexp_extract_all({_TEXT}, '\b([A-Z][A-Z0-9]{{1,12}}(?:-[A-Z0-9]+)?)\b', 1))) AS gene FROM conversations)"""


@query(
    """SELECT gene, count(DISTINCT kind) AS n_sources FROM (SELECT gene, 0 AS kind FROM lg UNION ALL SELECT gene, 1 FROM tg WHERE cluster_id = 'NATION_3' AND r <= 20 UNION ALL SELECT gene, 2 FROM sets WHERE set_ord = 1
UNION ALL SELECT gene, 3 FROM (SELECT gene, row_number() OVER (PARTITION BY s.cluster_id, set_name ORDER BY pct_in DESC, gene_ord) AS r FROM sets JOIN stats s USING (gene) WHERE set_ord = 1) WHERE r <= 5 UNION ALL SELECT gene, 4 FROM said) GROUP BY 1""",
    CELLS,
    SPARSE,
    STATS,
    SETS,
    SESSION,
    SAID,
)
def session_genes(a):
    """Genes of hits, of a compared cluster, of a set, of its best entries, and those that conversations name."""
    top = rank.top_genes(a.sparse_stats.withColumn("logfc", F.round("logfc", 9)), 30)
    sized = a.cells.groupBy("cluster_id").count().join(a.clusters, "cluster_id").orderBy(F.desc("count"), "cluster_ord").limit(3)
    one = a.sets.filter("set_ord = 1")
    best = genesets.top_set_genes(a.sparse_stats, one).withColumnRenamed("gene_u", "gene")
    return evalkit.session_genes(top.join(sized.select("cluster_id"), "cluster_id", "left_semi"), top.filter("cluster_id = 'NATION_3' AND rank <= 20"), one, best, a.table("conversations").select("text"))


TRUTH = """truth AS (SELECT lower(n_name) AS source, r_name || CASE WHEN n_nationkey % 2 = 0 THEN ' ' || n_name ELSE '' END AS target FROM nation JOIN region ON r_regionkey = n_regionkey),
lr AS (SELECT DISTINCT lower(l.cluster_id) AS source, lower(r.cluster_id) AS target FROM pairs JOIN stats l ON l.gene_u = upper(ligand) JOIN stats r ON r.gene_u = upper(receptor) WHERE l.pct_in >= 0.05 AND r.pct_in >= 0.05 AND l.cluster_id <> r.cluster_id),
summary AS (SELECT lower(cluster_id) AS source, lower(cluster_id) AS target FROM clusters WHERE cluster_ord < 5)"""
_HIT = "EXISTS (SELECT 1 FROM {0} p WHERE (contains(p.source, lower(t.source)) OR contains(lower(t.source), p.source)) AND (contains(p.target, lower(t.target)) OR contains(lower(t.target), p.target)))"


def _truth(a):
    own = a.table("nation").join(a.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    target = F.concat("r_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), "n_name")).otherwise(""))
    return own.select(F.lower("n_name").alias("source"), target.alias("target"))


def _predicted(a):
    return interact.interactions(a.sparse_stats, a.pairs, min_ligand=0.05, min_receptor=0.05).select("source", "target")


@query(f"SELECT count(*) AS n, CAST(sum(h) AS BIGINT) AS n_found, round(avg(h), 6) AS rate FROM (SELECT CASE WHEN {_HIT.format('(SELECT * FROM lr UNION ALL SELECT * FROM summary)')} THEN 1 ELSE 0 END AS h FROM truth t)", CELLS, SPARSE, STATS, PAIRS, TRUTH)
def paper_interactions_by_summary(a):
    """Some pairs are known by their summary only."""
    some = a.clusters.filter("cluster_ord < 5")
    return rounded(evalkit.paper_interactions(_truth(a), _predicted(a), some.select(F.col("cluster_id").alias("source"), F.col("cluster_id").alias("target"))))


THEMES = (("first", "the"), ("first", "zzz"), ("second", "zzzz"), ("third", "ION"))
CARD = f"""want AS (SELECT DISTINCT upper(p_name) AS g FROM part), got AS (SELECT DISTINCT gene_u AS g FROM stats WHERE cluster_id IN ('NATION_3', 'NATION_7') AND pct_in >= 0.4),
a1 AS (SELECT 100 * avg(CASE WHEN g IN (SELECT g FROM got) THEN 1.0 ELSE 0 END) AS gene_recall FROM want),
a2 AS (SELECT 100 * avg(CASE WHEN EXISTS (SELECT 1 FROM nsets WHERE contains(lower(set_name), lower(w)) OR contains(lower(w), lower(set_name))) THEN 1.0 ELSE 0 END) AS pathway_coverage FROM (SELECT DISTINCT p_type AS w FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part)),
a3 AS (SELECT 100 * avg(CASE WHEN {_HIT.format('summary')} THEN 1.0 ELSE 0 END) AS interaction_recall FROM truth t),
said AS (SELECT text FROM benchmark ORDER BY item_id LIMIT 1),
a4 AS (SELECT 100 * avg(h) AS theme_coverage FROM (SELECT theme, max(CASE WHEN contains(lower(text), lower(kw)) THEN 1.0 ELSE 0 END) AS h FROM (VALUES {", ".join(str(t) for t in THEMES)}) v(theme, kw) CROSS JOIN said GROUP BY 1)),
a5 AS (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS report_words FROM said)"""


@query("SELECT round(gene_recall, 6) AS gene_recall, round(pathway_coverage, 6) AS pathway_coverage, round(interaction_recall, 6) AS interaction_recall, round(theme_coverage, 6) AS theme_coverage, true AS proportions_available, CAST(report_words AS BIGINT) AS report_words, round(0.3 * gene_recall + 0.2 * pathway_coverage + 0.15 * interaction_recall + 0.25 * theme_coverage + 10, 6) AS composite_score FROM a1, a2, a3, a4, a5", CELLS, DENSE, STATS, SETS, PAIRS, TRUTH, CARD)
def replication_scorecard(a):
    """All five terms of the score from tables: genes, sets, interactions, themes of a text, proportions."""
    part = a.table("part")
    second = F.split("p_name", " ")[1]
    found = a.dense_stats.filter("cluster_id IN ('NATION_3', 'NATION_7') AND pct_in >= 0.4").select("gene_u")
    pathways = part.select(F.col("p_type").alias("pathway")).unionByName(part.select(second.alias("pathway"))).distinct()
    some = a.clusters.filter("cluster_ord < 5")
    text = a.table("benchmark").orderBy("item_id").first()["text"]
    themes = a.spark.createDataFrame(THEMES, "theme string, keyword string")
    card = evalkit.scorecard(part.select(F.upper("p_name").alias("gene_u")), found, pathways, part.select(second.alias("set_name")), _truth(a), some.select(F.col("cluster_id").alias("source"), F.col("cluster_id").alias("target")), themes, text, meta.composition(a.cells))
    return rounded(card)


# Statistics kept up to date: even and odd cells come one after the other


def _counts(a, expr=None):
    root, expr = f"{shared_folder(a.spark)}/counts-{uuid.uuid4().hex}", expr or a.dense
    for i in (0, 1):
        state.add_batch(root, i, expr.filter(F.col("cell_id") % 2 == i), a.cells.filter(F.col("cell_id") % 2 == i), ["segment", "balance"])
    return state.read_counts(a.spark, root)


@query("SELECT cluster_id, gene, CAST(nnz AS BIGINT) AS nnz, round(pct_in, 6) AS pct_in, round(pct_out, 6) AS pct_out, round(logfc, 6) AS logfc FROM stats", CELLS, DENSE, STATS)
def gene_stats_of_batches(a):
    return rounded(_counts(a).gene_stats().select("cluster_id", "gene", "nnz", "pct_in", "pct_out", "logfc"))


@query("SELECT cluster_id, n_cells, col, value, n, round(frac, 6) AS frac FROM meta", CELLS, META)
def metadata_of_batches(a):
    return rounded(_counts(a).cluster_metadata().drop("col_ord"))
