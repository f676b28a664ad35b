"""Queries along the paths that users take: the engine's entries, files that go out and come back, arms of operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..edge.engine import Engine
from ..functions import text as T
from ..functions import vectors as V
from ..operators import build, encode, meta, rank
from ..sources import catalog
from ..sources.staged import shared_folder
from .base import query, rounded
from .cells import MOMENTS, SCALED
from .fixture import CELLS, DENSE, META, SETS, SPARSE, STATS, VECTORS
from .more import SUMMARY_DEFAULT


def _folder(a) -> str:
    return f"{shared_folder(a.spark)}/out-{uuid.uuid4().hex}"


# Files that go out and come back


@query("SELECT CAST(cell_id AS VARCHAR) AS cell_id, cluster_id, segment FROM cells", CELLS)
def cells_as_csv(a):
    root = _folder(a)
    catalog.write_cells(a.cells, root, ["cell_id", "cluster_id", "segment"])
    return catalog.read_cells(a.spark, root)


@query("SELECT cluster_id, n_in AS n FROM sizes", CELLS)
def results_as_json(a):
    root = _folder(a)
    catalog.write_results(a.cells.groupBy("cluster_id").agg(F.count("*").alias("n")), root)
    return a.spark.read.json(root)


@query("SELECT 'ENSG' || (p_partkey // 3) AS base_id, arg_max(p_name, p_partkey) AS symbol FROM part GROUP BY 1")
def gene_map_of_csv(a):
    """Versions are cut off, and of repeated ids the last row counts: one sorted file keeps their order."""
    root = _folder(a)
    part = a.table("part").select(F.concat(F.lit("ENSG"), F.floor(F.col("p_partkey") / 3).cast("string"), F.lit("."), F.col("p_partkey").cast("string")).alias("feature_id"), F.col("p_name").alias("feature_name"), "p_partkey")
    part.repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey").drop("p_partkey").write.csv(root, header=True)
    return catalog.gene_map(a.spark, root)


@query("SELECT cluster_id, gene_u, round(pct_in, 6) AS pct_in FROM stats", CELLS, SPARSE, STATS)
def stats_of_catalog(a):
    root = _folder(a)
    catalog.write_table(a.sparse_stats, root, "gene_stats")
    return rounded(catalog.read_table(a.spark, root, "gene_stats").select("cluster_id", "gene_u", "pct_in"))


@query("SELECT count(*) FILTER (starts_with(g, 'ENSG')) >= 5 AS ensembl FROM (SELECT CASE WHEN p_partkey % 3 > 0 THEN 'ENSG' || p_partkey ELSE p_name END AS g FROM part ORDER BY p_partkey LIMIT 10)")
def ensembl_names(a):
    own = a.table("part").select(F.col("p_partkey").alias("gene_idx"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("symbol"))
    return a.spark.createDataFrame([(catalog.looks_ensembl(own),)], "ensembl boolean")


# The engine's entries

ONE = """asked AS (SELECT unnest(['G1', 'G2', 'G7', 'NOSUCH1']) AS gene_u), hit AS (SELECT cluster_id, sum((0.5 + abs(logfc)) * (0.3 + greatest(pct_in - pct_out, 0)) * CASE WHEN pct_in > 0.5 THEN 1.3 ELSE 1 END) AS s, count(*) AS h FROM asked JOIN stats USING (gene_u) GROUP BY 1),
won AS (SELECT cluster_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, cluster_ord) AS rank FROM (SELECT cluster_id, cluster_ord, coalesce(s * (0.5 + 0.5 * h / 4), 0) AS score FROM clusters LEFT JOIN hit USING (cluster_id)))"""


@query("SELECT rank, cluster_id, round(score, 6) AS score FROM won WHERE rank <= 10", CELLS, SPARSE, STATS, ONE)
def engine_query(a):
    """A text that names genes is parsed, routed and ranked by the engine."""
    found = Engine(a.clusters, a.sparse_stats).query("G1, g2; G7 NOSUCH1")
    return rounded(found.select("rank", "cluster_id", "score"))


@query("SELECT rank, cluster_id, round(score, 6) AS score FROM won WHERE rank <= 10", CELLS, SPARSE, STATS, ONE)
def engine_hybrid(a):
    """With no weight on meaning it is the ranking by genes."""
    return rounded(Engine(a.clusters, a.sparse_stats).hybrid("G1 G2 G7 NOSUCH1", share=0.0).select("rank", "cluster_id", "score"))


NEAREST = """q AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id = 0), ql AS (SELECT sqrt(sum(CAST(x AS DOUBLE) * x)) AS len FROM q),
cs AS (SELECT label, sum(x / len * v) AS score FROM q CROSS JOIN ql JOIN cents USING (i) GROUP BY 1)"""
_NEAREST = "SELECT rank, CAST(label AS VARCHAR) AS cluster_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, label) AS rank FROM cs) WHERE rank <= {0}"


def _meaning(a) -> Engine:
    """An engine over labels as clusters, whose encoder knows the vector of row 0."""
    own = a.vectors.withColumn("cluster_id", F.col("cluster_id").cast("string"))
    row = a.vector_queries.filter("qid = 0").first()
    return Engine(own, a.dense_stats, encoder=lambda texts: [row["vec"] for _ in texts])


@query(_NEAREST.format(10), VECTORS, NEAREST)
def engine_annotation(a):
    return rounded(_meaning(a).by_annotation("anything").select("rank", "cluster_id", "score"))


@query(_NEAREST.format(5), VECTORS, NEAREST)
def engine_discover(a):
    return rounded(_meaning(a).discover("anything").select("rank", "cluster_id", "score"))


PROMO = """one AS (SELECT * FROM sets WHERE set_ord = (SELECT min(set_ord) FROM sets WHERE contains(lower(set_name), 'promo'))),
sc AS (SELECT c.cluster_id, count(s.gene_u) AS n, avg(s.pct_in) AS mean FROM clusters c CROSS JOIN one LEFT JOIN stats s ON s.cluster_id = c.cluster_id AND s.gene_u = upper(one.gene) GROUP BY 1)"""


@query("SELECT cluster_id, (SELECT any_value(set_name) FROM one) AS set_name, n AS n_found, round(CASE WHEN n >= 3 THEN mean ELSE 0 END, 6) AS score FROM sc", CELLS, SPARSE, STATS, SETS, PROMO)
def engine_pathway(a):
    """One set by a part of its name."""
    return rounded(Engine(a.clusters, a.sparse_stats, sets=a.sets).pathways("promo").select("cluster_id", "set_name", "n_found", "score"))


@query("SELECT cluster_id, place, gene, round(logfc, 6) AS logfc FROM (SELECT cluster_id, gene, round(logfc, 9) AS logfc, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(round(logfc, 9)) DESC, gene) AS place FROM stats) WHERE place <= 50", CELLS, DENSE, STATS)
def cluster_views(a):
    """What the engine shows of each cluster: its top fifty genes here, as there are no terms."""
    found = Engine(a.clusters, a.dense_stats.withColumn("logfc", F.round("logfc", 9))).views()
    return rounded(found.select("cluster_id", F.explode("genes").alias("g")).select("cluster_id", F.col("g.rank").alias("place"), "g.gene", "g.logfc"))


# Arms of operators


@query("SELECT gene, cluster_id, round(logfc, 6) AS logfc, bias FROM stats JOIN (SELECT cluster_id, CASE WHEN sum(CASE WHEN value = 'neg' THEN frac ELSE 0 END) > 0.6 THEN 'neg' WHEN sum(CASE WHEN value = 'pos' THEN frac ELSE 0 END) > 0.6 THEN 'pos' ELSE 'mixed' END AS bias FROM meta WHERE col = 'balance' GROUP BY 1) USING (cluster_id) WHERE gene IN (SELECT p_name FROM part WHERE p_partkey <= 5)", CELLS, DENSE, STATS, META)
def compare_asked_genes(a):
    """With genes given there is no threshold and no cut."""
    own = meta.biased_clusters(a.clusters, a.meta, "balance", "neg", "pos")
    return rounded(meta.compared_genes(own, a.dense_stats, a.table("part").filter("p_partkey <= 5").select(F.upper("p_name").alias("gene_u"))).select("gene", "cluster_id", "logfc", "bias"))


@query("SELECT col FROM (SELECT 0 AS o, 'cell_id' AS col, count(DISTINCT cell_id) AS n FROM cells UNION ALL SELECT 1, 'segment', count(DISTINCT segment) FROM cells UNION ALL SELECT 2, 'balance', count(DISTINCT balance) FROM cells) WHERE n BETWEEN 2 AND 100 ORDER BY o LIMIT 1", CELLS)
def cluster_key(a):
    return a.spark.createDataFrame([(meta.cluster_key(a.cells, ["nothing", "cell_id", "segment", "balance"], most=100),)], "col string")


@query("SELECT name, row_number() OVER (ORDER BY CASE WHEN regexp_full_match(name, '[0-9]+') THEN 0 ELSE 1 END, name) AS place FROM (SELECT n_name AS name FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation)")
def clusters_digits_first(a):
    nation = a.table("nation")
    own = nation.select(F.col("n_name").alias("name")).unionByName(nation.select(F.col("n_nationkey").cast("string").alias("name")))
    return own.withColumn("place", F.row_number().over(Window.orderBy(*T.digits_first(F.col("name")))).cast("long"))


TOKENS = "tok AS (SELECT cell_id, gene, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene) AS r FROM expr)"


def _tokens(a) -> DataFrame:
    words = a.dense.select("gene").distinct().select("gene", F.col("gene").alias("token")).unionByName(a.spark.createDataFrame([("<cls>", "<cls>")], "gene string, token string"))
    return encode.cell_tokens(a.dense, words)


@query("SELECT cell_id, '<cls>' || repeat('|', 1) || coalesce(string_agg(gene, '|' ORDER BY r) FILTER (r <= 9), '') || repeat('|<pad>', greatest(0, 9 - CAST(count(*) AS INT))) AS padded FROM tok GROUP BY 1", CELLS, DENSE, TOKENS)
def padded_tokens(a):
    return _tokens(a).select("cell_id", F.array_join(V.padded(F.col("tokens"), 10, F.lit("<pad>")), "|").alias("padded"))


@query("SELECT cell_id, CAST(count(*) + 1 AS DOUBLE) AS n, CAST(sum(length(gene)) + 5 AS DOUBLE) AS letters FROM tok GROUP BY 1", CELLS, DENSE, TOKENS)
def vectors_of_model(a):
    """A model that counts tokens and letters, in batches."""

    def load():
        return lambda batch: [[float(len(t)), float(sum(map(len, t)))] for t in batch]

    return encode.model_vectors(_tokens(a), load).select("cell_id", F.col("vec")[0].alias("n"), F.col("vec")[1].alias("letters"))


@query("SELECT cluster_id, cluster_id || ' cell type' AS identity_text, 'Cluster ' || cluster_id || '. Marker genes: ' || genes || '. Enriched terms: ' || terms || '. Composition: ' || m AS context_text FROM tg JOIN mt USING (cluster_id) JOIN (SELECT cluster_id, 'rank ' || cluster_ord || ', region ' || region AS terms FROM clusters) USING (cluster_id)", CELLS, DENSE, STATS, META, SUMMARY_DEFAULT)
def whole_summaries(a):
    """With terms and composition."""
    terms = lambda source, word, c: a.clusters.select("cluster_id", F.lit(source).alias("source"), F.lit(1).alias("rank"), F.concat(F.lit(word), F.col(c).cast("string")).alias("term"))
    own = rank.top_genes(a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 400)
    return encode.summaries(a.clusters, own, terms("a", "rank ", "cluster_ord").unionByName(terms("b", "region ", "region")), a.meta)


@query(
    """, x AS (SELECT c.cell_id, m.gene, coalesce(v, 0) - m AS v FROM cells c CROSS JOIN mg m LEFT JOIN sc ON sc.cell_id = c.cell_id AND sc.gene = m.gene WHERE c.cell_id % 50 = 0)
SELECT cell_id, round(sum(v * v), 5) AS squared FROM x GROUP BY 1""",
    CELLS,
    DENSE,
    MOMENTS,
    SCALED,
)
def preprocessed_cells(a):
    """Variable genes, scaling and components as one chain: in all components a cell's length is that of its centred row."""
    found = build.cells_in_components(a.dense, a.cells, dims=1 << 20)
    return rounded(found.filter("cell_id % 50 = 0").select("cell_id", V.dot(F.col("pca"), F.col("pca")).alias("squared")), 5)
