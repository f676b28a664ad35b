"""Further queries: lookups, tables that feed the atlas, texts, baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import encode, evalkit, graph, interact, meta, names, profile, rank
from ..sources import catalog
from .base import query, rounded
from .fixture import CELLS, DENSE, META, PAIRS, SPARSE, STATS, VECTORS


def _sized(a):
    """The clusters by size, as a ranking for query 1."""
    from pyspark.sql import Window

    own = a.cells.groupBy("cluster_id").agg(F.count("*").alias("n")).join(a.clusters, "cluster_id")
    return own.select(F.lit(1).cast("long").alias("qid"), "cluster_id", F.row_number().over(Window.orderBy(F.desc("n"), "cluster_ord")).cast("long").alias("rank"))  # a row a cluster


BYSIZE = "bysize AS (SELECT cluster_id, row_number() OVER (ORDER BY n_in DESC, cluster_ord) AS rank FROM sizes JOIN clusters USING (cluster_id))"


@query("SELECT b.rank, b.cluster_id, t.g AS gene, t.r AS place, round(t.logfc, 6) AS logfc FROM (SELECT * FROM bysize WHERE rank <= 5) b JOIN (SELECT cluster_id, gene AS g, round(logfc, 9) AS logfc, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(round(logfc, 9)) DESC, gene) AS r FROM stats) t USING (cluster_id) WHERE t.r <= 5", CELLS, DENSE, STATS, BYSIZE)
def hits_with_genes(a):
    found = rank.with_genes(_sized(a).filter("rank <= 5"), a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 5)
    return rounded(found.select("rank", "cluster_id", F.explode("genes").alias("g")).select("rank", "cluster_id", "g.gene", F.col("g.rank").alias("place"), "g.logfc"))


@query(
    """, q AS (SELECT DISTINCT region AS qid FROM clusters), r AS (SELECT qid, run, cluster_id, row_number() OVER (PARTITION BY qid, run ORDER BY md5(qid || '|' || cluster_id || '|' || run)) AS rank FROM q CROSS JOIN range(0, 50) t(run) CROSS JOIN clusters),
e AS (SELECT qid, run, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS recall_at_10 FROM r JOIN clusters USING (cluster_id) WHERE region = qid GROUP BY 1, 2)
SELECT CAST(qid AS BIGINT) AS qid, round(avg(recall_at_10), 6) AS recall_at_10, count(*) AS runs FROM e GROUP BY 1""",
    CELLS,
)
def random_monte_carlo(a):
    wanted = a.clusters.select(F.col("region").alias("qid"), "cluster_id")
    runs = wanted.select("qid").distinct().join(a.spark.range(50).withColumnRenamed("id", "r"), F.lit(True))
    ranked = rank.random_ranking(runs, a.clusters, F.col("r"), 10).withColumn("hit", F.lit(1.0))
    every = wanted.join(a.spark.range(50).withColumnRenamed("id", "run"), F.lit(True)).join(ranked, ["qid", "run", "cluster_id"], "left")
    return rounded(evalkit.monte_carlo(every.groupBy("qid", "run").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall_at_10")), "recall_at_10"))


@query("SELECT DISTINCT gene FROM expr WHERE starts_with(upper(gene), 'RE')", CELLS, DENSE)
def gene_prefix_search(a):
    from ..edge.engine import Engine

    return Engine(a.clusters, a.dense_stats).genes_like("re")


@query("SELECT DISTINCT gene FROM expr WHERE starts_with(upper(gene), 'G1')", CELLS, SPARSE)
def gene_prefix_hits(a):
    from ..edge.engine import Engine

    return Engine(a.clusters, a.sparse_stats).genes_like("g1")


@query("SELECT cell_id FROM cells WHERE cluster_id = 'NATION_3' ORDER BY cell_id LIMIT 20", CELLS)
def cells_of_cluster(a):
    return a.cells.filter("cluster_id = 'NATION_3'").select("cell_id").orderBy("cell_id").limit(20)


@query("SELECT col, value, round(frac, 6) AS frac FROM meta WHERE cluster_id = 'NATION_3'", CELLS, META)
def metadata_of_cluster(a):
    return rounded(a.meta.filter("cluster_id = 'NATION_3'").select("col", "value", "frac"))


@query("SELECT col FROM (SELECT 'cluster_id' AS col, count(DISTINCT cluster_id) AS n FROM cells UNION ALL SELECT 'segment', count(DISTINCT segment) FROM cells UNION ALL SELECT 'balance', count(DISTINCT balance) FROM cells UNION ALL SELECT 'x', count(DISTINCT x) FROM cells) WHERE n BETWEEN 2 AND 20", CELLS)
def metadata_columns(a):
    """Found by counting values; the names are few, so they come back by way of the driver."""
    return a.spark.createDataFrame([(c,) for c in meta.chosen_columns(a.cells, ["cluster_id", "segment", "balance", "x"], 20)], "col string")


@query("SELECT cluster_id, unnest(list_distinct([cluster_id, split_part(cluster_id, '_', 1)])) AS name FROM clusters", CELLS)
def cluster_synonyms(a):
    """Names with a comma for the underscore, so that what stands before it is an alias."""
    own = a.clusters.select("cluster_id", F.translate("cluster_id", "_", ",").alias("c"))
    return own.select("cluster_id", F.explode(T.synonyms(F.col("c"))).alias("name")).select("cluster_id", F.translate("name", ",", "_").alias("name"))


SUMMARY = """tg AS (SELECT cluster_id, string_agg(gene, ', ' ORDER BY r) AS genes FROM (SELECT cluster_id, gene, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(round(logfc, 9)) DESC, gene) AS r FROM stats) WHERE r <= 5 GROUP BY 1),
mt AS (SELECT cluster_id, string_agg(col || ' ' || value || ' (' || CAST(round_even(frac * 100, 0) AS INT) || '%)', ', ' ORDER BY col, frac, value) AS m FROM meta WHERE frac >= 0.05 GROUP BY 1)"""


@query("SELECT cluster_id, cluster_id || ' cell type' AS identity_text, 'Cluster ' || cluster_id || '. Marker genes: ' || genes AS context_text FROM tg", CELLS, DENSE, STATS, META, SUMMARY)
def cluster_summaries(a):
    """With five genes each; cluster_summaries_default has the operator's own number."""
    return encode.summaries(a.clusters, rank.top_genes(a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 5))


SUMMARY_DEFAULT = SUMMARY.replace("r <= 5 ", "r <= 400 ")


@query("SELECT cluster_id, cluster_id || ' cell type' AS identity_text, 'Cluster ' || cluster_id || '. Marker genes: ' || genes AS context_text FROM tg", CELLS, DENSE, STATS, META, SUMMARY_DEFAULT)
def cluster_summaries_default(a):
    """With the operator's own number of genes."""
    return encode.summaries(a.clusters, rank.top_genes(a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 400))


@query("SELECT DISTINCT a.p_type AS a, b.p_type AS b FROM part a CROSS JOIN (SELECT DISTINCT p_type FROM part) b WHERE contains(lower(a.p_type), lower(b.p_type)) OR contains(lower(b.p_type), lower(a.p_type)) OR len(list_intersect(string_split(lower(a.p_type), ' '), string_split(lower(b.p_type), ' '))) >= 2")
def pathway_name_join(a):
    own = a.table("part").select("p_type")
    return names.pathways_alike(own, own)


@query("SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a CROSS JOIN (SELECT DISTINCT p_name FROM part) b WHERE contains(lower(a.p_name), lower(b.p_name)) OR contains(lower(b.p_name), lower(a.p_name)) OR len(list_intersect(string_split(lower(a.p_name), ' '), string_split(lower(b.p_name), ' '))) >= 1")
def cluster_name_join(a):
    own = a.table("part").select("p_name")
    return names.clusters_alike(own, own)


@query(
    """, v AS (SELECT vec_id AS id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), d AS (SELECT a.id, b.id AS other, sqrt(greatest(sum(power(CAST(a.x AS DOUBLE) - b.x, 2)), 0)) AS distance FROM v a JOIN v b ON a.i = b.i AND a.id <> b.id GROUP BY 1, 2)
SELECT id, other, round(distance, 5) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), other) AS rank FROM d) WHERE rank <= 3""".replace(", v AS", "WITH v AS", 1),
)
def nearest_vectors(a):
    return rounded(graph.neighbours(a.table("embeddings"), 3, "vec_id", "embedding"), 5)


def _token_order(a, **limit):
    words = a.dense.select("gene").distinct().select("gene", F.col("gene").alias("token")).unionByName(a.spark.createDataFrame([("<cls>", "<cls>")], "gene string, token string"))
    own = encode.cell_tokens(a.dense, words, **limit).select("cell_id", F.posexplode("tokens").alias("pos", "gene"))
    return rounded(own.filter("pos > 0"))


@query("SELECT cell_id, gene, CAST(rank AS BIGINT) AS pos FROM (SELECT cell_id, gene, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene) AS rank FROM expr) WHERE rank <= 4", CELLS, DENSE)
def cell_token_order(a):
    """The first genes of each cell's token sequence; a token is a gene's name here."""
    return _token_order(a, most=5)


@query("SELECT cell_id, gene, CAST(rank AS BIGINT) AS pos FROM (SELECT cell_id, gene, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene) AS rank FROM expr) WHERE rank <= 2999", CELLS, DENSE)
def cell_token_sequences(a):
    """Each cell's whole token sequence, up to the operator's own limit of 3000; cell_token_order has its beginning."""
    return _token_order(a)


@query("SELECT cell_id, gene, CAST(least(CAST(trunc(value * 10) AS INT), 50) AS BIGINT) AS bin FROM expr", CELLS, DENSE)
def binned_values(a):
    return rounded(a.dense.select("cell_id", "gene", V.binned(F.col("value") * 10, 51).alias("bin")))


@query("SELECT p_partkey AS gene_idx, CASE WHEN r > 0 THEN p_name || '-' || r ELSE p_name END AS symbol FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS r FROM part)")
def unique_symbols(a):
    return catalog.unique_symbols(a.table("part").select(F.col("p_partkey").alias("gene_idx"), F.col("p_name").alias("symbol")))


@query("SELECT p_partkey AS gene_idx, coalesce(m.symbol, 'ENSG' || p_partkey) AS symbol FROM part LEFT JOIN (SELECT p_partkey // 2 AS k, arg_max(p_name, p_partkey) AS symbol FROM part GROUP BY 1) m ON m.k = p_partkey")
def mapped_genes(a):
    """Ids of even parts are mapped twice; the later row counts."""
    part = a.table("part")
    mapping = catalog.last_by(part.select(F.concat(F.lit("ENSG"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("base_id"), F.col("p_name").alias("symbol"), F.col("p_partkey").alias("o")), "base_id", "symbol", "o")
    genes = part.select(F.col("p_partkey").alias("gene_idx"), F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string"), F.lit(".7")).alias("ensembl_id"))
    return catalog.mapped_genes(genes, mapping).select("gene_idx", "symbol")


@query("SELECT CAST(l AS BIGINT) AS cluster_id, round(sqrt(coalesce(sum(v * v), 0)), 6) AS length FROM range(0, 12) t(l) LEFT JOIN cents ON label = l GROUP BY 1", VECTORS)
def aligned_vectors(a):
    """Two clusters have no vector and get zeros."""
    own = a.spark.range(12).select(F.col("id").cast("int").alias("cluster_id"))
    return rounded(catalog.aligned_vectors(own, a.vectors, 64).select("cluster_id", V.norm(F.col("vec")).alias("length")))


@query("SELECT CAST(a.label AS BIGINT) AS label, round(sum(power(0.6 * a.v + 0.4 * b.v, 2)), 6) AS squared FROM cents a JOIN cents b ON b.label = (a.label + 1) % 10 AND a.i = b.i GROUP BY 1", VECTORS)
def mixed_vectors(a):
    other = a.vectors.select(((F.col("cluster_id") + 9) % 10).alias("cluster_id"), F.col("vec").alias("w"))
    both = a.vectors.join(other, "cluster_id").withColumn("m", V.mixed(F.col("vec"), F.col("w"), 0.6))
    return rounded(both.select(F.col("cluster_id").alias("label"), V.dot(F.col("m"), F.col("m")).alias("squared")))


@query("SELECT l.cluster_id AS source, r.cluster_id AS target, ligand, receptor, round(l.pct_in * r.pct_in, 6) AS score FROM pairs JOIN stats l ON l.gene_u = upper(ligand) JOIN stats r ON r.gene_u = upper(receptor) WHERE l.pct_in >= 0.02 AND r.pct_in >= 0.02 AND l.cluster_id = 'NATION_3' AND r.cluster_id LIKE 'NATION_1%' AND l.cluster_id <> r.cluster_id", CELLS, SPARSE, STATS, PAIRS)
def interactions_between(a):
    some = lambda n: interact.named_clusters(a.clusters, n)
    found = interact.interactions(a.sparse_stats, a.pairs, some("nation_3"), some("nation_1"), 0.02, 0.02, distinct=True)
    return rounded(found.select("source", "target", "ligand", "receptor", "score"))


@query("SELECT cluster_id, gene, round(least((mean - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 1.5), 6) AS scaled FROM (SELECT cluster_id, gene, pct_in AS mean, avg(pct_in) OVER w AS m, stddev_pop(pct_in) OVER w AS d FROM stats WINDOW w AS (PARTITION BY gene))", CELLS, DENSE, STATS)
def scaled_clipped(a):
    from pyspark.sql import Window

    at = Window.partitionBy("gene")
    return rounded(a.dense_stats.select("cluster_id", "gene", V.clipped_scale(F.col("pct_in"), F.avg("pct_in").over(at), F.stddev_pop("pct_in").over(at), 1.5).alias("scaled")))


@query("SELECT cluster_id, round(fraction, 6) AS fraction FROM (SELECT cluster_id, n_in / n_all AS fraction FROM sizes) ORDER BY fraction DESC, cluster_id LIMIT 1", CELLS)
def best_setting(a):
    return rounded(profile.best_setting(meta.composition(a.cells), "cluster_id", "fraction").select("cluster_id", "fraction"))
