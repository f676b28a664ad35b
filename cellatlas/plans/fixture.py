"""The local star schema as an atlas: customers are cells, nations clusters, parts genes, summed quantities values."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalized
from ..operators import meta, profile, stats

#: CTEs in DuckDB's SQL that say the same.
CELLS = """cells AS (SELECT c_custkey AS cell_id, n_name AS cluster_id, c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS balance, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
clusters AS (SELECT n_nationkey AS cluster_ord, n_name AS cluster_id, n_regionkey AS region FROM nation),
sizes AS (SELECT cluster_id, count(*) AS n_in, CAST(sum(count(*)) OVER () AS BIGINT) AS n_all FROM cells GROUP BY cluster_id)"""
_EXPR = """{0} AS (SELECT o_custkey AS cell_id, {1} AS gene, ln(1 + sum(l_quantity)) AS value
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey{2} WHERE o_custkey IN (SELECT cell_id FROM cells) GROUP BY 1, 2)"""
DENSE = _EXPR.format("expr", "p_name", " JOIN part ON p_partkey = l_partkey")
SPARSE = _EXPR.format("expr", "'G' || l_partkey", "")
STATS = """summed AS (SELECT cluster_id, gene, count(*) AS nnz, sum(exp(value) - 1) AS s FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2),
wide AS (SELECT *, sum(nnz) OVER (PARTITION BY gene) AS nnz_all, sum(s) OVER (PARTITION BY gene) AS s_all FROM summed JOIN sizes USING (cluster_id)),
plain AS (SELECT cluster_id, gene, upper(gene) AS gene_u, nnz, n_in, nnz / n_in AS pct_in, (nnz_all - nnz) / (n_all - n_in) AS pct_out,
  log2((s / n_in + 1e-9) / ((s_all - s) / (n_all - n_in) + 1e-9)) AS logfc FROM wide),
stats AS (SELECT *, exp(-5 * abs(logfc)) AS pval_adj FROM plain)"""
META = """long AS (SELECT cell_id, cluster_id, 0 AS col_ord, 'segment' AS col, segment AS value FROM cells UNION ALL SELECT cell_id, cluster_id, 1, 'balance', balance FROM cells),
counted AS (SELECT cluster_id, col_ord, col, value, count(*) AS n FROM long GROUP BY ALL),
placed AS (SELECT *, CAST(sum(n) OVER (PARTITION BY cluster_id, col) AS BIGINT) AS n_cells, row_number() OVER (PARTITION BY cluster_id, col ORDER BY n DESC, value) AS r FROM counted),
meta AS (SELECT cluster_id, n_cells, col_ord, col, value, n, n / n_cells AS frac FROM placed WHERE r <= 5)"""
SETS = """sets AS (SELECT p_type AS set_name, dense_rank() OVER (ORDER BY p_type) AS set_ord, p_partkey AS gene_ord, 'G' || p_partkey AS gene FROM part),
nsets AS (SELECT split_part(p_name, ' ', 2) AS set_name, p_name AS gene FROM part GROUP BY 1, 2)"""
PAIRS = """pairs AS (SELECT a.p_partkey AS lr_ord, 'G' || a.p_partkey AS ligand, 'G' || b.p_partkey AS receptor, a.p_type AS pathway FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_type = b.p_type)"""
ASKED = """queries AS (SELECT CAST(g % 5 AS BIGINT) AS qid, 'G' || g AS gene_u FROM range(1, 16) t(g) UNION ALL SELECT 0, 'NONE')"""
VECTORS = """unnested AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM unnested GROUP BY 1, 2),
lengths AS (SELECT label, sqrt(sum(m * m)) AS len FROM means GROUP BY 1),
cents AS (SELECT label, i, m / len AS v FROM means JOIN lengths USING (label))"""


class Atlas:
    """Frames over one folder of tables; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def clusters(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("cluster_ord"), F.col("n_name").alias("cluster_id"), F.col("n_regionkey").alias("region"))

    @cached_property
    def cells(self) -> DataFrame:
        own = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return own.select(F.col("c_custkey").alias("cell_id"), F.col("n_name").alias("cluster_id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") < 0, "neg").otherwise("pos").alias("balance"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))

    def _expr(self, gene, part: bool, by: str = "cell_id", clustered: bool = False) -> DataFrame:
        """cell_id, gene, value, and cluster_id if `clustered`: cells then meet their orders, not each of their values."""
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("cell_id"))
        cell = ["cell_id", "cluster_id"] if clustered else ["cell_id"]
        if clustered:
            orders = orders.join(self.cells.select(*cell), "cell_id")
        lines = self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        if part:
            lines = lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        own = lines.select(*cell, gene.alias("gene"), "l_quantity").repartition(by)  # by one key, which later sums and joins need too
        return own.groupBy(*cell, "gene").agg(F.log1p(F.sum("l_quantity")).alias("value"))

    @cached_property
    def dense(self) -> DataFrame:
        return self._expr(F.col("p_name"), True)

    @cached_property
    def sparse(self) -> DataFrame:
        return self._sparse()

    def _sparse(self, *how) -> DataFrame:
        return self._expr(F.concat(F.lit("G"), F.col("l_partkey").cast("string")), False, *how)

    @cached_property
    def sparse_by_gene(self) -> DataFrame:
        """sparse, where a gene's values lie in one partition, for sums by gene."""
        return self._sparse("gene")

    def _stats(self, expr: DataFrame) -> DataFrame:
        return stats.gene_stats(expr, self.cells).withColumn("pval_adj", F.exp(-5 * F.abs("logfc")))

    @cached_property
    def dense_stats(self) -> DataFrame:
        return self._stats(self._expr(F.col("p_name"), True, "cell_id", True))

    @cached_property
    def sparse_stats(self) -> DataFrame:
        return self._stats(self._sparse("gene", True))  # sums by cluster and gene, and windows by gene, need no other shuffle

    @cached_property
    def meta(self) -> DataFrame:
        return meta.cluster_metadata(self.cells, ["segment", "balance"])

    @cached_property
    def sets(self) -> DataFrame:
        """Parts of a type; few types, so the window that numbers them is small."""
        from pyspark.sql import Window

        part = self.table("part")
        types = part.select("p_type").distinct().withColumn("set_ord", F.row_number().over(Window.orderBy("p_type")))
        return part.join(F.broadcast(types), "p_type").select(F.lit("types").alias("collection"), "set_ord", F.col("p_type").alias("set_name"), F.col("p_partkey").alias("gene_ord"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"))

    @cached_property
    def pairs(self) -> DataFrame:
        a = self.table("part").select("p_partkey", "p_type")
        b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), "p_type")
        g = lambda x: F.concat(F.lit("G"), x.cast("string"))
        return a.join(b, ["p_partkey", "p_type"]).select(F.col("p_partkey").alias("lr_ord"), g(F.col("p_partkey")).alias("ligand"), g(F.col("p_partkey") + 1).alias("receptor"), F.col("p_type").alias("pathway"))

    @cached_property
    def gene_queries(self) -> DataFrame:
        """Five queries of three genes each, one of them with a gene that no cluster has."""
        return self.spark.createDataFrame([(g % 5, f"G{g}") for g in range(1, 16)] + [(0, "NONE")], "qid bigint, gene_u string")

    @cached_property
    def vectors(self) -> DataFrame:
        """The labels' centroids as clusters."""
        return profile.centroids(self.table("embeddings"), "label", "embedding").select(F.col("label").alias("cluster_ord"), F.col("label").alias("cluster_id"), "n", "vec")

    @cached_property
    def vector_queries(self) -> DataFrame:
        """The rows that ask: every hundredth."""
        return self.table("embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), normalized(F.col("embedding")).alias("vec"))
