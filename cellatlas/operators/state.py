"""Statistics that are kept up to date: counts that add up, from which they are read.

A batch of new cells writes its own counts below its number, so a batch that is written twice, as after a lost driver,
counts once. Reading adds the batches; `compacted` writes the sums as one. Each cell comes once, with all its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import meta, stats

TABLES = {"ties": ["cluster_id", "gene", "value"], "sizes": ["cluster_id"], "shares": ["cluster_id", "col_ord", "col", "value"]}


class Counts(NamedTuple):
    """ties: cluster_id, gene, value, k. sizes: cluster_id, k. shares: cluster_id, col_ord, col, value, k."""

    ties: DataFrame
    sizes: DataFrame
    shares: DataFrame

    def _sizes(self) -> DataFrame:
        return self.sizes.select("cluster_id", F.col("k").alias("n_in")).withColumn("n_all", F.sum("n_in").over(Window.partitionBy(F.lit(1))))  # a row a cluster

    def gene_stats(self) -> DataFrame:
        summed = self.ties.groupBy("cluster_id", "gene").agg(F.sum("k").alias("nnz"), F.sum(F.col("k") * F.expm1("value")).alias("s"))
        return stats.stats_of_sums(summed, self._sizes())

    def rank_sums(self) -> DataFrame:
        return stats.ranks_of_ties(self.ties, self._sizes())

    def markers(self, genes: int | None = None) -> DataFrame:
        """gene_stats with z, p and p_adj, all from one reading of the counts' sums."""
        found = stats.adjusted(self.gene_stats().join(self.rank_sums(), ["cluster_id", "gene"]).withColumn("p", stats.two_sided_p("z")))
        if genes is None:
            return found
        r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("z"), "gene"))
        return found.withColumn("_r", r).filter(F.col("_r") <= genes).drop("_r")

    def cluster_metadata(self, values: int = 5) -> DataFrame:
        return meta.metadata_of_counts(self.shares.withColumnRenamed("k", "n"), values)


def counted(expr: DataFrame, cells: DataFrame, columns: Sequence[str] = ()) -> Counts:
    """The counts of some cells (cell_id, cluster_id, `columns`) and their values."""
    ties = stats.clustered(expr, cells).groupBy("cluster_id", "gene", "value").agg(F.count("*").alias("k"))
    sizes = cells.groupBy("cluster_id").agg(F.count("*").alias("k"))
    if columns:
        shares = meta.long_form(cells, columns).groupBy(*TABLES["shares"]).agg(F.count("*").alias("k"))
    else:
        shares = cells.sparkSession.createDataFrame([], f"cluster_id {dict(cells.dtypes)['cluster_id']}, col_ord int, col string, value string, k long")
    return Counts(ties, sizes, shares)


def added(*parts: Counts) -> Counts:
    """The sums of counts."""
    out = []
    for name, by in TABLES.items():
        first, *rest = (getattr(p, name) for p in parts)
        for other in rest:
            first = first.unionByName(other)
        out.append(first.groupBy(*by).agg(F.sum("k").alias("k")))
    return Counts(*out)


def add_batch(root: str, batch: int, expr: DataFrame, cells: DataFrame, columns: Sequence[str] = ()) -> None:
    """Writes the counts of new cells as batch number `batch`; written again, it takes its own place."""
    own = counted(expr, cells, columns)
    for name in TABLES:
        getattr(own, name).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def read_counts(spark: SparkSession, root: str) -> Counts:
    """The sums of all batches below root."""
    return added(Counts(*(spark.read.parquet(f"{root}/{name}").drop("batch") for name in TABLES)))


def compacted(spark: SparkSession, root: str, new_root: str, batch: int) -> None:
    """Writes the sums of all batches as one below new_root, which later batches are then added to."""
    own = read_counts(spark, root)
    for name in TABLES:
        getattr(own, name).write.mode("overwrite").parquet(f"{new_root}/{name}/batch={batch}")


def keep_counting(arriving: DataFrame, root: str, checkpoint: str, columns: Sequence[str] = ()):
    """Starts a stream that adds arriving cells (cell_id, cluster_id, columns, genes: an array of gene and value).

    Each micro-batch is a batch under its own number, so after a restart none counts twice. Gives the writer, to be
    started with the trigger of choice.
    """

    def add(df: DataFrame, number: int) -> None:
        expr = df.select("cell_id", "cluster_id", F.inline("genes"))
        add_batch(root, number, expr, df.drop("genes"), columns)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
