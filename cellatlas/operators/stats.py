"""Statistics of genes in clusters, from cells and the non-zero values of their genes.

expr: cell_id, gene, value > 0. cells: cell_id, cluster_id. Zeros are never stored; they enter by arithmetic.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-9


def log_normalized(expr: DataFrame, target: float = 1e4, over: float = 50.0) -> DataFrame:
    """ln(1 + value * target / sum of the cell), if any value at all is over `over`; else expr as it is."""
    raw = expr.agg(F.max("value")).scalar() > over
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.withColumn("value", F.when(raw, F.log1p(F.col("value") * target / total)).otherwise(F.col("value")))


def clustered(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """expr with cluster_id. Where it was stored with it, as a large atlas should be, nothing is joined."""
    return expr if "cluster_id" in expr.columns else expr.join(cells.select("cell_id", "cluster_id"), "cell_id")


def cluster_sizes(cells: DataFrame) -> DataFrame:
    """cluster_id, n_in, and n_all on each row. One row a cluster, so the window over all of them is small."""
    return cells.groupBy("cluster_id").agg(F.count("*").alias("n_in")).withColumn("n_all", F.sum("n_in").over(Window.partitionBy(F.lit(1))))


def gene_stats(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """cluster_id, gene, gene_u, nnz, n_in, pct_in, pct_out, logfc for each cluster that expresses the gene.

    One pass: what lies outside a cluster is the gene's total less what lies inside. Cells without a value count.
    Shuffles carry partial sums by (cluster, gene), not cells, once each cell has its cluster.
    """
    summed = clustered(expr, cells).groupBy("cluster_id", "gene").agg(F.count("*").alias("nnz"), F.sum(F.expm1("value")).alias("s"))
    return stats_of_sums(summed, cluster_sizes(cells))


def stats_of_sums(summed: DataFrame, sizes: DataFrame) -> DataFrame:
    """What gene_stats gives, from summed (cluster_id, gene, nnz, s = sum of exp(value) - 1) and cluster_sizes."""
    gene = Window.partitionBy("gene")
    both = summed.withColumn("nnz_all", F.sum("nnz").over(gene)).withColumn("s_all", F.sum("s").over(gene)).join(F.broadcast(sizes), "cluster_id")  # a row a cluster
    n_out = F.col("n_all") - F.col("n_in")
    outside = lambda all_, own: F.when(n_out > 0, (F.col(all_) - F.col(own)) / n_out).otherwise(F.lit(0.0))
    return both.select(
        "cluster_id",
        "gene",
        F.upper("gene").alias("gene_u"),
        "nnz",
        "n_in",
        (F.col("nnz") / F.col("n_in")).alias("pct_in"),
        outside("nnz_all", "nnz").alias("pct_out"),
        F.log2((F.col("s") / F.col("n_in") + TINY) / (outside("s_all", "s") + TINY)).alias("logfc"),
    )


def rank_sums(expr: DataFrame, cells: DataFrame, grid: int = 32) -> DataFrame:
    """cluster_id, gene, z of the rank-sum test of the cluster's cells against all others, for each expressing cluster.

    Equal values share their mean rank. Zeros are one block below all values: n0 of them, of mean rank (n0 + 1) / 2.
    Ranks run over (gene, value) counts, and inside steps of 1 / grid of the value: the steps of a gene are few, so no
    task orders all cells of a gene.
    """
    tied = clustered(expr, cells).groupBy("gene", "value", "cluster_id").agg(F.count("*").alias("k"))
    return ranks_of_ties(tied, cluster_sizes(cells), grid)


def ranks_of_ties(ties: DataFrame, sizes: DataFrame, grid: int = 32) -> DataFrame:
    """What rank_sums gives, from ties (cluster_id, gene, value, k: so many cells) and cluster_sizes."""
    tied = ties.select("gene", "value", "cluster_id", "k", F.floor(F.col("value") * grid).alias("step"))
    values = tied.groupBy("gene", "step", "value").agg(F.sum("k").alias("ties"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    base = values.groupBy("gene", "step").agg(F.sum("ties").alias("n")).select("gene", "step", F.coalesce(F.sum("n").over(before("gene").orderBy("step")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("ties").over(before("gene", "step").orderBy("value")), F.lit(0)) + (F.col("ties") + 1) / 2
    ranks = values.withColumn("inside", inside).join(base, ["gene", "step"]).select("gene", "value", (F.col("base") + F.col("inside")).alias("r"))
    summed = tied.join(ranks, ["gene", "value"]).groupBy("cluster_id", "gene").agg(F.sum("k").alias("nnz"), F.sum(F.col("k") * F.col("r")).alias("r"))
    both = summed.withColumn("nnz_all", F.sum("nnz").over(Window.partitionBy("gene"))).join(F.broadcast(sizes), "cluster_id")  # a row a cluster
    n1, n, n0 = F.col("n_in"), F.col("n_all"), F.col("n_all") - F.col("nnz_all")
    total = F.col("r") + F.col("nnz") * n0 + (n1 - F.col("nnz")) * (n0 + 1) / 2
    z = (total - n1 * (n + 1) / 2) / F.sqrt(n1 * (n - n1) * (n + 1) / 12)
    return both.select("cluster_id", "gene", F.when(n1 < n, z).otherwise(F.lit(0.0)).alias("z"))


def _tail_series(terms: int = 28) -> list[float]:
    """Chebyshev coefficients, in 2 t - 1, of ln(exp(x * x) * erfc(x) / t) for t = 2 / (2 + x) in (0, 1]."""

    def scaled(x: float) -> float:
        if x < 10:
            return math.erfc(x) * math.exp(x * x)
        total, term = 0.0, 1.0
        for k in range(1, 12):
            total, term = total + term, term * -(2 * k - 1) / (2 * x * x)
        return total / (x * math.sqrt(math.pi))

    def f(u: np.ndarray) -> np.ndarray:
        t = (u + 1) / 2
        return np.array([math.log(scaled(2 / v - 2) / v) for v in t])

    return [float(c) for c in np.polynomial.chebyshev.chebinterpolate(f, terms - 1)]


TAIL = _tail_series()


def two_sided_p(z: Column | str) -> Column:
    """The chance of a normal value as far out as z, in the JVM; its relative error is below 1e-11 up to |z| = 37.

    Spark has no error function: this is a Chebyshev series for the logarithm of its complement, by Clenshaw's sums.
    """
    x = F.abs(F.col(z) if isinstance(z, str) else z) / math.sqrt(2)
    t = 2 / (2 + x)
    u = 2 * t - 1
    state = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    sums = F.aggregate(F.array(*[F.lit(c) for c in reversed(TAIL[1:])]), state, lambda s, c: F.struct((2 * u * s["a"] - s["b"] + c).alias("a"), s["a"].alias("b")), lambda s: u * s["a"] - s["b"] + TAIL[0])
    return t * F.exp(sums - x * x)


def adjusted(df: DataFrame, p: str = "p", by: str = "cluster_id", tie: str = "gene") -> DataFrame:
    """df and p_adj: false discovery rates, the running least of p * n / rank from the largest p down."""
    n = F.count("*").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(p), F.col(tie)))
    down = Window.partitionBy(by).orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_n", n).withColumn("_rank", rank).withColumn("p_adj", F.least(F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down), F.lit(1.0))).drop("_n", "_rank")


def markers(expr: DataFrame, cells: DataFrame, genes: int | None = None, most_p: float | None = None) -> DataFrame:
    """gene_stats with z, p and p_adj; the `genes` of highest z of a cluster, and of p_adj below `most_p`."""
    found = adjusted(gene_stats(expr, cells).join(rank_sums(expr, cells), ["cluster_id", "gene"]).withColumn("p", two_sided_p("z")))
    if genes is not None:
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("z"), "gene"))).filter(F.col("_r") <= genes).drop("_r")
    return found if most_p is None else found.filter(F.col("p_adj") < most_p)


def specificity(pct_in="pct_in", pct_out="pct_out"):
    return F.col(pct_in) / (F.col(pct_in) + F.col(pct_out) + 1e-8)


def inverted_index(stats: DataFrame) -> DataFrame:
    """gene_u, and the clusters that express it as an array of score, cluster_id, logfc, pct_in, specificity, best first."""
    entry = F.struct((F.abs("logfc") * specificity()).alias("score"), "cluster_id", "logfc", "pct_in", specificity().alias("specificity"))
    return stats.groupBy("gene_u").agg(F.sort_array(F.collect_list(entry), False).alias("clusters"))


def gene_universe(*tables: DataFrame) -> DataFrame:
    """gene_u, each gene of any table once."""
    first, *rest = (t.select("gene_u") for t in tables)
    for t in rest:
        first = first.unionByName(t)
    return first.distinct()


def variable_genes(expr: DataFrame, cells: DataFrame, genes: int = 3000) -> DataFrame:
    """gene, mean, variance, dispersion of all cells (zeros counted), the `genes` of highest dispersion.

    A ranking by variance over mean stands in for the fitted trend of dedicated packages.
    """
    n = cells.agg(F.count("*")).scalar()
    found = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).withColumn("n", n)
    mean = F.col("s") / F.col("n")
    found = found.select("gene", mean.alias("mean"), (F.col("q") / F.col("n") - mean * mean).alias("variance"))
    return found.withColumn("dispersion", F.col("variance") / F.col("mean")).orderBy(F.desc("dispersion"), "gene").limit(genes)


def guarded(stats: DataFrame) -> DataFrame:
    """stats with 0 for a logfc, and 1 for a pval_adj, that is no number."""
    return stats.withColumns({c: F.nanvl(c, F.lit(x)) for c, x in (("logfc", 0.0), ("pval_adj", 1.0)) if c in stats.columns})


def numbered(rows: DataFrame, key: str, order: str, slices: int = 64) -> DataFrame:
    """rows with place: from 1 in each group, in slices by the rows' hash, and in each slice by `order`.

    A narrow count of the slices tells where each begins, so no task orders a whole group.
    """
    own = rows.withColumn("_slice", F.pmod(F.xxhash64(order), F.lit(slices)))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy(key, "_slice").agg(F.count("*").alias("_n")).select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(order))
    return own.withColumn("_at", at).join(starts, [key, "_slice"]).select(*rows.columns, (F.col("_start") + F.col("_at")).alias("place"))
