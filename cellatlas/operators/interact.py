"""Ligand-receptor interactions between clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interactions(stats: DataFrame, pairs: DataFrame, sources: DataFrame | None = None, targets: DataFrame | None = None, min_ligand: float = 0.1, min_receptor: float = 0.05, distinct: bool = False) -> DataFrame:
    """source, target, ligand, receptor, pathway, lr_ord, ligand_pct, receptor_pct, score = their product.

    pairs: lr_ord, ligand, receptor, pathway; rows that repeat count again unless `distinct`. A cluster doesn't meet
    itself. sources, targets: cluster_id, of the clusters to look at. Thresholds keep what equals them, and work on
    the statistics before the joins.
    """
    db = pairs.groupBy("ligand", "receptor", "pathway").agg(F.min("lr_ord").alias("lr_ord")) if distinct else pairs
    side = lambda pct, least, name, of: (stats if of is None else stats.join(of.select("cluster_id"), "cluster_id", "left_semi")).filter(F.col("pct_in") >= least).select(F.col("gene_u").alias(f"_{name}"), F.col("cluster_id").alias(name), F.col("pct_in").alias(pct))
    left = db.withColumn("_source", F.upper("ligand")).join(side("ligand_pct", min_ligand, "source", sources), "_source")
    both = left.withColumn("_target", F.upper("receptor")).join(side("receptor_pct", min_receptor, "target", targets), "_target")
    return both.filter(F.col("source") != F.col("target")).select("source", "target", "ligand", "receptor", "pathway", "lr_ord", "ligand_pct", "receptor_pct", (F.col("ligand_pct") * F.col("receptor_pct")).alias("score"))


def in_order(found: DataFrame, clusters: DataFrame) -> DataFrame:
    """found with its score at four digits and its place by it; ties by lr_ord, then the clusters' ordinals.

    Places come from how many rows each of the 10001 scores has, and how many of these each pair; what is ordered in
    one task is a score's pairs, or the clusters of one pair and score.
    """
    ordinal = lambda side: clusters.select(F.col("cluster_id").alias(side), F.col("cluster_ord").alias(f"_{side}"))
    own = found.withColumn("score", F.round(F.round("score", 9), 4)).join(ordinal("source"), "source").join(ordinal("target"), "target")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = own.groupBy("score", "lr_ord").agg(F.count("*").alias("_n"))
    scores = pairs.groupBy("score").agg(F.sum("_n").alias("_n")).select("score", before(Window.orderBy(F.desc("score"))).alias("_above"))
    counts = pairs.select("score", "lr_ord", before(Window.partitionBy("score").orderBy("lr_ord")).alias("_before")).join(scores, "score")
    r = F.row_number().over(Window.partitionBy("score", "lr_ord").orderBy("_source", "_target"))
    return own.join(counts, ["score", "lr_ord"]).withColumn("place", F.col("_above") + F.col("_before") + r).drop("_above", "_before", "_source", "_target")


def by_pathway(found: DataFrame) -> DataFrame:
    return found.groupBy("pathway").agg(F.count("*").alias("n"))


def by_pair(found: DataFrame, top: int = 20) -> DataFrame:
    """The `top` pairs of clusters by their number of interactions."""
    return found.groupBy("source", "target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "target").limit(top)


def named_clusters(clusters: DataFrame, name: str | None) -> DataFrame:
    """The clusters whose id contains the name, whatever its case; all, if none does or there is no name."""
    if not name:
        return clusters
    hit = F.lower("cluster_id").contains(name.lower())
    return clusters.filter(hit | ~(clusters.agg(F.max(hit)).scalar()))
