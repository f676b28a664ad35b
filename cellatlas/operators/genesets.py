"""Scores of gene sets in clusters. sets: collection, set_ord, set_name, gene_ord, gene (a row for each entry)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .stats import adjusted


def last_definitions(sets: DataFrame) -> DataFrame:
    """Of sets of one name the last definition, in the place of the first."""
    at = Window.partitionBy("collection", "set_name")
    first, last = F.min("set_ord").over(at), F.max("set_ord").over(at)
    return sets.withColumn("_first", first).withColumn("_last", last).filter(F.col("set_ord") == F.col("_last")).withColumn("set_ord", F.col("_first")).drop("_first", "_last")


def set_scores(stats: DataFrame, sets: DataFrame, clusters: DataFrame, metric: str = "pct_in", min_genes: int = 3) -> DataFrame:
    """cluster_id, set_name, set_ord, n_found, n_genes, coverage, score: a row for each cluster and set.

    The score is the mean of `metric` over the entries that the cluster has, 0 if these are fewer than min_genes.
    Sets and clusters are few by nature; entries meet statistics by gene.
    """
    sizes = sets.groupBy("set_name").agg(F.min("set_ord").alias("set_ord"), F.count("*").alias("n_genes"))
    hits = sets.select("set_name", F.upper("gene").alias("gene_u")).join(stats, "gene_u").groupBy("cluster_id", "set_name").agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))
    every = clusters.select("cluster_id").join(sizes, F.lit(True)).join(hits, ["cluster_id", "set_name"], "left")
    n = F.coalesce("n", F.lit(0))
    return every.select("cluster_id", "set_name", "set_ord", n.alias("n_found"), "n_genes", (n / F.col("n_genes")).alias("coverage"), F.when(n >= min_genes, F.col("mean")).otherwise(F.lit(0.0)).alias("score"))


def top_set_genes(stats: DataFrame, sets: DataFrame, metric: str = "pct_in", top: int = 5) -> DataFrame:
    """cluster_id, set_name, gene_u, value, rank: the entries of highest value."""
    own = sets.select("set_name", "gene_ord", F.upper("gene").alias("gene_u")).join(stats, "gene_u")
    r = F.row_number().over(Window.partitionBy("cluster_id", "set_name").orderBy(F.desc(metric), "gene_ord"))
    return own.select("cluster_id", "set_name", "gene_u", F.col(metric).alias("value"), r.cast("long").alias("rank")).filter(F.col("rank") <= top)


def best_cluster_of_set(scores: DataFrame) -> DataFrame:
    """set_name, cluster_id, score: sets by the score of their best cluster; ties to the first name."""
    r = F.row_number().over(Window.partitionBy("set_name").orderBy(F.desc("score"), "cluster_id"))
    return scores.withColumn("_r", r).filter("_r = 1").select("set_name", "cluster_id", "score")


def sets_in_order(scores: DataFrame) -> DataFrame:
    """set_name, cluster_id, score, place: sets by the score of their best cluster; ties by set_ord. A row for each set."""
    best = best_cluster_of_set(scores).join(scores.groupBy("set_name").agg(F.min("set_ord").alias("set_ord")), "set_name")
    place = F.row_number().over(Window.orderBy(F.desc("score"), "set_ord"))
    return best.select("set_name", "cluster_id", "score", place.cast("long").alias("place"))


def phases_in_order(phases: DataFrame) -> DataFrame:
    """What cell_cycle gives, and place: clusters by the sum of both scores, each at four digits; ties by name."""
    both = F.round(F.round("s_score", 4) + F.round("g2m_score", 4), 4)
    return phases.withColumn("place", F.row_number().over(Window.orderBy(F.desc(both), "cluster_id")).cast("long"))


def best_set_of_cluster(scores: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "set_ord"))
    return scores.withColumn("_r", r).filter("_r = 1").select("cluster_id", "set_name", "score")


def resolved_set(sets: DataFrame, name: str) -> DataFrame:
    """The set (one row: set_name, set_ord) that a name means: the first that holds it or is held by it, else the one
    with most words in common, if any."""
    wanted = F.lit(name)
    each = sets.groupBy("set_name").agg(F.min("set_ord").alias("set_ord"))
    a, b = T.plain_name(F.col("set_name")), T.plain_name(wanted)
    found = each.withColumn("holds", (a.contains(b) | b.contains(a)).cast("int")).withColumn("common", F.size(F.array_intersect(T.words(a), T.words(b))))
    return found.filter("holds = 1 OR common > 0").orderBy(F.desc("holds"), F.when(F.col("holds") == 1, 0).otherwise(-F.col("common")), "set_ord").limit(1).select("set_name", "set_ord")


def cell_cycle(stats: DataFrame, sets: DataFrame, clusters: DataFrame, s_set: str, g2m_set: str, metric: str = "pct_in") -> DataFrame:
    """cluster_id, s_score, g2m_score, phase. Means over what is found; the bounds 0.3 and 0.2 must be exceeded."""
    own = sets.filter(F.col("set_name").isin(s_set, g2m_set)).select("set_name", F.upper("gene").alias("gene_u")).join(stats, "gene_u")
    mean = lambda name: F.avg(F.when(F.col("set_name") == name, F.col(metric)))
    found = clusters.select("cluster_id").join(own.groupBy("cluster_id").agg(mean(s_set).alias("s"), mean(g2m_set).alias("g")), "cluster_id", "left")
    s, g = F.coalesce("s", F.lit(0.0)), F.coalesce("g", F.lit(0.0))
    phase: Column = F.when((s > 0.3) & (g > 0.3), "cycling").when(s > 0.2, "S").when(g > 0.2, "G2M").otherwise("G1")
    return found.select("cluster_id", s.alias("s_score"), g.alias("g2m_score"), phase.alias("phase"))


EXACT = [math.log(math.factorial(i)) for i in range(16)]


def log_factorial(n: Column) -> Column:
    """ln(n!): a table up to 15, then Stirling's series, whose next term is below 1e-13 there. No row needs a table of all genes."""
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n < len(EXACT), F.get(F.array(*[F.lit(v) for v in EXACT]), n.cast("int"))).otherwise(series)


def hypergeometric_tail(hits: Column, drawn: Column, size: Column, total: Column) -> Column:
    """Chance of `hits` or more of `drawn` genes in a set of `size` of all `total` genes.

    The first term comes from logarithms, the others from the ratio of each to the one before.
    """
    at = log_factorial
    choose = lambda n, k: at(n) - at(k) - at(n - k)
    low = F.greatest(hits, drawn - (total - size))  # below, there are too few other genes
    first = F.exp(choose(size, low) + choose(total - size, drawn - low) - choose(total, drawn))
    ratio = lambda k: (size - k) * (drawn - k).cast("double") / ((k + 1).cast("double") * (total - size - drawn + k + 1))
    step = lambda s, k: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * ratio(k)).alias("term"))
    sums = F.aggregate(F.sequence(low, F.least(drawn, size)), F.struct(F.lit(0.0).alias("sum"), first.alias("term")), step, lambda s: s["sum"])
    return F.when(low <= F.least(drawn, size), F.least(sums, F.lit(1.0))).otherwise(F.lit(0.0))


def over_representation(markers: DataFrame, sets: DataFrame, universe: DataFrame, genes: int = 200, top: int = 15) -> DataFrame:
    """cluster_id, set_name, hits, p, p_adj, rank: the `top` sets over-represented among a cluster's first genes.

    markers: cluster_id, gene_u, rank. Local, by the hypergeometric tail; sets count once for each distinct gene. Ranks go
    by p_adj, then p, at twelve digits, then the set's name.
    """
    every = universe.select("gene_u").distinct()
    own = sets.select("set_name", F.upper("gene").alias("gene_u")).distinct().join(every, "gene_u", "left_semi")
    sizes = own.groupBy("set_name").agg(F.count("*").alias("size"))
    drawn = markers.filter(F.col("rank") <= genes).select("cluster_id", "gene_u").distinct()
    counts = drawn.groupBy("cluster_id").agg(F.count("*").alias("drawn"))
    hits = drawn.join(own, "gene_u").groupBy("cluster_id", "set_name").agg(F.count("*").alias("hits")).join(sizes, "set_name").join(counts, "cluster_id").join(every.agg(F.count("*").alias("total")), F.lit(True))
    found = adjusted(hits.withColumn("p", hypergeometric_tail(F.col("hits"), F.col("drawn"), F.col("size"), F.col("total"))).drop("total"), "p", "cluster_id", "set_name")
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.round("p_adj", 12), F.round("p", 12), "set_name"))
    return found.withColumn("rank", r.cast("long")).filter(F.col("rank") <= top).select("cluster_id", "set_name", "hits", "p", "p_adj", "rank")
