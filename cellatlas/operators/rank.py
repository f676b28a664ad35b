"""Rankings of clusters for queries. A ranking has qid, cluster_id, score and rank (1 is best); its order is total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import dot, norm


def ranked(scored: DataFrame, top: int | None, tie: str = "cluster_ord") -> DataFrame:
    """scored with rank within each qid, cut at `top`."""
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.col(tie)))
    out = scored.withColumn("rank", r.cast("long"))
    return out if top is None else out.filter(F.col("rank") <= top)


def marker_term(mode: str) -> Column:
    """What a query gene that a cluster expresses adds. simple: 1; weighted: by logfc and pct; full: by p too."""
    if mode == "simple":
        return F.lit(1.0)
    weighted = (0.5 + F.abs("logfc")) * (0.3 + F.greatest(F.col("pct_in") - F.col("pct_out"), F.lit(0.0))) * F.when(F.col("pct_in") > 0.5, 1.3).otherwise(1.0)
    if mode == "weighted":
        return weighted
    if mode != "full":
        raise ValueError(f"no scoring mode {mode}")
    p = F.col("pval_adj")
    sure = F.when((p > 0) & (p < 1), F.least(-F.log10(p + 1e-300), F.lit(10.0)) / 10).otherwise(0.0)
    return weighted * (0.5 + sure)


def marker_scores(queries: DataFrame, stats: DataFrame, clusters: DataFrame, mode: str = "weighted", top: int | None = 10) -> DataFrame:
    """Rankings for gene queries (qid, gene_u; a row for each mention). Clusters without a hit score 0 and are ranked too.

    The sum is scaled by 0.5 + 0.5 * coverage, the share of the query's mentions that the cluster has.
    """
    sizes = queries.groupBy("qid").agg(F.count("*").alias("n_genes"))
    hits = queries.join(stats, "gene_u").groupBy("qid", "cluster_id").agg(F.sum(marker_term(mode)).alias("s"), F.count("*").alias("hits"))
    pairs = sizes.join(clusters.select("cluster_id", "cluster_ord"), F.lit(True))  # each query ranks each cluster
    score = F.col("s") if mode == "simple" else F.col("s") * (0.5 + 0.5 * F.col("hits") / F.col("n_genes"))
    found = pairs.join(hits, ["qid", "cluster_id"], "left").select("qid", "cluster_id", "cluster_ord", F.coalesce(score, F.lit(0.0)).alias("score"))
    return ranked(found, top).drop("cluster_ord")


def semantic_ranking(queries: DataFrame, clusters: DataFrame, top: int | None = 10, boost: float = 0.15, names: bool = False) -> DataFrame:
    """Rankings by dot product of normalised vectors (queries: qid, vec, and text if `names`; clusters: cluster_id, cluster_ord, vec).

    Every query is scored against every cluster; both are of the size of a batch and of an atlas' clusters.
    """
    q = queries.select("qid", F.col("vec").alias("_q"), *(["text"] if names else []))
    score = dot(F.col("_q"), F.col("vec"))
    if names:
        score = score + T.name_boost(F.col("cluster_id"), F.col("text"), boost)
    return ranked(q.join(clusters.select("cluster_id", "cluster_ord", "vec"), F.lit(True)).select("qid", "cluster_id", "cluster_ord", score.alias("score")), top).drop("cluster_ord")


def fused(rankings: Sequence[tuple[DataFrame, float]], k: int = 60, top: int | None = 10) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank). Ties: the earlier list, then the better rank in it."""
    parts = [r.select("qid", "cluster_id", F.lit(i).alias("list"), "rank", (F.lit(float(w)) / (k + F.col("rank"))).alias("x")) for i, (r, w) in enumerate(rankings)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    summed = every.groupBy("qid", "cluster_id").agg(F.sum("x").alias("score"), F.min(F.struct("list", "rank")).alias("tie"))
    return ranked(summed, top, "tie").drop("tie")


def synonym_boosted(ranking: DataFrame, queries: DataFrame, synonyms: DataFrame, clusters: DataFrame, boost: float = 0.1, top: int | None = None) -> DataFrame:
    """Adds `boost` to clusters for which the query's text contains a term (synonyms: term, cluster_id), once each.

    Such clusters come in with that score alone if the ranking lacks them; only clusters of the atlas do.
    """
    hit = queries.join(F.broadcast(synonyms), F.lower("text").contains(F.col("term"))).select("qid", "cluster_id", F.lit(boost).alias("b")).distinct()
    hit = hit.join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    both = ranking.select("qid", "cluster_id", "score").join(hit, ["qid", "cluster_id"], "full")
    found = both.select("qid", "cluster_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"))
    return ranked(found.join(clusters.select("cluster_id", "cluster_ord"), "cluster_id"), top).drop("cluster_ord")


def union_ranking(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of the first list, then what only the second has."""
    every = first.select("qid", "cluster_id", F.lit(0).alias("list"), "rank").unionByName(second.select("qid", "cluster_id", F.lit(1).alias("list"), "rank"))
    best = every.groupBy("qid", "cluster_id").agg(F.min(F.struct("list", "rank")).alias("at"))
    r = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    return best.select("qid", "cluster_id", F.when(F.col("at.list") == 0, "first").otherwise("second").alias("origin"), r.cast("long").alias("rank"))


def baseline_ranking(queries: DataFrame, clusters: DataFrame, top: int = 10, guard: float = 1e-8) -> DataFrame:
    """qid, cluster_id, rank, score, random: the ranking of an outside model, by the cosine of queries (qid, vec) and of
    its mean vectors (cluster_id, cluster_ord, vec), each length with a guard.

    A query that the model has no vector for is ranked by a hash of query and cluster, and says so.
    """
    q = queries.select("qid", F.col("vec").alias("_q"))
    cosine = dot(F.col("_q"), F.col("vec")) / ((norm(F.col("_q")) + guard) * (norm(F.col("vec")) + guard))
    both = q.join(clusters.select("cluster_id", "cluster_ord", "vec"), F.lit(True)).withColumn("score", cosine)
    h = F.md5(F.concat_ws("|", F.col("qid").cast("string"), F.col("cluster_id").cast("string")))
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), F.when(F.col("score").isNull(), h), "cluster_ord"))
    return both.select("qid", "cluster_id", r.cast("long").alias("rank"), "score", F.col("_q").isNull().alias("random")).filter(F.col("rank") <= top)


def random_ranking(queries: DataFrame, clusters: DataFrame, run: Column, top: int = 10) -> DataFrame:
    """A baseline that repeats: by a hash of query, cluster and run (a column of queries or a constant)."""
    h = F.md5(F.concat_ws("|", F.col("qid").cast("string"), "cluster_id", F.col("_run").cast("string")))
    pairs = queries.withColumn("_run", run).select("qid", "_run").join(clusters.select("cluster_id"), F.lit(True)).withColumn("h", h)
    r = F.row_number().over(Window.partitionBy("qid", "_run").orderBy("h"))
    return pairs.withColumn("rank", r.cast("long")).filter(F.col("rank") <= top).select("qid", F.col("_run").alias("run"), "cluster_id", "rank")


def top_genes(stats: DataFrame, top: int = 30) -> DataFrame:
    """cluster_id, gene, logfc, rank: the genes of highest |logfc| of each cluster."""
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.abs("logfc")), "gene"))
    return stats.withColumn("rank", r.cast("long")).filter(F.col("rank") <= top)


def with_genes(ranking: DataFrame, stats: DataFrame, top: int = 30) -> DataFrame:
    """ranking and genes: its clusters' top genes as an array of rank, gene and logfc."""
    genes = top_genes(stats, top).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "gene", "logfc"))).alias("genes"))
    return ranking.join(genes, "cluster_id", "left")


def route(mode: str, genes: DataFrame, semantic: DataFrame, plain: DataFrame, queries: DataFrame, synonyms: DataFrame, clusters: DataFrame, top: int = 10, k: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The pipeline of a query mode, over rankings cut at twice `top`.

    gene_list: marker scores three to one with the semantic ranking without name boost (plain); ontology: semantic
    ranking and synonyms; mixed: both fused by `weights`, then synonyms.
    """
    cut = lambda r: r.filter(F.col("rank") <= 2 * top)
    if mode == "gene_list":
        return fused([(cut(genes), 3.0), (cut(plain), 1.0)], k, top)
    base = cut(semantic) if mode == "ontology" else fused([(cut(genes), weights[0]), (cut(semantic), weights[1])], k, 2 * top)
    return synonym_boosted(base, queries, synonyms, clusters, top=top)
