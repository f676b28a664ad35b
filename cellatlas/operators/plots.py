"""The data of plots: what is drawn where, as tables; drawing is left to the user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import vector_components

METRICS = ("semantic", "expression", "hybrid")


def marked(df: DataFrame, hits: DataFrame, key: str = "cluster_id") -> DataFrame:
    """df with `retrieved`: whether its key is among the hits'."""
    own = hits.select(key).distinct().withColumn("_hit", F.lit(True))
    return df.join(own, key, "left").withColumn("retrieved", F.coalesce("_hit", F.lit(False))).drop("_hit")


def landscape(clusters: DataFrame, hits: DataFrame, vec: str = "vec") -> DataFrame:
    """cluster_id, x, y, retrieved: clusters by the first two components of their vectors. Those without one are left out."""
    placed, _ = vector_components(clusters.filter(F.col(vec).isNotNull()), "cluster_id", vec, 2)
    return marked(placed.select("cluster_id", F.get("pca", F.lit(0)).alias("x"), F.coalesce(F.get("pca", F.lit(1)), F.lit(0.0)).alias("y")), hits)


def landscapes(clusters: DataFrame, hits: DataFrame, **spaces: str) -> DataFrame:
    """landscape in several spaces (name=column of vectors), under `space`."""
    first, *rest = (landscape(clusters, hits, vec).withColumn("space", F.lit(name)) for name, vec in spaces.items())
    for other in rest:
        first = first.unionByName(other)
    return first


def profile(results: DataFrame, metrics: Sequence[str] = METRICS, key: str = "cluster_id") -> DataFrame:
    """key, place, metric, value: the metrics that any result has, a missing one of a result as 0.

    If no result has any of them there is the first alone, as 0.
    """
    there = [m for m in metrics if m in results.columns] or [metrics[0]]
    own = results.select(key, *[F.col(m).cast("double").alias(m) if m in results.columns else F.lit(None).cast("double").alias(m) for m in there])
    used = own.agg(*[F.count(m).alias(m) for m in there])
    every = own.join(used.select(F.array(*there).alias("_n")), F.lit(True))
    entries = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), F.coalesce(m, F.lit(0.0)).alias("value")) for i, m in enumerate(there)])
    rows = every.select(key, "_n", F.inline(entries))
    none = ~F.exists("_n", lambda n: n > 0)
    return rows.filter((F.get("_n", F.col("place")) > 0) | (none & (F.col("place") == 0))).drop("_n")


def coverage(results: DataFrame, label: str, modes: Sequence[str]) -> DataFrame:
    """label, mode, coverage: bars of each label, side by side; modes that the results lack are left out."""
    entries = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).cast("double").alias("coverage")) for m in modes if m in results.columns])
    return results.select(label, F.inline(entries)).filter("coverage IS NOT NULL")


def waterfall(results: DataFrame, score: str = "hybrid", otherwise: str = "semantic", key: str = "cluster_id") -> DataFrame:
    """key, similarity, place: results from the most similar down, by `score`, by `otherwise` where that is missing, else 0."""
    columns = [F.col(c).cast("double") for c in (score, otherwise) if c in results.columns]
    own = results.select(key, F.coalesce(*columns, F.lit(0.0)).alias("similarity"))
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("similarity"), key)).cast("long"))  # results of a query are few


def scatter(semantic: DataFrame, expression: DataFrame, hits: DataFrame) -> DataFrame:
    """cluster_id, semantic, expression, retrieved: both scores (cluster_id, score) of each cluster that has either; a missing one is 0."""
    a, b = semantic.select("cluster_id", F.col("score").alias("semantic")), expression.select("cluster_id", F.col("score").alias("expression"))
    return marked(a.join(b, "cluster_id", "full").na.fill(0.0, ["semantic", "expression"]), hits)


def discovery_split(found: DataFrame, expected: DataFrame) -> DataFrame:
    """gene, kind, place: found genes (gene, rank) that are expected (gene_u) first, then those that aren't, each by rank."""
    known = expected.select("gene_u").distinct().withColumn("_known", F.lit(0))
    own = found.groupBy("gene").agg(F.min("rank").alias("rank")).withColumn("gene_u", F.upper("gene")).join(known, "gene_u", "left").withColumn("_side", F.coalesce("_known", F.lit(1)))
    kind: Column = F.when(F.col("_side") == 0, "expected").otherwise("context-shifted")
    return own.select("gene", kind.alias("kind"), F.row_number().over(Window.orderBy("_side", "rank", "gene")).cast("long").alias("place"))


def retrieval_plots(clusters: DataFrame, results: DataFrame, genes: DataFrame, mode: str = "hybrid", **spaces: str) -> dict[str, DataFrame]:
    """The usual set for one retrieval (results: cluster_id and scores; genes: cluster_id, gene, logfc of the hits).

    landscapes of each space, gene_evidence, similarity, gene_heatmap, and for hybrid and discovery profile.
    """
    from .profile import strongest_evidence

    found = {"landscapes": landscapes(clusters, results, **spaces), "gene_evidence": strongest_evidence(genes), "similarity": waterfall(results, "semantic" if mode == "semantic" else "hybrid")}
    found["gene_heatmap"] = genes.groupBy("gene", "cluster_id").agg(F.max("logfc").alias("logfc"))
    return found | ({"profile": profile(results)} if mode in ("hybrid", "discovery") else {})
