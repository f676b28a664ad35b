"""A two-dimensional layout of a neighbour graph: neighbours attract, sampled others repel.

Every round is joins of edges and of hashed samples with the positions, and a sum of moves by vertex. Positions are a
table that is written in each round; no task and no driver holds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staged import Stages, stages
from .stats import numbered

A, B = 1.577, 0.895  # of the curve 1 / (1 + A d^(2 B)), which falls off beyond a distance of about 0.1
ROUNDS, SAMPLES, FAR, MOST = 60, 5, 10.0, 4.0


def _start(edges: DataFrame, start: DataFrame | None) -> DataFrame:
    """id, x, y: hashed places in a square, or the first two components of `start` (id, pca) at its size."""
    ids = edges.select("id").distinct()
    by_hash = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 19) - 1
    if start is None:
        return ids.select("id", (by_hash("x") * FAR).alias("x"), (by_hash("y") * FAR).alias("y"))
    own = start.select("id", F.get("pca", F.lit(0)).alias("x"), F.coalesce(F.get("pca", F.lit(1)), F.lit(0.0)).alias("y"))
    size = own.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-12)).alias("size"))
    near = lambda c: F.coalesce(F.col(c) / F.col("size") * FAR, F.lit(0.0)) + by_hash(c) * 1e-3  # noqa: E731  so that no two lie at one place
    return ids.join(own, "id", "left").join(size, F.lit(True)).select("id", near("x").alias("x"), near("y").alias("y"))


def _cut(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(MOST)), F.lit(-MOST))


def graph_layout(edges: DataFrame, start: DataFrame | None = None, rounds: int = ROUNDS, samples: int = SAMPLES, own: Stages | None = None) -> DataFrame:
    """id, x, y of each vertex of an undirected graph (id, other).

    In a round a vertex moves by the mean pull of its neighbours and the mean push of `samples` others that a hash of
    vertex and round draws, in steps that get shorter. The same graph gives the same layout. A graph without edges
    gives no row; loops don't count.
    """
    with stages(edges.sparkSession) as st:
        st = own or st
        e = edges.select("id", "other")
        both = st.table(e.unionByName(e.select(F.col("other").alias("id"), F.col("id").alias("other"))).filter("id <> other").distinct(), "edges")
        placed = _start(both, start).withColumn("all", F.lit(0))
        at = st.table(numbered(placed, "all", "id").drop("all"), "places")
        n = at.count()
        for r in range(rounds if n else 0):
            pull = both.join(at.select(F.col("id").alias("other"), F.col("x").alias("u"), F.col("y").alias("v")), "other").select("id", "u", "v", F.lit(True).alias("near"))
            drawn = at.select("id", F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(r), F.lit(j)), F.lit(n)) + 1 for j in range(samples)])).alias("place"))
            push = drawn.join(at.select("place", F.col("id").alias("other"), F.col("x").alias("u"), F.col("y").alias("v")), "place").filter("id <> other").select("id", "u", "v", F.lit(False).alias("near"))
            met = pull.unionByName(push).join(at.select("id", "x", "y"), "id")
            dx, dy = F.col("x") - F.col("u"), F.col("y") - F.col("v")
            d = dx * dx + dy * dy + 1e-12
            force = F.when(F.col("near"), -2 * A * B * F.pow(d, F.lit(B - 1)) / (1 + A * F.pow(d, F.lit(B)))).otherwise(2 * B / ((0.001 + d) * (1 + A * F.pow(d, F.lit(B)))))
            mean = lambda c, near: F.coalesce(F.avg(F.when(F.col("near") == near, _cut(force * c))), F.lit(0.0))
            moves = met.groupBy("id").agg((mean(dx, True) + mean(dx, False)).alias("mx"), (mean(dy, True) + mean(dy, False)).alias("my"))
            step = 1.0 - r / rounds
            at = st.table(at.join(moves, "id", "left").select("id", (F.col("x") + step * F.coalesce("mx", F.lit(0.0))).alias("x"), (F.col("y") + step * F.coalesce("my", F.lit(0.0))).alias("y"), "place"), "places")
        found = at.select("id", "x", "y")
        if own is None:
            st.drop(at)
        return found
