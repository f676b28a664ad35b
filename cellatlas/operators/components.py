"""Principal components of cells that are stored by their non-zero values.

The centred matrix is never made: a product with it is one with the stored values, less one with the column means. Each
round multiplies the covariance by a block of vectors in one pass over the cells (partial results by block of genes are
summed by Spark), and the components come from all blocks together. The driver holds blocks of the size of the genes,
never of the cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import Stages, stages

EXTRA, ROUNDS, SEED = 10, 6, 7
GENES = 256  # in a block of partial results
_DENSE = 1 << 21  # numbers that a task lays out at once
_NUMBERS = {"int": np.int32, "bigint": np.int64}
PAIRED = 2048  # rows of a block of inner_products; two blocks meet in a task


class Components(NamedTuple):
    """scores: cell_id, pca. loadings: gene, weights. variances: those of the components, the largest first."""

    scores: DataFrame
    loadings: DataFrame
    variances: np.ndarray


def scaled(expr: DataFrame, moments: DataFrame, most: float = 10.0) -> DataFrame:
    """cell_id, gene, value: (value - mean) / deviation, cut at `most`, less what a zero becomes; zeros stay zeros.

    moments: gene, mean, variance. A deviation of 0 counts as 1. Genes without moments are left out. Components don't
    change when all values of a gene are shifted alike, so these rows stand for the whole scaled matrix.
    """
    own = expr.select("cell_id", "gene", "value").join(moments.select("gene", "mean", "variance"), "gene")
    sd = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(F.lit(1.0))
    return own.select("cell_id", "gene", (F.least((F.col("value") - F.col("mean")) / sd, F.lit(most)) + F.col("mean") / sd).alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and dense rows of batches (id, at, values), a bounded number of numbers at once."""
    step = max(1, _DENSE // max(width, 1))
    for b in batches:
        for s in range(0, b.num_rows, step):
            part = b.slice(s, step)
            at, values = part.column(1), part.column(2)
            rows = np.repeat(np.arange(part.num_rows), np.asarray(at.value_lengths()))
            x = np.zeros((part.num_rows, width))
            x[rows, np.asarray(at.flatten())] = np.asarray(values.flatten())
            yield part.column(0), x


def _times_covariance(cells: DataFrame, mean: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """The covariance of the cells times a block of vectors."""
    genes, width = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((genes, width))
        there = mean @ block
        for _, x in _blocks(batches, genes):
            total += x.T @ (x @ block - there)
        at = range(0, genes, GENES)
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([total[s : s + GENES].tobytes() for s in at], pa.binary())], names=["part", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    shape = "part long, sums binary"
    found = cells.mapInArrow(run, shape).groupBy("part").applyInArrow(added, shape).orderBy("part").collect()
    # Centring: the sum over cells of mean x (row - mean) is 0, so the mean needn't be taken off the left factor.
    return np.concatenate([np.frombuffer(r["sums"], np.float64).reshape(-1, width) for r in found]) / max(n - 1, 1)


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What of the block's span lies outside of the basis, as orthonormal columns."""
    scale = np.linalg.norm(block, axis=0).max(initial=0)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(scale, 1e-300)]
        scale = 1.0
    return block


def _projected(rows: DataFrame, mean: np.ndarray, weights: np.ndarray, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = mean @ weights
        for ids, x in _blocks(batches, len(weights)):
            y = x @ weights - there
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(y), pa.list_(pa.float64()))], names=[key, "pca"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, pca array<double>")


def _decomposed(rows: DataFrame, mean: np.ndarray, n: int, dims: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (genes x dims) and variances of the first components of rows (id, at, values); none without rows or genes."""
    genes = len(mean)
    if not genes or not n:
        return np.zeros((genes, 0)), np.zeros(0)
    width = min(genes, dims + EXTRA)
    start = np.random.default_rng(SEED).normal(size=(genes, width)) if width < genes else np.eye(genes)
    basis, images = np.zeros((genes, 0)), np.zeros((genes, 0))
    block = _orthonormal(start, basis)
    for _ in range(rounds):
        image = _times_covariance(rows, mean, block, n)
        basis, images = np.concatenate([basis, block], 1), np.concatenate([images, image], 1)
        block = _orthonormal(image, basis)[:, : genes - basis.shape[1]]
        if not block.shape[1]:
            break
    small = basis.T @ images
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:dims]
    weights = basis @ turn[:, best]
    weights *= np.where(weights[np.abs(weights).argmax(0), np.arange(len(best))] < 0, -1, 1)
    return weights, np.maximum(values[best], 0)


def principal_components(expr: DataFrame, cells: DataFrame, dims: int = 50, rounds: int = ROUNDS, own: Stages | None = None) -> Components:
    """The first `dims` components (as many as there are genes, if fewer) of expr (cell_id, gene, value) over all cells.

    Cells without a value take part as rows of zeros. The sign of a component makes its largest weight positive.
    Convergence is by blocks of dims + 10 vectors and at most `rounds` passes; with as many vectors as genes it is
    exact after one. The cells' rows are written once and read in each pass; `own` remembers them for deletion.
    """
    spark = cells.sparkSession
    with stages(spark) as st:
        st = own or st
        sums = expr.groupBy("gene").agg(F.sum("value").alias("s")).orderBy("gene").collect()  # a row a gene
        n = cells.count()
        names = [r["gene"] for r in sums]
        mean = np.array([r["s"] for r in sums], np.float64) / max(n, 1)
        at = spark.createDataFrame(pa.table({"gene": pa.array(names, pa.string()), "at": pa.array(range(len(names)), pa.int32())}))
        there = expr.join(at, "gene").groupBy("cell_id").agg(F.collect_list(F.struct("at", "value")).alias("v"))
        rows = cells.select("cell_id").join(there, "cell_id", "left").select("cell_id", *[F.coalesce(F.col(f"v.{c}"), F.array().cast(f"array<{t}>")).alias(c) for c, t in (("at", "int"), ("value", "double"))])
        rows = st.table(rows, "rows")
        weights, variances = _decomposed(rows, mean, n, min(dims, len(names)), rounds)
        loadings = spark.createDataFrame(pa.table({"gene": pa.array(names, pa.string()), "weights": pa.array(list(weights), pa.list_(pa.float64()))}))
        return Components(_projected(rows, mean, weights, "cell_id"), loadings, variances)


def vector_components(vectors: DataFrame, key: str = "id", vec: str = "vec", dims: int = 2, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """key, pca of dense vectors of one length, and the components' variances."""
    rows = vectors.select(key, F.sequence(F.lit(0), F.size(vec) - 1).alias("at"), F.col(vec).cast("array<double>").alias("value"))
    means = rows.select(F.posexplode("value").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.count("*").alias("n")).orderBy("i").collect()
    mean = np.array([r["m"] for r in means], np.float64)
    weights, variances = _decomposed(rows, mean, means[0]["n"] if means else 0, min(dims, len(mean)), rounds)
    return _projected(rows, mean, weights, key), variances


def inner_products(rows: DataFrame, key: str, vec: str, digits: int = 5) -> DataFrame:
    """a, b, product: the inner products of all pairs of rows with a <= b, rounded half away from zero.

    All pairs are asked for, so the result grows with the square. Blocks of about PAIRED rows meet in tasks and are
    multiplied as matrices; a row is shuffled once for each block, and no task holds more than two blocks' pairs.
    """
    kind = dict(rows.dtypes)[key]
    blocks = max(1, -(-rows.count() // PAIRED))
    own = rows.select(F.col(key).alias("a"), F.col(vec).cast("array<double>").alias("x"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("i"))
    left = own.withColumn("j", F.explode(F.sequence("i", F.lit(blocks - 1).cast("long"))))
    right = own.select(F.col("a").alias("b"), F.col("x").alias("y"), F.col("i").alias("q")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), "q")))
    shape = pa.schema([("a", pa.from_numpy_dtype(np.dtype(_NUMBERS[kind]))), ("b", pa.from_numpy_dtype(np.dtype(_NUMBERS[kind]))), ("product", pa.float64())])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return shape.empty_table()
        a, b = (np.asarray(t.column(0)) for t in (x, y))
        v, w = (np.asarray(t.column(1).combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (x, y))
        same = x.column("i")[0].as_py() == x.column("j")[0].as_py()
        parts = []
        for s in range(0, len(a), 256):
            product = v[s : s + 256] @ w.T
            first, second = (np.broadcast_to(k, product.shape) for k in (a[s : s + 256, None], b[None, :]))
            kept = first <= second if same else np.ones(product.shape, bool)  # other blocks meet once, in either order
            low, high, product = np.minimum(first, second)[kept], np.maximum(first, second)[kept], product[kept]
            product = np.copysign(np.floor(np.abs(product) * 10.0**digits + 0.5), product) / 10.0**digits + 0.0
            parts.append(pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(product)], schema=shape))
        return pa.Table.from_batches(parts)

    return left.groupBy("i", "j").cogroup(right.groupBy("p", "q")).applyInArrow(run, f"a {kind}, b {kind}, product double")
