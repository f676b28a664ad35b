"""Bounded, repeatable samples of labelled rows, for the operators that fit a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by five: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lowest(own: DataFrame, rows: int, labels: int) -> DataFrame:
    """The rows (label, h, ...) of the `rows` lowest hashes h of each of the `labels` most frequent labels, h once each.

    A first pass counts, so that a second one brings only a few rows more than asked for to the last sort.
    """
    counted = own.groupBy("label").agg(F.approx_count_distinct("h", 0.03).alias("n"), F.count("*").alias("m")).orderBy(F.desc("m"), "label").limit(labels).collect()
    bound = F.lit(None)
    for r in counted:
        share = min(1.0, 1.5 * rows / max(1, r["n"]))
        bound = F.when(F.col("label") == F.lit(r["label"]), F.lit(min(int(-(2.0**63) + share * 2.0**64), 2**63 - 1))).otherwise(bound)
    rest = [c for c in own.columns if c not in ("label", "h")]
    few = own.filter(F.col("h") <= bound.cast("long")).groupBy("label", "h").agg(*[F.min(c).alias(c) for c in rest])
    return few.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).filter(F.col("r") <= rows)


def sampled(df: DataFrame, label: str, text: str, rows: int, labels: int) -> DataFrame:
    """label, text, r: at most `rows` different texts of each of the `labels` most frequent labels.

    Which: those whose text has the lowest hash, so copies count once and the same input gives the same sample. Rows
    with a null label or text are left out. No text comes into Python here.
    """
    own = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    return lowest(own.select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(text).alias("h")), rows, labels)


def sample(df: DataFrame, label: str, text: str, rows: int, labels: int) -> list[tuple]:
    """(label, text) of that sample."""
    return [(r["label"], r["text"]) for r in sampled(df, label, text, rows, labels).orderBy("label", "r").collect()]
