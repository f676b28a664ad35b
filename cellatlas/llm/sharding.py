"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fresh, partitions


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of `key`: shard i waits -ln(u(key, i)) / weight i, and the shortest wait wins.

    u is a hash of key and shard number, so a shard's share is as its weight, and a further shard takes rows only into
    itself. A shard of weight 0 gets none. A null key is a key like any other. Of equal waits the lower number wins.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    waits = []
    for i, w in enumerate(weights):
        if w > 0:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
            waits.append(F.struct((-F.ln(u) / F.lit(float(w))).alias("wait"), F.lit(i).alias("shard")))
    return F.array_min(F.array(*waits))["shard"]


def shard(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, slices: int | None = None) -> DataFrame:
    """df with `shard` (int) and `slot` (long), gapless from 0 in each shard.

    Slots are dealt in `slices` slices of a shard (as many as Spark's shuffle partitions by default), by a hash of the
    key and of the columns of whole numbers: a narrow count of each slice gives where it begins, so no task orders a
    whole shard, nor all rows of a hot or null key, unless they are alike in all of these. Repeated rows get a slot
    each, null keys too; of rows that tie in key and whole numbers, either may come first. An empty table gives an empty one. Columns named shard or slot give way; the others stay as they are, in
    front, whatever their names. Texts are not read.
    """
    slices = slices or max(64, partitions(df.sparkSession))
    rows = df.drop("shard", "slot")
    part, at, first = (fresh(rows, c) for c in ("slice", "at", "first"))
    whole = [F.col(f"`{c}`") for c, t in rows.dtypes if c == key or t in ("bigint", "int")]
    own = rows.withColumn("shard", rendezvous(F.col(key), weights)).withColumn(part, F.pmod(F.xxhash64(F.lit("slice"), *whole), F.lit(slices)).cast("int"))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # len(weights) * slices rows at most, whatever the input
    starts = own.groupBy("shard", part).agg(F.count("*").alias(first)).select("shard", part, F.coalesce(F.sum(first).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy("shard", part).orderBy(*whole)
    placed = own.withColumn(at, F.row_number().over(within)).join(F.broadcast(starts), ["shard", part])
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", (F.col(first) + F.col(at) - 1).alias("slot"))


def op1_sharding(spark, sf_dir: str, shards: int = 16) -> DataFrame:
    """All documents in `shards` shards of equal weight, a row for a row, by the law `key`.

    Null texts count as empty ones; long texts only give their size and checksum. Null and repeated doc_ids, ties and
    empty tables as shard states; of other columns none is read.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    grown = rendezvous(F.col("doc_id"), (1.0,) * (shards + 1))
    return shard(rows, "doc_id", (1.0,) * shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))
