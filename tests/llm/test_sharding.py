import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from cellatlas.llm.sharding import op1_sharding, rendezvous, shard
from llm.conftest import SF


def test_rows_slots_and_growth(spark, texts):
    rows = op1_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_few_moves(spark):
    df = spark.range(20_000)
    weights = [1.0, 2.0, 1.0, 0.0]
    n = Counter(r[0] for r in df.select(rendezvous(F.col("id"), weights)).collect())
    assert n[3] == 0 and abs(n[1] - 10_000) < 300 and abs(n[0] - 5000) < 300
    moved = df.select(rendezvous(F.col("id"), [1.0] * 8).alias("a"), rendezvous(F.col("id"), [1.0] * 9).alias("b")).filter("a <> b")
    assert moved.filter("b <> 8").count() == 0 and abs(moved.count() - 20_000 / 9) < 200


def test_decides_by_key_alone(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    one, other = shard(df, slices=3), shard(df.repartition(7).filter("doc_id % 2 = 0"), slices=5)
    both = one.join(other.select("doc_id", F.col("shard").alias("s")), "doc_id")
    assert both.count() == 500 and both.filter("shard <> s").count() == 0


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "doc_id bigint")
    rows = shard(df, weights=(1.0, 1.0)).collect()
    assert len(rows) == 5
    for s in (0, 1):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_no_weight():
    with pytest.raises(ValueError):
        rendezvous(None, (0.0,))


def test_as_plain(spark):
    """The shard of each document by its own waits, hashed here as Spark does."""

    def plain(key, weights):
        best = None
        for i, w in enumerate(weights):
            h = xxhash.xxh64(struct.pack("<i", i), xxhash.xxh64(struct.pack("<q", key), 42).intdigest()).intdigest()
            wait = -math.log(((h >> 11) + 0.5) * 2.0**-53) / w
            best = min(best or (wait, i), (wait, i))
        return best[1]

    for r in op1_sharding(spark, SF).collect():
        assert (r["shard"], r["grown_shard"]) == (plain(r["doc_id"], [1.0] * 16), plain(r["doc_id"], [1.0] * 17))
    weights = [0.5, 3.0, 1.0]
    for r in spark.range(300).select("id", rendezvous(F.col("id"), weights).alias("s")).collect():
        assert r["s"] == plain(r["id"], weights)


def test_own_columns_stay(spark, odd):
    out = shard(odd)
    assert out.columns == [*(c for c in odd.columns if c not in ("shard", "slot")), "shard", "slot"]
    assert {(r["_slice"], r["_at"], r["slice"]) for r in out.collect()} == {(r["_slice"], r["_at"], r["slice"]) for r in odd.collect()}


def test_hot_null_key(spark):
    """A hundred thousand rows without a key: all in one shard, gapless, and ordered by several tasks."""
    df = spark.range(100_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.col("id").alias("size"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = shard(df).select("shard", "slot", F.spark_partition_id().alias("task"))
        by_task = Counter(r["task"] for r in found.select("task").collect())
        one = found.agg(F.count_distinct("shard"), F.count_distinct("slot"), F.min("slot"), F.max("slot")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert tuple(one) == (1, 100_000, 0, 99_999) and len(by_task) == 4 and max(by_task.values()) < 50_000
