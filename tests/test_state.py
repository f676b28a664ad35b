"""Counts that add up, batch by batch and from a stream, against the statistics of all cells at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from cellatlas.operators import meta, state, stats
from cellatlas.plans.fixture import Atlas

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def atlas(spark):
    a = Atlas(spark, SF)
    return a.dense.withColumn("value", F.round("value", 9)).cache(), a.cells.select("cell_id", "cluster_id", "segment", "balance").cache()


def rows(df):
    return oracle.rows(df.columns, [tuple(r) for r in df.collect()])


def same(counts, expr, cells):
    assert rows(counts.gene_stats()) == rows(stats.gene_stats(expr, cells))
    assert rows(counts.rank_sums()) == rows(stats.rank_sums(expr, cells))
    assert rows(counts.cluster_metadata()) == rows(meta.cluster_metadata(cells, ["segment", "balance"]))


def test_parts(spark, atlas, tmp_path):
    """Three batches, one of them written twice, then compacted and added to."""
    expr, cells = atlas
    part = lambda i: (expr.filter(f"cell_id % 3 = {i}"), cells.filter(f"cell_id % 3 = {i}"))
    root = str(tmp_path / "a")
    for i in (0, 1, 1):
        state.add_batch(root, i, *part(i), ["segment", "balance"])
    state.compacted(spark, root, str(tmp_path / "b"), 1)
    state.add_batch(str(tmp_path / "b"), 2, *part(2), ["segment", "balance"])
    same(state.read_counts(spark, str(tmp_path / "b")), expr, cells)
    found = state.read_counts(spark, str(tmp_path / "b")).markers(5)
    assert rows(found) == rows(stats.markers(expr, cells, 5))


def test_stream(spark, atlas, tmp_path):
    """Cells that arrive in files: each micro-batch is added once."""
    expr, cells = atlas
    whole = cells.join(expr.groupBy("cell_id").agg(F.collect_list(F.struct("gene", "value")).alias("genes")), "cell_id", "left")
    for i in range(2):
        whole.filter(f"cell_id % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again, it has nothing to add
        state.keep_counting(arriving, str(tmp_path / "out"), str(tmp_path / "check"), ["segment", "balance"]).trigger(availableNow=True).start().awaitTermination()
    same(state.read_counts(spark, str(tmp_path / "out")), expr, cells)


def test_no_cells(spark, atlas, tmp_path):
    expr, cells = atlas
    state.add_batch(str(tmp_path), 0, expr.limit(0), cells.limit(0))
    found = state.read_counts(spark, str(tmp_path))
    assert found.gene_stats().count() == 0 and found.cluster_metadata().count() == 0


def test_normal_tail(spark):
    """The series against math.erfc, far out too."""
    import math

    z = [0.0, 1e-9, 0.3, 1.0, -1.96, 5.0, -12.0, 30.0, 37.0]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(stats.two_sided_p("z")).collect()]
    assert np.allclose(found, [math.erfc(abs(x) / math.sqrt(2)) for x in z], rtol=1e-11, atol=0)
