"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(tempfile.mkdtemp(prefix="llm-"))
        atexit.register(shutil.rmtree, _OWN_ROOT[0], ignore_errors=True)
    return f"file://{_OWN_ROOT[0]}"


_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage is cut, and a lost executor costs no recomputation.

    Inside `scratch` the table is deleted at its end; with `keep`, at the end of the scratch around that, if any.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    within = _OPEN.get()[: -1 if keep else None]
    if within:
        within[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables written inside, but for the kept ones. No lazy result may read the others."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for x in own:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch; null is the empty text."""
    for x in batch.column(batch.schema.get_field_index(column)).to_pylist():
        yield x or ""


def slices(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one holds about `chars` bytes of text (one text at least)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        start = size = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # a worker process lives on after its task


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """The batch without `drop`, and with these columns behind; a column of the same name gives way."""
    names = [n for n in batch.schema.names if n not in drop and n not in columns]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=names + list(columns))
