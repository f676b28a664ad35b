"""Tables between the steps of a long job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it, a temporary folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="cellatlas-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


class Stages:
    """Writes tables and remembers them, so that those that nothing reads any more can be deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str = "stage") -> DataFrame:
        """df, written and read again: its lineage is cut, and a lost executor costs no recomputation."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: DataFrame | None = None) -> None:
        """Deletes all tables but those that `keep` reads."""
        read = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in keep.inputFiles()} if keep is not None else set()
        conf, left = self.spark.sparkContext._jsc.hadoopConfiguration(), []
        for x in self.paths:
            if x.split(":", 1)[-1].lstrip("/") in read:
                left.append(x)
                continue
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)
        self.paths = left


@contextmanager
def stages(spark: SparkSession) -> Iterator[Stages]:
    """Stages that are deleted at the end, but for the result's: pass that to `drop` first."""
    own = Stages(spark)
    try:
        yield own
    except BaseException:
        own.drop()
        raise
