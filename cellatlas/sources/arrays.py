"""Array files as partitioned tables: a reader partition for each block of rows, so no process holds a whole file.

`register(spark)` makes the formats known:

* `atlas_vectors`: an .npz archive of vectors (rows x places) and their ids, with labels if it has them. Columns id,
  vec, label.
* `atlas_table`: the table `obs` (cells) or `var` (genes) beside a matrix, with the number of the row as `row` and the
  names of rows as `name`; columns of numbers are doubles, all others text. In an .npz archive its members are
  `obs/_index` and `obs/<column>`, or `obs/<column>/codes` and `obs/<column>/categories`; in an .h5ad file they are so
  called by the format. Option table: obs or var.
* `atlas_matrix`: a matrix of cells x genes, as an .npz archive (a dense `X`, or CSR or CSC in the members data,
  indices, indptr, shape, format) or, where h5py is installed, an .h5ad file. Columns cell, gene (numbers of row and
  column), value: the entries that aren't zero.

Options: path (of a file that every executor can open), block (rows of a partition, 65536 by default; columns for CSC),
and for vectors the members' names (ids, vectors, labels).
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

BLOCK = 1 << 16


class Member:
    """One array of an .npz archive, of which slices of rows are read."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.archive, self.name = archive, f"{name}.npy"
        with archive.open(self.name) as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            self.shape, self.by_column, self.dtype = read(f)
            self.start = f.tell()
        if self.dtype.hasobject:
            raise ValueError(f"{name} holds Python objects")

    def rows(self, start: int, stop: int) -> np.ndarray:
        """A member that is stored as it is is read from there on; a compressed one is unpacked up to there."""
        if self.by_column and len(self.shape) > 1:
            raise ValueError(f"{self.name} is stored by column; save it by row")
        width = int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize
        with self.archive.open(self.name) as f:
            f.seek(self.start + start * width)
            own = f.read((stop - start) * width)
        return np.frombuffer(own, self.dtype).reshape(-1, *self.shape[1:])


class Dataset:
    """The same over an array of an h5ad file."""

    def __init__(self, array):
        self.array, self.shape = array, array.shape

    def rows(self, start: int, stop: int) -> np.ndarray:
        return self.array[start:stop]


@contextmanager
def _opened(path: str):
    """(members, kind): a function that gives arrays by name, and how the matrix is stored: dense, csr or csc."""
    if path.endswith(".h5ad"):
        try:
            import h5py
        except ImportError as e:
            raise ImportError("h5py is needed to read h5ad; save the matrix as npz, or land it as Parquet") from e
        with h5py.File(path) as f:
            x = f["X"]
            kind = "dense" if isinstance(x, h5py.Dataset) else str(x.attrs.get("encoding-type", "csr_matrix"))[:3]

            def member(name: str) -> Dataset:
                if name.endswith("/_index"):
                    group = f[name.removesuffix("/_index")]
                    return Dataset(group[group.attrs.get("_index", "_index")])
                return Dataset(f[name] if "/" in name or name == "X" else x[name])

            yield member, kind
    else:
        with zipfile.ZipFile(path) as archive:
            names = {n.removesuffix(".npy") for n in archive.namelist()}
            kind = "dense" if "indptr" not in names else bytes(np.asarray(Member(archive, "format").rows(0, 1)).reshape(-1)[0]).decode() if "format" in names else "csr"
            yield (lambda name: Member(archive, name)), kind


class Block(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


def _blocks(n: int, size: int) -> list[Block]:
    return [Block(s, min(s + size, n)) for s in range(0, n, size)] or [Block(0, 0)]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("block", BLOCK))


class _VectorReader(_Reader):
    def __init__(self, options, labelled: bool):
        super().__init__(options)
        self.names = [options.get("ids", "orig_ids"), options.get("vectors", "transcriptome_embeds")] + [options.get("labels", "labels")] * labelled

    def partitions(self) -> list[Block]:
        with _opened(self.path) as (member, _):
            return _blocks(member(self.names[1]).shape[0], self.size)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as (member, _):
            members = [member(n) for n in self.names]
            for s in range(partition.start, partition.stop, 4096):
                ids, vectors, *labels = (m.rows(s, min(s + 4096, partition.stop)) for m in members)
                text = lambda x: pa.array([v.decode() if isinstance(v, bytes) else str(v) for v in x.tolist()], pa.string())
                vec = pa.array(list(vectors.astype(np.float64)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([text(ids), vec, *map(text, labels)], names=["id", "vec", "label"][: 2 + len(labels)])


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "atlas_vectors"

    def _labelled(self) -> bool:
        with zipfile.ZipFile(self.options["path"]) as archive:
            return f"{self.options.get('labels', 'labels')}.npy" in archive.namelist()

    def schema(self) -> str:
        return "id string, vec array<double>" + ", label string" * self._labelled()

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self.options, "label" in schema.names)


def _columns(path: str, table: str) -> dict[str, bool]:
    """The table's columns, and whether each is categorical."""
    if path.endswith(".h5ad"):
        import h5py

        with h5py.File(path) as f:
            group = f[table]
            index = group.attrs.get("_index", "_index")
            return {c: not isinstance(v, h5py.Dataset) for c, v in group.items() if c != index and not c.startswith("__")}
    with zipfile.ZipFile(path) as archive:
        names = [n.removesuffix(".npy").removeprefix(f"{table}/") for n in archive.namelist() if n.startswith(f"{table}/")]
    plain = {n: False for n in names if "/" not in n and n != "_index"}
    return plain | {n.removesuffix("/codes"): True for n in names if n.endswith("/codes")}


def _text(x) -> str:
    return x.decode() if isinstance(x, bytes) else str(x)


class _TableReader(_Reader):
    def __init__(self, options, schema):
        super().__init__(options)
        self.table, self.fields = options.get("table", "obs"), [(f.name, f.dataType.simpleString() == "double") for f in schema.fields[2:]]

    def partitions(self) -> list[Block]:
        with _opened(self.path) as (member, _):
            return _blocks(member(f"{self.table}/_index").shape[0], self.size)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        categorical = _columns(self.path, self.table)
        with _opened(self.path) as (member, _):
            for s in range(partition.start, partition.stop, 1 << 14):
                e = min(s + (1 << 14), partition.stop)
                columns = [pa.array(np.arange(s, e)), pa.array([_text(x) for x in member(f"{self.table}/_index").rows(s, e).tolist()], pa.string())]
                for name, number in self.fields:
                    if categorical[name]:
                        codes, values = member(f"{self.table}/{name}/codes").rows(s, e), member(f"{self.table}/{name}/categories")
                        words = [_text(x) for x in values.rows(0, values.shape[0]).tolist()]
                        columns.append(pa.array([words[c] if c >= 0 else None for c in codes.tolist()], pa.string()))
                    else:
                        x = member(f"{self.table}/{name}").rows(s, e)
                        columns.append(pa.array(x.astype(np.float64)) if number else pa.array([_text(v) for v in x.tolist()], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "name", *[n for n, _ in self.fields]])


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "atlas_table"

    def schema(self) -> StructType:
        path, table = self.options["path"], self.options.get("table", "obs")
        out = StructType().add("row", LongType()).add("name", StringType())
        with _opened(path) as (member, _):
            for column, categorical in _columns(path, table).items():
                number = not categorical and member(f"{table}/{column}").rows(0, 0).dtype.kind in "iuf"
                out = out.add(column, DoubleType() if number else StringType())
        return out

    def reader(self, schema) -> DataSourceReader:
        return _TableReader(self.options, schema)


class _MatrixReader(_Reader):
    def partitions(self) -> list[Block]:
        with _opened(self.path) as (member, kind):
            return _blocks(member("X").shape[0] if kind == "dense" else member("indptr").shape[0] - 1, self.size)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as (member, kind):
            for s in range(partition.start, partition.stop, 256 if kind == "dense" else partition.stop):
                if kind == "dense":
                    x = member("X").rows(s, min(s + 256, partition.stop))
                    row, column = np.nonzero(x)
                    yield self._batch(row + s, column, x[row, column])
                    continue
                starts = member("indptr").rows(partition.start, partition.stop + 1).astype(np.int64)
                at, values = member("indices"), member("data")
                for a in range(int(starts[0]), int(starts[-1]), 1 << 18):
                    b = min(a + (1 << 18), int(starts[-1]))
                    own = partition.start + np.searchsorted(starts, np.arange(a, b), side="right") - 1
                    other, x = at.rows(a, b), values.rows(a, b)
                    kept = x != 0
                    row, column = (own, other) if kind == "csr" else (other, own)
                    yield self._batch(row[kept], column[kept], x[kept])

    def _batch(self, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(column.astype(np.int64)), pa.array(value.astype(np.float64))], names=["cell", "gene", "value"])


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "atlas_matrix"

    def schema(self) -> str:
        return "cell long, gene long, value double"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorSource)
    spark.dataSource.register(TableSource)
    spark.dataSource.register(MatrixSource)
