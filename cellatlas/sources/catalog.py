"""The atlas as a folder of Parquet tables, and other files that feed it or leave it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import SYMBOL_COLUMNS
from ..functions.text import base_id

TABLES = ("clusters", "gene_stats", "gene_index", "cluster_meta", "terms", "synonyms", "cells", "expr", "pairs", "sets", "manifest")


def write_table(df: DataFrame, root: str, name: str, by: Sequence[str] = ()) -> None:
    """Overwrites one table; gene_stats are sorted by gene in each file, so that a gene's row groups are found."""
    own = df.sortWithinPartitions("gene_u") if name == "gene_stats" else df
    writer = own.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{root}/{name}")


def write_manifest(spark: SparkSession, root: str, version: str, alpha: float) -> None:
    write_table(spark.createDataFrame([(version, alpha)], "pipeline_version string, embedding_alpha double"), root, "manifest")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name}; there are {', '.join(TABLES)}")
    return spark.read.parquet(f"{root}/{name}")


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def write_cells(cells: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    (cells.select(*columns) if columns else cells).write.mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def gene_map(spark: SparkSession, path: str) -> DataFrame:
    """base_id, symbol from a CSV of feature_id and feature_name; of repeated ids the last row counts."""
    rows = spark.read.csv(path, header=True).withColumn("_ord", F.monotonically_increasing_id())
    return last_by(rows.select(base_id(F.col("feature_id")).alias("base_id"), F.col("feature_name").alias("symbol"), "_ord"), "base_id", "symbol", "_ord")


def last_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def mapped_genes(genes: DataFrame, mapping: DataFrame) -> DataFrame:
    """genes (gene_idx, ensembl_id) with symbol: from the mapping, else the id without its version."""
    own = genes.withColumn("base_id", base_id(F.col("ensembl_id")))
    return own.join(mapping, "base_id", "left").withColumn("symbol", F.coalesce("symbol", "base_id")).drop("base_id")


def unique_symbols(genes: DataFrame) -> DataFrame:
    """Repeated symbols get -1, -2 and so on behind the first."""
    r = F.row_number().over(Window.partitionBy("symbol").orderBy("gene_idx")) - 1
    return genes.withColumn("_r", r).withColumn("symbol", F.when(F.col("_r") > 0, F.concat_ws("-", "symbol", F.col("_r").cast("string"))).otherwise(F.col("symbol"))).drop("_r")


def symbol_column(genes: DataFrame, names: Sequence[str] = SYMBOL_COLUMNS) -> str | None:
    """The first known column whose first value is no Ensembl id."""
    there = [c for c in names if c in genes.columns]
    first = genes.orderBy("gene_idx").select(*there).first() if there else None
    return next((c for c in there if first is not None and not str(first[c]).startswith("ENSG")), None)


def looks_ensembl(genes: DataFrame, column: str = "symbol", first: int = 10, least: int = 5) -> bool:
    rows = genes.orderBy("gene_idx").limit(first).agg(F.sum(F.col(column).startswith("ENSG").cast("int"))).first()
    return (rows[0] or 0) >= least


def aligned_vectors(clusters: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """clusters with vec of another table by cluster id, zeros where it has none, at length 1 (a guard of 1e-8)."""
    from ..functions.vectors import normalized

    own = clusters.drop("vec").join(vectors.select("cluster_id", F.col("vec").cast("array<double>").alias("vec")), "cluster_id", "left")
    return own.withColumn("vec", normalized(F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)), 1e-8))


def read_npz(spark: SparkSession, path: str, ids: str = "orig_ids", vectors: str = "transcriptome_embeds") -> DataFrame:
    """id, vec and, where the archive has labels, label: read by blocks of rows (see sources.arrays)."""
    from . import arrays

    arrays.register(spark)
    return spark.read.format("atlas_vectors").option("path", path).option("ids", ids).option("vectors", vectors).load()


def read_atlas(spark: SparkSession, path: str, block: int | None = None) -> dict[str, DataFrame]:
    """cells, genes and expr of an .h5ad file (needs h5py) or of an .npz archive of the same members.

    cells: cell_id and the columns of obs. genes: gene_idx, ensembl_id and symbol, from the first known symbol column
    that holds symbols, else the names themselves; repeated symbols get a number. expr: cell_id, gene (the symbol),
    value, without zeros. All are read by blocks of rows (see sources.arrays); nothing passes the driver but names of
    columns.
    """
    from . import arrays

    arrays.register(spark)
    read = lambda kind, **more: spark.read.format(kind).options(path=path, **({"block": block} if block else {}), **more).load()
    obs, var = read("atlas_table", table="obs"), read("atlas_table", table="var").withColumnsRenamed({"row": "gene_idx", "name": "ensembl_id"})
    known = symbol_column(var)
    genes = unique_symbols(var.select("gene_idx", "ensembl_id", F.col(known or "ensembl_id").alias("symbol")))
    entries = read("atlas_matrix")
    expr = entries.join(genes.select(F.col("gene_idx").alias("gene"), "symbol"), "gene").drop("gene")
    expr = expr.join(obs.select(F.col("row").alias("cell"), F.col("name").alias("cell_id")), "cell").select("cell_id", F.col("symbol").alias("gene"), "value")
    return {"cells": obs.drop("row").withColumnRenamed("name", "cell_id"), "genes": genes, "expr": expr}


def read_gmt(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Gene sets, a line each: name, a note, genes; tab-separated. Definitions keep their order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("set_ord", "line")).filter(F.trim("line") != "")
    parts = F.split("line", "\t")
    entries = lines.select("set_ord", parts[0].alias("set_name"), F.posexplode(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))).alias("gene_ord", "gene"))
    return entries.select(F.lit(collection).alias("collection"), "set_ord", "set_name", "gene_ord", "gene")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """lr_ord, ligand, receptor, pathway from a CSV with these last three columns; repeats stay."""
    return spark.read.csv(path, header=True).select(F.monotonically_increasing_id().alias("lr_ord"), "ligand", "receptor", "pathway")


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, of the same columns; where both have a key, the second's."""
    return second.unionByName(first.join(second.select(key), key, "left_anti"))
