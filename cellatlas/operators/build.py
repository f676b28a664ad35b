"""The offline build: from counts to clusters, and from clustered cells to a written catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import catalog
from ..sources.staged import Stages, stages
from . import components, encode, genesets, graph, meta, profile, stats, trend
from .rank import top_genes


def cells_in_components(expr: DataFrame, cells: DataFrame, genes: int = 3000, dims: int = 50, most: float = 10.0, own: Stages | None = None) -> DataFrame:
    """cell_id, pca: cells in the first components of their scaled variable genes. expr is log-normalized."""
    with stages(cells.sparkSession) as st:
        st = own or st
        moments = st.table(trend.genes_by_trend(expr, cells, genes, own=st).select("gene", "mean", "variance"), "variable")
        scaled = st.table(components.scaled(expr, moments, most), "scaled")
        return components.principal_components(scaled, cells, dims, own=st).scores


def clustered_cells(expr: DataFrame, cells: DataFrame, genes: int = 3000, dims: int = 50, k: int = 15, resolution: float = 1.0, probes: int | None = None) -> DataFrame:
    """cells with cluster_id ('0' is the largest) and pca: variable genes, components, neighbours, communities.

    Counts are log-normalized first, if they are counts. Cells that nobody is near to, as in an atlas of one cell, get
    clusters of their own. Clusters are numbered by size, equal ones by their smallest cell.
    """
    spark = cells.sparkSession
    with stages(spark) as st:
        plain = st.table(stats.log_normalized(expr.select("cell_id", "gene", "value")), "values")
        vectors = st.table(cells_in_components(plain, cells, genes, dims, own=st), "components")
        near = st.table(graph.neighbours(vectors, k, "cell_id", "pca", probes, own=st).select("id", "other"), "neighbours")
        labels = graph.modular_communities(near, resolution).withColumnRenamed("id", "cell_id")
        every = cells.drop("cluster_id", "pca").join(vectors, "cell_id", "left").join(labels, "cell_id", "left").withColumn("community", F.coalesce("community", "cell_id"))
        sizes = every.groupBy("community").agg(F.count("*").alias("n"))  # a row a cluster
        numbered = sizes.withColumn("cluster_id", (F.row_number().over(Window.orderBy(F.desc("n"), "community")) - 1).cast("string")).drop("n")
        found = st.table(every.join(numbered, "community").drop("community"), "clustered")
        st.drop(found)
        return found


def build(root: str, expr: DataFrame, cells: DataFrame, columns: Sequence[str] | None = None, sets: DataFrame | None = None, pairs: DataFrame | None = None, encoder=None, text_genes: int = 400, stat_genes: int = 10_000, alpha: float = 0.6, version: str = "1", **clustering) -> dict[str, DataFrame]:
    """Writes a catalog below `root` and gives its tables by name.

    expr: cell_id, gene, value (counts, or log-normalized). cells: cell_id, cluster_id and further columns; without a
    cluster_id, clustered_cells finds clusters (it takes `clustering`). columns: those to be counted in clusters; by
    default those with 2 to 30 values, 8 at most. sets: gene sets for over-representation, and encoder: a function
    that loads a TextEncoder, for vectors of the clusters' texts; both may be left out.

    Tables: cells, expr (with cluster_id, so that later statistics need no join), gene_stats (marker statistics with p
    and p_adj of the `stat_genes` of highest z in each cluster), gene_index, cluster_meta, terms, synonyms, clusters
    (ordinal, texts, vectors of texts and of cells), pairs and sets as given, manifest.
    """
    spark = cells.sparkSession
    write = lambda df, name: catalog.write_table(df, root, name)
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    own = cells if "cluster_id" in cells.columns else clustered_cells(expr, cells, **clustering)
    write(own.withColumn("cluster_id", F.col("cluster_id").cast("string")), "cells")
    own = read("cells")
    write(stats.clustered(stats.log_normalized(expr.select("cell_id", "gene", "value")), own), "expr")
    plain = read("expr")
    write(stats.guarded(stats.markers(plain, own, stat_genes).withColumnRenamed("p_adj", "pval_adj")), "gene_stats")
    found = read("gene_stats")
    write(stats.inverted_index(found), "gene_index")
    rest = [c for c in own.columns if c not in ("cell_id", "cluster_id", "pca")]
    named = list(columns) if columns is not None else meta.chosen_columns(own, rest) if rest else []
    if named:
        write(meta.cluster_metadata(own, named), "cluster_meta")
    ranked = top_genes(found, max(text_genes, 200))
    if sets is not None:
        terms = genesets.over_representation(ranked, sets, found)
        write(terms.select("cluster_id", F.lit("sets").alias("source"), "rank", F.col("set_name").alias("term"), "p_adj"), "terms")
        write(sets, "sets")
    if pairs is not None:
        write(pairs, "pairs")
    ids = own.select("cluster_id").distinct()
    order = Window.orderBy((~F.col("cluster_id").rlike("^[0-9]+$")).cast("int"), "cluster_id")  # digits first; a row a cluster
    clusters = ids.withColumn("cluster_ord", F.row_number().over(order) - 1)
    write(ids.select("cluster_id", F.explode(T.synonyms(F.col("cluster_id"))).alias("term")), "synonyms")
    texts = encode.summaries(ids, ranked, read("terms") if sets is not None else None, read("cluster_meta") if named else None, text_genes)
    clusters = clusters.join(texts, "cluster_id")
    if encoder is not None:
        both = clusters.withColumn("_a", encode.encoded(F.col("identity_text"), encoder)).withColumn("_b", encode.encoded(F.col("context_text"), encoder))
        clusters = both.withColumn("vec", encode.cluster_vectors(F.col("_a"), F.col("_b"), alpha)).drop("_a", "_b")
    if "pca" in own.columns:
        cell_vec = profile.centroids(own.filter("pca IS NOT NULL"), "cluster_id", "pca", 1e-8).select("cluster_id", F.col("vec").alias("cell_vec"))
        clusters = clusters.join(cell_vec, "cluster_id", "left")
    write(clusters, "clusters")
    catalog.write_manifest(spark, root, version, alpha)
    names = ["cells", "expr", "gene_stats", "gene_index", "synonyms", "clusters", "manifest", *["cluster_meta"] * bool(named), *["terms", "sets"] * (sets is not None), *["pairs"] * (pairs is not None)]
    return {n: read(n) for n in names}
