"""What the metadata of cells say about clusters: shares of values, conditions, compositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ANNOTATION_KEYS, CLUSTERING_KEYS


def long_form(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """cell_id, cluster_id, col_ord, col, value: a row for each column of a cell; a missing value is the text nan."""
    entries = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value")) for i, c in enumerate(columns)])
    return cells.select("cell_id", "cluster_id", F.inline(entries))


def chosen_columns(cells: DataFrame, columns: Sequence[str], most_values: int = 30, most_columns: int = 8) -> list[str]:
    """The first columns that have 2 to `most_values` values; one row comes to the driver."""
    n = cells.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("nan"))).alias(c) for c in columns]).first()
    return [c for c in columns if 1 < n[c] <= most_values][:most_columns]


def cluster_key(cells: DataFrame, candidates: Sequence[str] = (*ANNOTATION_KEYS, *CLUSTERING_KEYS), least: int = 2, most: int = 200) -> str | None:
    """The first candidate of the table that has `least` to `most` values."""
    there = [c for c in candidates if c in cells.columns]
    if not there:
        return None
    n = cells.agg(*[F.count_distinct(c).alias(c) for c in there]).first()
    return next((c for c in there if least <= n[c] <= most), None)


def cluster_metadata(cells: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """cluster_id, n_cells, col_ord, col, value, n, frac: the `top` values of each column in each cluster."""
    return metadata_of_counts(long_form(cells, columns).groupBy("cluster_id", "col_ord", "col", "value").agg(F.count("*").alias("n")), top)


def metadata_of_counts(counted: DataFrame, top: int = 5) -> DataFrame:
    """What cluster_metadata gives, from counts (cluster_id, col_ord, col, value, n)."""
    own = Window.partitionBy("cluster_id", "col")
    found = counted.withColumn("n_cells", F.sum("n").over(own)).withColumn("_r", F.row_number().over(own.orderBy(F.desc("n"), "value")))
    return found.filter(F.col("_r") <= top).select("cluster_id", "n_cells", "col_ord", "col", "value", "n", (F.col("n") / F.col("n_cells")).alias("frac"))


def composition(cells: DataFrame) -> DataFrame:
    """cluster_id, n, fraction, percentage."""
    counted = cells.groupBy("cluster_id").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row for each cluster
    return counted.select("cluster_id", "n", share.alias("fraction"), F.round(share * 100, 2).alias("percentage"))


def condition_composition(meta: DataFrame, col: str) -> DataFrame:
    """condition, cluster_id, n and fraction_of_condition, from the shares that the metadata keep.

    n is the share of the cluster's cells, as a whole number, halves to the even one.
    """
    own = meta.filter(F.col("col") == col).select(F.col("value").alias("condition"), "cluster_id", F.rint(F.col("n_cells") * F.col("frac")).cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy("condition"))
    return own.select("condition", "cluster_id", "n", F.coalesce(F.try_divide("n", total), F.lit(0.0)).alias("fraction_of_condition"))


def fold_changes(shares: DataFrame) -> DataFrame:
    """cluster_id, fa, fb, fold_change, is_inf of the first condition over the second, in the order of their names.

    Empty unless there are two conditions. Where fb is 0.001 or less: infinite if fa is more, else 1.
    """
    names = shares.agg(F.sort_array(F.collect_set("condition"))).scalar()
    of = lambda i: F.sum(F.when(F.col("condition") == F.get(names, F.lit(i)), F.round("fraction_of_condition", 4)).otherwise(0.0))
    both = shares.groupBy("cluster_id").agg(of(0).alias("fa"), of(1).alias("fb")).filter(F.size(names) == 2)
    is_inf = (F.col("fb") <= 0.001) & (F.col("fa") > 0.001)
    return both.withColumn("is_inf", is_inf).withColumn("fold_change", F.when(F.col("fb") > 0.001, F.col("fa") / F.when(F.col("fb") > 0.001, F.col("fb"))).when(~is_inf, F.lit(1.0)))


def changes_in_order(changes: DataFrame) -> DataFrame:
    """What fold_changes gives, and place: by the change at three digits, an infinite one as 999; ties by cluster."""
    size = F.when(F.col("is_inf"), 999.0).otherwise(F.round("fold_change", 3))
    return changes.withColumn("place", F.row_number().over(Window.orderBy(F.desc(size), "cluster_id")).cast("long"))


def detect_condition(meta: DataFrame, keywords: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """One row at most: col and how it was found.

    First a column of 2 to 10 values whose name holds a keyword, or is held by one (keywords: kw_ord, kw; the order of
    keywords goes before that of columns); else a column of two values whose name has nothing of `skip`.
    """
    columns = meta.groupBy("col_ord", "col").agg(F.count_distinct("value").alias("n")).withColumn("name", F.translate(F.lower("col"), "_-", "  "))
    named = columns.filter("n BETWEEN 2 AND 10").join(F.broadcast(keywords), F.col("name").contains(F.col("kw")) | F.col("kw").contains(F.col("name"))).select(F.lit(0).alias("how"), "kw_ord", "col_ord", "col")
    skipped = F.lit(False)
    for s in skip:
        skipped = skipped | F.col("name").contains(s)
    binary = columns.filter((F.col("n") == 2) & ~skipped).select(F.lit(1).alias("how"), F.lit(0).alias("kw_ord"), "col_ord", "col")
    return named.unionByName(binary).orderBy("how", "kw_ord", "col_ord").limit(1).select("col", F.when(F.col("how") == 0, "keyword").otherwise("binary").alias("how"))


def group_column(meta: DataFrame, a: str, b: str) -> DataFrame:
    """The first column that holds either group, whatever its case, and the groups as they are stored there."""
    own = meta.filter(F.lower("value").isin(a.lower(), b.lower()))
    stored = lambda x: F.max(F.when(F.lower("value") == x.lower(), F.col("value")))
    return own.groupBy("col_ord", "col").agg(F.min("cluster_id").alias("_first"), stored(a).alias("group_a"), stored(b).alias("group_b")).orderBy("col_ord").limit(1).drop("_first", "col_ord")


def biased_clusters(clusters: DataFrame, meta: DataFrame, col: str, a: str, b: str, over: float = 0.6, least: float = 0.01) -> DataFrame:
    """cluster_id, frac_a, frac_b, bias (a, b or mixed); clusters with less than `least` of both are left out."""
    own = meta.filter(F.col("col") == col).groupBy("cluster_id").agg(*[F.sum(F.when(F.col("value") == v, F.col("frac")).otherwise(0.0)).alias(n) for v, n in ((a, "frac_a"), (b, "frac_b"))])
    both = clusters.select("cluster_id").join(own, "cluster_id", "left").na.fill(0.0, ["frac_a", "frac_b"])
    bias = F.when(F.col("frac_a") > over, a).when(F.col("frac_b") > over, b).otherwise("mixed")
    return both.filter((F.col("frac_a") >= least) | (F.col("frac_b") >= least)).withColumn("bias", bias)


def compared_genes(biased: DataFrame, stats: DataFrame, genes: DataFrame | None = None, min_pct: float = 0.05, top: int = 20) -> DataFrame:
    """The markers of the biased clusters: those in `genes` (gene_u) if given, else the `top` by |logfc| of pct_in >= min_pct."""
    both = biased.join(stats, "cluster_id")
    if genes is not None:
        return both.join(genes.select("gene_u").distinct(), "gene_u", "left_semi")
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.abs("logfc")), "gene"))
    return both.filter(F.col("pct_in") >= min_pct).withColumn("_r", r).filter(F.col("_r") <= top).drop("_r")


def enriched_genes(compared: DataFrame, sides: Sequence[str], top: int = 30) -> DataFrame:
    """side, gene, n_clusters, max_logfc, rank: genes of positive logfc in clusters biased to a side."""
    own = compared.filter(F.col("bias").isin(*sides) & (F.col("logfc") > 0)).groupBy(F.col("bias").alias("side"), "gene").agg(F.count("*").alias("n_clusters"), F.max("logfc").alias("max_logfc"))
    r = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("max_logfc"), "gene"))
    return own.withColumn("rank", r.cast("long")).filter(F.col("rank") <= top)


def capabilities(clusters: DataFrame, meta: DataFrame, keywords: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """One row: has_conditions, condition_column, condition_values (sorted; 10 at most), n_clusters.

    The clusters themselves are a table of their own.
    """
    found = detect_condition(meta, keywords, skip).select(F.col("col").alias("condition_column"))
    values = meta.join(found, F.col("col") == F.col("condition_column")).groupBy("condition_column").agg(F.array_sort(F.collect_set("value")).alias("condition_values"))
    own = clusters.agg(F.count("*").alias("n_clusters")).join(values, F.lit(True), "left")
    return own.select(F.col("condition_column").isNotNull().alias("has_conditions"), "condition_column", F.coalesce("condition_values", F.array().cast("array<string>")).alias("condition_values"), "n_clusters")
