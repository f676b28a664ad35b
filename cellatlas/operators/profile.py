"""Profiles of genes over clusters, and what plots of them need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, normalized
from .stats import clustered, specificity


def marker_specificity(stats: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """cluster_id, gene, specificity, weighted = specificity * |logfc|."""
    own = stats if genes is None else stats.join(genes.select("gene_u").distinct(), "gene_u", "left_semi")
    return own.select("cluster_id", "gene", specificity().alias("specificity"), (specificity() * F.abs("logfc")).alias("weighted"))


def top_specific(found: DataFrame, top: int = 20) -> DataFrame:
    """The `top` of each cluster, on values rounded to four digits."""
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.round("weighted", 4)), "gene"))
    return found.withColumn("rank", r.cast("long")).filter(F.col("rank") <= top)


def top_specific_overall(found: DataFrame, top: int = 50) -> DataFrame:
    return found.orderBy(F.desc(F.round("weighted", 4)), "gene", "cluster_id").limit(top)


def coexpression(stats: DataFrame, clusters: DataFrame, gene: str, metric: str = "pct_in") -> DataFrame:
    """gene_u, corr of each other gene with `gene` over all clusters; where a cluster lacks a gene its value is 0.

    By sums over what is there, so no zero is ever stored. Genes that hardly vary (deviation under 1e-8) are left out.
    """
    x = stats.filter(F.col("gene_u") == gene.upper()).select("cluster_id", F.col(metric).alias("x"))
    # One row: the gene's values by cluster, and their sums. Statistics are evaluated for it and for the scan, no more.
    one = x.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("sx"), F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("sxx"), F.map_from_entries(F.collect_list(F.struct("cluster_id", "x"))).alias("_x"))
    one = one.join(clusters.agg(F.count("*").alias("n")), F.lit(True))
    y = F.col(metric)
    there = stats.filter(F.col("gene_u") != gene.upper()).select("gene_u", "cluster_id", metric).join(one, F.lit(True))
    sums = there.groupBy("gene_u").agg(F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(y * F.coalesce(F.element_at("_x", F.col("cluster_id")), F.lit(0.0))).alias("sxy"))
    own = sums.join(one.drop("_x"), F.lit(True))
    var = lambda s, q: F.greatest(F.col(q) / F.col("n") - F.col(s) * F.col(s) / (F.col("n") * F.col("n")), F.lit(0.0))
    own = own.withColumn("dx", F.sqrt(var("sx", "sxx"))).withColumn("dy", F.sqrt(var("sy", "syy"))).filter("dx >= 1e-8 AND dy >= 1e-8")
    return own.select("gene_u", ((F.col("sxy") / F.col("n") - F.col("sx") * F.col("sy") / (F.col("n") * F.col("n"))) / (F.col("dx") * F.col("dy"))).alias("corr"))


def top_correlated(found: DataFrame, top: int = 20) -> DataFrame:
    """The `top` positive and negative partners by |corr|, rounded to four digits."""
    side = F.when(F.col("corr") > 0, "positive").otherwise("negative")
    r = F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs(F.round("corr", 4))), "gene_u"))
    return found.withColumn("side", side).withColumn("rank", r.cast("long")).filter(F.col("rank") <= top)


def coexpression_pair(stats: DataFrame, clusters: DataFrame, a: str, b: str, metric: str = "pct_in") -> DataFrame:
    """One row: gene_a, gene_b, corr; 0 if either hardly varies."""
    value = lambda g, n: F.sum(F.when(F.col("gene_u") == g.upper(), F.col(metric)).otherwise(0.0)).alias(n)
    own = clusters.select("cluster_id").join(stats.filter(F.col("gene_u").isin(a.upper(), b.upper())).groupBy("cluster_id").agg(value(a, "x"), value(b, "y")), "cluster_id", "left").na.fill(0.0, ["x", "y"])
    moments = own.agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("dx"), F.stddev_pop("y").alias("dy"))
    corr = F.when((F.col("dx") < 1e-8) | (F.col("dy") < 1e-8), F.lit(0.0)).otherwise(F.try_divide("c", F.col("dx") * F.col("dy")))
    return moments.select(F.lit(a).alias("gene_a"), F.lit(b).alias("gene_b"), corr.alias("corr"))


def centroids(vectors: DataFrame, key: str, vec: str = "vec", guard: float | None = None) -> DataFrame:
    """key, n, vec: the mean of each group's vectors, at length 1 unless guard is negative. Sums are by key and place."""
    n = vectors.groupBy(key).agg(F.count("*").alias("n"))
    means = vectors.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec")).join(n, key)
    return whole if guard is not None and guard < 0 else whole.withColumn("vec", normalized(F.col("vec"), guard))


def pooled(cells: DataFrame, key: str = "cluster_id", vec: str = "vec", cell: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """The mean of each group's vectors as it is (key, n, vec), and its cells as rows (key, cell, place).

    A group's cells are rows, not a list, so that a large one is never a single value; places are counted in slices of
    the cells' hash, so no task orders a whole group.
    """
    from .stats import numbered

    own = cells.filter(F.col(vec).isNotNull())
    return centroids(own, key, vec, -1), numbered(cells.select(key, cell), key, cell)


def similarities(clusters: DataFrame) -> DataFrame:
    """a, b, cosine of each two clusters (cluster_id, vec), itself included; clusters are few."""
    a, b = clusters.select(F.col("cluster_id").alias("a"), F.col("vec").alias("va")), clusters.select(F.col("cluster_id").alias("b"), F.col("vec").alias("vb"))
    return a.join(b, F.lit(True)).select("a", "b", cosine(F.col("va"), F.col("vb"), 0.0).alias("cosine"))


def vector_spread(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: the mean over the places of the vectors' population variance."""
    return vectors.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.var_pop(F.col("x").cast("double")).alias("v")).agg(F.avg("v").alias("mean_variance"))


def pairwise_cosines(vectors: DataFrame, key: str, vec: str = "vec", sample: int = 500) -> DataFrame:
    """One row: n pairs, and the mean, least and highest cosine of each two of `sample` vectors, drawn by a hash of their key.

    A vector of zeros has the cosine 0 with all. The sample is bounded, and so are its pairs.
    """
    own = vectors.select(F.col(key).alias("k"), normalized(F.col(vec)).alias("v")).orderBy(F.md5(F.col("k").cast("string")), "k").limit(sample)
    a, b = own.toDF("a", "va"), own.toDF("b", "vb")
    pairs = a.join(b, F.col("a") < F.col("b")).select(F.coalesce(cosine(F.col("va"), F.col("vb"), 0.0), F.lit(0.0)).alias("c"))
    return pairs.agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.min("c").alias("least"), F.max("c").alias("highest"))


def dotplot(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """cluster_id, gene, pct, mean, z for each cluster and each asked gene; z over the clusters, 0 for a constant gene."""
    sizes = cells.groupBy("cluster_id").agg(F.count("*").alias("n"))
    asked = genes.select("gene").distinct()
    own = clustered(expr.join(asked, "gene", "left_semi"), cells).groupBy("cluster_id", "gene").agg(F.count("*").alias("k"), F.sum("value").alias("s"))
    every = sizes.join(asked, F.lit(True)).join(own, ["cluster_id", "gene"], "left")
    found = every.select("cluster_id", "gene", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("pct"), (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))
    at = Window.partitionBy("gene")
    d = F.stddev_pop("mean").over(at)
    return found.withColumn("z", F.coalesce(F.try_divide(F.col("mean") - F.avg("mean").over(at), F.nullif(d, F.lit(0.0))), F.lit(0.0)))


def quantiles(expr: DataFrame, share: float, grid: int = 32) -> DataFrame:
    """gene, n, value: the exact quantile of each gene's values, linear between the two around its place.

    First how many values each step of 1 / grid has, which tells the steps that hold the two; then only the values of
    these steps are counted and ordered. No buffer holds a gene's values.
    """
    own = expr.select("gene", "value", F.floor(F.col("value") * grid).alias("step"))
    counts = own.groupBy("gene", "step").agg(F.count("*").alias("k"))
    up_to = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = (F.col("n") - 1) * F.lit(float(share))
    steps = counts.withColumn("n", F.sum("k").over(Window.partitionBy("gene"))).withColumn("before", F.sum("k").over(up_to("gene").orderBy("step")) - F.col("k"))
    low, high = F.floor(place), F.ceil(place)
    inside = lambda x: (F.col("before") <= x) & (x < F.col("before") + F.col("k"))
    held = steps.filter(inside(low) | inside(high)).select("gene", "step", "n", "before", low.alias("low"), high.alias("high"), (place - low).alias("part"))
    values = own.join(held, ["gene", "step"]).groupBy("gene", "step", "value").agg(F.count("*").alias("k"), *[F.first(c).alias(c) for c in ("n", "before", "low", "high", "part")])
    ranked = values.withColumn("before", F.col("before") + F.sum("k").over(up_to("gene", "step").orderBy("value")) - F.col("k"))
    ends = ranked.groupBy("gene").agg(F.max("n").alias("n"), F.max("part").alias("part"), F.max(F.when(inside(F.col("low")), F.col("value"))).alias("a"), F.max(F.when(inside(F.col("high")), F.col("value"))).alias("b"))
    return ends.select("gene", "n", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("value"))


def expression_cap(expr: DataFrame, share: float = 0.98, few: int = 10) -> DataFrame:
    """gene, n, cap: the exact percentile of non-zero values; 1 for a gene of `few` values or less."""
    return quantiles(expr, share).select("gene", "n", F.when(F.col("n") > few, F.col("value")).otherwise(F.lit(1.0)).alias("cap"))


def gene_on_cells(expr: DataFrame, cells: DataFrame, gene: str) -> DataFrame:
    """cell_id, cluster_id, value of one gene, 0 where a cell has none."""
    return cells.select("cell_id", "cluster_id").join(expr.filter(F.col("gene") == gene).select("cell_id", "value"), "cell_id", "left").na.fill(0.0, ["value"])


def gene_cluster_pivot(stats: DataFrame, clusters: list[str], top: int = 20, metric: str = "logfc") -> DataFrame:
    """gene and a column for each cluster: the `top` genes by their highest value, 0 where a cluster has none."""
    best = stats.groupBy("gene").agg(F.max(metric).alias("_m")).orderBy(F.desc("_m"), "gene").limit(top)
    return stats.join(best, "gene").groupBy("gene").pivot("cluster_id", clusters).agg(F.first(metric)).na.fill(0.0)


def strongest_evidence(stats: DataFrame, top: int = 15) -> DataFrame:
    """gene, cluster_id, logfc: for each gene its entry of largest |logfc|; the `top` of these."""
    own = stats.groupBy("gene").agg(F.max_by(F.struct("cluster_id", "logfc"), F.struct(F.abs("logfc"), "cluster_id")).alias("x"))
    return own.select("gene", "x.cluster_id", "x.logfc").orderBy(F.desc(F.abs("logfc")), "gene").limit(top)


def cluster_positions(cells: DataFrame, x: str, y: str) -> DataFrame:
    """cluster_id, n, x, y: where to write a cluster's name."""
    return cells.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def best_setting(results: DataFrame, setting: str, score: str) -> DataFrame:
    """The setting of the highest score (the lowest of equal ones)."""
    return results.orderBy(F.desc(score), setting).limit(1)


def projected(vectors: DataFrame, vec: str = "vec", dims: int = 2) -> DataFrame:
    """vectors and pca: their first principal components (the sign of each is arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = vectors.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return PCA(k=dims, inputCol="_v", outputCol="_p").fit(own).transform(own).withColumn("pca", vector_to_array("_p")).drop("_v", "_p")
