"""Measures of rankings and analyses against what is expected.

expected: qid, cluster_id. rankings: qid, mode, cluster_id, rank. `alike` matching counts a name that holds another or
shares half of its words; exact matching wants equal ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alike
from .names import alike as alike_names
from .names import containing


def matched(expected: DataFrame, rankings: DataFrame, fuzzy: bool = False) -> DataFrame:
    """qid, mode, cluster_id and best, the first rank at which an expected cluster is met (null: nowhere)."""
    modes = rankings.select("mode").distinct()
    wanted = expected.select("qid", "cluster_id").distinct().join(modes, F.lit(True))
    r = rankings.select(F.col("qid").alias("_q"), F.col("mode").alias("_m"), F.col("cluster_id").alias("_c"), "rank")
    same = alike(F.col("cluster_id"), F.col("_c")) if fuzzy else F.col("cluster_id") == F.col("_c")
    met = wanted.join(r, (F.col("qid") == F.col("_q")) & (F.col("mode") == F.col("_m")) & same, "left")
    return met.groupBy("qid", "mode", "cluster_id").agg(F.min("rank").alias("best"))


def recall_mrr(expected: DataFrame, rankings: DataFrame, ks: Sequence[int] = (5, 10), fuzzy: bool = False) -> DataFrame:
    """qid, mode, recall_at_k for each k, mrr = 1 / the first rank that matches, 0 if none does."""
    found = matched(expected, rankings, fuzzy)
    recalls = [F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks]
    return found.groupBy("qid", "mode").agg(*recalls, F.coalesce(1 / F.min("best"), F.lit(0.0)).alias("mrr"))


def summary(results: DataFrame, measures: Sequence[str], by: Sequence[str] = ("category", "mode")) -> DataFrame:
    """Mean and population deviation of each measure."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), *[f(m).alias(f"{n}_{m}") for m in measures for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def benchmark(results: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Means by category, and over all queries (category null)."""
    return results.rollup("category").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in measures])


def macro_mean(results: DataFrame, measure: str, by: str = "mode") -> DataFrame:
    """The mean of the categories' means."""
    return results.groupBy(by, "category").agg(F.avg(measure).alias("m")).groupBy(by).agg(F.avg("m").alias(measure))


def complementarity(expected: DataFrame, rankings: DataFrame, a: str, b: str, k: int = 10, fuzzy: bool = False) -> DataFrame:
    """One row: how many expected clusters only a finds within k, only b, both, neither."""
    found = matched(expected, rankings.filter(F.col("mode").isin(a, b)), fuzzy).groupBy("qid", "cluster_id").agg(*[F.max(F.when((F.col("mode") == m) & (F.col("best") <= k), 1).otherwise(0)).alias(n) for m, n in ((a, "in_a"), (b, "in_b"))])
    count = lambda x, y, n: F.coalesce(F.sum(F.when((F.col("in_a") == x) & (F.col("in_b") == y), 1).otherwise(0)), F.lit(0)).alias(n)
    return found.agg(count(1, 0, "only_a"), count(0, 1, "only_b"), count(1, 1, "both"), count(0, 0, "neither"))


def gene_recall(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """qid and the share of its expected genes (qid, gene_u) that were retrieved (qid, gene_u)."""
    want, have = expected.select("qid", F.upper("gene_u").alias("gene_u")).distinct(), retrieved.select("qid", F.upper("gene_u").alias("gene_u"), F.lit(1).alias("hit")).distinct()
    return want.join(have, ["qid", "gene_u"], "left").groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("gene_recall"))


def genes_of_clusters(ranking: DataFrame, stats: DataFrame, clusters: int, top: int = 500) -> DataFrame:
    """qid, gene_u: distinct genes among the `top` by |logfc| of a query's first clusters."""
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.abs("logfc")), "gene"))
    best = stats.withColumn("_r", r).filter(F.col("_r") <= top).select("cluster_id", "gene_u")
    return ranking.filter(F.col("rank") <= clusters).select("qid", "cluster_id").join(best, "cluster_id").select("qid", "gene_u").distinct()


def additive_gain(results: DataFrame, union: str, singles: Sequence[str], measure: str) -> DataFrame:
    """qid, gain of the union's measure over the best single one."""
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col(measure)))
    best = F.greatest(*[of(m) for m in singles]) if len(singles) > 1 else of(singles[0])
    return results.groupBy("qid").agg((of(union) - best).alias("gain"))


def recovered(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: n, lr_rate and full_rate of the truth's interactions (ligand, receptor, source, target).

    The first wants ligand and receptor in any pair of clusters, the second clusters of like names too.
    """
    t = truth.withColumn("_id", F.monotonically_increasing_id())
    key = lambda d: [F.upper("ligand").alias("_l"), F.upper("receptor").alias("_r")]
    p = predicted.select(*key(predicted), F.col("source").alias("_s"), F.col("target").alias("_t"))
    both = t.select("_id", "source", "target", *key(t)).join(p, ["_l", "_r"], "left")
    full = alike(F.col("source"), F.col("_s")) & alike(F.col("target"), F.col("_t"))
    each = both.groupBy("_id").agg(F.max(F.when(F.col("_s").isNotNull(), 1).otherwise(0)).alias("lr"), F.max(F.when(F.coalesce(full, F.lit(False)), 1).otherwise(0)).alias("full"))
    return each.agg(F.count("*").alias("n"), F.avg("lr").alias("lr_rate"), F.avg("full").alias("full_rate"))


def holding(left: DataFrame, right: DataFrame) -> DataFrame:
    """x, y: names (one column each) of which either holds the other."""
    return containing(left, right).unionByName(containing(right, left).select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()


def paper_interactions(truth: DataFrame, predicted: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """One row: n, n_found and rate of the truth's pairs of cluster names (source, target) that a predicted pair matches.

    Names match, whatever their case, if either holds the other; an empty one matches none. Pairs of which only a
    summary is left (source, target) count too. Predicted pairs are made distinct before they meet.
    """
    pairs = predicted.select("source", "target")
    if summary is not None:
        pairs = pairs.unionByName(summary.select("source", "target"))
    p = pairs.select(F.lower("source").alias("_s"), F.lower("target").alias("_t")).distinct()
    t = truth.select(F.lower("source").alias("source"), F.lower("target").alias("target")).withColumn("_id", F.monotonically_increasing_id())
    sources = holding(t.select("source"), p.select("_s")).toDF("source", "_s")
    targets = holding(t.select("target"), p.select("_t")).toDF("target", "_t")
    hit = t.join(sources, "source").join(p, "_s").join(targets, ["target", "_t"]).select("_id", F.lit(1).alias("_hit")).distinct()
    n = F.coalesce("_hit", F.lit(0))
    return t.join(hit, "_id", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("n_found"), F.coalesce(F.avg(n), F.lit(0.0)).alias("rate"))


def pathway_alignment(truth: DataFrame, best: DataFrame) -> DataFrame:
    """pathway and score: the best score of a computed set (set_name, score) whose name holds it or is held by it; null if none."""
    wanted = truth.select("pathway").distinct().withColumn("_p", F.lower("pathway"))
    own = best.select(F.lower("set_name").alias("_s"), "score")
    pairs = containing(wanted.select("_p"), own.select("_s")).toDF("_p", "_s").unionByName(containing(own.select("_s"), wanted.select("_p")).toDF("_s", "_p")).distinct()
    return wanted.join(pairs.join(own, "_s"), "_p", "left").groupBy("pathway").agg(F.max("score").alias("score"))


def direction_consistency(changes: DataFrame, up: DataFrame, down: DataFrame) -> DataFrame:
    """One row: n_checked and rate of clusters (cluster_id, fold_change, is_inf) that change as a list of names says.

    An infinite change counts as up; a cluster in both lists is right either way; such in neither aren't checked.
    """
    flag = lambda names, n: names.select(F.col("name").alias(n))
    own = changes.select("cluster_id", F.when(F.col("is_inf"), 999.0).otherwise(F.col("fold_change")).alias("fc"))
    for names, n in ((up, "_up"), (down, "_down")):
        met = alike_names(own.select("cluster_id"), flag(names, n)).select(F.col("a").alias("cluster_id"), F.lit(True).alias(n)).distinct()
        own = own.join(met, "cluster_id", "left").na.fill(False, [n])
    right = (F.col("_up") & (F.col("fc") > 1)) | (F.col("_down") & (F.col("fc") < 1))
    return own.filter("_up OR _down").agg(F.count("*").alias("n_checked"), F.coalesce(F.avg(F.when(right, 1.0).otherwise(0.0)), F.lit(0.0)).alias("rate"))


def overlap_recall(expected: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """One row: n_expected, n_found, n_missed and recall of distinct values."""
    want, have = expected.select(on).distinct(), found.select(on, F.lit(1).alias("_hit")).distinct()
    hit = F.coalesce("_hit", F.lit(0))
    return want.join(have, on, "left").agg(F.count("*").alias("n_expected"), F.coalesce(F.sum(hit), F.lit(0)).alias("n_found"), F.coalesce(F.sum(1 - hit), F.lit(0)).alias("n_missed"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("recall"))


def composite(gene: Column, pathway: Column, interaction: Column, theme: Column, has_proportions: Column) -> Column:
    """The replication score: shares in percent, and ten points for any proportions."""
    return 0.30 * gene + 0.20 * pathway + 0.15 * interaction + 0.25 * theme + 10 * has_proportions.cast("double")


def against_baseline(results: DataFrame, baseline: DataFrame, measure: str, pass_at: float = 0.5) -> DataFrame:
    """category, the measure, passed, delta to the baseline (category, baseline)."""
    return results.join(baseline, "category", "left").select("category", measure, (F.col(measure) >= pass_at).alias("passed"), (F.col(measure) - F.col("baseline")).alias("delta"))


def monte_carlo(results: DataFrame, measure: str) -> DataFrame:
    """qid and the mean over all runs (results: qid, run, measure)."""
    return results.groupBy("qid").agg(F.avg(measure).alias(measure), F.count("*").alias("runs"))


def evidence(**parts: DataFrame) -> DataFrame:
    """gene_u, n_parts: distinct genes over all parts of a session."""
    every = None
    for name, df in parts.items():
        own = df.select(F.upper("gene_u").alias("gene_u"), F.lit(name).alias("part"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("gene_u").agg(F.count_distinct("part").alias("n_parts"))


#: Genes that a text names: before an id in brackets, or as words in capitals.
MENTIONS = (r"\b([A-Z][A-Z0-9-]{1,15})\s*\(ENSG\d+", r"\b([A-Z][A-Z0-9]{1,12}(?:-[A-Z0-9]+)?)\b")


def session_genes(hits: DataFrame | None = None, compared: DataFrame | None = None, members: DataFrame | None = None, top: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """gene, n_sources: the distinct genes that a session came upon, and in how many of five kinds of evidence.

    The first four have a column gene: of the hits, of compared clusters, members of gene sets, and these sets' top
    genes. texts: answers and reports (one column), in which genes are named.
    """
    found = [df.select("gene", F.lit(i).alias("_kind")) for i, df in enumerate((hits, compared, members, top)) if df is not None]
    if texts is not None:
        text = F.col(f"`{texts.columns[0]}`")
        named = F.array_distinct(F.concat(*[F.coalesce(F.regexp_extract_all(text, F.lit(m), F.lit(1)), F.array().cast("array<string>")) for m in MENTIONS]))
        found.append(texts.select(F.explode(named).alias("gene"), F.lit(4).alias("_kind")))
    first, *rest = found
    for other in rest:
        first = first.unionByName(other)
    return first.filter("gene <> ''").groupBy("gene").agg(F.count_distinct("_kind").alias("n_sources"))


def scorecard(genes: DataFrame, found: DataFrame, pathways: DataFrame, computed: DataFrame, interactions: DataFrame, predicted: DataFrame, themes: DataFrame, text: str, proportions: DataFrame | None = None) -> DataFrame:
    """One row of a replication: gene_recall, pathway_coverage, interaction_recall, theme_coverage in percent, whether
    there are proportions, the report's words, and the composite score.

    genes, found: gene_u. pathways: pathway; computed: set_name. interactions, predicted: source, target. themes:
    theme, keyword. Where nothing is expected a share is 0.
    """
    percent = lambda c, n: F.coalesce(100 * F.avg(c), F.lit(0.0)).alias(n)
    recall = overlap_recall(genes, found, "gene_u").select((100 * F.col("recall")).alias("gene_recall"))
    wanted = pathways.select(F.lower("pathway").alias("x")).distinct()
    hit = holding(wanted, computed.select(F.lower("set_name").alias("y"))).select("x", F.lit(1.0).alias("_hit")).distinct()
    covered = wanted.join(hit, "x", "left").agg(percent(F.coalesce("_hit", F.lit(0.0)), "pathway_coverage"))
    pairs = paper_interactions(interactions, predicted).select((100 * F.col("rate")).alias("interaction_recall"))
    said = themes.groupBy("theme").agg(F.max(F.lower(F.lit(text)).contains(F.lower("keyword")).cast("double")).alias("_said")).agg(percent(F.col("_said"), "theme_coverage"))
    some = proportions is not None
    there = (proportions if some else genes).limit(1).agg((F.count("*") > 0 if some else F.count("*") < 0).alias("proportions_available"))
    one = recall.join(covered, F.lit(True)).join(pairs, F.lit(True)).join(said, F.lit(True)).join(there, F.lit(True))
    score = composite(F.col("gene_recall"), F.col("pathway_coverage"), F.col("interaction_recall"), F.col("theme_coverage"), F.col("proportions_available"))
    return one.withColumn("report_words", F.lit(len(text.split()))).withColumn("composite_score", score)
