"""Jobs over an atlas: the build, a benchmark, a comparison with an outside model, a replication.

`python -m cellatlas.edge.jobs JOB ...`; each job is a function that can be called as well. What they write beside
tables are small JSON and Markdown files on the driver.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build as atlas
from ..operators import evalkit, meta, rank
from ..operators.encode import hashing_encoder
from ..operators.profile import centroids
from ..sources import catalog
from . import report
from .commands import parse, run
from .engine import Engine

MODES = ("random", "semantic", "genes", "union")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def build(spark: SparkSession, out: str, source: str | None = None, cells: str | None = None, expr: str | None = None, sets: str | None = None, pairs: str | None = None, cluster_key: str | None = None, wanted: str | None = None, dims: int = 256, **options) -> dict:
    """Writes a catalog from an array file (`source`), or from Parquet tables of cells and values.

    The column of clusters is `cluster_key`, or found among the usual names, or made by clustering. wanted: a file of
    gene names, a line each; the coverage of these is given back.
    """
    frames = catalog.read_atlas(spark, source) if source else {"cells": spark.read.parquet(cells), "expr": spark.read.parquet(expr)}
    own = frames["cells"]
    key = cluster_key or ("cluster_id" if "cluster_id" in own.columns else meta.cluster_key(own))
    if key and key != "cluster_id":
        own = own.withColumn("cluster_id", F.col(key).cast("string"))
    tables = atlas.build(out, frames["expr"], own, sets=catalog.read_gmt(spark, sets, "sets") if sets else None, pairs=catalog.read_pairs(spark, pairs) if pairs else None, encoder=lambda: hashing_encoder(dims), **options)
    said = {"tables": sorted(tables), "clusters": tables["clusters"].count()}
    if wanted:
        names = spark.read.text(wanted).select(F.upper(F.trim("value")).alias("gene_u")).filter("gene_u <> ''")
        said["coverage"] = _rows(evalkit.overlap_recall(names, tables["gene_stats"].select("gene_u"), "gene_u"))[0]
    return said


def mode_rankings(engine: Engine, queries: DataFrame, expected: DataFrame, top: int = 10, runs: int = 50) -> DataFrame:
    """qid, mode, cluster_id, rank (and run, for random): all queries (qid, text) in each of MODES at once.

    The union begins with the list that does better by what is expected, so it is a bound, not a method to use.
    """
    texts = _rows(queries.select("qid", "text"))
    vectors = engine.encoder([q["text"] or "" for q in texts])
    asked = engine.spark.createDataFrame([(q["qid"], q["text"], v) for q, v in zip(texts, vectors, strict=True)], "qid bigint, text string, vec array<double>")
    semantic = rank.semantic_ranking(asked, engine.clusters, top, engine.name_boost, True).select("qid", "cluster_id", "rank")
    named = T.parsed(queries, engine.stats.select("gene_u"), engine.prefixes, engine.ordinary).select("qid", F.explode("genes").alias("gene_u"))
    genes = rank.marker_scores(named, engine.stats, engine.clusters, engine.scoring, top).select("qid", "cluster_id", "rank")
    genes = genes.unionByName(semantic.join(named, "qid", "left_anti"))  # a query without genes is ranked by its meaning
    both = semantic.withColumn("mode", F.lit("semantic")).unionByName(genes.withColumn("mode", F.lit("genes")))
    score = evalkit.recall_mrr(expected, both, (top,), fuzzy=True)
    better = score.groupBy("qid").agg(F.min_by("mode", F.struct(-F.col(f"recall_at_{top}"), -F.col("mrr"), "mode")).alias("first"))
    side = lambda first: both.join(better, "qid").filter((F.col("mode") == F.col("first")) == first).select("qid", "cluster_id", "rank")
    union = rank.union_ranking(side(True), side(False)).select("qid", "cluster_id", "rank").withColumn("mode", F.lit("union"))
    drawn = queries.select("qid").join(engine.spark.range(runs).withColumnRenamed("id", "r"), F.lit(True))
    random = rank.random_ranking(drawn, engine.clusters, F.col("r"), top).select("qid", "cluster_id", "rank", "run").withColumn("mode", F.lit("random"))
    return both.unionByName(union).withColumn("run", F.lit(0).cast("long")).unionByName(random.withColumn("run", F.col("run").cast("long")))


def benchmark(engine: Engine, questions: Sequence[dict], top: int = 10, out: str | None = None) -> dict:
    """Recall, MRR and gene recall of each mode over questions (text, category, expected_clusters, expected_genes)."""
    spark = engine.spark
    queries = spark.createDataFrame([(i, q["text"], q["category"]) for i, q in enumerate(questions)], "qid bigint, text string, category string")
    expected = spark.createDataFrame([(i, c) for i, q in enumerate(questions) for c in q["expected_clusters"]], "qid bigint, cluster_id string")
    wanted = spark.createDataFrame([(i, g.upper()) for i, q in enumerate(questions) for g in q.get("expected_genes", [])], "qid bigint, gene_u string")
    ranked = mode_rankings(engine, queries, expected, top)
    runs = ranked.withColumn("mode", F.concat_ws("|", "mode", F.col("run").cast("string")))
    each = evalkit.recall_mrr(expected, runs, (5, top) if top != 5 else (5,), fuzzy=True).withColumn("mode", F.split("mode", r"\|")[0])
    measures = [c for c in each.columns if c not in ("qid", "mode")]
    results = each.groupBy("qid", "mode").agg(*[F.avg(c).alias(c) for c in measures]).join(queries.select("qid", "category"), "qid")
    single = ranked.filter("mode <> 'random'").drop("run")
    found = {"summary": _rows(evalkit.summary(results, measures).orderBy("category", "mode")), "overall": _rows(evalkit.benchmark(results.filter("mode = 'union'"), measures)), "complementarity": _rows(evalkit.complementarity(expected, single, "semantic", "genes", top, True))[0], "detail": _rows(results.orderBy("qid", "mode"))}
    by_mode = {}
    for mode in MODES[1:]:
        own = evalkit.genes_of_clusters(single.filter(F.col("mode") == mode), engine.stats, 5)
        by_mode[mode] = _rows(evalkit.gene_recall(wanted, own).agg(F.avg("gene_recall").alias("gene_recall")))[0]["gene_recall"]
    found["gene_recall"], found["top_k"] = by_mode, top
    if out:
        Path(out).write_text(json.dumps(found, default=str))
    return found


def compare(spark: SparkSession, results: str, vectors: str, asked: str, questions: Sequence[dict], top: int = 10, out: str | None = None) -> dict:
    """A benchmark's file beside an outside model: cells' vectors with labels (`vectors`) and queries' (`asked`), as npz.

    Ids of `asked` are the questions' numbers. Means are over categories first, then over these. Queries without a
    vector are ranked at random and counted as such.
    """
    own = json.loads(Path(results).read_text())
    cells = catalog.read_npz(spark, vectors)
    labels = cells.groupBy("label").agg(F.count("*").alias("n")).select("label", F.row_number().over(Window.orderBy("label")).alias("cluster_ord"))
    clusters = centroids(cells, "label").join(labels, "label").select(F.col("label").alias("cluster_id"), "cluster_ord", "vec")
    queries = spark.createDataFrame([(i, q["category"]) for i, q in enumerate(questions)], "qid bigint, category string")
    vec = catalog.read_npz(spark, asked).select(F.col("id").cast("bigint").alias("qid"), "vec")
    ranked = rank.baseline_ranking(queries.join(vec, "qid", "left"), clusters, top)
    expected = spark.createDataFrame([(i, c) for i, q in enumerate(questions) for c in q["expected_clusters"]], "qid bigint, cluster_id string")
    outside = evalkit.recall_mrr(expected, ranked.withColumn("mode", F.lit("outside")), (5, top) if top != 5 else (5,), fuzzy=True).join(queries, "qid")
    measures = [c for c in outside.columns if c not in ("qid", "mode", "category")]
    table = {"outside": {m: _rows(evalkit.macro_mean(outside, m))[0][m] for m in measures}}
    detail = spark.createDataFrame([tuple(r[c] for c in ("qid", "mode", "category", *measures)) for r in own["detail"]], f"qid bigint, mode string, category string, {', '.join(f'{m} double' for m in measures)}")
    for m in measures:
        for r in _rows(evalkit.macro_mean(detail, m)):
            table.setdefault(r["mode"], {})[m] = r[m]
    found = {"macro_means": table, "random": ranked.filter("random").select("qid").distinct().count(), "delta": {m: table["union"][m] - table["outside"][m] for m in measures}}
    if out:
        Path(out).write_text(json.dumps(found))
    return found


def replicate(engine: Engine, lines: Sequence[str], truth: dict, out: str) -> dict:
    """Runs a scripted session and scores it: report.md, session.json and scorecard.json in the folder `out`.

    truth: genes, pathways, interactions ([source, target]), themes ({name: [keyword]}).
    """
    spark, folder = engine.spark, Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    genes, pairs, sets, shares = [], [], [], None
    for line in lines:
        answer, verb = run(engine, line), parse(line).verb
        frames = answer if isinstance(answer, tuple) else (answer,) if isinstance(answer, DataFrame) else ()
        for df in frames:
            if "gene" in df.columns:
                genes.append(df.select("gene"))
            elif "genes" in df.columns:
                genes.append(df.select(F.explode("genes.gene").alias("gene")))
            if "source" in df.columns:
                pairs.append(df.select("source", "target"))
                genes += [df.select(F.col(c).alias("gene")) for c in ("ligand", "receptor")]
            if verb == "pathway":
                sets.append(df.select("set_name"))
            shares = df if verb == "proportions" else shares
    body = report.markdown("Session", [(said, "", parts) for said, parts in engine.results])
    report.written(body, str(folder / "report.md"))
    report.exported(engine.results, str(folder / "session.json"))

    def joined(parts: list[DataFrame], schema: str) -> DataFrame:
        first = spark.createDataFrame([], schema)
        for df in parts:
            first = first.unionByName(df)
        return first

    texts = spark.createDataFrame([(body,)], "text string")
    found = evalkit.session_genes(hits=joined(genes, "gene string"), texts=texts).select(F.upper("gene").alias("gene_u"))
    table = lambda rows, schema: spark.createDataFrame([x if isinstance(x, tuple) else tuple(x) for x in rows], schema)
    card = evalkit.scorecard(
        table([(g.upper(),) for g in truth.get("genes", [])], "gene_u string"),
        found,
        table([(p,) for p in truth.get("pathways", [])], "pathway string"),
        joined(sets, "set_name string"),
        table(truth.get("interactions", []), "source string, target string"),
        joined(pairs, "source string, target string"),
        table([(t, k) for t, words in truth.get("themes", {}).items() for k in words], "theme string, keyword string"),
        body,
        shares,
    )
    own = _rows(card)[0]
    (folder / "scorecard.json").write_text(json.dumps(own))
    return own


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    jobs = p.add_subparsers(dest="job", required=True)
    b = jobs.add_parser("build")
    b.add_argument("out")
    for name in ("--source", "--cells", "--expr", "--sets", "--pairs", "--cluster-key", "--wanted"):
        b.add_argument(name)
    b.add_argument("--text-genes", type=int, default=400)
    b.add_argument("--stat-genes", type=int, default=10_000)
    b.add_argument("--alpha", type=float, default=0.6)
    m = jobs.add_parser("benchmark")
    c = jobs.add_parser("compare")
    r = jobs.add_parser("replicate")
    for q in (m, r):
        q.add_argument("catalog")
    m.add_argument("questions", help="JSON: a list of text, category, expected_clusters, expected_genes")
    for name in ("results", "vectors", "asked", "questions"):
        c.add_argument(name)
    r.add_argument("session", help="a text file of commands")
    r.add_argument("truth", help="JSON: genes, pathways, interactions, themes")
    for q in (m, c):
        q.add_argument("--top-k", type=int, default=10)
    for q in (m, c, r):
        q.add_argument("--out", default="out")
    p.add_argument("--dims", type=int, default=256)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("cellatlas").getOrCreate()
    load = lambda **more: Engine.load(spark, a.catalog, encoder=hashing_encoder(a.dims), **more)
    read = lambda path: json.loads(Path(path).read_text())
    if a.job == "build":
        said = build(spark, a.out, a.source, a.cells, a.expr, a.sets, a.pairs, a.cluster_key, a.wanted, a.dims, text_genes=a.text_genes, stat_genes=a.stat_genes, alpha=a.alpha)
    elif a.job == "benchmark":
        said = benchmark(load(), read(a.questions), a.top_k, a.out)["overall"]
    elif a.job == "compare":
        said = compare(spark, a.results, a.vectors, a.asked, read(a.questions), a.top_k, a.out)
    else:
        there = [n for n in ("pairs", "sets") if catalog.has_table(spark, a.catalog, n)]
        said = replicate(load(optional=("meta", "cells", *there)), Path(a.session).read_text().splitlines(), read(a.truth), a.out)
    print(json.dumps(said, default=str))


if __name__ == "__main__":
    main()
