import json

import pytest

from cellatlas.edge import commands, model, report
from cellatlas.edge.engine import Engine
from cellatlas.functions import text as T
from cellatlas.operators.encode import hashing_encoder
from cellatlas.plans.fixture import Atlas
from cellatlas.sources import catalog
from cellatlas.streaming.composition import arriving_composition

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    a = Atlas(spark, SF)
    encode = hashing_encoder(32)
    clusters = spark.createDataFrame([(r["cluster_ord"], r["cluster_id"], encode([r["cluster_id"]])[0]) for r in a.clusters.collect()], "cluster_ord int, cluster_id string, vec array<double>")
    return Engine(clusters, a.dense_stats.cache(), meta=a.meta.cache(), cells=a.cells, pairs=a.pairs, sets=a.sets, encoder=encode)


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("compare: A vs b | x, y", commands.Command("compare", "A vs b", ("A", "b"), ("x", "y"))),
        ("interactions: src -> tgt", commands.Command("interactions", "src -> tgt", ("src", "tgt"))),
        ("info", commands.Command("info")),
        ("some words: with a colon", commands.Command("hybrid", "some words: with a colon")),
        ("Semantic: t cells", commands.Command("semantic", "t cells")),
    ],
)
def test_grammar(line, expected):
    assert commands.parse(line) == expected


def test_bad_compare():
    with pytest.raises(ValueError):
        commands.parse("compare: only one")


@pytest.mark.parametrize("line", ["info", "capabilities", "annotation: nation_3", "semantic: nation_3", "hybrid: nation_3 cells", "discover: nation_3", "interactions: nation_3 -> nation_5", "proportions", "proportions: balance", "pathway: promo", "genes: a", "metadata: NATION_3", "cells: NATION_3", "specificity"])
def test_commands_run(engine, line):
    assert commands.run(engine, line).limit(3).collect() is not None


def test_semantic_finds_the_name(engine):
    assert engine.by_meaning("nation_3").filter("rank = 1").first()["cluster_id"] == "NATION_3"


def test_compare(engine):
    genes, enriched = commands.run(engine, "compare: building vs MACHINERY")
    assert set(genes.columns) >= {"bias", "gene"} and enriched.columns == ["side", "gene", "n_clusters", "max_logfc", "rank"]
    with pytest.raises(ValueError):
        engine.compare("nobody", "noone")


def test_phases_and_conditions(engine):
    assert {r["phase"] for r in engine.cell_cycle().collect()} == {"G1"}
    assert engine.conditions().first()["col"] == "balance"


def test_report_and_payload(engine, tmp_path):
    text = report.markdown("Title", [("Clusters", "All of them.", {"info": engine.info()})], rows=3)
    assert text.count("\n| ") == 4 and report.written(text, str(tmp_path / "r.md")).endswith("r.md")
    assert len(report.payload({"info": engine.info()}, chars=200)) <= 200


def test_report_and_export_verbs(engine, tmp_path):
    engine.results.clear()
    commands.run(engine, "cells: NATION_3")
    commands.run(engine, "compare: building vs machinery")
    made = commands.run(engine, f"report: {tmp_path}/r.md")
    assert made.endswith("r.md") and "## cells: NATION_3" in open(made).read()
    found = json.loads(open(commands.run(engine, f"export: {tmp_path}/s.json")).read())["results"]
    assert [len(x["tables"]) for x in found] == [1, 2]
    assert [r["cell_id"] for r in found[0]["tables"]["table 1"]] == [r["cell_id"] for r in engine.cells_of("NATION_3").collect()]


def test_parsed(spark):
    rows = [(1, "p/1 p/2"), (2, "the p/1 of it"), (3, None), (4, " .,; ")]
    got = {r["qid"]: (r["mode"], r["genes"]) for r in T.parsed(spark.createDataFrame(rows, "qid int, text string"), spark.createDataFrame([("P/1",), ("P/2",), ("P/1",)], "gene_u string"), [], ["the", "of"]).collect()}
    assert got == {1: ("gene_list", ["P/1", "P/2"]), 2: ("mixed", ["P/1", "IT"]), 3: ("ontology", []), 4: ("ontology", [])}


def test_budget_and_retries():
    budget = model.Budget(cap=1.0, per_token_in=0.5)
    calls, waits = [], []

    def client(system, user):
        calls.append(user)
        if len(calls) < 3:
            raise model.RateLimited
        return "yes", 3, 0

    assert model.ask(client, "s", "u" * 50, budget, chars=10, sleep=waits.append) == "yes"
    assert waits == [2.0, 4.0] and calls[-1] == "u" * 10 and budget.spent == 1.5
    with pytest.raises(model.OverBudget):
        model.ask(client, "s", "u", budget)


def test_catalog_round_trip(spark, engine, tmp_path):
    root = str(tmp_path)
    for name, df in (("clusters", engine.clusters), ("gene_stats", engine.stats), ("cluster_meta", engine.meta), ("cells", engine.cells)):
        catalog.write_table(df, root, name)
    catalog.write_manifest(spark, root, "1", 0.6)
    back = Engine.load(spark, root, scoring="simple")
    assert back.stats.count() == engine.stats.count() and back.query("almond", mode="gene_list").count() == 10
    with pytest.raises(ValueError):
        catalog.read_table(spark, root, "other")


def test_gene_maps(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("feature_id,feature_name\nENSG1.2,A\nENSG1.3,B\nENSG2.1,B\n")
    genes = spark.createDataFrame([(0, "ENSG1.9"), (1, "ENSG2"), (2, "ENSG3.1")], "gene_idx int, ensembl_id string")
    named = catalog.unique_symbols(catalog.mapped_genes(genes, catalog.gene_map(spark, str(path))))
    assert [r["symbol"] for r in named.orderBy("gene_idx").collect()] == ["B", "B-1", "ENSG3"]
    columns = genes.selectExpr("gene_idx", "ensembl_id AS symbol", "'A' AS gene")
    assert catalog.symbol_column(columns) == "gene" and catalog.symbol_column(genes) is None
    assert catalog.looks_ensembl(genes, "ensembl_id", least=3) and not catalog.looks_ensembl(genes, "ensembl_id")


def test_gmt_and_alignment(spark, tmp_path):
    path = tmp_path / "s.gmt"
    path.write_text("one\tnote\ta\tb\n\ntwo\tnote\tc\n")
    assert [(r["set_name"], r["gene"]) for r in catalog.read_gmt(spark, str(path), "x").orderBy("set_ord", "gene_ord").collect()] == [("one", "a"), ("one", "b"), ("two", "c")]
    clusters = spark.createDataFrame([("A",), ("B",)], "cluster_id string")
    got = {r["cluster_id"]: r["vec"] for r in catalog.aligned_vectors(clusters, spark.createDataFrame([("A", [3.0, 4.0])], "cluster_id string, vec array<double>"), 2).collect()}
    assert got["A"] == [pytest.approx(0.6), pytest.approx(0.8)] and got["B"] == [0.0, 0.0]


def test_stream(spark, engine, tmp_path):
    cells = engine.cells.select("cell_id", "cluster_id")
    cells.write.parquet(f"{tmp_path}/in")
    stream = arriving_composition(spark.readStream.schema(cells.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("composition").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("composition").agg({"n": "sum"}).first()[0] == cells.count()
