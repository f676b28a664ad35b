"""The jobs from files to files, over one small catalog."""

import json

import numpy as np
import pytest

from cellatlas.edge import jobs
from cellatlas.edge.engine import Engine
from cellatlas.operators.encode import hashing_encoder


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("jobs")


@pytest.fixture(scope="module")
def built(spark, folder):
    """Three clusters of cells with five genes of their own, as one array file."""
    rng = np.random.default_rng(6)
    kinds = ["T cell", "B cell", "mast cell"]
    x = rng.poisson(0.4, (60, 15)).astype(np.float32)
    for i in range(60):
        x[i, (i % 3) * 5 : (i % 3) * 5 + 5] += rng.poisson(60, 5)
    names = np.array([f"CD{j}" for j in range(15)])
    np.savez(folder / "atlas.npz", X=x, **{"obs/_index": np.array([f"c{i}" for i in range(60)]), "obs/cell_type": np.array([kinds[i % 3] for i in range(60)]), "obs/condition": np.array(["ill" if i < 30 else "well" for i in range(60)]), "var/_index": names})
    (folder / "sets.gmt").write_text("\n".join(f"{k} program\t\t" + "\t".join(names[g * 5 : g * 5 + 5]) for g, k in enumerate(("first", "second", "third"))) + "\n")
    (folder / "pairs.csv").write_text("ligand,receptor,pathway\nCD0,CD5,one\nCD6,CD11,two\n")
    (folder / "wanted.txt").write_text("cd0\nCD7\n\nNOGENE\n")
    f = lambda n: str(folder / n)
    said = jobs.build(spark, f("catalog"), f("atlas.npz"), sets=f("sets.gmt"), pairs=f("pairs.csv"), wanted=f("wanted.txt"), dims=32)
    assert said["clusters"] == 3 and said["coverage"]["n_found"] == 2 and said["coverage"]["n_missed"] == 1
    return f("catalog")


@pytest.fixture(scope="module")
def engine(spark, built):
    return Engine.load(spark, built, ("meta", "cells", "pairs", "sets"), encoder=hashing_encoder(32))


QUESTIONS = [
    {"text": "CD0 CD1 CD3", "category": "expression", "expected_clusters": ["T cell"], "expected_genes": ["CD0", "CD1"]},
    {"text": "CD6 CD7", "category": "expression", "expected_clusters": ["B cell"], "expected_genes": ["CD6"]},
    {"text": "mast cell degranulation", "category": "ontology", "expected_clusters": ["mast cell"], "expected_genes": ["CD12"]},
]


@pytest.fixture(scope="module")
def scored(engine, folder):
    return jobs.benchmark(engine, QUESTIONS, 2, str(folder / "results.json"))


def test_benchmark(scored, folder):
    assert json.loads((folder / "results.json").read_text())["top_k"] == 2
    by = {(r["category"], r["mode"]): r for r in scored["summary"]}
    assert by["expression", "genes"]["mean_mrr"] == 1 and by["ontology", "semantic"]["mean_mrr"] == 1
    assert by["expression", "union"]["mean_recall_at_2"] == 1 and 0.3 < by["expression", "random"]["mean_recall_at_2"] < 0.95
    assert scored["gene_recall"]["union"] == 1


def test_compare(spark, scored, folder):
    """An outside model that knows the first two questions; the third is ranked at random, and counted."""
    rng = np.random.default_rng(1)
    kinds = np.array(["T cell", "B cell", "mast cell"])
    middle = np.eye(3)
    np.savez(folder / "cells.npz", orig_ids=np.arange(30), transcriptome_embeds=middle[np.arange(30) % 3] + rng.normal(0, 0.01, (30, 3)), labels=kinds[np.arange(30) % 3])
    np.savez(folder / "asked.npz", orig_ids=np.arange(2), transcriptome_embeds=middle[[0, 2]])
    found = jobs.compare(spark, *(str(folder / n) for n in ("results.json", "cells.npz", "asked.npz")), QUESTIONS, 2, str(folder / "compared.json"))
    assert found["random"] == 1 and set(found["macro_means"]) == {"outside", *jobs.MODES}
    assert json.loads((folder / "compared.json").read_text())["delta"] == found["delta"] and found["macro_means"]["union"]["mrr"] == 1


def test_replicate(engine, folder):
    lines = ["info", "semantic: T cell", "hybrid: CD0 CD1", "interactions: T -> B", "pathway", "proportions", "compare: ill vs well"]
    truth = {"genes": ["CD0", "CD1", "NOGENE"], "pathways": ["second", "nothing"], "interactions": [["t cell", "B cell"], ["x", "y"]], "themes": {"cells": ["t cell"], "none": ["zzz"]}}
    card = jobs.replicate(engine, lines, truth, str(folder / "session"))
    assert card["pathway_coverage"] == 50 and card["interaction_recall"] == 50 and card["theme_coverage"] == 50 and card["proportions_available"]
    assert card["gene_recall"] == pytest.approx(200 / 3) and card["composite_score"] == pytest.approx(0.3 * 200 / 3 + 10 + 7.5 + 12.5 + 10)
    assert json.loads((folder / "session" / "scorecard.json").read_text()) == card
    assert {p.name for p in (folder / "session").iterdir()} == {"report.md", "session.json", "scorecard.json"}


def test_arguments(spark, built, folder, capsys):
    (folder / "questions.json").write_text(json.dumps(QUESTIONS[:1]))
    jobs.main(["--dims", "32", "benchmark", built, str(folder / "questions.json"), "--top-k", "2", "--out", str(folder / "again.json")])
    assert '"mrr": 1.0' in capsys.readouterr().out and (folder / "again.json").exists()
