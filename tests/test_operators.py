"""Formulas on rows small enough to check by hand."""

import math

import pytest
from pyspark.sql import functions as F

from cellatlas.functions import text as T
from cellatlas.functions import vectors as V
from cellatlas.operators import encode, evalkit, genesets, graph, interact, meta, profile, rank, stats


def one(spark, column, **values):
    row = [tuple(values.values())] if values else [(1,)]
    return spark.createDataFrame(row, list(values) or ["x"]).select(column.alias("out")).first()["out"]


@pytest.fixture(scope="module")
def atlas(spark):
    clusters = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "cluster_ord int, cluster_id string")
    rows = [("A", "G1", 1.0, 0.5, 0.1, 0.0), ("A", "G2", -2.0, 0.6, 0.2, 1e-5), ("B", "G1", 0.5, 0.1, 0.3, 1.0), ("B", "G3", 0.0, 0.0, 0.0, 0.5)]
    st = spark.createDataFrame([(c, g, g.upper(), a, b, d, e) for c, g, a, b, d, e in rows], "cluster_id string, gene string, gene_u string, logfc double, pct_in double, pct_out double, pval_adj double")
    return clusters, st


def scores(spark, atlas, genes, mode, top=None):
    q = spark.createDataFrame([(1, g) for g in genes], "qid int, gene_u string")
    return {r["cluster_id"]: (r["score"], r["rank"]) for r in rank.marker_scores(q, atlas[1], atlas[0], mode, top).collect()}


def test_marker_scores(spark, atlas):
    got = scores(spark, atlas, ["G1", "G1", "G2", "NONE"], "weighted")
    a = 2 * 1.5 * 0.7 + 2.5 * 0.7 * 1.3  # pct_in of exactly 0.5 has no bonus; a negative logfc counts as a positive one
    assert got["A"] == (pytest.approx(a * (0.5 + 0.5 * 3 / 4)), 1)
    assert got["B"] == (pytest.approx(2 * 1.0 * 0.3 * 0.75), 2)
    assert got["C"] == (0.0, 3)
    assert scores(spark, atlas, ["G1", "G1"], "simple")["A"][0] == 2
    full = scores(spark, atlas, ["G1"], "full")
    assert full["A"][0] == pytest.approx(1.5 * 0.7 * 0.5)  # a p of 0 and one of 1 are as good as none
    assert full["B"][0] == pytest.approx(1.0 * 0.3 * 0.5)
    assert scores(spark, atlas, ["G2"], "full")["A"][0] == pytest.approx(2.5 * 0.7 * 1.3 * (0.5 + 0.5))
    with pytest.raises(ValueError):
        scores(spark, atlas, ["G1"], "other")


def test_name_boost(spark):
    boost = lambda c, q: one(spark, T.name_boost(F.col("c"), F.col("q")), c=c, q=q)
    assert boost("natural_killer-cell", "Natural things") == pytest.approx(0.15 / 3)
    assert boost("aaaa bbbb cccc dddd", "aaaa") == 0.0
    assert boost("abc", "abc") == 0.0


def test_rrf_and_union(spark):
    ranking = lambda ids: spark.createDataFrame([(1, c, i) for i, c in enumerate(ids, 1)], "qid int, cluster_id string, rank long")
    got = [(r["cluster_id"], r["score"]) for r in rank.fused([(ranking("AB"), 3.0), (ranking("CA"), 1.0)]).orderBy("rank").collect()]
    assert got == [("A", pytest.approx(3 / 61 + 1 / 62)), ("B", pytest.approx(3 / 62)), ("C", pytest.approx(1 / 61))]
    tie = [r["cluster_id"] for r in rank.fused([(ranking("A"), 1.0), (ranking("B"), 1.0)]).orderBy("rank").collect()]
    assert tie == ["A", "B"]
    assert [r["cluster_id"] for r in rank.union_ranking(ranking("AB"), ranking("CB")).orderBy("rank").collect()] == ["A", "B", "C"]


def test_synonyms_insert_and_add_once(spark, atlas):
    base = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.45)], "qid int, cluster_id string, score double")
    q = spark.createDataFrame([(1, "Thinking of dc")], "qid int, text string")
    syn = spark.createDataFrame([("nk", "B"), ("thinking", "B"), ("dc", "C"), ("dc", "Z")], "term string, cluster_id string")
    got = [(r["cluster_id"], round(r["score"], 6)) for r in rank.synonym_boosted(base, q, syn, atlas[0]).orderBy("rank").collect()]
    assert got == [("B", 0.55), ("A", 0.5), ("C", 0.1)]


def test_query_modes(spark):
    mode = lambda t: one(spark, T.query_mode(F.col("t"), F.array(F.lit("FOO")), ["CD"], ["the", "in"]), t=t)
    assert mode("foo, CD8A il2") == "gene_list"
    assert mode("foo in the b") == "mixed"
    assert mode("") == mode("from here") == "ontology"
    names = one(spark, T.gene_names(F.col("t"), F.array(F.lit("FOO")), ["the"]), t="the foo; foo from x_y")
    assert names == ["FOO", "FOO", "FROM"]


def test_names(spark):
    alike = lambda a, b: one(spark, T.alike(F.col("a"), F.col("b")), a=a, b=b)
    assert alike("T cell", "t cell memory") and alike("a b", "b c d a") and not alike("a b", "c d") and not alike("", "x")
    assert one(spark, T.short_name(F.col("a")), a="x" * 30) == "x" * 24 + "."
    assert one(spark, T.synonyms(F.col("a")), a="T cell, memory") == ["T cell", "T cell, memory"]
    assert one(spark, T.synonyms(F.col("a")), a="natural killer cell") == ["NK", "NK cell", "natural killer cell"]
    assert one(spark, T.base_id(F.col("a")), a="ENSG01.5") == "ENSG01"


def test_interactions(spark, atlas):
    pairs = spark.createDataFrame([(0, "g1", "G1", "p"), (1, "g1", "G1", "p"), (2, "G2", "G1", "q"), (3, "G1", "G9", "r")], "lr_ord int, ligand string, receptor string, pathway string")
    found = interact.interactions(atlas[1], pairs, min_ligand=0.1, min_receptor=0.1)
    rows = sorted((r["source"], r["target"], r["lr_ord"], round(r["score"], 4)) for r in found.collect())
    assert rows == [("A", "B", 0, 0.05), ("A", "B", 1, 0.05), ("A", "B", 2, 0.06), ("B", "A", 0, 0.05), ("B", "A", 1, 0.05)]
    assert interact.interactions(atlas[1], pairs, min_ligand=0.1, min_receptor=0.1, distinct=True).count() == 3
    assert [r["n"] for r in interact.by_pair(found, 1).collect()] == [3]
    assert interact.named_clusters(atlas[0], "zzz").count() == 3 and interact.named_clusters(atlas[0], "a").count() == 1


def test_gene_sets(spark, atlas):
    rows = [("x", 0, "one", 0, "G1"), ("x", 0, "one", 1, "G2"), ("x", 0, "one", 2, "g2"), ("x", 1, "two", 0, "G3"), ("x", 2, "one", 0, "G1"), ("x", 2, "one", 1, "G2"), ("x", 2, "one", 2, "G2")]
    sets = genesets.last_definitions(spark.createDataFrame(rows, "collection string, set_ord int, set_name string, gene_ord int, gene string"))
    assert sets.filter("set_name = 'one'").select("set_ord").distinct().first()[0] == 0 and sets.count() == 4
    got = {(r["cluster_id"], r["set_name"]): (r["n_found"], r["coverage"], r["score"]) for r in genesets.set_scores(atlas[1], sets, atlas[0]).collect()}
    assert len(got) == 6
    assert got["A", "one"] == (3, 1.0, pytest.approx((0.5 + 0.6 + 0.6) / 3))
    assert got["B", "one"][2] == 0.0 and got["B", "two"] == (1, 1.0, 0.0)  # too few; a hit of value 0 is found
    assert genesets.resolved_set(sets, "TWO sets").first()["set_name"] == "two"
    assert genesets.resolved_set(sets, "zzz").count() == 0


def test_phases_exceed_their_bounds(spark):
    st = spark.createDataFrame([(c, g, v) for c, s, m in [("a", 0.2, 0.2), ("b", 0.3, 0.31), ("c", 0.31, 0.31), ("d", 0.1, 0.21)] for g, v in (("S", s), ("M", m))], "cluster_id string, gene_u string, pct_in double")
    sets = spark.createDataFrame([("s", "S"), ("m", "M")], "set_name string, gene string")
    clusters = spark.createDataFrame([(c,) for c in "abcde"], "cluster_id string")
    got = {r["cluster_id"]: r["phase"] for r in genesets.cell_cycle(st, sets, clusters, "s", "m").collect()}
    assert got == {"a": "G1", "b": "S", "c": "cycling", "d": "G2M", "e": "G1"}


def test_over_representation(spark):
    universe = spark.createDataFrame([(f"G{i}",) for i in range(20)], "gene_u string")
    sets = spark.createDataFrame([("s", f"G{i}") for i in range(5)], "set_name string, gene string")
    markers = spark.createDataFrame([("c", f"G{i}", i + 1) for i in range(4)], "cluster_id string, gene_u string, rank int")
    row = genesets.over_representation(markers, sets, universe).first()
    assert row["hits"] == 4 and row["p"] == pytest.approx(math.comb(5, 4) / math.comb(20, 4))


def test_gene_stats_and_rank_sums(spark):
    cells = spark.createDataFrame([(i, "A" if i < 3 else "B") for i in range(7)], "cell_id int, cluster_id string")
    values = {0: 2.0, 1: 1.0, 3: 1.0, 4: 3.0}
    expr = spark.createDataFrame([(c, "g", v) for c, v in values.items()], "cell_id int, gene string, value double")
    got = {r["cluster_id"]: r for r in stats.gene_stats(expr, cells).collect()}
    assert got["A"]["pct_in"] == pytest.approx(2 / 3) and got["A"]["pct_out"] == pytest.approx(2 / 4)
    mean = lambda ids: sum(math.expm1(values.get(i, 0)) for i in ids) / len(ids)
    assert got["A"]["logfc"] == pytest.approx(math.log2((mean(range(3)) + 1e-9) / (mean(range(3, 7)) + 1e-9)))
    dense = [values.get(i, 0.0) for i in range(7)]
    ranks = [sum(y < x for y in dense) + (sum(y == x for y in dense) + 1) / 2 for x in dense]
    z = (sum(ranks[:3]) - 3 * 8 / 2) / math.sqrt(3 * 4 * 8 / 12)
    rows = {r["cluster_id"]: r["z"] for r in stats.rank_sums(expr, cells).collect()}
    assert rows["A"] == pytest.approx(z) and rows["B"] == pytest.approx(-z)


def test_adjusted_is_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.9]
    got = {r["gene"]: r["p_adj"] for r in stats.adjusted(spark.createDataFrame([("c", str(i), x) for i, x in enumerate(p)], "cluster_id string, gene string, p double")).collect()}
    assert [round(got[str(i)], 6) for i in range(5)] == [0.05, 0.05, 0.05, 0.05, 0.9]


def test_log_normalized_decides_once(spark):
    low = spark.createDataFrame([(1, "a", 2.0)], "cell_id int, gene string, value double")
    assert stats.log_normalized(low).first()["value"] == 2.0
    high = low.union(spark.createDataFrame([(1, "b", 98.0)], low.schema))
    assert sorted(r["value"] for r in stats.log_normalized(high).collect()) == [pytest.approx(math.log1p(200)), pytest.approx(math.log1p(9800))]


def test_fold_changes(spark):
    rows = [("x", "A", 0.5), ("y", "A", 0.25), ("x", "B", 0.5), ("y", "C", 0.75)]
    got = {r["cluster_id"]: (r["fold_change"], r["is_inf"]) for r in meta.fold_changes(spark.createDataFrame(rows, "condition string, cluster_id string, fraction_of_condition double")).collect()}
    assert got == {"A": (2.0, False), "B": (None, True), "C": (0.0, False)}
    third = spark.createDataFrame([*rows, ("z", "A", 1.0)], "condition string, cluster_id string, fraction_of_condition double")
    assert meta.fold_changes(third).count() == 0


def test_condition_columns(spark):
    rows = [("c", i, col, v, 1.0) for i, col in enumerate(["batch", "patient_group", "disease_state"]) for v in ("a", "b")]
    m = spark.createDataFrame(rows, "cluster_id string, col_ord int, col string, value string, frac double")
    words = lambda *w: spark.createDataFrame(list(enumerate(w)), "kw_ord int, kw string")
    assert meta.detect_condition(m, words("patient_group", "disease", "group")).first()["col"] == "disease_state"
    assert tuple(meta.detect_condition(m, words("zzz"), ["batch"]).first()) == ("patient_group", "binary")
    assert meta.detect_condition(m.filter("value = 'a'"), words("disease")).count() == 0


def test_metadata_and_keys(spark):
    cells = spark.createDataFrame([(1, "A", "x", None), (2, "A", "y", "t"), (3, "A", "x", None)], "cell_id int, cluster_id string, p string, q string")
    got = {(r["col"], r["value"]): r["frac"] for r in meta.cluster_metadata(cells, ["p", "q"]).collect()}
    assert got["q", "nan"] == pytest.approx(2 / 3) and sum(v for (c, _), v in got.items() if c == "p") == 1.0
    assert meta.chosen_columns(cells, ["cluster_id", "p", "q"]) == ["p", "q"]
    assert meta.cluster_key(cells, ["none", "cluster_id", "p"]) == "p"


def test_correlation_skips_constants(spark):
    clusters = spark.createDataFrame([("A",), ("B",), ("C",)], "cluster_id string")
    rows = [("A", "X", 1.0), ("B", "X", 2.0), ("A", "Y", 2.0), ("B", "Y", 4.0), *((c, "K", 0.3) for c in "ABC"), ("C", "Z", 5.0)]
    st = spark.createDataFrame(rows, "cluster_id string, gene_u string, pct_in double")
    got = {r["gene_u"]: r["corr"] for r in profile.coexpression(st, clusters, "x").collect()}
    assert got["Y"] == pytest.approx(1.0) and "K" not in got and got["Z"] < 0
    assert profile.coexpression_pair(st, clusters, "X", "K").first()["corr"] == 0.0


def test_vectors(spark):
    v = lambda c, **x: one(spark, c, **x)
    assert v(V.normalized(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8] and v(V.normalized(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert v(V.padded(F.col("a"), 3, F.lit(0.0)), a=[1.0]) == [1.0, 0.0, 0.0] and v(V.padded(F.col("a"), 1, F.lit(0.0)), a=[1.0, 2.0]) == [1.0]
    assert v(V.binned(F.col("a"), 51), a=60.7) == 50
    assert v(V.mixed(F.col("a"), F.col("b"), 0.5), a=[1.0], b=[3.0]) == [2.0]


def test_evaluation(spark):
    expected = spark.createDataFrame([(1, "T cell"), (1, "B cell"), (2, "NK")], "qid int, cluster_id string")
    rankings = spark.createDataFrame([(1, "m", "X", 1), (1, "m", "T cell memory", 2), (1, "m", "B cell", 7), (2, "m", "X", 1)], "qid int, mode string, cluster_id string, rank long")
    exact = {r["qid"]: (r["recall_at_5"], r["recall_at_10"], r["mrr"]) for r in evalkit.recall_mrr(expected, rankings).collect()}
    assert exact == {1: (0.0, 0.5, pytest.approx(1 / 7)), 2: (0.0, 0.0, 0.0)}
    fuzzy = {r["qid"]: (r["recall_at_5"], r["mrr"]) for r in evalkit.recall_mrr(expected, rankings, fuzzy=True).collect()}
    assert fuzzy[1] == (0.5, 0.5)
    assert tuple(evalkit.complementarity(expected, rankings, "m", "other").first()) == (1, 0, 0, 2)


def test_recovery_keeps_truths_apart(spark):
    truth = spark.createDataFrame([("L", "R", "T cell", "B"), ("L", "Q", "a", "b")], "ligand string, receptor string, source string, target string")
    predicted = spark.createDataFrame([("l", "r", "t cell naive", "B cell"), ("l", "r", "x", "y")], "ligand string, receptor string, source string, target string")
    assert tuple(evalkit.recovered(truth, predicted).first()) == (2, 0.5, 0.5)


def test_neighbours_and_communities(spark):
    points = [(i, [float(i // 3 * 100 + i % 3), 0.0]) for i in range(6)]
    near = graph.neighbours(spark.createDataFrame(points, "id long, vec array<double>"), 2)
    assert all(r["id"] // 3 == r["other"] // 3 for r in near.collect())
    assert {r["id"]: r["community"] for r in graph.communities(near).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_encoder_and_tokens(spark):
    df = spark.createDataFrame([("t cell",), (None,)], "t string").select(encode.encoded(F.col("t"), lambda: encode.hashing_encoder(16)).alias("v"))
    a, b = (r["v"] for r in df.collect())
    assert sum(x * x for x in a) == pytest.approx(1.0) and sum(b) == 0.0
    vocabulary = spark.createDataFrame([("<cls>", 0), ("a", 1), ("b", 2), ("c", 3)], "gene string, token int")
    expr = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (1, "c", 2.0), (1, "zz", 9.0)], "cell_id int, gene string, value double")
    assert encode.cell_tokens(expr, vocabulary, 3).first()["tokens"] == [0, 2, 3]
    out = encode.model_vectors(encode.cell_tokens(expr, vocabulary), lambda: lambda batch: [[float(len(t))] for t in batch])
    assert out.first()["vec"] == [4.0]


def test_further_matches(spark):
    paths = lambda a, b: one(spark, T.pathways_alike(F.col("a"), F.col("b"), {"x stress": ["upr"]}), a=a, b=b)
    assert paths("Cell-cycle", "the cell cycle") and paths("a b c", "c z b") and paths("ER x stress response", "UPR genes") and not paths("a b", "b c") and not paths("", "a")
    names = lambda a, b: one(spark, T.clusters_alike(F.col("a"), F.col("b"), {"A-like": ["alpha"]}), a=a, b=b)
    assert names("A-like", "alpha cells") and names("big T-cell", "T_x") and not names("b cell", "t cell")
    rows = spark.createDataFrame([("b",), ("10",), ("2",)], "x string").orderBy(*T.digits_first(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["10", "2", "b"]
