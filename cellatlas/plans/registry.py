"""All queries over the local star schema, each beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evalkit, genesets, interact, meta, names, profile, rank, stats
from ..sources.staged import Stages
from . import cells, more, paths, views  # noqa: F401  register their queries
from .base import QUERIES, SQL, query, rounded
from .fixture import ASKED, CELLS, DENSE, META, PAIRS, SETS, SPARSE, STATS, VECTORS, Atlas

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marker_score_weighted(Atlas(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Atlas(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Statistics

STATS_OUT = "SELECT cluster_id, gene, CAST(nnz AS BIGINT) AS nnz, round(pct_in, 6) AS pct_in, round(pct_out, 6) AS pct_out, round(logfc, 6) AS logfc FROM stats"


@query(STATS_OUT, CELLS, SPARSE, STATS)
def gene_stats_sparse(a):
    return rounded(a.sparse_stats.select("cluster_id", "gene", "nnz", "pct_in", "pct_out", "logfc"))


@query(STATS_OUT, CELLS, DENSE, STATS)
def gene_stats_dense(a):
    return rounded(a.dense_stats.select("cluster_id", "gene", "nnz", "pct_in", "pct_out", "logfc"))


RANKS = """tied AS (SELECT gene, value, cluster_id, count(*) AS k FROM (SELECT cell_id, gene, round(value, 9) AS value FROM expr) JOIN cells USING (cell_id) GROUP BY ALL),
vals AS (SELECT gene, value, sum(k) AS ties FROM tied GROUP BY ALL),
ranks AS (SELECT gene, value, coalesce(sum(ties) OVER (PARTITION BY gene ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (ties + 1) / 2 AS r FROM vals),
rs AS (SELECT cluster_id, gene, sum(k) AS nnz, sum(k * r) AS r FROM tied JOIN ranks USING (gene, value) GROUP BY ALL),
rw AS (SELECT *, sum(nnz) OVER (PARTITION BY gene) AS nnz_all FROM rs JOIN sizes USING (cluster_id)),
zs AS (SELECT cluster_id, gene, (r + nnz * (n_all - nnz_all) + (n_in - nnz) * (n_all - nnz_all + 1) / 2 - n_in * (n_all + 1) / 2) / sqrt(CAST(n_in AS DOUBLE) * (n_all - n_in) * (n_all + 1) / 12) AS z FROM rw)"""


@query("SELECT cluster_id, gene, round(z, 6) AS z FROM zs", CELLS, DENSE, RANKS)
def ranksum_z(a):
    return rounded(stats.rank_sums(a.dense.withColumn("value", F.round("value", 9)), a.cells))


@query("SELECT cluster_id, gene, round(z, 6) AS z FROM zs", CELLS, DENSE, RANKS)
def ranksum_of_batches(a):
    """From counts of even and odd cells that were added one after the other."""
    return rounded(views._counts(a, a.dense.withColumn("value", F.round("value", 9))).rank_sums())


@query(
    """, p AS (SELECT cluster_id, gene, exp(-abs(z)) AS p FROM zs), pr AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY round(p, 9), gene) AS rk FROM p)
SELECT cluster_id, gene, round(least(1.0, min(round(p, 9) * n / rk) OVER (PARTITION BY cluster_id ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adj FROM pr""",
    CELLS,
    DENSE,
    RANKS,
)
def bh_adjust(a):
    z = stats.rank_sums(a.dense.withColumn("value", F.round("value", 9)), a.cells)
    return rounded(stats.adjusted(z.withColumn("p", F.round(F.exp(-F.abs("z")), 9))).select("cluster_id", "gene", "p_adj"))


RAW = "raw AS (SELECT o_custkey AS cell_id, p_name AS gene, sum(l_quantity) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"


@query("SELECT cell_id, gene, round(CASE WHEN (SELECT max(value) FROM raw) > 50 THEN ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY cell_id)) ELSE value END, 6) AS value FROM raw", RAW)
def log_normalize(a):
    lines = a.table("lineitem").join(a.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(a.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(stats.log_normalized(lines.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_name").alias("gene")).agg(F.sum("l_quantity").alias("value"))))


SPEC = "spec AS (SELECT *, pct_in / (pct_in + pct_out + 1e-8) AS specificity, pct_in / (pct_in + pct_out + 1e-8) * abs(logfc) AS weighted FROM stats)"


@query("SELECT gene_u, cluster_id, round(weighted, 6) AS score, round(specificity, 6) AS specificity FROM spec", CELLS, SPARSE, STATS, SPEC)
def inverted_index(a):
    return rounded(stats.inverted_index(a.sparse_stats).select("gene_u", F.inline("clusters")).select("gene_u", "cluster_id", "score", "specificity"))


@query("SELECT DISTINCT upper(gene) AS gene_u FROM (SELECT gene FROM expr UNION ALL SELECT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey))", CELLS, SPARSE)
def gene_universe(a):
    """Genes of two tables of statistics."""
    return stats.gene_universe(a.sparse_stats, a.dense_stats)


@query("SELECT gene, round(s / n, 6) AS mean, round(q / n - (s / n) * (s / n), 6) AS variance, round((q / n - (s / n) * (s / n)) / (s / n), 6) AS dispersion FROM (SELECT gene, sum(value) AS s, sum(value * value) AS q, (SELECT count(*) FROM cells) AS n FROM expr GROUP BY gene) ORDER BY (q / n - (s / n) * (s / n)) / (s / n) DESC, gene LIMIT 20", CELLS, DENSE)
def variable_genes(a):
    """The first twenty; variable_genes_default has the operator's own number."""
    return rounded(stats.variable_genes(a.dense, a.cells, 20))


@query("SELECT gene, round(s / n, 6) AS mean, round(q / n - (s / n) * (s / n), 6) AS variance, round((q / n - (s / n) * (s / n)) / (s / n), 6) AS dispersion FROM (SELECT gene, sum(value) AS s, sum(value * value) AS q, (SELECT count(*) FROM cells) AS n FROM expr GROUP BY gene) ORDER BY (q / n - (s / n) * (s / n)) / (s / n) DESC, gene LIMIT 3000", CELLS, DENSE)
def variable_genes_default(a):
    return rounded(stats.variable_genes(a.dense, a.cells))


# Rankings


def _marker_sql(term: str, simple: bool = False) -> str:
    score = "s" if simple else "s * (0.5 + 0.5 * hits / n_genes)"
    return f""", qs AS (SELECT qid, count(*) AS n_genes FROM queries GROUP BY qid),
h AS (SELECT qid, cluster_id, sum({term}) AS s, count(*) AS hits FROM queries JOIN stats USING (gene_u) GROUP BY 1, 2),
sc AS (SELECT qid, cluster_id, cluster_ord, coalesce({score}, 0.0) AS score FROM qs CROSS JOIN clusters LEFT JOIN h USING (qid, cluster_id)),
rk AS (SELECT qid, cluster_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cluster_ord) AS rank FROM sc)
SELECT qid, cluster_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 10"""


WEIGHTED = "(0.5 + abs(logfc)) * (0.3 + greatest(pct_in - pct_out, 0)) * CASE WHEN pct_in > 0.5 THEN 1.3 ELSE 1 END"
FULL = WEIGHTED + " * (0.5 + CASE WHEN pval_adj > 0 AND pval_adj < 1 THEN least(-log10(pval_adj + 1e-300), 10) / 10 ELSE 0 END)"


def _marker(a, mode):
    return rounded(rank.marker_scores(a.gene_queries, a.sparse_stats, a.clusters, mode))


@query(_marker_sql("CAST(1 AS DOUBLE)", True), CELLS, SPARSE, STATS, ASKED)
def marker_score_simple(a):
    return _marker(a, "simple")


@query(_marker_sql(WEIGHTED), CELLS, SPARSE, STATS, ASKED)
def marker_score_weighted(a):
    return _marker(a, "weighted")


@query(_marker_sql(FULL), CELLS, SPARSE, STATS, ASKED)
def marker_score_full(a):
    return _marker(a, "full")


COSINE = """q AS (SELECT vec_id AS qid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 100 = 0),
ql AS (SELECT qid, sqrt(sum(CAST(x AS DOUBLE) * x)) AS len FROM q GROUP BY 1),
cs AS (SELECT qid, label AS cluster_id, sum(x / len * v) AS score FROM q JOIN ql USING (qid) JOIN cents USING (i) GROUP BY 1, 2)"""


@query("SELECT qid, CAST(cluster_id AS BIGINT) AS cluster_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cluster_id) AS rank FROM cs) WHERE rank <= 5", VECTORS, COSINE)
def cosine_topk(a):
    return rounded(rank.semantic_ranking(a.vector_queries, a.vectors, 5))


TEXTS = [(1, "cells of the nation"), (2, "state and germany tissue"), (3, "fra"), (4, "")]
TEXT_SQL = "texts AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'cells of the nation'), (2, 'state and germany tissue'), (3, 'fra'), (4, '')) t(qid, text))"
BOOSTS = """names AS (SELECT cluster_id, list_filter(regexp_split_to_array(replace(replace(lower(cluster_id), '-', ' '), '_', ' '), '\\s+'), lambda p: length(p) > 3) AS parts FROM clusters),
nb AS (SELECT qid, cluster_id, len(list_filter(parts, lambda p: contains(lower(text), p))) / greatest(len(parts), 1) AS ratio FROM texts CROSS JOIN names)"""


def _texts(a):
    return a.spark.createDataFrame(TEXTS, "qid bigint, text string")


@query("SELECT qid, cluster_id, round(CASE WHEN ratio > 0.3 THEN 0.15 * ratio ELSE 0 END, 6) AS boost FROM nb", CELLS, TEXT_SQL, BOOSTS)
def name_boost(a):
    return rounded(_texts(a).join(a.clusters, F.lit(True)).select("qid", "cluster_id", T.name_boost(F.col("cluster_id"), F.col("text")).alias("boost")))


TWO = """byval AS (SELECT cluster_id, row_number() OVER (ORDER BY round(sum(value), 6) DESC, cluster_ord) AS rank FROM expr JOIN cells USING (cell_id) JOIN clusters USING (cluster_id) GROUP BY cluster_id, cluster_ord),
bysize AS (SELECT cluster_id, row_number() OVER (ORDER BY n_in DESC, cluster_ord) AS rank FROM sizes JOIN clusters USING (cluster_id))"""


def _two(a):
    """Rankings by summed value and by size, as query 1."""
    from pyspark.sql import Window

    place = lambda df, x: df.join(a.clusters, "cluster_id").select(F.lit(1).cast("long").alias("qid"), "cluster_id", F.row_number().over(Window.orderBy(F.desc(x), "cluster_ord")).cast("long").alias("rank"))  # noqa: E731  a row a cluster
    value = a.dense.join(a.cells, "cell_id").groupBy("cluster_id").agg(F.round(F.sum("value"), 6).alias("s"))
    return place(value, "s"), place(a.cells.groupBy("cluster_id").agg(F.count("*").alias("n")), "n")


FUSED = """fs AS (SELECT cluster_id, sum(w / (60 + rank)) AS score, min(l * 1000 + rank) AS tie FROM (SELECT cluster_id, rank, 3.0 AS w, 0 AS l FROM byval WHERE rank <= 20 UNION ALL SELECT cluster_id, rank, 1.0, 1 FROM bysize WHERE rank <= 20) GROUP BY 1)"""


@query("SELECT CAST(1 AS BIGINT) AS qid, cluster_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, tie) AS rank FROM fs) WHERE rank <= 10", CELLS, DENSE, TWO, FUSED)
def rrf_fusion(a):
    x, y = (r.filter("rank <= 20") for r in _two(a))
    return rounded(rank.fused([(x, 3.0), (y, 1.0)], top=10))


TERMS = [("state", "NATION_7"), ("germany", "NATION_3"), ("fra", "NATION_5"), ("tissue", "NOWHERE")]
TERM_SQL = "terms AS (SELECT * FROM (VALUES ('state', 'NATION_7'), ('germany', 'NATION_3'), ('fra', 'NATION_5'), ('tissue', 'NOWHERE')) t(term, cluster_id))"


@query(
    """, base AS (SELECT qid, cluster_id, 1.0 / (60 + rank) AS score FROM texts CROSS JOIN bysize WHERE rank <= 5),
hit AS (SELECT DISTINCT qid, cluster_id, 0.1 AS b FROM texts JOIN terms ON contains(lower(text), term) WHERE cluster_id IN (SELECT cluster_id FROM clusters))
SELECT qid, cluster_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cluster_ord) AS rank FROM (SELECT qid, cluster_id, coalesce(score, 0) + coalesce(b, 0) AS score FROM base FULL JOIN hit USING (qid, cluster_id)) JOIN clusters USING (cluster_id)""",
    CELLS,
    DENSE,
    TWO,
    TEXT_SQL,
    TERM_SQL,
)
def synonym_boost(a):
    base = _texts(a).select("qid").join(_two(a)[1].filter("rank <= 5").drop("qid"), F.lit(True)).withColumn("score", 1.0 / (60 + F.col("rank")))
    return rounded(rank.synonym_boosted(base, _texts(a), a.spark.createDataFrame(TERMS, "term string, cluster_id string"), a.clusters))


@query(
    """, every AS (SELECT cluster_id, 0 AS l, rank FROM byval WHERE rank <= 6 UNION ALL SELECT cluster_id, 1, rank FROM bysize WHERE rank <= 6), best AS (SELECT cluster_id, min(l * 1000 + rank) AS place FROM every GROUP BY 1)
SELECT CAST(1 AS BIGINT) AS qid, cluster_id, CASE WHEN place < 1000 THEN 'first' ELSE 'second' END AS origin, row_number() OVER (ORDER BY place) AS rank FROM best""",
    CELLS,
    DENSE,
    TWO,
)
def union_additive(a):
    x, y = (r.filter("rank <= 6") for r in _two(a))
    return rank.union_ranking(x, y)


@query("SELECT qid, run, cluster_id, rank FROM (SELECT qid, 7 AS run, cluster_id, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || '|' || cluster_id || '|7')) AS rank FROM texts CROSS JOIN clusters) WHERE rank <= 5", CELLS, TEXT_SQL)
def random_baseline(a):
    return rank.random_ranking(_texts(a), a.clusters, F.lit(7), 5)


@query("SELECT cluster_id, gene, round(logfc, 6) AS logfc, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(abs(logfc), 9) DESC, gene) AS rank FROM stats) WHERE rank <= 30", CELLS, DENSE, STATS)
def top_genes_per_cluster(a):
    return rounded(rank.top_genes(a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 30).select("cluster_id", "gene", "logfc", "rank"))


ROUTED = """gs AS (SELECT CAST(1 AS BIGINT) AS qid, cluster_id, rank FROM byval WHERE rank <= 10), ss AS (SELECT CAST(1 AS BIGINT) AS qid, cluster_id, rank FROM bysize WHERE rank <= 10)"""


def _routed(a, mode):
    genes, sem = _two(a)
    sem = sem.withColumn("score", 1.0 / F.col("rank"))
    text = a.spark.createDataFrame([(1, "from germany and the states")], "qid bigint, text string")
    return rounded(rank.route(mode, genes, sem, sem, text, a.spark.createDataFrame(TERMS, "term string, cluster_id string"), a.clusters, 5))


@query("SELECT qid, cluster_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, tie) AS rank FROM (SELECT qid, cluster_id, sum(w / (60 + rank)) AS score, min(l * 1000 + rank) AS tie FROM (SELECT *, 3.0 AS w, 0 AS l FROM gs UNION ALL SELECT *, 1.0, 1 FROM ss) GROUP BY 1, 2)) WHERE rank <= 5", CELLS, DENSE, TWO, ROUTED)
def route_gene_list(a):
    return _routed(a, "gene_list")


SYN = ", hit AS (SELECT CAST(1 AS BIGINT) AS qid, cluster_id, 0.1 AS b FROM (VALUES ('NATION_7'), ('NATION_3')) t(cluster_id)) SELECT qid, cluster_id, round(score, 6) AS score, rank FROM (SELECT qid, cluster_id, score, row_number() OVER (ORDER BY score DESC, cluster_ord) AS rank FROM (SELECT qid, cluster_id, coalesce(score, 0) + coalesce(b, 0) AS score FROM {0} FULL JOIN hit USING (qid, cluster_id)) JOIN clusters USING (cluster_id)) WHERE rank <= 5"


@query(SYN.format("(SELECT qid, cluster_id, 1.0 / rank AS score FROM ss)"), CELLS, DENSE, TWO, ROUTED)
def route_ontology(a):
    return _routed(a, "ontology")


@query(SYN.format("(SELECT qid, cluster_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, tie) AS r FROM (SELECT qid, cluster_id, sum(1.0 / (60 + rank)) AS score, min(l * 1000 + rank) AS tie FROM (SELECT *, 0 AS l FROM gs UNION ALL SELECT *, 1 FROM ss) GROUP BY 1, 2)) WHERE r <= 10)"), CELLS, DENSE, TWO, ROUTED)
def route_mixed(a):
    return _routed(a, "mixed")


# Query texts

PREFIXES, ORDINARY = ["CD", "IL", "COL"], ["the", "of", "and", "in", "to", "is"]
TOKENS = """universe AS (SELECT list(DISTINCT upper(p_name)) AS u FROM part),
raw_tokens AS (SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''), 1) AS i FROM benchmark),
toks AS (SELECT qid, i, upper(replace(trim(w, '.,;:()'), 'ß', 'SS')) AS t FROM raw_tokens),
flags AS (SELECT qid, i, t, t IN ('THE', 'OF', 'AND', 'IN', 'TO', 'IS') AS nl, regexp_matches(t, '^[A-Z][A-Z0-9]{1,14}(?:-[A-Z0-9]{1,6})?$') AS form FROM toks WHERE t <> ''),
marked AS (SELECT *, NOT nl AND form AND (starts_with(t, 'CD') OR starts_with(t, 'IL') OR starts_with(t, 'COL') OR (regexp_matches(t, '[0-9]') AND length(t) >= 3)) AS gene FROM flags)"""


def _parsed(a):
    universe = a.table("part").select(F.upper("p_name").alias("gene_u"))
    return T.parsed(a.table("benchmark").select(F.col("item_id").alias("qid"), "text"), universe, PREFIXES, ORDINARY)


@query(
    """, n AS (SELECT qid, count(*) AS n FROM toks GROUP BY qid), c AS (SELECT qid, sum(CASE WHEN gene THEN 1 ELSE 0 END) AS g, sum(CASE WHEN nl THEN 1 ELSE 0 END) AS l FROM marked GROUP BY qid)
SELECT item_id AS qid, CASE WHEN g / n >= 0.6 THEN 'gene_list' WHEN g / n >= 0.2 AND l / n >= 0.2 THEN 'mixed' ELSE 'ontology' END AS mode FROM benchmark LEFT JOIN n ON n.qid = item_id LEFT JOIN c ON c.qid = item_id""",
    TOKENS,
)
def classify_query(a):
    return _parsed(a).select("qid", "mode")


@query("SELECT qid, t AS gene, CAST(row_number() OVER (PARTITION BY qid ORDER BY i) AS BIGINT) AS pos FROM marked WHERE form AND NOT nl", TOKENS)
def extract_genes(a):
    found = _parsed(a).select("qid", F.posexplode("genes").alias("pos", "gene"))
    return found.select("qid", "gene", (F.col("pos") + 1).cast("long").alias("pos"))


KNOWN = """uni AS (SELECT 'P/' || p_partkey AS g FROM part WHERE p_partkey % 2 = 0),
said AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 3 = 0 THEN ['P/' || p_partkey, 'P/' || (2 * p_partkey)] ELSE ['THE', 'CELLS', 'OF', 'P/' || p_partkey, 'AND', 'P/' || (2 * p_partkey), 'IN', 'IT'] END AS ts FROM part),
tk AS (SELECT qid, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM said),
fl AS (SELECT qid, i, t, t IN (SELECT g FROM uni) AS known, t IN ('THE', 'OF', 'AND', 'IN') AS plain, regexp_matches(t, '^[A-Z][A-Z0-9]{1,14}(?:-[A-Z0-9]{1,6})?$') AS form FROM tk)"""


def _known(a):
    """Texts of genes whose names have no gene's form: only the universe, every second part, tells them."""
    part = a.table("part")
    one, two = (F.concat(F.lit("p/"), (F.col("p_partkey") * k).cast("string")) for k in (1, 2))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", one, two)).otherwise(F.concat_ws(" ", F.lit("The cells of"), one, F.lit("and"), two, F.lit("in it.")))
    universe = part.filter("p_partkey % 2 = 0").select(F.upper(one).alias("gene_u"))
    return T.parsed(part.select(F.col("p_partkey").alias("qid"), text.alias("text")), universe, PREFIXES, ORDINARY)


@query("SELECT qid, CASE WHEN g / n >= 0.6 THEN 'gene_list' WHEN g / n >= 0.2 AND l / n >= 0.2 THEN 'mixed' ELSE 'ontology' END AS mode FROM (SELECT qid, count(*) AS n, sum(CASE WHEN known THEN 1 ELSE 0 END) AS g, sum(CASE WHEN plain THEN 1 ELSE 0 END) AS l FROM fl GROUP BY 1)", KNOWN)
def classify_known_genes(a):
    return _known(a).select("qid", "mode")


@query("SELECT qid, t AS gene, CAST(row_number() OVER (PARTITION BY qid ORDER BY i) AS BIGINT) AS pos FROM fl WHERE known OR (form AND NOT plain)", KNOWN)
def extract_known_genes(a):
    return _known(a).select("qid", F.posexplode("genes").alias("pos", "gene")).select("qid", "gene", (F.col("pos") + 1).cast("long").alias("pos"))


WORD_SQL = "ws AS (SELECT p_name, list_distinct(string_split(lower(p_name), ' ')) AS w FROM (SELECT DISTINCT p_name FROM part)), jw AS (SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.w, b.w)) AS k, len(list_distinct(list_concat(a.w, b.w))) AS u FROM ws a CROSS JOIN ws b)"


def _names(a):
    x = a.table("part").select(F.col("p_name").alias("a")).distinct()
    return x.join(x.withColumnRenamed("a", "b"), F.lit(True))


@query("SELECT a, b, round(k / u, 6) AS jaccard FROM jw", WORD_SQL)
def word_jaccard(a):
    return rounded(_names(a).select("a", "b", T.jaccard(F.col("a"), F.col("b")).alias("jaccard")))


@query("SELECT a, b FROM jw WHERE contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) OR k / u >= 0.5", WORD_SQL)
def fuzzy_match_join(a):
    own = a.table("part").select("p_name")
    return names.alike(own, own)


@query("SELECT item_id AS qid, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS BIGINT) AS n, list_bool_or(list_transform(['the', 'ion', 'zzz'], lambda k: contains(lower(text), k))) AS themed FROM benchmark")
def words_and_themes(a):
    return a.table("benchmark").select(F.col("item_id").alias("qid"), T.n_tokens(F.col("text")).cast("long").alias("n"), T.covered(F.col("text"), F.array(F.lit("THE"), F.lit("ion"), F.lit("zzz"))).alias("themed"))


@query("SELECT doc_id, m AS gene FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][A-Z0-9]{2,9}'))) AS m FROM documents)")
def regex_genes(a):
    return a.table("documents").select("doc_id", F.explode(T.mentioned(F.col("text"), "[A-Z][A-Z0-9]{2,9}")).alias("gene"))


@query("SELECT cluster_id, CASE WHEN length(cluster_id) > 8 THEN substr(cluster_id, 1, 7) || '.' ELSE cluster_id END AS short, lower(cluster_id) LIKE '%nation_1%' AS named FROM clusters WHERE lower(cluster_id) LIKE '%nation_1%' OR NOT EXISTS (SELECT 1 FROM clusters WHERE lower(cluster_id) LIKE '%nation_1%')", CELLS)
def named_clusters(a):
    return interact.named_clusters(a.clusters, "Nation_1").select("cluster_id", T.short_name(F.col("cluster_id"), 8).alias("short"), F.lower("cluster_id").contains("nation_1").alias("named"))


# Interactions

LR = "lr AS (SELECT l.cluster_id AS source, r.cluster_id AS target, ligand, receptor, pathway, l.pct_in AS ligand_pct, r.pct_in AS receptor_pct FROM pairs JOIN stats l ON l.gene_u = upper(ligand) JOIN stats r ON r.gene_u = upper(receptor) WHERE l.pct_in >= 0.03 AND r.pct_in >= 0.02 AND l.cluster_id <> r.cluster_id)"


def _lr(a):
    return interact.interactions(a.sparse_stats, a.pairs, min_ligand=0.03, min_receptor=0.02)


@query("SELECT source, target, ligand, receptor, pathway, round(ligand_pct, 3) AS ligand_pct, round(receptor_pct, 3) AS receptor_pct, round(ligand_pct * receptor_pct, 6) AS score FROM lr", CELLS, SPARSE, STATS, PAIRS, LR)
def lr_interactions(a):
    return _lr(a).drop("lr_ord").withColumns({"ligand_pct": F.round("ligand_pct", 3), "receptor_pct": F.round("receptor_pct", 3), "score": F.round("score", 6)})


@query("SELECT pathway, count(*) AS n FROM lr GROUP BY 1", CELLS, SPARSE, STATS, PAIRS, LR)
def lr_by_pathway(a):
    return interact.by_pathway(_lr(a))


@query("SELECT source, target, count(*) AS n FROM lr GROUP BY 1, 2 ORDER BY n DESC, source, target LIMIT 20", CELLS, SPARSE, STATS, PAIRS, LR)
def lr_by_pair(a):
    return interact.by_pair(_lr(a))


@query("SELECT count(*) AS n, avg(CASE WHEN EXISTS (SELECT 1 FROM lr WHERE lr.ligand = t.ligand AND lr.receptor = t.receptor) THEN 1.0 ELSE 0.0 END) AS lr_rate FROM pairs t", CELLS, SPARSE, STATS, PAIRS, LR)
def lr_recovery(a):
    truth = a.pairs.select("ligand", "receptor", F.lit("NATION_3").alias("source"), F.lit("NATION_5").alias("target"))
    return evalkit.recovered(truth, _lr(a)).select("n", "lr_rate")


LR_TRUTH = "truth AS (SELECT ligand, receptor, 'NATION_' || (lr_ord % 25) AS s, 'nation_' || (lr_ord % 7) AS t FROM pairs)"


@query("SELECT count(*) AS n, round(avg(CASE WHEN lr THEN 1.0 ELSE 0 END), 6) AS lr_rate, round(avg(CASE WHEN f THEN 1.0 ELSE 0 END), 6) AS full_rate FROM (SELECT EXISTS (SELECT 1 FROM lr WHERE lr.ligand = u.ligand AND lr.receptor = u.receptor) AS lr, EXISTS (SELECT 1 FROM lr WHERE lr.ligand = u.ligand AND lr.receptor = u.receptor AND (contains(lower(source), lower(s)) OR contains(lower(s), lower(source))) AND (contains(lower(target), t) OR contains(t, lower(target)))) AS f FROM truth u)", CELLS, SPARSE, STATS, PAIRS, LR, LR_TRUTH)
def lr_recovery_full(a):
    """With the clusters' names too; a name that holds another counts."""
    name = lambda x, k: F.concat(F.lit(x), (F.col("lr_ord") % k).cast("string"))
    return rounded(evalkit.recovered(a.pairs.select("ligand", "receptor", name("NATION_", 25).alias("source"), name("nation_", 7).alias("target")), _lr(a)))


@query("SELECT source, target, ligand, receptor, CAST(score AS DOUBLE) AS score, row_number() OVER (ORDER BY score DESC, lr_ord, s, t) AS place FROM (SELECT source, target, ligand, receptor, round(CAST(ligand_pct * receptor_pct AS DECIMAL(18, 9)), 4) AS score, lr_ord, a.cluster_ord AS s, b.cluster_ord AS t FROM lr JOIN pairs USING (ligand, receptor) JOIN clusters a ON a.cluster_id = source JOIN clusters b ON b.cluster_id = target)", CELLS, SPARSE, STATS, PAIRS, LR)
def lr_in_order(a):
    return interact.in_order(_lr(a), a.clusters).select("source", "target", "ligand", "receptor", "score", "place")


@query("SELECT count(*) AS n, CAST(sum(hit) AS BIGINT) AS n_found, round(avg(hit), 6) AS rate FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM lr WHERE (contains(lower(lr.source), lower(t.source)) OR contains(lower(t.source), lower(lr.source))) AND (contains(lower(lr.target), lower(t.target)) OR contains(lower(t.target), lower(lr.target)))) THEN 1 ELSE 0 END AS hit FROM (SELECT lower(n_name) AS source, r_name || CASE WHEN n_nationkey % 2 = 0 THEN ' ' || n_name ELSE '' END AS target FROM nation JOIN region ON r_regionkey = n_regionkey) t)", CELLS, SPARSE, STATS, PAIRS, LR)
def paper_interactions(a):
    """Half of the targets hold a cluster's name, the others none."""
    own = a.table("nation").join(a.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    target = F.concat("r_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), "n_name")).otherwise(""))
    return rounded(evalkit.paper_interactions(own.select(F.lower("n_name").alias("source"), target.alias("target")), _lr(a)))


@query("SELECT cluster_id, gene, round(CASE WHEN nnz % 2 = 0 THEN 0 ELSE logfc END, 6) AS logfc, round(CASE WHEN nnz % 3 = 0 THEN 1 ELSE pval_adj END, 6) AS pval_adj FROM stats", CELLS, DENSE, STATS)
def guarded_stats(a):
    nan = F.lit(float("nan"))
    own = a.dense_stats.withColumns({c: F.when(F.col("nnz") % m == 0, nan).otherwise(F.col(c)) for c, m in (("logfc", 2), ("pval_adj", 3))})
    return rounded(stats.guarded(own).select("cluster_id", "gene", "logfc", "pval_adj"))


@query("SELECT k, v FROM (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_partkey % 3 = 0) ")
def merged_definitions(a):
    """Every third part is defined by both, most others by the first alone."""
    from ..sources import catalog

    part = a.table("part")
    return catalog.merged(part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v")), "k")


# Gene sets

SET_SCORES = """ss AS (SELECT set_name, min(set_ord) AS set_ord, count(*) AS n_genes FROM sets GROUP BY 1),
sh AS (SELECT cluster_id, set_name, count(*) AS n, avg(pct_in) AS mean FROM sets JOIN stats ON gene_u = upper(sets.gene) GROUP BY 1, 2),
scored AS (SELECT cluster_id, set_name, set_ord, coalesce(n, 0) AS n_found, n_genes, coalesce(n, 0) / n_genes AS coverage, CASE WHEN n >= 3 THEN mean ELSE 0 END AS score FROM clusters CROSS JOIN ss LEFT JOIN sh USING (cluster_id, set_name))"""


def _set_scores(a):
    return genesets.set_scores(a.sparse_stats, a.sets, a.clusters).withColumn("score", F.round("score", 9))


@query("SELECT cluster_id, set_name, n_found, n_genes, round(coverage, 6) AS coverage, round(score, 6) AS score FROM scored", CELLS, SPARSE, STATS, SETS, SET_SCORES)
def pathway_scores(a):
    return rounded(_set_scores(a).drop("set_ord"))


@query("SELECT set_name, cluster_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY round(score, 9) DESC, cluster_id) AS r FROM scored) WHERE r = 1", CELLS, SPARSE, STATS, SETS, SET_SCORES)
def top_cluster_per_set(a):
    return rounded(genesets.best_cluster_of_set(_set_scores(a)))


@query("SELECT set_name, cluster_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, set_ord) AS place FROM (SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY round(score, 9) DESC, cluster_id) AS r FROM scored) WHERE r = 1", CELLS, SPARSE, STATS, SETS, SET_SCORES)
def pathways_in_order(a):
    return rounded(genesets.sets_in_order(_set_scores(a)))


@query("SELECT cluster_id, set_name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, set_ord) AS r FROM scored) WHERE r = 1", CELLS, SPARSE, STATS, SETS, SET_SCORES)
def top_set_per_cluster(a):
    return rounded(genesets.best_set_of_cluster(_set_scores(a)))


@query("SELECT cluster_id, set_name, gene_u, round(pct_in, 6) AS value, rank FROM (SELECT cluster_id, set_name, gene_u, pct_in, row_number() OVER (PARTITION BY cluster_id, set_name ORDER BY pct_in DESC, gene_ord) AS rank FROM sets JOIN stats ON gene_u = upper(sets.gene)) WHERE rank <= 5", CELLS, SPARSE, STATS, SETS)
def pathway_top_genes(a):
    return rounded(genesets.top_set_genes(a.sparse_stats, a.sets))


@query("SELECT set_name, CAST(set_ord AS BIGINT) AS set_ord FROM (SELECT set_name, min(set_ord) AS set_ord FROM sets GROUP BY 1) WHERE contains(lower(set_name), 'promo') ORDER BY set_ord LIMIT 1", SETS)
def resolve_pathway(a):
    return rounded(genesets.resolved_set(a.sets, "promo"))


@query(
    """, own AS (SELECT cluster_id, avg(CASE WHEN set_ord = 1 THEN pct_in END) AS s, avg(CASE WHEN set_ord = 2 THEN pct_in END) AS g FROM (SELECT DISTINCT dense_rank() OVER (ORDER BY split_part(p_name, ' ', 1)) AS set_ord, p_name AS gene FROM part) q JOIN stats USING (gene) GROUP BY 1), f AS (SELECT cluster_id, coalesce(s, 0) AS s, coalesce(g, 0) AS g FROM clusters LEFT JOIN own USING (cluster_id))
SELECT cluster_id, round(s, 6) AS s_score, round(g, 6) AS g2m_score, CASE WHEN s > 0.3 AND g > 0.3 THEN 'cycling' WHEN s > 0.2 THEN 'S' WHEN g > 0.2 THEN 'G2M' ELSE 'G1' END AS phase FROM f""",
    CELLS,
    DENSE,
    STATS,
)
def cell_cycle_phase(a):
    from pyspark.sql import Window

    own = a.table("part").select("p_name").distinct()
    sets = own.withColumn("set_name", F.concat(F.lit("s"), F.dense_rank().over(Window.orderBy(F.split("p_name", " ")[0])).cast("string"))).withColumnRenamed("p_name", "gene")
    return rounded(genesets.cell_cycle(a.dense_stats, sets, a.clusters, "s1", "s2"))


@query(
    """, own AS (SELECT cluster_id, avg(CASE WHEN g < 'm' THEN pct_in END) AS s, avg(CASE WHEN g >= 'm' THEN pct_in END) AS g FROM (SELECT DISTINCT p_name AS gene, p_name AS g FROM part) q JOIN stats USING (gene) GROUP BY 1), f AS (SELECT cluster_id, coalesce(s, 0) AS s, coalesce(g, 0) AS g FROM clusters LEFT JOIN own USING (cluster_id))
SELECT cluster_id, round(s, 6) AS s_score, round(g, 6) AS g2m_score, row_number() OVER (ORDER BY round(round(s, 4) + round(g, 4), 4) DESC, cluster_id) AS place FROM f""",
    CELLS,
    DENSE,
    STATS,
)
def phases_in_order(a):
    sets = a.table("part").select(F.when(F.col("p_name") < "m", "s").otherwise("g").alias("set_name"), F.col("p_name").alias("gene")).distinct()
    return rounded(genesets.phases_in_order(genesets.cell_cycle(a.dense_stats, sets, a.clusters, "s", "g")).drop("phase"))


# Metadata


@query("SELECT cluster_id, n_cells, col, value, n, round(frac, 6) AS frac FROM meta", CELLS, META)
def cluster_metadata(a):
    return rounded(a.meta.drop("col_ord"))


@query("SELECT cluster_id, n_in AS n, round(n_in / n_all, 6) AS fraction, round(n_in / n_all * 100, 2) AS percentage FROM sizes", CELLS)
def proportions(a):
    return rounded(meta.composition(a.cells))


COND = "cond AS (SELECT value AS condition, cluster_id, CAST(round_even(n_cells * frac, 0) AS BIGINT) AS n FROM meta WHERE col = 'balance'), share AS (SELECT *, n / sum(n) OVER (PARTITION BY condition) AS f FROM cond)"


@query("SELECT condition, cluster_id, n, round(f, 6) AS fraction_of_condition FROM share", CELLS, META, COND)
def condition_proportions(a):
    return rounded(meta.condition_composition(a.meta, "balance"))


@query("SELECT cluster_id, fa, fb, fb <= 0.001 AND fa > 0.001 AS is_inf, round(CASE WHEN fb > 0.001 THEN fa / fb WHEN fa > 0.001 THEN NULL ELSE 1 END, 6) AS fold_change FROM (SELECT cluster_id, sum(CASE WHEN condition = 'neg' THEN round(f, 4) ELSE 0 END) AS fa, sum(CASE WHEN condition = 'pos' THEN round(f, 4) ELSE 0 END) AS fb FROM share GROUP BY 1)", CELLS, META, COND)
def proportion_fold_change(a):
    return rounded(meta.fold_changes(meta.condition_composition(a.meta, "balance")))


@query("SELECT cluster_id, round(fold_change, 6) AS fold_change, row_number() OVER (ORDER BY CASE WHEN fb <= 0.001 AND fa > 0.001 THEN 999 ELSE round(fold_change, 3) END DESC, cluster_id) AS place FROM (SELECT *, CASE WHEN fb > 0.001 THEN fa / fb WHEN fa > 0.001 THEN NULL ELSE 1 END AS fold_change FROM (SELECT cluster_id, sum(CASE WHEN condition = 'neg' THEN round(f, 4) ELSE 0 END) AS fa, sum(CASE WHEN condition = 'pos' THEN round(f, 4) ELSE 0 END) AS fb FROM share WHERE NOT (condition = 'pos' AND cluster_id = 'NATION_3') GROUP BY 1))", CELLS, META, COND)
def fold_changes_in_order(a):
    """One cluster lacks the second condition, so that its change is infinite where it has the first."""
    shares = meta.condition_composition(a.meta, "balance").filter("NOT (condition = 'pos' AND cluster_id = 'NATION_3')")
    return rounded(meta.changes_in_order(meta.fold_changes(shares)).select("cluster_id", "fold_change", "place"))


FOUND = """cols AS (SELECT col_ord, col, count(DISTINCT value) AS n, translate(lower(col), '_-', '  ') AS name FROM meta GROUP BY 1, 2),
kws AS (SELECT * FROM (VALUES (0, 'disease'), (1, 'market segment')) t(kw_ord, kw)),
named AS (SELECT 0 AS how, kw_ord, col_ord, col FROM cols JOIN kws ON n BETWEEN 2 AND 10 AND (contains(name, kw) OR contains(kw, name)) UNION ALL SELECT 1, 0, col_ord, col FROM cols WHERE n = 2 AND NOT contains(name, 'batch'))"""


@query("SELECT col, CASE how WHEN 0 THEN 'keyword' ELSE 'binary' END AS how FROM named ORDER BY named.how, kw_ord, col_ord LIMIT 1", CELLS, META, FOUND)
def detect_condition(a):
    return meta.detect_condition(a.meta, a.spark.createDataFrame([(0, "disease"), (1, "market segment")], "kw_ord int, kw string"), ["batch"])


@query("SELECT 'none' AS asked, col, CASE how WHEN 0 THEN 'keyword' ELSE 'binary' END AS how FROM named WHERE named.how = 1 ORDER BY col_ord LIMIT 1", CELLS, META, FOUND)
def detect_binary_condition(a):
    """No keyword fits, so a column of two values is taken."""
    found = meta.detect_condition(a.meta, a.spark.createDataFrame([(0, "disease")], "kw_ord int, kw string"), ["batch"])
    return found.select(F.lit("none").alias("asked"), "col", "how")


@query("SELECT col, max(CASE WHEN lower(value) = 'neg' THEN value END) AS group_a, max(CASE WHEN lower(value) = 'pos' THEN value END) AS group_b FROM meta WHERE lower(value) IN ('neg', 'pos') GROUP BY col_ord, col ORDER BY col_ord LIMIT 1", CELLS, META)
def group_column(a):
    return meta.group_column(a.meta, "NEG", "Pos")


BIAS = """bf AS (SELECT cluster_id, sum(CASE WHEN value = 'BUILDING' THEN frac ELSE 0 END) AS frac_a, sum(CASE WHEN value = 'MACHINERY' THEN frac ELSE 0 END) AS frac_b FROM meta WHERE col = 'segment' GROUP BY 1),
bias AS (SELECT cluster_id, coalesce(frac_a, 0) AS frac_a, coalesce(frac_b, 0) AS frac_b, CASE WHEN frac_a > 0.2 THEN 'BUILDING' WHEN frac_b > 0.2 THEN 'MACHINERY' ELSE 'mixed' END AS bias FROM clusters LEFT JOIN bf USING (cluster_id) WHERE frac_a >= 0.01 OR frac_b >= 0.01),
cg AS (SELECT * FROM (SELECT cluster_id, bias, gene, round(logfc, 9) AS logfc, pct_in, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(round(logfc, 9)) DESC, gene) AS r FROM bias JOIN stats USING (cluster_id) WHERE pct_in >= 0.05) WHERE r <= 20)"""


def _compared(a):
    biased = meta.biased_clusters(a.clusters, a.meta, "segment", "BUILDING", "MACHINERY", over=0.2)
    return biased, meta.compared_genes(biased, a.dense_stats.withColumn("logfc", F.round("logfc", 9)))


@query("SELECT cluster_id, bias, gene, round(logfc, 6) AS logfc, round(pct_in, 6) AS pct_in FROM cg", CELLS, DENSE, STATS, META, BIAS)
def compare_clusters(a):
    return rounded(_compared(a)[1].select("cluster_id", "bias", "gene", "logfc", "pct_in"))


@query("SELECT * FROM (SELECT side, gene, n_clusters, round(max_logfc, 6) AS max_logfc, row_number() OVER (PARTITION BY side ORDER BY max_logfc DESC, gene) AS rank FROM (SELECT bias AS side, gene, count(*) AS n_clusters, max(logfc) AS max_logfc FROM cg WHERE bias <> 'mixed' AND logfc > 0 GROUP BY 1, 2)) WHERE rank <= 30", CELLS, DENSE, STATS, META, BIAS)
def condition_enriched(a):
    return rounded(meta.enriched_genes(_compared(a)[1], ["BUILDING", "MACHINERY"]))


# Profiles


def _spec(a):
    return profile.marker_specificity(a.dense_stats)


@query("SELECT cluster_id, gene, round(specificity, 6) AS specificity, round(weighted, 6) AS weighted, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weighted, 4) DESC, gene) AS rank FROM spec) WHERE rank <= 20", CELLS, DENSE, STATS, SPEC)
def marker_specificity(a):
    return rounded(profile.top_specific(_spec(a)))


@query("SELECT cluster_id, gene, round(specificity, 6) AS specificity, round(weighted, 6) AS weighted FROM spec ORDER BY round(weighted, 4) DESC, gene, cluster_id LIMIT 50", CELLS, DENSE, STATS, SPEC)
def marker_specificity_global(a):
    return rounded(profile.top_specific_overall(_spec(a)))


ZERO = "zero AS (SELECT c.cluster_id, g.gene_u, coalesce(s.pct_in, 0) AS v FROM clusters c CROSS JOIN (SELECT DISTINCT gene_u FROM stats) g LEFT JOIN stats s ON s.cluster_id = c.cluster_id AND s.gene_u = g.gene_u)"
GENE, OTHER = "G1", "G2"


@query(
    f""", x AS (SELECT cluster_id, v AS x FROM zero WHERE gene_u = '{GENE}'), c AS (SELECT gene_u, covar_pop(v, x) AS c, stddev_pop(v) AS dy, stddev_pop(x) AS dx FROM zero JOIN x USING (cluster_id) WHERE gene_u <> '{GENE}' GROUP BY 1), k AS (SELECT gene_u, c / (dx * dy) AS corr FROM c WHERE dx >= 1e-8 AND dy >= 1e-8),
s AS (SELECT gene_u, corr, CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END AS side FROM k) SELECT gene_u, round(corr, 6) AS corr, side, rank FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(round(corr, 4)) DESC, gene_u) AS rank FROM s) WHERE rank <= 20""",
    CELLS,
    SPARSE,
    STATS,
    ZERO,
)
def coexpr_scan(a):
    return rounded(profile.top_correlated(profile.coexpression(a.sparse_stats, a.clusters, GENE)))


@query(f"SELECT '{GENE}' AS gene_a, '{OTHER}' AS gene_b, round(corr(x.v, y.v), 6) AS corr FROM zero x JOIN zero y USING (cluster_id) WHERE x.gene_u = '{GENE}' AND y.gene_u = '{OTHER}'", CELLS, SPARSE, STATS, ZERO)
def coexpr_pair(a):
    return rounded(profile.coexpression_pair(a.sparse_stats, a.clusters, GENE, OTHER))


@query("SELECT CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS i, round(v, 6) AS v FROM cents", VECTORS)
def label_centroids(a):
    return rounded(a.vectors.select(F.col("cluster_id").alias("label"), F.posexplode("vec").alias("i", "v")))


@query("SELECT CAST(a.label AS BIGINT) AS a, CAST(b.label AS BIGINT) AS b, round(sum(a.v * b.v), 6) AS cosine FROM cents a JOIN cents b USING (i) GROUP BY 1, 2", VECTORS)
def similarity_matrix(a):
    return rounded(profile.similarities(a.vectors))


@query(
    """, drawn AS (SELECT vec_id AS k, embedding FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), k LIMIT 500), x AS (SELECT k, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM drawn), l AS (SELECT k, sqrt(sum(x * x)) AS len FROM x GROUP BY 1), u AS (SELECT k, i, x / len AS x FROM x JOIN l USING (k)), c AS (SELECT a.k, b.k AS other, sum(a.x * b.x) AS c FROM u a JOIN u b ON a.i = b.i AND a.k < b.k GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(max(c), 6) AS highest FROM c""".replace(", drawn AS", "WITH drawn AS", 1),
)
def embedding_cosines(a):
    return rounded(profile.pairwise_cosines(a.table("embeddings"), "vec_id", "embedding"))


@query("SELECT round(avg(v), 9) AS mean_variance FROM (SELECT i, var_pop(CAST(x AS DOUBLE)) AS v FROM unnested GROUP BY i)", VECTORS)
def embedding_spread(a):
    return rounded(profile.vector_spread(a.table("embeddings"), "embedding"), 9)


@query(
    """, asked AS (SELECT DISTINCT gene FROM expr), o AS (SELECT cluster_id, gene, count(*) AS k, sum(value) AS s FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2), e AS (SELECT cluster_id, gene, coalesce(k, 0) / n_in AS pct, coalesce(s, 0) / n_in AS mean FROM sizes CROSS JOIN asked LEFT JOIN o USING (cluster_id, gene))
SELECT cluster_id, gene, round(pct, 6) AS pct, round(mean, 6) AS mean, round(coalesce((mean - avg(mean) OVER w) / nullif(stddev_pop(mean) OVER w, 0), 0), 6) AS z FROM e WINDOW w AS (PARTITION BY gene)""",
    CELLS,
    DENSE,
)
def dotplot_zscore(a):
    return rounded(profile.dotplot(a.dense, a.cells, a.dense))


@query("SELECT gene, count(*) AS n, round(CASE WHEN count(*) > 10 THEN quantile_cont(value, 0.98) ELSE 1 END, 6) AS cap FROM expr GROUP BY 1", CELLS, SPARSE)
def expr_percentile_cap(a):
    return rounded(profile.expression_cap(a.sparse))


@query("SELECT cell_id, cluster_id, round(coalesce(value, 0), 6) AS value FROM cells LEFT JOIN (SELECT cell_id, value FROM expr WHERE gene = 'G1') USING (cell_id)", CELLS, SPARSE)
def gene_on_cells(a):
    return rounded(profile.gene_on_cells(a.sparse, a.cells, "G1"))


PIVOT = ["NATION_3", "NATION_5", "NATION_7"]


@query(", best AS (SELECT gene FROM stats GROUP BY 1 ORDER BY max(round(logfc, 9)) DESC, gene LIMIT 20) SELECT gene, " + ", ".join(f"round(coalesce(max(CASE WHEN cluster_id = '{c}' THEN logfc END), 0), 6) AS \"{c}\"" for c in PIVOT) + " FROM stats JOIN best USING (gene) GROUP BY 1", CELLS, DENSE, STATS)
def gene_cluster_pivot(a):
    return rounded(profile.gene_cluster_pivot(a.dense_stats.withColumn("logfc", F.round("logfc", 9)), PIVOT))


@query("SELECT gene, cluster_id, round(logfc, 6) AS logfc FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY abs(round(logfc, 9)) DESC, cluster_id DESC) AS r FROM stats) WHERE r = 1 ORDER BY abs(round(logfc, 9)) DESC, gene LIMIT 15", CELLS, DENSE, STATS)
def strongest_evidence(a):
    return rounded(profile.strongest_evidence(a.dense_stats.withColumn("logfc", F.round("logfc", 9))))


@query("SELECT cluster_id, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM cells GROUP BY 1", CELLS)
def cluster_positions(a):
    return rounded(profile.cluster_positions(a.cells, "x", "y"))


# Evaluation

EVAL = """wanted AS (SELECT region AS qid, cluster_id FROM clusters),
rankings AS (SELECT r.region AS qid, m.mode, m.cluster_id, m.rank FROM (SELECT DISTINCT region FROM clusters) r CROSS JOIN (SELECT 'value' AS mode, cluster_id, rank FROM byval WHERE rank <= 10 UNION ALL SELECT 'size', cluster_id, rank FROM bysize WHERE rank <= 10) m),
met AS (SELECT w.qid, m.mode, w.cluster_id, min(r.rank) AS best FROM wanted w CROSS JOIN (SELECT DISTINCT mode FROM rankings) m LEFT JOIN rankings r ON r.qid = w.qid AND r.mode = m.mode AND r.cluster_id = w.cluster_id GROUP BY 1, 2, 3),
res AS (SELECT qid, mode, avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END) AS recall_at_5, avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0 END) AS recall_at_10, coalesce(1 / min(best), 0) AS mrr, CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM met GROUP BY 1, 2)"""


def _eval(a):
    x, y = _two(a)
    both = x.withColumn("mode", F.lit("value")).unionByName(y.withColumn("mode", F.lit("size"))).filter("rank <= 10").drop("qid")
    expected = a.clusters.select(F.col("region").alias("qid"), "cluster_id")
    return expected, expected.select("qid").distinct().join(both, F.lit(True))


def _results(a):
    return evalkit.recall_mrr(*_eval(a)).withColumn("category", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd"))


@query("SELECT CAST(qid AS BIGINT) AS qid, mode, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(mrr, 6) AS mrr FROM res", CELLS, DENSE, TWO, EVAL)
def recall_mrr(a):
    return rounded(_results(a).drop("category"))


@query("SELECT category, count(*) AS n, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(mrr), 6) AS mrr FROM res GROUP BY ROLLUP (category)", CELLS, DENSE, TWO, EVAL)
def benchmark_rollup(a):
    return rounded(evalkit.benchmark(_results(a), ["recall_at_5", "mrr"]))


@query("SELECT category, mode, count(*) AS n, round(avg(mrr), 6) AS mean_mrr, round(stddev_pop(mrr), 6) AS std_mrr FROM res GROUP BY 1, 2", CELLS, DENSE, TWO, EVAL)
def benchmark_summary(a):
    return rounded(evalkit.summary(_results(a), ["mrr"]))


@query("SELECT mode, round(avg(m), 6) AS mrr FROM (SELECT mode, category, avg(mrr) AS m FROM res GROUP BY 1, 2) GROUP BY 1", CELLS, DENSE, TWO, EVAL)
def macro_mean(a):
    return rounded(evalkit.macro_mean(_results(a), "mrr"))


@query(", f AS (SELECT qid, cluster_id, max(CASE WHEN mode = 'value' AND best <= 5 THEN 1 ELSE 0 END) AS x, max(CASE WHEN mode = 'size' AND best <= 5 THEN 1 ELSE 0 END) AS y FROM met GROUP BY 1, 2) SELECT CAST(sum(CASE WHEN x = 1 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN x = 0 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS only_b, CAST(sum(x * y) AS BIGINT) AS both, CAST(sum((1 - x) * (1 - y)) AS BIGINT) AS neither FROM f", CELLS, DENSE, TWO, EVAL)
def complementarity(a):
    return evalkit.complementarity(*_eval(a), "value", "size", 5)


@query("SELECT CAST(qid AS BIGINT) AS qid, round(max(CASE WHEN mode = 'value' THEN mrr END) - max(CASE WHEN mode = 'size' THEN mrr END), 6) AS gain FROM res GROUP BY 1", CELLS, DENSE, TWO, EVAL)
def additive_gain(a):
    return rounded(evalkit.additive_gain(_results(a), "value", ["size"], "mrr"))


@query("SELECT mode AS category, round(mrr, 6) AS mrr, mrr >= 0.5 AS passed, round(mrr - 0.4, 6) AS delta FROM (SELECT mode, avg(m) AS mrr FROM (SELECT mode, category, avg(mrr) AS m FROM res GROUP BY 1, 2) GROUP BY 1)", CELLS, DENSE, TWO, EVAL)
def against_baseline(a):
    base = a.spark.createDataFrame([("value", 0.4), ("size", 0.4)], "category string, baseline double")
    return rounded(evalkit.against_baseline(evalkit.macro_mean(_results(a), "mrr").withColumnRenamed("mode", "category"), base, "mrr"))


TOPG = "tg AS (SELECT DISTINCT qid, gene_u FROM (SELECT cluster_id, gene_u, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(round(logfc, 9)) DESC, gene) AS r FROM stats) JOIN (SELECT CAST(1 AS BIGINT) AS qid, cluster_id, rank FROM byval) USING (cluster_id) WHERE rank <= 3 AND r <= 10), eg AS (SELECT CAST(1 AS BIGINT) AS qid, upper(p_name) AS gene_u FROM part GROUP BY 2)"


@query("SELECT qid, round(avg(CASE WHEN (qid, gene_u) IN (SELECT (qid, gene_u) FROM tg) THEN 1.0 ELSE 0 END), 6) AS gene_recall FROM eg GROUP BY 1", CELLS, DENSE, STATS, TWO, TOPG)
def gene_recall(a):
    """Of ten genes a cluster; gene_recall_default has the operator's own number."""
    found = evalkit.genes_of_clusters(_two(a)[0], a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 3, 10)
    expected = a.table("part").select(F.lit(1).cast("long").alias("qid"), F.upper("p_name").alias("gene_u"))
    return rounded(evalkit.gene_recall(expected, found))


@query("SELECT count(*) AS n_expected, CAST(sum(h) AS BIGINT) AS n_found, CAST(sum(1 - h) AS BIGINT) AS n_missed, round(avg(h), 6) AS recall FROM (SELECT gene_u, CASE WHEN gene_u IN (SELECT gene_u FROM tg) THEN 1 ELSE 0 END AS h FROM eg)", CELLS, DENSE, STATS, TWO, TOPG)
def compare_recall(a):
    """Of ten genes a cluster; compare_recall_default has the operator's own number."""
    found = evalkit.genes_of_clusters(_two(a)[0], a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 3, 10)
    return rounded(evalkit.overlap_recall(a.table("part").select(F.upper("p_name").alias("gene_u")), found, "gene_u"))


@query("SELECT gene_u, count(DISTINCT part) AS n_parts FROM (SELECT gene_u, 'a' AS part FROM tg UNION ALL SELECT gene_u, 'b' FROM eg) GROUP BY 1", CELLS, DENSE, STATS, TWO, TOPG)
def session_evidence(a):
    """Of ten genes a cluster; session_evidence_default has the operator's own number."""
    found = evalkit.genes_of_clusters(_two(a)[0], a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 3, 10)
    return evalkit.evidence(a=found, b=a.table("part").select(F.upper("p_name").alias("gene_u")))


# The same with the operators' own numbers of genes

TOPG_DEFAULT = TOPG.replace("r <= 10)", "r <= 500)")


@query("SELECT qid, round(avg(CASE WHEN (qid, gene_u) IN (SELECT (qid, gene_u) FROM tg) THEN 1.0 ELSE 0 END), 6) AS gene_recall FROM eg GROUP BY 1", CELLS, DENSE, STATS, TWO, TOPG_DEFAULT)
def gene_recall_default(a):
    found = evalkit.genes_of_clusters(_two(a)[0], a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 3)
    expected = a.table("part").select(F.lit(1).cast("long").alias("qid"), F.upper("p_name").alias("gene_u"))
    return rounded(evalkit.gene_recall(expected, found))


@query("SELECT count(*) AS n_expected, CAST(sum(h) AS BIGINT) AS n_found, CAST(sum(1 - h) AS BIGINT) AS n_missed, round(avg(h), 6) AS recall FROM (SELECT gene_u, CASE WHEN gene_u IN (SELECT gene_u FROM tg) THEN 1 ELSE 0 END AS h FROM eg)", CELLS, DENSE, STATS, TWO, TOPG_DEFAULT)
def compare_recall_default(a):
    found = evalkit.genes_of_clusters(_two(a)[0], a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 3)
    return rounded(evalkit.overlap_recall(a.table("part").select(F.upper("p_name").alias("gene_u")), found, "gene_u"))


@query("SELECT gene_u, count(DISTINCT part) AS n_parts FROM (SELECT gene_u, 'a' AS part FROM tg UNION ALL SELECT gene_u, 'b' FROM eg) GROUP BY 1", CELLS, DENSE, STATS, TWO, TOPG_DEFAULT)
def session_evidence_default(a):
    found = evalkit.genes_of_clusters(_two(a)[0], a.dense_stats.withColumn("logfc", F.round("logfc", 9)), 3)
    return evalkit.evidence(a=found, b=a.table("part").select(F.upper("p_name").alias("gene_u")))


LIKE = "EXISTS (SELECT 1 FROM clusters d WHERE {0} AND (contains(lower(d.cluster_id), lower(c.cluster_id)) OR contains(lower(c.cluster_id), lower(d.cluster_id))))"


@query(
    f""", fc AS (SELECT cluster_id, CASE WHEN fb <= 0.001 AND fa > 0.001 THEN 999 WHEN fb > 0.001 THEN fa / fb ELSE 1 END AS fc FROM (SELECT cluster_id, sum(CASE WHEN condition = 'neg' THEN round(f, 4) ELSE 0 END) AS fa, sum(CASE WHEN condition = 'pos' THEN round(f, 4) ELSE 0 END) AS fb FROM share GROUP BY 1)),
flagged AS (SELECT fc, {LIKE.format('d.region <= 1')} AS up, {LIKE.format('d.region = 2')} AS down FROM fc c)
SELECT count(*) AS n_checked, round(coalesce(avg(CASE WHEN (up AND fc > 1) OR (down AND fc < 1) THEN 1.0 ELSE 0 END), 0), 6) AS rate FROM flagged WHERE up OR down""",
    CELLS,
    META,
    COND,
)
def consistency_rate(a):
    named = lambda cond: a.clusters.filter(cond).select(F.col("cluster_id").alias("name"))
    return rounded(evalkit.direction_consistency(meta.fold_changes(meta.condition_composition(a.meta, "balance")), named("region <= 1"), named("region = 2")))


@query("SELECT pathway, round(score, 6) AS score FROM (SELECT DISTINCT p_type AS pathway FROM part) LEFT JOIN (SELECT set_name, max(round(score, 9)) AS score FROM scored GROUP BY 1) ON set_name = pathway", CELLS, SPARSE, STATS, SETS, SET_SCORES)
def pathway_alignment(a):
    best = genesets.best_cluster_of_set(_set_scores(a))
    return rounded(evalkit.pathway_alignment(a.table("part").select(F.col("p_type").alias("pathway")), best))


@query("SELECT cluster_id, round(0.3 * 100 * frac + 0.2 * 50 + 0.15 * 40 + 0.25 * 60 + 10, 6) AS score FROM meta WHERE col = 'balance' AND value = 'pos'", CELLS, META)
def composite_score(a):
    score = evalkit.composite(100 * F.col("frac"), F.lit(50.0), F.lit(40.0), F.lit(60.0), F.lit(True))
    return rounded(a.meta.filter("col = 'balance' AND value = 'pos'").select("cluster_id", score.alias("score")))


P = """dbl AS (SELECT k, sum(ln(2 * k + 1)) OVER (ORDER BY k) AS l FROM range(0, 400) t(k)),
zp AS (SELECT zs.cluster_id, zs.gene, any_value(zs.z) AS z, greatest(1 - sqrt(2 / pi()) * sum(exp((2 * k + 1) * ln(greatest(abs(zs.z), 1e-300)) - l - zs.z * zs.z / 2)), 0) AS p FROM zs CROSS JOIN dbl GROUP BY 1, 2),
pr AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY p, gene) AS rk FROM zp),
pa AS (SELECT *, least(1.0, min(p * n / rk) OVER (PARTITION BY cluster_id ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj, row_number() OVER (PARTITION BY cluster_id ORDER BY z DESC, gene) AS place FROM pr)"""


@query("SELECT cluster_id, gene, round(z, 6) AS z, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM pa WHERE place <= 50 AND p_adj < 0.9", CELLS, DENSE, RANKS, P)
def markers_with_p(a):
    """Chances from a series of the normal integral in SQL, from a fit of its logarithm here."""
    return rounded(stats.markers(a.dense.withColumn("value", F.round("value", 9)), a.cells, 50, 0.9).select("cluster_id", "gene", "z", "p", "p_adj"))


OVER = """uni AS (SELECT DISTINCT gene_u FROM stats), lf AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS l UNION ALL SELECT i, sum(ln(i)) OVER (ORDER BY i) FROM (SELECT row_number() OVER () AS i FROM uni)), tot AS (SELECT count(*) AS total FROM uni),
member AS (SELECT DISTINCT set_name, upper(gene) AS gene_u FROM sets WHERE upper(gene) IN (SELECT gene_u FROM uni)), size AS (SELECT set_name, count(*) AS size FROM member GROUP BY 1),
drawn AS (SELECT cluster_id, gene_u FROM (SELECT cluster_id, gene_u, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(round(logfc, 9)) DESC, gene) AS r FROM stats) WHERE r <= 200), dn AS (SELECT cluster_id, count(*) AS drawn FROM drawn GROUP BY 1),
hits AS (SELECT cluster_id, set_name, count(*) AS hits FROM drawn JOIN member USING (gene_u) GROUP BY 1, 2),
terms AS (SELECT cluster_id, set_name, hits, drawn, size, total, unnest(range(hits, least(drawn, size) + 1)) AS k FROM hits JOIN size USING (set_name) JOIN dn USING (cluster_id) CROSS JOIN tot),
tails AS (SELECT cluster_id, set_name, any_value(hits) AS hits, least(1.0, sum(exp(a.l - b.l - c.l + d.l - e.l - f.l - g.l + h.l + j.l))) AS p FROM terms JOIN lf a ON a.i = size JOIN lf b ON b.i = k JOIN lf c ON c.i = size - k JOIN lf d ON d.i = total - size JOIN lf e ON e.i = drawn - k JOIN lf f ON f.i = total - size - drawn + k JOIN lf g ON g.i = total JOIN lf h ON h.i = drawn JOIN lf j ON j.i = total - drawn GROUP BY 1, 2),
ranked AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY p, set_name) AS rk FROM tails),
adj AS (SELECT *, least(1.0, min(p * n / rk) OVER (PARTITION BY cluster_id ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM ranked)"""


@query("SELECT * FROM (SELECT cluster_id, set_name, hits, round(p, 6) AS p, round(p_adj, 6) AS p_adj, row_number() OVER (PARTITION BY cluster_id ORDER BY round(p_adj, 12), round(p, 12), set_name) AS rank FROM adj) WHERE rank <= 15", CELLS, SPARSE, STATS, SETS, OVER)
def over_representation(a):
    st = Stages(a.spark)
    own = st.table(a.sparse_stats.select("cluster_id", "gene", F.round("logfc", 9).alias("logfc")), "stats")  # markers and universe read it
    ranked = st.table(rank.top_genes(own, 200).select("cluster_id", F.upper("gene").alias("gene_u"), "rank"), "markers")
    return rounded(genesets.over_representation(ranked, a.sets, own.select(F.upper("gene").alias("gene_u"))))
