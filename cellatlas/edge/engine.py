"""The engine as one object: rankings, analyses and lookups over a catalog's tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import evalkit, genesets, interact, meta, profile, rank
from ..operators.encode import TextEncoder
from ..operators.stats import guarded
from ..sources import catalog

@dataclass
class Engine:
    """Frames of an atlas; optional ones may be None. `encoder` makes query vectors of the clusters' kind."""

    clusters: DataFrame
    stats: DataFrame
    meta: DataFrame | None = None
    cells: DataFrame | None = None
    pairs: DataFrame | None = None
    sets: DataFrame | None = None
    synonyms: DataFrame | None = None
    terms: DataFrame | None = None
    encoder: TextEncoder | None = None
    scoring: str = "weighted"
    k: int = 60
    weights: tuple[float, float] = (1.0, 1.0)
    name_boost: float = 0.15
    synonym_boost: float = 0.10
    prefixes: Sequence[str] = fixed.GENE_PREFIXES
    ordinary: Sequence[str] = fixed.ORDINARY_WORDS
    log: list[dict] = field(default_factory=list)
    results: list[tuple[str, dict[str, DataFrame]]] = field(default_factory=list)

    @classmethod
    def load(cls, spark: SparkSession, root: str, optional: Sequence[str] = ("meta", "cells"), **more) -> Engine:
        own = {"meta": "cluster_meta", "cells": "cells", "synonyms": "synonyms", "terms": "terms", "pairs": "pairs", "sets": "sets"}
        frames = {k: catalog.read_table(spark, root, own[k]) for k in optional}
        return cls(catalog.read_table(spark, root, "clusters"), guarded(catalog.read_table(spark, root, "gene_stats")), **frames, **more)

    @property
    def spark(self) -> SparkSession:
        return self.clusters.sparkSession

    def _texts(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(1, text)], "qid bigint, text string")

    def parsed(self, text: str) -> tuple[str, list[str]]:
        """The query's mode and its genes."""
        row = T.parsed(self._texts(text), self.stats.select("gene_u"), self.prefixes, self.ordinary).first()
        return row["mode"], row["genes"]

    def by_genes(self, genes: Sequence[str], top: int = 10) -> DataFrame:
        queries = self.spark.createDataFrame([(1, g.upper()) for g in genes], "qid bigint, gene_u string")
        return rank.marker_scores(queries, self.stats, self.clusters, self.scoring, top)

    def by_meaning(self, text: str, top: int = 10, names: bool = True) -> DataFrame:
        if self.encoder is None:
            raise ValueError("a semantic query needs an encoder")
        queries = self.spark.createDataFrame([(1, text, self.encoder([text])[0])], "qid bigint, text string, vec array<double>")
        return rank.semantic_ranking(queries, self.clusters, top, self.name_boost, names)

    def by_annotation(self, text: str, top: int = 10) -> DataFrame:
        """by_meaning with genes; nothing, if the clusters have no vectors."""
        if "vec" not in self.clusters.columns or self.encoder is None:
            return rank.with_genes(self.by_genes([], top).limit(0), self.stats)
        return rank.with_genes(self.by_meaning(text, top), self.stats)

    def query(self, text: str, top: int = 10, mode: str | None = None, genes: int = 30) -> DataFrame:
        """The ranking by the query's mode, with the clusters' top genes. A gene query without genes is an ontology one."""
        found, names = self.parsed(text)
        mode = mode or found
        if mode == "gene_list" and not names:
            mode = "ontology"
        by_genes = self.by_genes(names or ["-"], 2 * top)
        if self.encoder is None:
            out = by_genes.filter(F.col("rank") <= top)
        else:
            usual = self.spark.createDataFrame([(t, c) for t, of in fixed.QUERY_SYNONYMS.items() for c in of], "term string, cluster_id string")
            out = rank.route(mode, by_genes, self.by_meaning(text, 2 * top), self.by_meaning(text, 2 * top, False), self._texts(text), usual if self.synonyms is None else self.synonyms, self.clusters, top, self.k, self.weights)
        self.log.append({"query": text, "mode": mode})
        return rank.with_genes(out, self.stats, genes)

    def hybrid(self, text: str, top: int = 10, share: float = 0.5) -> DataFrame:
        """share of meaning: up to 0.1 by genes, from 0.9 on by meaning, else both."""
        return self.query(text, top, "gene_list" if share <= 0.1 else "ontology" if share >= 0.9 else "mixed")

    def discover(self, text: str, top: int = 5) -> DataFrame:
        return rank.with_genes(self.by_meaning(text, top), self.stats)

    def interactions(self, source: str | None = None, target: str | None = None, **limits) -> DataFrame:
        found = interact.interactions(self.stats, self.pairs, interact.named_clusters(self.clusters, source), interact.named_clusters(self.clusters, target), **limits)
        return interact.in_order(found, self.clusters).orderBy("place").drop("place")

    def proportions(self, column: str | None = None) -> DataFrame:
        return meta.composition(self.cells) if column is None else meta.changes_in_order(meta.fold_changes(meta.condition_composition(self.meta, column))).orderBy("place").drop("place")

    def _condition_words(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(fixed.CONDITION_WORDS)), "kw_ord int, kw string")

    def conditions(self) -> DataFrame:
        return meta.detect_condition(self.meta, self._condition_words(), fixed.NO_CONDITION_WORDS)

    def capabilities(self) -> DataFrame:
        return meta.capabilities(self.clusters, self.meta, self._condition_words(), fixed.NO_CONDITION_WORDS)

    def compare(self, a: str, b: str, genes: Sequence[str] | None = None, otherwise: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The biased clusters' genes, and those enriched on each side; groups are found in any column, whatever their case.

        With `otherwise`, the name of a column, a group that no column holds is one of its (then without clusters).
        """
        at = meta.group_column(self.meta, a, b).first()
        if otherwise is None and (at is None or at["group_a"] is None or at["group_b"] is None):
            raise ValueError(f"no column has both {a} and {b}")
        column, sides = (at["col"] if at else otherwise), [(at and at["group_a"]) or a, (at and at["group_b"]) or b]
        biased = meta.biased_clusters(self.clusters, self.meta, column, *sides)
        asked = self.spark.createDataFrame([(g.upper(),) for g in genes], "gene_u string") if genes else None
        own = meta.compared_genes(biased, self.stats, asked)
        return own, meta.enriched_genes(own, sides)

    def pathways(self, name: str | None = None, metric: str = "pct_in") -> DataFrame:
        """Scores of all sets, or of the one that a name means: sets by their best cluster, and in each the best first."""
        sets = self.sets if name is None else self.sets.join(genesets.resolved_set(self.sets, name).select("set_name"), "set_name", "left_semi")
        scores = genesets.set_scores(self.stats, sets, self.clusters, metric)
        order = genesets.sets_in_order(scores).select("set_name", "place")
        return scores.join(order, "set_name").orderBy("place", F.desc("score"), "cluster_id").drop("place")

    def cell_cycle(self, metric: str = "pct_in") -> DataFrame:
        rows = [(n, g) for n, own in (("S", fixed.S_PHASE), ("G2M", fixed.G2M_PHASE)) for g in own]
        found = genesets.cell_cycle(self.stats, self.spark.createDataFrame(rows, "set_name string, gene string"), self.clusters, "S", "G2M", metric)
        return genesets.phases_in_order(found).orderBy("place").drop("place")

    def specificity(self, top: int = 20) -> DataFrame:
        return profile.top_specific(profile.marker_specificity(self.stats), top)

    def coexpression(self, a: str, b: str | None = None) -> DataFrame:
        return profile.coexpression_pair(self.stats, self.clusters, a, b) if b else profile.top_correlated(profile.coexpression(self.stats, self.clusters, a))

    def genes_like(self, prefix: str) -> DataFrame:
        return self.stats.filter(F.col("gene_u").startswith(prefix.upper())).select("gene").distinct().orderBy("gene")

    def metadata(self, cluster: str) -> DataFrame:
        return self.meta.filter(F.col("cluster_id") == cluster)

    def cells_of(self, cluster: str, shown: int = 20) -> DataFrame:
        return self.cells.filter(F.col("cluster_id") == cluster).select("cell_id").orderBy("cell_id").limit(shown)

    def info(self) -> DataFrame:
        return self.clusters.select("cluster_id").orderBy("cluster_id")

    def views(self, terms: int = 5, genes: int = 50) -> DataFrame:
        """What is known of each cluster: its terms by source, and its top genes."""
        own = rank.with_genes(self.clusters.select("cluster_id"), self.stats, genes)
        if self.terms is None:
            return own
        said = self.terms.filter(F.col("rank") <= terms).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("source", "rank", "term"))).alias("terms"))
        return own.join(said, "cluster_id", "left")

    def evaluate(self, expected: DataFrame, rankings: DataFrame, fuzzy: bool = False) -> DataFrame:
        return evalkit.recall_mrr(expected, rankings, fuzzy=fuzzy)
