"""Encoders: texts to vectors, and cells to token sequences for a model.

No trained encoder ships with this package. `TextEncoder` is the interface; `hashing_encoder` is a repeatable stand-in
that knows nothing of biology.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.text import percent_text
from ..functions.vectors import mixed, normalized

TextEncoder = Callable[[list[str]], list[list[float]]]


def hashing_encoder(dims: int = 256) -> TextEncoder:
    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dims
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return encode


def encoded(text: Column, load: Callable[[], TextEncoder]) -> Column:
    """A vector for each text; `load` runs once for each task, so a model is read once."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for batch in batches:
            yield pd.Series(encoder(batch.fillna("").tolist()))

    return encode(text)


def cluster_vectors(identity: Column, context: Column, alpha: float = 0.6) -> Column:
    """alpha of the identity text's vector and the rest of the context's, at length 1."""
    return normalized(mixed(identity, context, alpha))


def cell_tokens(expr: DataFrame, vocabulary: DataFrame, most: int = 3000, first: str = "<cls>") -> DataFrame:
    """cell_id, tokens: `first`, then the cell's genes of the vocabulary (gene, token) by value, the highest first."""
    known = expr.filter("value <> 0").join(vocabulary, "gene")
    r = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("value"), "gene"))
    kept = known.withColumn("r", r).filter(F.col("r") <= most - 1)
    own = kept.groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "token"))), lambda s: s["token"]).alias("t"))
    start = vocabulary.filter(F.col("gene") == first).select("token").agg(F.first("token")).scalar()
    return own.select("cell_id", F.concat(F.array(start), "t").alias("tokens"))


def model_vectors(tokens: DataFrame, load: Callable[[], Callable[[list[list[int]]], list[list[float]]]], batch: int = 64) -> DataFrame:
    """cell_id, vec of a model that takes batches of token lists, loaded once a task."""
    kind = dict(tokens.dtypes)["cell_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for df in batches:
            for i in range(0, len(df), batch):
                part = df.iloc[i : i + batch]
                yield pd.DataFrame({"cell_id": part["cell_id"], "vec": model([list(t) for t in part["tokens"]])})

    return tokens.mapInPandas(run, f"cell_id {kind}, vec array<double>")


def summaries(clusters: DataFrame, genes: DataFrame, terms: DataFrame | None = None, meta: DataFrame | None = None, top: int = 400) -> DataFrame:
    """cluster_id, identity_text, context_text.

    genes: cluster_id, gene, rank. terms: cluster_id, source, rank, term. meta: cluster_id, col, value, frac; values
    under five percent are left out.
    """
    listed = lambda df, value, order, name: df.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"]), ", ").alias(name))
    own = clusters.select("cluster_id").join(listed(genes.filter(F.col("rank") <= top), "gene", ["rank"], "_genes"), "cluster_id", "left")
    parts = [F.when(F.col("_genes").isNotNull(), F.concat(F.lit("Marker genes: "), "_genes"))]
    if terms is not None:
        own = own.join(listed(terms, "term", ["source", "rank"], "_terms"), "cluster_id", "left")
        parts.append(F.when(F.col("_terms").isNotNull(), F.concat(F.lit("Enriched terms: "), "_terms")))
    if meta is not None:
        text = F.concat_ws(" ", "col", percent_text(F.col("value"), F.col("frac")))
        own = own.join(listed(meta.filter("frac >= 0.05").withColumn("t", text), "t", ["col", "frac"], "_meta"), "cluster_id", "left")
        parts.append(F.when(F.col("_meta").isNotNull(), F.concat(F.lit("Composition: "), "_meta")))
    return own.select("cluster_id", F.concat("cluster_id", F.lit(" cell type")).alias("identity_text"), F.concat_ws(". ", F.concat(F.lit("Cluster "), "cluster_id"), *parts).alias("context_text"))
