"""Joins of names that are alike, by indexes of their words and characters instead of all pairs.

What an index finds are candidates; the column functions of functions.text decide. So rows are those of a join with
these functions as its condition, but only pairs that share a rare word, or a rare piece, ever meet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

GRAM = 3


def _grams(x: Column, n: int) -> Column:
    some = F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n)))
    return F.when(F.length(x) >= n, some).otherwise(F.array().cast("array<string>"))


def containing(long: DataFrame, short: DataFrame) -> DataFrame:
    """x, y: each x of `long` (one column) that contains a y of `short` (one column), both distinct and not empty.

    A y is looked up by the piece of three characters (all of it, if shorter) that fewest names have.
    """
    x = long.select(F.col(f"`{long.columns[0]}`").alias("x")).filter("x <> ''").distinct()
    y = short.select(F.col(f"`{short.columns[0]}`").alias("y")).filter("y <> ''").distinct()
    index = x.select("x", F.explode(F.array_distinct(F.concat(*[_grams(F.col("x"), n) for n in range(1, GRAM + 1)]))).alias("g"))
    counts = index.groupBy("g").agg(F.count("*").alias("n"))
    pieces = F.when(F.length("y") >= GRAM, _grams(F.col("y"), GRAM)).otherwise(F.array("y"))
    rarest = y.select("y", F.explode(F.array_distinct(pieces)).alias("g")).join(counts, "g", "left").groupBy("y").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    return rarest.join(index, "g").filter(F.col("x").contains(F.col("y"))).select("x", "y")


def sharing_words(left: DataFrame, right: DataFrame, words, kept) -> DataFrame:
    """x, y: pairs of names (one column each) that may share enough words: by prefixes of words, the rarest first.

    words: a column function for a name's words. kept: the number of a name's rarest words, as a function of how many
    it has, of which two names must have one in common to be alike.
    """
    sides = []
    for df in (left, right):
        name = F.col(f"`{df.columns[0]}`")
        sides.append(df.select(name.alias("x")).distinct().select("x", F.explode(words(F.col("x"))).alias("w")))
    counts = sides[0].unionByName(sides[1]).groupBy("w").agg(F.count("*").alias("n"))
    found = []
    for own, column in zip(sides, ("x", "y"), strict=True):
        at = Window.partitionBy("x")
        placed = own.join(counts, "w").withColumn("r", F.row_number().over(at.orderBy("n", "w"))).withColumn("m", F.count("*").over(at))
        found.append(placed.filter(F.col("r") <= kept(F.col("m"))).select(F.col("x").alias(column), "w"))
    return found[0].join(found[1], "w").select("x", "y").distinct()


def _joined(a: DataFrame, b: DataFrame, candidates: list[DataFrame], rule) -> DataFrame:
    """a, b that the rule holds for, from candidates (x, y) of what the names (a, x) and (b, y) were made to."""
    pairs = candidates[0]
    for other in candidates[1:]:
        pairs = pairs.unionByName(other)
    return a.join(pairs.distinct().join(b, "y"), "x").filter(rule(F.col("a"), F.col("b"))).select("a", "b").distinct()


def _keyed(df: DataFrame, key, name: str, column: str) -> DataFrame:
    own = F.col(f"`{df.columns[0]}`")
    return df.select(own.alias(name), key(own).alias(column)).filter(F.col(name).isNotNull()).distinct()


def _turned(df: DataFrame) -> DataFrame:
    return df.select(F.col("y").alias("x"), F.col("x").alias("y"))


def alike(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """a, b: names (one column each) that functions.text.alike holds for, each pair once."""
    key = lambda c: T.trimmed(F.lower(c))
    a, b = _keyed(left, key, "a", "x"), _keyed(right, key, "b", "y")
    x, y = a.select("x"), b.select("y")
    shared = sharing_words(x, y, T.words, lambda m: m - F.ceil(F.lit(least) * m) + 1)
    return _joined(a, b, [containing(x, y), _turned(containing(y, x)), shared], lambda p, q: T.alike(p, q, least))


def pathways_alike(left: DataFrame, right: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """a, b: names that functions.text.pathways_alike holds for. Two common words: one is among all but the last."""
    key = lambda c: F.translate(F.lower(c), "-/", "  ")
    a, b = _keyed(left, key, "a", "x"), _keyed(right, key, "b", "y")
    x, y = a.select("x"), b.select("y")
    found = [containing(x, y), _turned(containing(y, x)), sharing_words(x, y, T.words, lambda m: m - 1)]
    if aliases:  # few, a parameter: names that hold one meet names that hold one of its forms
        rows = [(k.lower(), f.lower()) for k, forms in aliases.items() for f in forms]
        table = left.sparkSession.createDataFrame(rows, "k string, f string")
        holds = containing(x, table.select("k")).withColumnRenamed("y", "k")
        forms = containing(y, table.select("f")).toDF("y", "f")
        found.append(holds.join(table, "k").join(forms, "f").select("x", "y"))
    return _joined(a, b, found, lambda p, q: T.pathways_alike(p, q, aliases))


def clusters_alike(left: DataFrame, right: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None, common: Sequence[str] = ("like", "cells", "cell", "type", "the", "and", "of")) -> DataFrame:
    """a, b: names that functions.text.clusters_alike holds for; one common word is enough, so all but `common` are looked up."""
    key = lambda c: T.trimmed(F.lower(c))
    a, b = _keyed(left, key, "a", "x"), _keyed(right, key, "b", "y")
    x, y = a.select("x"), b.select("y")
    split = lambda n: F.array_except(T.words(F.translate(n, "-+_", "   ")), F.array(*[F.lit(w) for w in common]))
    found = [containing(x, y), _turned(containing(y, x)), sharing_words(x, y, split, lambda m: m)]
    if aliases:
        table = left.sparkSession.createDataFrame([(k, f.lower()) for k, forms in aliases.items() for f in forms], "a string, f string")
        own = a.join(table, "a").select("x", "f")
        held = containing(y, table.select("f")).toDF("y", "f").unionByName(containing(table.select("f"), y).toDF("f", "y").select("y", "f"))
        found.append(own.join(held.distinct(), "f").select("x", "y"))
    return _joined(a, b, found, lambda p, q: T.clusters_alike(p, q, aliases, common))
