"""Quality rules of documents and of their hosts.

A document's own rules give failures. A host's rate of failures, shrunk by a beta prior that is fitted over all hosts,
gives the host's verdict: whether it is kept at all, and how much may speak against one of its documents. Joined back to
the documents, it decides: all of a rejected host go, and of the others those whose own failures outweigh the rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import appended, documents, fresh, slices, texts, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: How much likelier each failure is in a bad document than in a good one; the last: that there is no failure. On
#: labelled rows that pass the base rules symbols fail in 1.0 of the bad and in none of the good, lines in 0.0067 and
#: 0.0025 (check_s), and bad ones without a failure did not occur; words of odd length did not occur at all.
ODDS = {"base": 1e9, "symbols": 50.0, "dup_lines": 3.0, "word_length": 6.0, "none": 0.02}
_WORDS = 1 << 16


class _Codes(dict):
    """64-bit numbers of words; emptied when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    n = len(codes) - 2
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        w = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1]
        w = (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[2:]
    order = np.argsort(w, kind="stable")
    same = np.zeros(n + 1, bool)
    same[1:-1] = w[order][1:] == w[order][:-1]
    again = np.zeros(n + 2, bool)
    hit = order[same[1:] | same[:-1]]
    for k in range(3):
        again[hit + k] = True
    return int(again.sum())


def counts(text: str, codes: dict) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = sum(map(text.count, SYMBOLS))
    chars = len(text) - sum(map(text.count, SPACES))
    keys = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(keys), len(lines)


def with_counts(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df and COUNTS (long) of each whole text; null texts have none of anything. Columns of these names give way."""
    kept = [f for f in df.schema.fields if f.name not in COUNTS and (keep_text or f.name != text)]
    out = StructType([*kept, *(StructField(c, LongType()) for c in COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in slices(batches, column=text):
            rows = [counts(x, codes) for x in texts(batch, text)]
            yield appended(batch, {c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(COUNTS)}, () if keep_text else (text,))

    return df.mapInArrow(count, out)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Each rule's failure, from COUNTS."""
    return {
        "base": base_failed(),
        "symbols": 20 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
    }


def host_rates(counted: DataFrame, host: str = "source", least: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, rate and host_kept: rate is the host's share of failing documents, shrunk to the mean of all hosts.

    The prior is a beta distribution whose mean and strength follow from the hosts' own rates by moments; it has at
    least the weight of `least` documents. Documents without a host are one host. One row for each host, so a host
    with a third of all documents is summed where its rows are read.
    """
    any_failed = F.lit(False)
    for x in rules().values():
        any_failed = any_failed | x
    hosts = written(counted.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.when(any_failed, 1).otherwise(0)).alias("n_failed")), "hosts")
    own = F.col("n_failed") / F.col("n_docs")
    n, failed, plain, square, inverse = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.avg(own), F.avg(F.pow(own, 2)), F.avg(1 / F.col("n_docs"))).first()
    mean, strength = 0.5, least
    if n:
        mean = (failed + 0.5) / (n + 1)
        spread = square - plain**2 - plain * (1 - plain) * inverse  # of the true rates: without what chance adds
        strength = min(max(mean * (1 - mean) / spread - 1, least), 1e6) if spread > 0 else 1e6
    rated = hosts.withColumn("rate", (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength)))
    return rated.withColumn("host_kept", F.lit(ODDS["none"]) * F.col("rate") < 1 - F.col("rate"))


def verdict(counted: DataFrame, rates: DataFrame, host: str = "source") -> DataFrame:
    """counted, and base_failed, host_rate, host_kept and kept; columns of these names give way, others stay.

    kept: false if the base rules fail or the host is rejected; of a document without a failure, else true; of others,
    whether the odds of the host's rate, times ODDS of each failure, stay below one (at odds of one it goes). `rates` is
    a written table, so Spark knows its size before it decides to broadcast it.
    """
    names = ("base_failed", "host_rate", "host_kept", "kept")
    odds = F.lit(1.0)
    clean = F.lit(True)
    for name, failed in rules().items():
        odds = odds * F.when(failed, F.lit(ODDS[name])).otherwise(F.lit(1.0))
        clean = clean & ~failed
    rows = counted.drop(*names)
    h, r, k = (fresh(rows, c) for c in ("h", "r", "k"))
    both = rows.join(rates.select("host", "rate", "host_kept").toDF(h, r, k), F.col(host).eqNullSafe(F.col(h)), "left")
    rate, stays = F.coalesce(F.col(r), F.lit(0.5)), F.coalesce(F.col(k), F.lit(True))
    kept = ~base_failed() & stays & (clean | (odds * rate < 1 - rate))
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], *[x.alias(n) for n, x in zip(names, (base_failed(), rate, stays, kept), strict=True)])


def quality(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """df with COUNTS, base_failed, host_rate, host_kept and kept; columns of these names give way, others stay.

    Null, empty and blank texts fail the base rules; texts of any length are counted whole; rows that repeat count as
    often in their host and get the same verdict; a null host is a host like any other; an empty table gives an empty
    one. The texts are read twice, once for the hosts and once for the verdicts; nothing but narrow counts is shuffled.
    """
    rates = host_rates(with_counts(df.select(text, host), text, keep_text=False), host)
    return verdict(with_counts(df, text), rates, host)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every whole text of documents, a row for a row.

    Nulls, empty and long texts, ties, repeated rows and empty tables as quality states; other columns than doc_id,
    text and source are not read. host_rate is rounded to six digits.
    """
    counted = written(with_counts(documents(spark, sf_dir).select("doc_id", "text", "source"), keep_text=False), "counts")
    return verdict(counted, host_rates(counted)).select("doc_id", *COUNTS[:5], "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"), "host_kept")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept. Columns that clash with those of quality are set aside meanwhile, so none is lost."""
    names = {c: fresh(docs, f"own_{i}") for i, c in enumerate(docs.columns)}
    aside = docs.withColumnsRenamed({c: n for c, n in names.items() if c not in ("text", "source")})
    return quality(aside).filter("kept").select(*[F.col(c if c in ("text", "source") else n).alias(c) for c, n in names.items()])
