"""Secrets: three patterns, and strings whose sliding-window entropy is high for their class of characters.

DataFrame functions only: all of it is one projection, without Python and without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter run can't hold a longer one, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: The least entropy, in bits a character, of a window by the string's class of characters.
HIGH = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.7), ("^.*$", 3.9))
#: What looks random and is none: ids in the common form, runs of the alphabet, samples.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|abcdefgh|0123456789|example"
#: Paths: lower-case names and numbers between single slashes. One class over the whole string, so it needs no stack.
PATH = "^[a-z0-9_/-]+$"
_NONE = "CAST(array() AS array<struct<start:bigint,rank:int,kind:string,end:bigint,string:string>>)"
_FIRST, _CELLS = ord("+"), 12  # the least character of a candidate; counts of five bits in a long
_WORDS = (ord("z") - _FIRST) // _CELLS + 1


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once however often `use` names it: a one-element array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of an array of numbers from 0 on: step k joins each with the one 2^k before it.

    The work is n log n, as each step writes the array anew; a list that grew by one at each step would take n^2.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    before = lambda acc, i, k: F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0).cast("long"))
    return F.aggregate(steps, values, lambda acc, k: F.transform(acc, lambda v, i: join(v, before(acc, i, k))))


def matches(text: Column, pattern: str, kind: str, rank: int, group: int = 0) -> Column:
    """All matches, leftmost first and non-overlapping: start, rank, kind, end and the group's string.

    Offsets are in code points: each is the sum of the lengths of what lies between the matches before and of these.
    """
    regex = F.lit(pattern)
    found = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"), F.regexp_extract_all(text, regex, F.lit(group)).alias("own"))

    def spans(m: Column) -> Column:
        sizes = F.transform(m["whole"], lambda w, i: (F.length(w) + F.length(F.get(m["gap"], i))).cast("long"))
        span = lambda e, i: F.struct((e - F.length(F.get(m["whole"], i))).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), F.get(m["own"], i).alias("string"))
        return once(sizes, lambda s: F.transform(running(s, lambda a, b: a + b), span))

    return F.when(text.rlike(pattern), once(found, spans)).otherwise(F.expr(_NONE))


def untouched(spans: Column, others: Column) -> Column:
    """The spans that touch none of the others, in n log n: by their ends among the others' starts.

    A span is touched if, of the others that begin before its end, the furthest end lies behind its start.
    """
    none = F.expr("CAST(NULL AS struct<start:bigint,rank:int,kind:string,end:bigint,string:string>)")
    events = F.concat(F.transform(others, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("behind"), b["end"].alias("end"), none.alias("span"))), F.transform(spans, lambda m: F.struct(m["end"].alias("at"), F.lit(0).alias("behind"), F.lit(0).cast("long").alias("end"), m.alias("span"))))

    def free(e: Column) -> Column:
        reach = running(F.transform(e, lambda x: x["end"]), F.greatest)
        return once(reach, lambda r: F.filter(F.transform(e, lambda x, i: F.when(F.get(r, i) <= x["span"]["start"], x["span"])), lambda x: x.isNotNull()))

    return F.when((F.size(others) == 0) | (F.size(spans) == 0), spans).otherwise(once(F.sort_array(events), free))


def window_entropy(string: Column) -> Column:
    """The highest entropy, in bits a character, of WINDOW characters in a row; 0 for a shorter string.

    Counts follow the window: one character leaves, one comes, and the sum of c log2 c changes by their terms alone.
    The counts lie in a few longs, five bits each. `string` has characters of CANDIDATE only.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    raw = F.encode(string, "UTF-8")
    cells = once(raw, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.ascii(F.substr(r, i, F.lit(1)).cast("string")) - _FIRST))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), _WORDS).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    place = lambda cell: F.pmod(cell, F.lit(_CELLS)) * 5
    word = lambda cell: F.floor(cell / _CELLS).cast("int")
    one = lambda cell: F.call_function("shiftleft", F.lit(1).cast("long"), place(cell))
    count = lambda n, cell: F.call_function("shiftright", F.get(n, word(cell)), place(cell)).bitwiseAND(F.lit(31)).cast("int")
    moved = lambda n, cell, by: F.transform(n, lambda x, j: F.when(j == word(cell), x + by * one(cell)).otherwise(x))

    def slide(k: Column):
        def step(acc: Column, come: Column, i: Column) -> Column:
            gone = F.get(k, i - WINDOW)
            left = F.when(i < WINDOW, F.struct(acc["n"].alias("n"), acc["s"].alias("s"))).otherwise(
                once(count(acc["n"], gone), lambda was: F.struct(moved(acc["n"], gone, -1).alias("n"), (acc["s"] - F.get(term, was) + F.get(term, was - 1)).alias("s")))
            )

            def added(x: Column) -> Column:
                s = once(count(x["n"], come), lambda had: x["s"] - F.get(term, had) + F.get(term, had + 1))
                best = lambda s: F.greatest(acc["best"], F.when(i >= WINDOW - 1, F.lit(math.log2(WINDOW)) - s / WINDOW).otherwise(F.lit(0.0)))
                return once(s, lambda s: F.struct(moved(x["n"], come, 1).alias("n"), s.alias("s"), best(s).alias("best")))

            return once(left, added)

        return lambda acc, i: step(acc, F.get(k, i), i)

    return once(cells, lambda k: F.aggregate(F.sequence(F.lit(0), F.size(k) - 1), start, slide(k), lambda acc: acc["best"]))


def path_like(string: Column) -> Column:
    return string.contains("/") & ~string.contains("//") & string.rlike(PATH)


def high(string: Column) -> Column:
    """Whether the string has a letter and a digit, isn't allowed, and has a window of high entropy for its class."""
    candidate = string.rlike("[0-9]") & string.rlike("[A-Za-z]") & ~string.rlike(ALLOWED) & ~path_like(string)
    return F.when(candidate, once(window_entropy(string), lambda h: F.coalesce(*[F.when(string.rlike(p), h >= least) for p, least in HIGH]))).otherwise(F.lit(False))


def with_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with secrets: an array of start, rank, kind, end (code points, exclusive) and string, by start and then kind.

    Null and empty texts have no spans; a text of any length is read whole, in time n log n of its matches. The base
    kinds keep all that passes their least lengths; an entropy span gives way where it touches one of them, so no two
    spans tie in start and kind. Repeated rows get the same spans each, an empty table gives an empty one. Only a column
    named secrets gives way; there are no helper columns that could clash.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(matches(own, ASSIGN, "assign", 0, 2), lambda m: F.length(m["string"]) >= 6)
    found = F.struct(F.concat(assign, matches(own, ACCESS, "access", 1), matches(own, HEX, "hex", 2)).alias("base"), matches(own, CANDIDATE, "entropy", 3).alias("more"))
    return df.withColumn("secrets", once(found, lambda f: F.sort_array(F.concat(f["base"], F.filter(untouched(f["more"], f["base"]), lambda m: high(m["string"]))))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and places of the secrets of every whole text of documents, a row for a row.

    Null and empty texts count nothing and have the digest of the empty string; long texts are read whole; spans are
    ordered by start and kind, so there are no ties; repeated rows are repeated; an empty table gives an empty result;
    of other columns none is read.
    """
    found = with_secrets(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda m: m["kind"] != "entropy")
    counts = [F.size(F.expr(f"filter(secrets, m -> m.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
