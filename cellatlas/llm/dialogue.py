"""Conversation structure repair: an error-correcting Earley parse of the roles, with weighted edits.

The grammar is left-linear (a nonterminal only at the left of a production), so every chart item begins at the first
row, a chart set holds a bounded number of items, and a conversation is parsed while its rows stream by. An item keeps
the least (cost, audit) that reaches it, and the digest of what the edits have made so far; rows are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
ROLES = {"u": "user", "a": "assistant"}  # those that rows can be given and that can be inserted, by initial
#: (s?(ua)+)? as productions: capitals are nonterminals, S is where it starts.
GRAMMAR = (("S", ""), ("S", "T"), ("T", "Pua"), ("T", "Tua"), ("P", ""), ("P", "s"))
ADJACENT = ("su", "ua", "au")


class Costs(NamedTuple):
    delete: int = 4
    rerole: int = 3
    insert: int = 3
    truncated: int = 3  # of a row that is cut off and not deleted


class Audit:
    """The letters of edits as a list that shares its beginning with others."""

    __slots__ = ("before", "length", "letter")

    def __init__(self, before: Audit | None, letter: str):
        self.before, self.letter, self.length = before, letter, before.length + 1 if before else 1


def letters(audit: Audit | None) -> str:
    own = []
    while audit:
        own.append(audit.letter)
        audit = audit.before
    return "".join(reversed(own))


def less(x: Audit | None, y: Audit | None) -> bool:
    """Whether x comes before y as text; only what lies behind their common beginning is read."""
    n, m = x.length if x else 0, y.length if y else 0
    shorter = n < m
    while n > m:
        x, n = x.before, n - 1
    while m > n:
        y, m = y.before, m - 1
    first = 0
    while x is not y:
        if x.letter != y.letter:
            first = -1 if x.letter < y.letter else 1
        x, y = x.before, y.before
    return first < 0 or first == 0 and shorter


class Reached(NamedTuple):
    """How an item is reached at the least cost."""

    cost: int
    audit: Audit | None
    digest: object  # of the repaired rows so far
    some: bool  # whether there is a repaired row


class Parser:
    """Reads a conversation row by row; `chart` is the present set of items (production, dot)."""

    def __init__(self, grammar: Sequence[tuple[str, str]] = GRAMMAR, roles: Mapping[str, str] = ROLES, costs: Costs = Costs(), start: str = "S"):
        if any(c.isupper() for _, right in grammar for c in right[1:]):
            raise ValueError("the grammar must be left-linear")
        self.grammar, self.roles, self.costs, self.start = grammar, roles, costs, start
        self.parents: dict[str, list[int]] = {}
        for p, (_, right) in enumerate(grammar):
            if right[:1].isupper():
                self.parents.setdefault(right[0], []).append(p)
        self.reset()

    def reset(self) -> None:
        nothing = Reached(0, None, hashlib.sha256(), False)
        self.chart: dict[tuple[int, int], Reached] = {(p, 0): nothing for p, (_, right) in enumerate(self.grammar) if not right[:1].isupper()}
        self._close()

    def _put(self, chart: dict, item: tuple[int, int], was: Reached, cost: int, letter: str = "", said: tuple[str, str] | None = None) -> bool:
        """Keeps the way to `item` from `was` if it is better than the one it has."""
        cost += was.cost
        old = chart.get(item)
        if old is not None and old.cost < cost:
            return False
        audit = Audit(was.audit, letter) if letter else was.audit
        if old is not None and old.cost == cost and not less(audit, old.audit):
            return False
        digest, some = was.digest, was.some
        if said is not None:
            digest = digest.copy()
            digest.update(("\n" * some + said[0] + ":" + said[1]).encode())
            some = True
        chart[item] = Reached(cost, audit, digest, some)
        return True

    def _close(self) -> None:
        """Inserts and completions inside a set, until nothing gets better. An insert costs, so this ends."""
        todo = list(self.chart)
        while todo:
            p, dot = item = todo.pop()
            left, right = self.grammar[p]
            was = self.chart[item]
            if dot == len(right):
                todo += [(q, 1) for q in self.parents.get(left, ()) if self._put(self.chart, (q, 1), was, 0)]
            elif right[dot] in self.roles and self._put(self.chart, (p, dot + 1), was, self.costs.insert, "I", (self.roles[right[dot]], "")):
                todo.append((p, dot + 1))

    def row(self, role: str, text: str, lost: bool, truncated: bool) -> None:
        """The next row; one that is `lost` can only be deleted."""
        new: dict[tuple[int, int], Reached] = {}
        more = self.costs.truncated * truncated
        for (p, dot), was in self.chart.items():
            right = self.grammar[p][1]
            self._put(new, (p, dot), was, self.costs.delete, "D")
            if lost or dot == len(right):
                continue
            if role[:1] == right[dot]:
                self._put(new, (p, dot + 1), was, more, "K", (role, text))
            if right[dot] in self.roles:
                self._put(new, (p, dot + 1), was, self.costs.rerole + more, "R", (self.roles[right[dot]], text))
        self.chart = new
        self._close()

    def result(self) -> Reached:
        """The best of the completed chart. Every conversation has one: all its rows can be deleted."""
        best: dict[int, Reached] = {}
        for (p, dot), was in self.chart.items():
            if self.grammar[p][0] == self.start and dot == len(self.grammar[p][1]):
                self._put(best, 0, was, 0)
        return best[0]


class Conversation:
    """Counts the faults of one conversation's rows, in their order, and parses them."""

    def __init__(self, parser: Parser):
        self.parser = parser
        parser.reset()
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and (self.last is None or turn != self.last):
            self.first = turn if self.first is None else self.first
            self.turns, self.last = self.turns + 1, turn
        if self.before is not None and self.before + role[:1] not in ADJACENT:
            self.illegal += 1
        self.before = role[:1]
        own = text.rstrip(BLANKS)
        name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        lost = truncated = False
        if not own:
            self.blank, lost = self.blank + 1, True
        elif name in self.seen:
            self.duplicate, lost = self.duplicate + 1, True
        elif own[-1] not in ENDS:
            self.truncated, truncated = self.truncated + 1, True
        self.seen.add(name)
        self.parser.row(role, text, lost, truncated)

    def summary(self) -> tuple:
        end = self.parser.result()
        gaps = 0 if self.last is None else min(self.last - self.first + 1 - self.turns, 2**63 - 1)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, end.cost, letters(end.audit), end.digest.hexdigest()


SUMMARY = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def _streamed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (conv, turn, role, text, gone), those of a conversation together and in order, to a row for each of them."""
    parser, own, name, out = Parser(), None, None, []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, *rest = zip(*rows, strict=True)
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(ids, kind)] + [pa.array(x, k) for x, k in zip(rest, kinds, strict=True)], names=["conv", *SUMMARY])

    for b in batches:
        for conv, turn, role, text, gone in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if own is None or conv != name:
                if own is not None:
                    out.append((name, *own.summary()))
                own, name = Conversation(parser), conv
            if not gone:
                own.row(turn, role, text)
            if len(out) >= 1000:
                yield batch(out)
                out = []
    if own is not None:
        out.append((name, *own.summary()))
    if out:
        yield batch(out)


def repairs(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """conv and, for each conversation, SUMMARY: its faults, the cost and letters of the cheapest edits, and the digest
    of the repaired rows (`role:text`, newline-joined).

    The order of rows is by turn (nulls first), then role, then text. A null role or text is one space; null
    conversations are one conversation; rows where `gone` is true don't take part, but their conversation is reported.
    Blank rows and those whose role and text came before can only be deleted. Of edits of equal cost those whose
    letters are ASCII-least count. Repeated rows are duplicates; rows that tie in all of these are equal. A text is
    read whole; an empty table gives no row. One conversation's rows stream through one task, which keeps for each row
    a digest of 16 bytes and the letters of the few paths that are still open.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias("gone"))
    ordered = own.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    kind = dict(own.dtypes)["conv"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    found = ordered.mapInArrow(lambda x: _streamed(x, arrow), f"conv {kind}, {', '.join(f'{c} long' for c in SUMMARY[:6])}, audit string, repaired_sha256 string")
    return found.withColumnRenamed("conv", conv)


def repaired_rows(rows: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations, as rows: conv, place (from 1), edit (K, R or I), role, text.

    `rows` are those that `repairs` was given (without the gone ones), `found` is what it gave. Letters are laid out as
    rows and meet the conversation's rows by number, so a long conversation is never one value.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    order = Window.partitionBy(conv).orderBy(F.asc_nulls_first(turn), blank(role), blank(text))
    own = rows.select(F.col(conv).alias("_c"), blank(role).alias("_role"), blank(text).alias("_text"), F.row_number().over(order).alias("_r"))
    before = Window.partitionBy(conv).orderBy("_at")
    count = lambda x: F.sum(F.when(F.col("edit") != x, 1).otherwise(0)).over(before)
    edits = found.select(conv, F.posexplode(F.split("audit", "")).alias("_at", "edit")).filter("edit <> ''")
    edits = edits.select(conv, "edit", count("I").alias("_n"), count("D").cast("int").alias("place")).filter("edit <> 'D'")
    both = edits.join(own, F.col(conv).eqNullSafe(F.col("_c")) & (F.col("_n") == F.col("_r")) & (F.col("edit") != "I"), "left")
    system = F.max(F.when((F.col("place") == 1) & (F.col("edit") == "K") & F.col("_role").startswith("s"), 1).otherwise(0)).over(Window.partitionBy(conv))
    whose = F.when(F.col("edit") == "K", F.col("_role")).when((F.col("place") - system) % 2 == 1, ROLES["u"]).otherwise(ROLES["a"])
    return both.select(conv, "place", "edit", whose.alias(role), F.coalesce("_text", F.lit("")).alias(text))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, str]:
    """Rows with faults that crc32 of `conv:turn` (a null is one space) decides, and the name of the column that says
    which rows are dropped: 0 of 20 drops, 1 empties, 2 removes full stops, 3 repeats, 4 makes it the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate, gone = fresh(rows, "fate"), fresh(rows, "gone")
    own = rows.withColumn(fate, F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20)
    f = F.col(fate)
    own = own.withColumn(text, F.when(f == 1, "").when(f == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text)))
    own = own.withColumn(role, F.when(f == 4, "user").otherwise(said(role))).withColumn(gone, f == 0)
    twice = fresh(own, "twice")
    return own.withColumn(twice, F.explode(F.array_repeat(F.lit(1), F.when(f == 3, 2).otherwise(1)))).drop(twice, fate), gone


def op13_dialogue(spark, sf_dir: str) -> DataFrame:
    """All `conversations`, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Null ids are one conversation. Nulls, ties, repeated rows, long texts and empty tables as `repairs` and `damaged`
    state; of other columns none is read. A conversation of which all rows are dropped has zeros, no letters and the
    digest of the empty text.
    """
    rows, gone = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return repairs(rows, gone=F.col(gone))
