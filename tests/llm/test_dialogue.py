"""Conversation repair against a shortest path over plain strings, and against every sequence of edits on short ones."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cellatlas.llm import dialogue as D
from llm.conftest import SF

WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    """(role, text, lost, truncated) and the counts of a conversation's (turn, role, text) in order."""
    seen, out, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        plain = text.strip(WHITE)
        kind = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else None
        seen.add((role, text))
        if kind:
            n[kind] += 1
        out.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
    return out, n


STEPS = {"0": {"s": "1", "u": "2"}, "1": {"u": "2"}, "2": {"a": "3"}, "3": {"u": "2"}}  # 0 and 3 are ends


def cheapest(rows):
    """(cost, audit) by Dijkstra's method over (rows read, state of the role automaton), ties by the letters."""
    heap, done = [(0, "", 0, "0")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in "03":
            return cost, audit
        for x, to in STEPS[state].items():
            if x in "ua":
                heapq.heappush(heap, (cost + 3, audit + "I", i, to))
            if i < len(rows) and not rows[i][2]:
                if rows[i][0][:1] == x:
                    heapq.heappush(heap, (cost + 3 * rows[i][3], audit + "K", i + 1, to))
                if x in "ua":
                    heapq.heappush(heap, (cost + 3 + 3 * rows[i][3], audit + "R", i + 1, to))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))


def applied(rows, audit):
    out, at = [], iter(rows)
    for x in audit:
        row = next(at) if x != "I" else None
        if x != "D":
            system = bool(out) and out[0][0][:1] == "s" and out[0][2] == "K"
            other = "user" if (len(out) - system) % 2 == 0 else "assistant"
            out.append((row[0] if x == "K" else other, row[1] if row else "", x))
    return [(r, t) for r, t, _ in out]


def plain(rows):
    """What the operator gives for a conversation's rows after damage."""
    own, n = faults(rows)
    cost, audit = cheapest(own)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    text = "\n".join(f"{r}:{t}" for r, t in applied(own, audit))
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **n, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (fate != 0) * (1 + (fate == 3))
    return out


def expected(rows):
    left = damage(rows)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    return {c: plain(sorted((r[1:] for r in left if r[0] == c), key=key)) for c in {r[0] for r in rows}}


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def parsed(rows):
    own = D.Conversation(D.Parser())
    for r in rows:
        own.row(*r)
    return dict(zip(D.SUMMARY, own.summary(), strict=True))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: {k: r[k] for k in D.SUMMARY} for r in D.op13_dialogue(spark, SF).collect()}
    assert found == expected(rows) and len(found) > 10


@pytest.mark.parametrize("seed", range(60))
def test_random_conversations(seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["system", "user", "assistant", "tool", "", " "]), rng.choice(["Hi.", "No", "What?", "", " \n", "So!", f"row {i}."])) for i in range(rng.randint(0, 40))]
    assert parsed(rows) == plain(rows)


def test_every_sequence_of_edits():
    """All edits of short conversations with up to one insertion in each place, two at the end."""
    rng = random.Random(5)
    for _ in range(60):
        rows = [(i, rng.choice(["system", "user", "assistant", "x"]), rng.choice(["A.", "b", "", f"{i}!"])) for i in range(rng.randint(0, 3))]
        own, _ = faults(rows)
        best = None
        for edits in itertools.product(*[["D"] if lost else ["D", "K", "Ru", "Ra"] for _, _, lost, _ in own]):
            for inserts in itertools.product(["", "u", "a"], *[["", "u", "a"]] * (len(own) - 1 + (len(own) > 0)), ["", "a", "ua"]):
                said, cost, audit = "", 0, ""
                for i in range(len(own) + 1):
                    said, cost, audit = said + inserts[i], cost + 3 * len(inserts[i]), audit + "I" * len(inserts[i])
                    if i < len(own):
                        x = edits[i]
                        said += "" if x == "D" else x[1] if x[0] == "R" else own[i][0][:1]
                        cost += 4 if x == "D" else 3 * (x[0] == "R") + 3 * own[i][3]
                        audit += x[0]
                said += inserts[-1] if len(inserts) > len(own) + 1 else ""
                cost, audit = (cost + 3 * len(inserts[-1]), audit + "I" * len(inserts[-1])) if len(inserts) > len(own) + 1 else (cost, audit)
                if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, audit) < best):
                    best = cost, audit
        out = parsed(rows)
        assert (out["cost"], out["audit"]) == best


ODD = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, None, None), (1, 9, "user", "cut off"),
    (None, 1, "user", "Whose?"), (None, None, "assistant", "None's."),
    (2, None, "assistant", None), (3, 5, "system", "Be kind."), (4, 2, "user", "x " * 50_000 + "."), (4, 3, "", "no role."),
    (5, 0, "u", "Initial."), (5, 1, "a", "Initials too."), (6, 7, "user", "\x85."), (6, -7, "assistant", "a "),
]


def test_odd_rows(spark):
    """Nulls in each column, repeated rows, ties, gaps, a long text, and clashing names."""
    df = table(spark, ODD).selectExpr("*", "1 AS fate", "2 AS gone", "3 AS twice", "4 AS conv", "5 AS audit", "6 AS _role")
    rows, gone = D.damaged(df)
    found = {r["conv_id"]: {k: r[k] for k in D.SUMMARY} for r in D.repairs(rows, gone=F.col(gone)).collect()}
    assert found == expected(ODD)


def test_no_damage_and_dropped(spark):
    good = [(1, 0, "system", "S."), (1, 1, "user", "U?"), (1, 2, "assistant", "A."), (1, 3, "user", "More?"), (1, 4, "assistant", "No.")]
    one = D.repairs(table(spark, good)).first()
    assert (one["cost"], one["audit"]) == (0, "KKKKK")
    none = D.repairs(table(spark, good), gone=F.lit(True)).first()
    assert tuple(none)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert D.repairs(table(spark, []), gone=F.lit(True)).collect() == []


def test_repaired_rows(spark):
    """The rows that the edits make have the digest that was given, and the roles of the grammar."""
    rows, gone = D.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    rows = rows.filter(~F.col(gone))
    found = D.repairs(rows)
    made = {}
    for r in D.repaired_rows(rows, found).orderBy("conv_id", "place").collect():
        made.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for r in found.collect():
        own = made.get(r["conv_id"], [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in own))


def test_one_long_conversation():
    """Each second question lacks an answer: thirty thousand rows are parsed as they come, at the least cost."""
    rows = [(i, ("user", "user", "assistant")[i % 3], f"row {i}.") for i in range(30_000)]
    out = parsed(rows)
    assert len(out["audit"].replace("I", "")) == len(rows) and out["cost"] == 3 * 10_000
