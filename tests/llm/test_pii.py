import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from cellatlas.llm import pii as P
from llm.conftest import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in found.split(".")), "card": lambda: 16 <= len(digits) <= 19 and P.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text) if holds(k, m[0])]


@settings(max_examples=500, deadline=None)
@given(st.text("a1.@-+ 2()x40é😀", max_size=50))
def test_base_spans(text):
    assert [s[:3] for s in P.spans(text) if s.base] == brute(text)


def test_query(spark, texts):
    import hashlib

    for r in P.op5_pii(spark, SF).collect():
        found = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in found) for k in PLAIN]
        assert set(f"{k}:{a}:{b}" for k, a, b in found) <= set(r["spans"].split(","))


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("DE89370400440532013000") and not P.mod97("DE88370400440532013000")


def test_further_kinds_and_scores():
    kinds = lambda t: [s.kind for s in P.spans(t)]
    assert kinds("my bank account DE89 3704 0044 0532 0130 00 thanks") == ["iban"]
    assert kinds("DE88 3704 0044 0532 0130 00") == []
    assert kinds("her social security number 123-45-6789") == ["ssn"]
    assert kinds("order 123-45-6789") == [] == kinds("ssn 000-45-6789")
    near, far = P.spans("ip address 10.0.0.1")[0], P.spans("version 10.0.0.1")[0]
    assert near.score > far.score


def test_numbers_in_runs_that_are_too_long():
    text = "call +1 (826) 555-4081 97.51.17.173 or 4111 1111 1111 1111 9807 9157 6280 4490, 9807915762804490 4111111111111111"
    assert P.masked(text, P.spans(text)) == "call <PHONE> <IP> or <CARD> 9807 9157 6280 4490, 9807915762804490 <CARD>"
    assert [s.base for s in P.spans(text)] == [True, False, False, False]
    assert P.spans("1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9") == []


def test_masked():
    text = "mail a@b.cd or +1 (234) 567-8901, é 😀 4111 1111 1111 1111."
    assert P.masked(text, P.spans(text)) == "mail <EMAIL> or <PHONE>, é 😀 <CARD>."
    assert P.masked("plain", []) == "plain"


def test_stage(spark, odd):
    docs = odd.unionByName(odd.limit(1).withColumns({"doc_id": P.F.lit(99).cast("long"), "text": P.F.lit("write to a@b.cd"), "n_chars": P.F.lit(5).cast("long")}))
    out = P.pii_stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    row = out.filter("doc_id = 99").first()
    assert (row["text"], row["n_chars"]) == ("write to <EMAIL>", 16)
    assert out.filter("doc_id = 3").first()["text"] is None


def test_long_runs_are_linear():
    began = time.monotonic()
    for text in ("a" * 10**6 + "@", "1" * 10**6, "1." * 500_000, "+" * 10**6, "+1(" * 300_000, "a@" * 500_000, "a@b." * 250_000, "AA11" * 250_000, "1 " * 500_000, "1-" * 500_000, "@" + "a." * 500_000):
        P.masked(text, P.spans(text))
    assert time.monotonic() - began < 60
    assert P.spans("a" * 200_000 + "@") == [] and P.spans("1" * 100_000) == []


def test_context_decides_further_spans():
    """A word against it takes each further kind away, a word for it brings it back; base spans stay."""
    kinds = lambda t: [(s.kind, s.base) for s in P.spans(t)]
    iban, run = "DE89 3704 0044 0532 0130 00", "4111 1111 1111 1111 9807 9157 6280 4490"
    assert kinds(f"see {iban}") == [("iban", False)] == kinds(f"invoice, bank account {iban}") and kinds(f"invoice {iban}") == []
    assert kinds(f"see {run}") == [("card", False)] == kinds(f"serial of a visa: {run}") and kinds(f"serial {run}") == []
    long = "+1 (826) 555-4081 97.51.17.19.5"
    assert kinds(f"at {long}")[-1] == ("phone", False) and ("phone", False) not in kinds(f"release {long}")
    assert kinds("release 10.0.0.1") == [("ip", True)]


def test_scores_stand_beside_spans(spark, texts):
    n = 0
    for r in P.op5_pii(spark, SF).collect():
        found = P.spans(texts[r["doc_id"]] or "")
        assert r["scores"] == ",".join(f"{x.score:.2f}" for x in found) and len(r["scores"].split(",")) == len(r["spans"].split(","))
        assert all(x.base or x.score >= P.LEAST for x in found)
        n += len(found)
    assert n > 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9))), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9))))
def test_taken_places(base, more):
    places = [(a, a + n) for a, n in base]
    taken = P.Taken(places)
    for a, n in more:
        free = not any(x < a + n and a < y for x, y in places)
        assert taken.add(a, a + n) == free
        places += [(a, a + n)] * free


def test_many_spans_are_quick():
    began = time.monotonic()
    assert len(P.spans("a@b.cd 10.0.0.1 " * 18_000)) == 36_000
    assert len(P.spans("DE89370400440532013000 10.0.0.1 " * 18_000)) == 36_000
    assert time.monotonic() - began < 30
