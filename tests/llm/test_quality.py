from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from cellatlas.llm import quality as Q


def brute(text):
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(three)
    again = {i + k for i, w in enumerate(three) if n[w] > 1 for k in range(3)}
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(lines)


@settings(max_examples=400, deadline=None)
@given(st.text("ab #|é😀\n\t\x0b\x1c", max_size=80))
def test_counts(text):
    assert Q.counts(text, Q._Codes()) == brute(text)


def test_hosts_shrink_and_decide(spark):
    good = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"w#{i}|{i}" for i in range(60))
    dup = "\n".join(["the very same line of words comes"] + [f"line {i} has words of its own" for i in range(12)] + ["short x"] * 9)
    rows = [(i, good, "good") for i in range(30)] + [(100 + i, junk, "bad") for i in range(30)] + [(200, dup, "good"), (201, dup, "bad"), (202, good, "bad"), (203, good, None), (204, None, "rare")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    rates = {r["host"]: (r["rate"], r["n_failed"] / r["n_docs"]) for r in Q.host_rates(Q.with_counts(df)).collect()}
    assert rates["bad"][0] < rates["bad"][1] and rates["rare"][0] < rates["rare"][1] and rates[None][0] > 0
    kept = {r["doc_id"]: r["kept"] for r in Q.quality(df).collect()}
    assert len(kept) == len(rows)
    assert all(kept[i] for i in range(30)) and not any(kept[100 + i] for i in range(30))
    assert not kept[201] and kept[203] and not kept[204]


def test_stage(spark, odd):
    out = Q.quality_stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == 0


def test_host_verdict(spark):
    """A host that nearly always fails is rejected with its clean documents; own columns stay."""
    good, junk = " ".join(f"word{i}" for i in range(60)), " ".join(f"w#{i}|{i}" for i in range(60))
    rows = [(i, junk, "bad", "x") for i in range(900)] + [(901, good, "bad", "x")] + [(1000 + i, good, f"good{i % 3}", "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _host string")
    found = {r["doc_id"]: r for r in Q.quality(df).collect()}
    assert not found[901]["host_kept"] and not found[901]["kept"] and not found[901]["base_failed"] and found[901]["host_rate"] > 0.98
    assert all(found[1000 + i]["host_kept"] and found[1000 + i]["kept"] for i in range(300))
    assert {r["_host"] for r in found.values()} == {"x"}
    assert sorted(r["doc_id"] for r in Q.quality_stage(spark, df.withColumn("kept", Q.F.lit(7)), "").filter("kept = 7").collect()) == [1000 + i for i in range(300)]
