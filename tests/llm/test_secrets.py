import math
import random
import re
import time

from cellatlas.llm import secrets as S

PLAIN = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def brute(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if len(m[2] if k == "assign" else m[0]) >= LEAST[k]]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def entropy(s):
    return max((-sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) for w in (s[i : i + 20] for i in range(len(s) - 19))), default=0.0)


def test_spans_and_entropy(spark):
    rng = random.Random(3)
    parts = ["password", "PassWD", "secret", ":", "=", " ", '"', "'", "token", "apikey", "api_key", "AKIA", "ABCDEF0123", "abcdef0123", "9f", "x", ".", "😀", "é", "\n", "K7", "zQ1w", "sſ"]
    rows = [None, "", 'é😀 password: "token: abcdefgh1" secret=x api_key = abc.def 😀 AKIA' + "A" * 16, "q7" * 40_000]
    rows += ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    n = 0
    for r in S.with_secrets(df).collect():
        text, found = rows[r["doc_id"]], r["secrets"]
        assert [(m["kind"], m["start"], m["end"]) for m in found if m["kind"] != "entropy"] == brute(text)
        for m in (m for m in found if m["kind"] == "entropy"):
            n += 1
            assert text[m["start"] : m["end"]] == m["string"] and entropy(m["string"]) >= 3.0 and not re.search(S.ALLOWED, m["string"])
    assert n > 20


def test_window_entropy(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices(S.ALPHABET[: rng.randint(1, 66)], k=rng.randint(0, 60))),) for _ in range(200)]
    for r in spark.createDataFrame(rows, "s string").select("s", S.window_entropy(S.F.col("s")).alias("h")).collect():
        assert abs(entropy(r["s"]) - r["h"]) < 1e-9


def test_allowed(spark):
    rows = [("id 123e4567-e89b-12d3-a456-426614174000",), ("abcdefghijklmnop0123456789",), ("k8Zq2LmX9vTr4WsY7bNc1D",)]
    assert [len(r["secrets"]) for r in S.with_secrets(spark.createDataFrame(rows, "text string")).collect()] == [0, 0, 1]


def test_paths(spark):
    """Names and numbers between single slashes are paths; capitals, double slashes and other signs are not."""
    rows = [("/usr/lib/python3/dist-packages/x86_64",), ("k8q2lmx9vtr4wsy7bnc1d/a5z0e3u6p",), ("k8q2lmx9//vtr4wsy7bnc1d5z0e3u6p",), ("K8q2lmx9/vtr4wsy7bnc1d5z0e3u6p",)]
    assert [len(r["secrets"]) for r in S.with_secrets(spark.createDataFrame(rows, "text string")).collect()] == [0, 0, 1, 1]


def test_long_texts(spark):
    """A megabyte of anything takes seconds, and no stack."""
    rng = random.Random(5)
    n = 1 << 20
    rows = {
        "path": "a/" * 500_000 + "b1",
        "assign": "password=abcdef1 " * 100_000,
        "mixed": ("".join(rng.choices(S.ALPHABET, k=24)) + " password: x1y2z3q ") * 25_000,
        "any": "".join(rng.choices(S.ALPHABET, k=n)),
        "hex": "".join(rng.choices("0123456789abcdef", k=n)),
        "upper": "".join(rng.choices(S.ALPHABET[:26], k=n)),
        "letters": "a" * n,
        "signs": "+/=-_" * (n // 5) + "a1",
        "spaces": "password" + " " * n,
    }
    began = time.monotonic()
    df = spark.createDataFrame(list(rows.items()), "name string, text string").repartition(4)
    found = {r["name"]: r["secrets"] for r in S.with_secrets(df).select("name", "secrets").collect()}
    assert time.monotonic() - began < 120
    for name, text in rows.items():
        assert [(m["kind"], m["start"], m["end"]) for m in found[name] if m["kind"] != "entropy"] == brute(text)
    assert len(found["path"]) == 0 and len(found["any"]) >= 1 and len(found["assign"]) == 100_000


def test_entropy_spans_touch_no_other(spark):
    """Against all pairs, over texts full of both."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(S.ALPHABET, k=rng.randint(18, 30)))
    rows = [(i, "".join(rng.choice([word(), " ", "password", "=", ": ", "token", "AKIA" + "Q7" * 9, "9f" * 13]) for _ in range(40))) for i in range(200)]
    n = 0
    for r in S.with_secrets(spark.createDataFrame(rows, "id int, text string")).collect():
        base = brute(r["text"])
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", r["text"]):
            s = m[0]
            least = 3.0 if re.fullmatch("[0-9a-fA-F]+", s) else 3.7 if s.isalnum() else 3.9
            path = "/" in s and "//" not in s and re.fullmatch("[a-z0-9_/-]+", s)
            plain = re.search("[0-9]", s) and re.search("[A-Za-z]", s) and not re.search(S.ALLOWED, s) and not path
            if plain and entropy(s) >= least and not any(a < m.end() and m.start() < b for _, a, b in base):
                want.append(m.span())
        assert [(m["start"], m["end"]) for m in r["secrets"] if m["kind"] == "entropy"] == want
        n += len(want)
    assert n > 50


def test_own_columns_stay(spark):
    df = spark.createDataFrame([("token=abcdef1", 1, 2, 3)], "text string, _base int, _more int, secrets int")
    r = S.with_secrets(df).first()
    assert (r["_base"], r["_more"], len(r["secrets"])) == (1, 2, 1)
