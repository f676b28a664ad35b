import math
import zlib

from cellatlas.llm import langid as L
from cellatlas.llm.labelled import held_out, sample


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op2_langid(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in own) >= 0.98 * len(own)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_no_letters_and_narrow_margins():
    model = L.Languages(L.fit([("aa", "lorem ipsum dolor " * 50), ("bb", "uno dos tres cuatro " * 50)]))
    for text in ("", "123 !?", "😀"):
        assert model.guess(text) == L.Guess("und", 0.0, 0.0, False)
    assert model.guess("ipsum dolor lorem ipsum lorem").lang == "aa"
    assert model.guess("Tres cuatro, uno!").accepted
    assert not model.guess("q").accepted
    assert L.Languages(L.fit([])).guess("text").lang == "und"


def test_sample_is_bounded_and_repeats(spark):
    rows = [("a", f"text {i % 50}") for i in range(400)] + [("b", "one")] + [(None, "x"), ("a", None)]
    df = spark.createDataFrame(rows, "label string, text string")
    one = sample(df, "label", "text", 10, 5)
    assert one == sample(df.repartition(5), "label", "text", 10, 5)
    assert sum(k == "a" for k, _ in one) == 10 == len({t for k, t in one if k == "a"}) and ("b", "one") in one
    assert {k for k, _ in sample(df, "label", "text", 10, 1)} == {"a"}
    assert sample(df.limit(0), "label", "text", 10, 5) == []


def test_held_out_null(spark):
    assert [r[0] for r in spark.createDataFrame([(None,)], "doc_id bigint").select(held_out()).collect()] == [False]


def test_stage_keeps_columns(spark, odd):
    out = L.langid_stage(spark, odd, "")
    assert out.columns == odd.columns
    assert {r["text"] for r in out.collect()} <= {r["text"] for r in odd.collect()}


def test_as_plain(spark):
    """Each prediction once more, in one process, from whole texts: smallest mean size, margin and score."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(sample(docs.filter(~held_out()), "lang", "text", L.ROWS, L.LANGUAGES))
    assert model == L.learned(docs)
    total = sum(n for n, _ in model.values())
    press = {lang: [L.Languages.compressor(d) for d in ds] for lang, (_, ds) in model.items()}
    rows = {r["doc_id"]: r for r in L.op2_langid(spark, sf).collect()}
    for r in docs.collect():
        raw, own = L.letters(r["text"] or ""), rows[r["doc_id"]]
        if not raw:
            assert (own["lang_pred"], own["score"], own["accepted"]) == ("und", 0.0, False)
            continue
        sizes = {}
        for lang, both in press.items():
            blocks = [raw[i : i + L.BLOCK] for i in range(0, len(raw), L.BLOCK)]
            sizes[lang] = sum(len(c(lead + b)) for c, lead in both for b in blocks) / len(both) - math.log(model[lang][0] / total) / 1000
        best, second = sorted(sizes, key=sizes.get)[:2]
        margin = (sizes[second] - sizes[best]) / math.sqrt(len(raw))
        assert own["lang_pred"] == best and abs(own["margin"] - margin) < 1e-9 and own["accepted"] == (margin >= L.NARROW)
        assert abs(own["score"] - 1 / sum(math.exp(max(-50, 0.7 * (sizes[best] - x))) for x in sizes.values())) < 1e-9


def test_slices_cover_the_whole_sample():
    raw = bytes(range(256)) * 40
    for share in (0.05, 0.5, 1.0):
        parts = L.spread(raw, share)
        assert sum(map(len, parts)) >= share * len(raw) and len(b"".join(parts)) <= share * len(raw) + len(parts)
        assert raw.startswith(parts[0]) and all(p in raw for p in parts)
    assert b"".join(L.spread(raw, 1.0)) == raw
    n, ds = L.fit([("a", f"{'begin ' * 9000}{i} middle {'end ' * 9000}") for i in range(3)])["a"]
    assert n == 3 and all(b"begin" in d and b"end" in d for d in ds) and sum(map(len, ds)) < 1.2 * L.DICTIONARIES * L.DICTIONARY


def test_a_language_that_was_not_learned_is_mostly_rejected(spark):
    """One left out at a time, at any length; of the learned ones hardly a document goes."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL AND size(split(text, ' ')) >= 50")
    own = [(r["lang"], r["text"]) for r in rows.filter(held_out()).select("lang", "text").limit(600).collect()]
    learned = sample(rows.filter(~held_out()), "lang", "text", 200, 8)
    whole = L.Languages(L.fit(learned))
    kept = [whole.guess(t).accepted for _, t in own]
    assert sum(kept) >= 0.985 * len(kept)
    passed = []
    for lang in ("de", "es", "fr"):
        model = L.Languages(L.fit([r for r in learned if r[0] != lang]))
        passed += [model.guess(t).accepted for x, t in own if x == lang]
    assert sum(passed) <= 0.25 * len(passed)


def test_stage_leaves_own_columns(spark):
    text = "lorem ipsum dolor sit amet " * 20
    docs = spark.createDataFrame([(i, f"{text} {i}", "aa", "mine") for i in range(9)] + [(i, f"uno dos tres {i} " * 30, "bb", "mine") for i in range(20, 29)], "doc_id bigint, text string, lang string, lang_pred string")
    assert {r["lang_pred"] for r in L.langid_stage(spark, docs, "").collect()} == {"mine"}
