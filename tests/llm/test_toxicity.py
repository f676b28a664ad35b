import functools

import numpy as np

from cellatlas.llm import toxicity as X
from cellatlas.llm.labelled import held_out


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = X.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    assert np.mean(np.array(toxic) >= 0.5) > 0.8 and np.mean(np.array(clean) < 0.5) > 0.96


def test_one_label_tells_nothing():
    model = X.fit([(0, *X.some_windows("a plain text"))])
    assert X.Scorer(model).score("any text") < 0.5
    assert X.Scorer(X.fit([])).score("any text") < 0.5
    assert X.Scorer(model).score("") == 0.0 == X.Scorer(model).score("12 !")


def test_misspelt_words_share_ngrams():
    rng = np.random.default_rng(0)
    plain = [" ".join("".join(rng.choice(list("bcdfgaeiou"), 5)) for _ in range(20)) for _ in range(200)]
    rows = [(0, *X.some_windows(t)) for t in plain[:100]] + [(1, *X.some_windows(f"{t} vzkrmplo {t}")) for t in plain[100:]]
    s = X.Scorer(X.fit(rows))
    assert s.worst("bacde vzkrmplx fegi")[0] > s.worst("bacde fobig fegi")[0]


def test_windows_cover_all_words():
    for n in (1, 5, 8, 9, 100):
        start, end = X.bounds(n)
        assert set(range(n)) == {i for a, b in zip(start, end, strict=True) for i in range(a, b)} and (end > start).all()


def test_held_out_is_not_learned(spark):
    assert spark.range(1000).withColumnRenamed("id", "doc_id").filter(held_out()).count() in range(150, 250)


def test_as_plain(spark):
    """Scores once more from the model's arrays: mean of subword vectors, mean of a window, softmax, logistic."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = X.learned(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    found = {r["doc_id"]: r["toxicity"] for r in X.with_toxicity(docs.limit(150), model).collect()}
    a, b, c = model.scale
    for r in docs.limit(150).collect():
        own = X.words(r["text"] or "")
        if not own:
            assert found[r["doc_id"]] == 0
            continue
        vectors = [model.vectors[X.features(w)].astype(float).mean(0) for w in own]
        worst = max(float(z[1] - z[0]) for z in (np.mean(vectors[i : i + X.WINDOW], 0) @ model.weights + model.bias for i in range(0, max(1, len(own) - X.WINDOW // 2), X.WINDOW // 2)))
        n = len(range(0, max(1, len(own) - X.WINDOW // 2), X.WINDOW // 2))
        assert abs(found[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(a * worst + b * np.log(n) + c, -30, 30)))) < 1e-4


def test_ngram_hash_goes_on_from_the_shorter_one():
    for word in ("a", "ab", "abcdef", "naïveté"):
        codes = [60, *map(ord, word), 62]
        plain = [codes] + [codes[i:j] for i in range(len(codes)) for j in range(i + X.GRAMS[0], min(i + X.GRAMS[1], len(codes)) + 1)]
        bucket = lambda x: ((functools.reduce(lambda h, y: (h * 0x01000193 ^ y) & 0xFFFFFFFF, x, 0)) * 0x9E3779B1 & 0xFFFFFFFF) >> 15
        assert sorted(X.features(word)) == sorted(map(bucket, plain))


def test_new_words_are_hashed_together(monkeypatch):
    """Words that a worker hasn't met cost no call each, and give what each gives alone; long ones aren't kept."""
    rng = np.random.default_rng(1)
    own = ["".join(rng.choice(list("abcdeéß\U00010438"), n)) for n in rng.choice([1, 2, 3, 5, 9, 63, 64, 65, 200], 3000)]
    line = rng.standard_normal((X.BUCKETS, X.DIM)).astype(np.float32)
    scorer = X.Scorer(X.Model(line, np.eye(X.DIM, 2, dtype=np.float32), np.zeros(2, np.float32), (1.0, 0.0, 0.0)))
    alone = {w: float(np.mean((line[:, 1].astype(float) - line[:, 0])[X.features(w)])) for w in own[:200]}
    calls = []
    plain = X.features
    monkeypatch.setattr(X, "features", lambda w: calls.append(w) or plain(w))
    monkeypatch.setattr(X, "_KNOWN", 2000)
    texts = [" ".join(own[i : i + 7]) for i in range(0, len(own), 7)]
    found = [r for i in range(0, len(texts), 50) for r in (scorer.worsts(texts[i : i + 50]) if hasattr(scorer, "worsts") else map(scorer.worst, texts[i : i + 50]))]
    assert not calls and len(scorer) <= 2000 and all(len(w) < 64 for w in scorer)
    assert found == [scorer.worst(t) for t in reversed(texts)][::-1]
    assert all(abs(scorer.worst(w)[0] - x) < 1e-6 for w, x in alone.items())
