import random
from collections import Counter

import numpy as np
import pytest

from cellatlas.llm import neardup as N
from cellatlas.llm import shingles as H


def brute(rows, percent=85):
    """doc_id: (size, component), by all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = (t or "").translate(low).encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies(n, seed=1, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [256, 16])
def test_hot_group(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = near_copies(150) + [(1000 + i, t) for i, t in near_copies(90, 2, 6)] + [(5000, None), (5001, ""), (5002, "two Words"), (5003, "two words")]
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (70, 70), (8, 2)]
    found = {r["id"]: r["label"] for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(31), 0), 50: 50, 70: 50, 100: 50}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(1 << 63, size=n, dtype=np.uint64) for n in (600, 200, 200))
    x, y = (np.unique(np.concatenate([both, s])) for s in (a, b))
    assert abs((H.signature(x) == H.signature(y)).mean() - 0.6) < 0.12
    assert (H.bands(H.signature(x)) == H.bands(H.signature(x.copy()))).all()


def test_common_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 40, 100, 250)]
    expected = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = N._common(sets)
    assert all(expected[i][j] == got[i][j] for i in range(4) for j in range(4) if i != j)


def test_stage(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "A B c d e f"), (5, "another text of six words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in N.neardup_stage(spark, docs, "").collect()) == [1, 3, 5]


def test_stage_at_80(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    near = words[:-10] + [f"e{i}" for i in range(10)]  # 90 of them in common: 90 of 110, 0.82
    far = [f"f{i}" for i in range(12)] + words[12:]  # 88 of 112, 0.79
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in ((1, words), (2, near), (3, far))], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in N.neardup_stage(spark, docs, "").collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in N.neardup_stage(spark, docs, "", percent=85).collect()) == [1, 2, 3]


def test_bands_fit_the_similarity():
    """Of 3000 pairs of 0.8 all share a band; with bands of 8 values some did not."""
    rng = np.random.default_rng(3)
    missed = {8: 0, H.band_rows(80): 0}
    for _ in range(3000):
        x = rng.integers(1 << 63, size=110, dtype=np.uint64)  # 100 and 98 of 110, 88 in common
        a, b = H.signature(x[:100]), H.signature(x[12:])
        for rows in missed:
            missed[rows] += not (H.bands(a, rows) == H.bands(b, rows)).any()
    assert H.band_rows(85) == 8 and H.band_rows(80) == 6
    assert missed[6] == 0 < missed[8], missed


def test_repeated_ids_with_other_texts(spark):
    """Each text of a repeated id is compared, whichever row comes first; no text is lost in the stage."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(104)) for x in "abc")
    near = lambda t: t.rsplit(" ", 2)[0] + " e f"
    rows = [(1, a), (1, b), (2, near(b)), (3, near(a)), (9, c), (9, a), (9, b), (7, near(c))]
    rows += [(50, " ".join(f"h{k}x{i}" for i in range(60))) for k in range(30)] + [(60 + k, near(" ".join(f"h{k}x{i}" for i in range(60)))) for k in range(30)]
    for own in (rows, rows[::-1]):
        docs = spark.createDataFrame(own, "doc_id bigint, text string").coalesce(1)
        found = sorted((r["doc_id"], r["component_id"]) for r in N.near_duplicates(docs).collect())
        assert found == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (9, 1), (9, 1), (9, 7), (7, 7)] + [(50, 50)] * 30 + [(60 + k, 50) for k in range(30)])
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, near(b))], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["text"]) for r in N.neardup_stage(spark, docs, "").collect()) == [(1, a), (2, b)]


def test_repeated_rows_in_the_stage(spark):
    """One row of an id and a text stays, also of texts without a word; rows without an id stay; own columns too."""
    a, b = (" ".join(f"{x}{i}" for i in range(104)) for x in "ab")
    near = b.rsplit(" ", 2)[0] + " e f"
    rows = [(1, a, 0), (1, a, 0), (1, b, 0), (2, near, 0), (3, b, 0), (3, near, 0), (4, "", 0), (4, None, 0), (5, " ", 0), (None, a, 0), (None, a, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, H int")
    left = N.neardup_stage(spark, docs, "")
    assert left.columns == docs.columns
    found = sorted(((r["doc_id"] or 0, r["text"] or "") for r in left.collect()))
    assert found == sorted([(1, a), (1, b), (4, ""), (5, " "), (0, a), (0, a)])


def test_key_must_be_a_number(spark):
    with pytest.raises(ValueError):
        N.near_duplicates(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def template(n, seed=4):
    """Documents of one template, 0.77 alike and linked with nothing, but for planted near copies of a few."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(91)]
    rows = [base + [f"o{i}x{k}" for k in range(13)] for i in range(n)]
    for i in range(0, n, 50):
        own = list(rows[i])
        own[rng.randrange(40)] = f"e{i}"
        rows.append(own)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def linked(rows, percent=85):
    """component of each doc_id by all pairs, by a matrix of the shingles that are not alone."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    times = Counter(x for s in sets for x in s)
    column = {x: i for i, x in enumerate(x for x, m in times.items() if m > 1)}
    has = np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        has[i, [column[x] for x in s if x in column]] = 1
    size = np.array([len(s) for s in sets])
    common = has @ has.T
    hit = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(hit, True)
    label = np.arange(len(sets))
    while True:
        new = np.array([label[h].min() for h in hit])
        if (new == label).all():
            return {rows[i][0]: rows[x][0] for i, x in enumerate(label)}
        label = new


def test_template_group(spark, monkeypatch):
    """Exact, and what is compared grows in proportion although the group falls apart."""
    compared, sent = N.compared, []

    def counted(groups, sets, percent):
        sent.append(groups.count())
        return compared(groups, sets, percent)

    monkeypatch.setattr(N, "compared", counted)
    for n in (1500, 3000):
        rows = template(n)
        found = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == linked(rows)
        assert sum(not r["kept"] for r in found) == n // 50
    assert sent[1] <= 2.05 * sent[0] <= 2.05 * 4 * 1530


def test_groups_that_partly_hold_together(spark, monkeypatch):
    """Against all pairs, where similarities lie around the threshold and sets differ in size."""
    monkeypatch.setattr(N, "BLOCK", 32)
    rng = random.Random(8)
    rows = []
    for i in range(700):
        base = [f"t{k}" for k in range(rng.choice([85, 90, 95, 100]))]
        for _ in range(rng.choice([0, 1, 2, 3])):
            base[rng.randrange(len(base))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(base + [f"o{i}x{k}" for k in range(rng.randint(0, 14))])))
    for percent in (80, 85):
        found = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), percent=percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == linked(rows, percent)


def test_prefix_pairs_lose_nothing(spark):
    """All pairs that are similar enough pass, and of a template's pages no others."""
    rng = np.random.default_rng(9)
    pool = rng.integers(1 << 62, size=60, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(pool, rng.integers(40, 60), replace=False), rng.integers(1 << 62, size=rng.integers(0, 8), dtype=np.uint64)]) for _ in range(120)]
    rows = [(i, i, len(s), int(w)) for i, s in enumerate(sets) for w in s.view(np.int64)]
    for percent in (70, 85, 95):
        pairs = {tuple(sorted(r)) for r in N.prefix_pairs(N.units(spark.createDataFrame(rows, "id bigint, part bigint, n bigint, w bigint")), percent).collect()}
        true = {(i, j) for i in range(120) for j in range(i + 1, 120) if H.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), percent)}
        assert true <= pairs and len(pairs) < 120 * 119 / 2


def option_bank(n, seed=6):
    """Documents of 40 places, each with one of two passages of its own (0.9 to 0.1): many are nearly alike, many aren't."""
    rng = random.Random(seed)
    bank = [[" ".join(f"s{i}o{k}w{j}" for j in range(12)) for k in (0, 1)] for i in range(40)]
    return [(i, " ".join(bank[j][rng.random() < 0.1] for j in range(40))) for i in range(n)]


def test_shared_passages(spark, monkeypatch):
    """Exact where pages share passages; a passage is joined as a unit, not by each of its shingles."""
    own, sent = N.units, []

    def counted(rows):
        found = own(rows)
        sent.append((rows.count(), found.count()))
        return found

    monkeypatch.setattr(N, "units", counted)
    rows = option_bank(700)
    for percent in (80, 85):
        found = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), percent=percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == linked(rows, percent)
    assert all(4 * u < w for w, u in sent), sent


def test_units(spark):
    """Elements that the same sets have are one unit; those of one set alone are none."""
    sets = {1: [10, 11, 12, 20, 30], 2: [10, 11, 12, 20], 3: [20, 40], 4: [40]}
    part = {1: 1, 2: 1, 3: 3, 4: 4}
    rows = [(i, part[i], len(s), w) for i, s in sets.items() for w in s]
    found = N.units(spark.createDataFrame(rows, "id bigint, part bigint, n bigint, w bigint")).collect()
    assert sorted((r["id"], r["f"], r["k"], r["apart"]) for r in found) == [(1, 2, 3, False), (1, 3, 1, True), (2, 2, 3, False), (2, 3, 1, True), (3, 2, 1, True), (3, 3, 1, True), (4, 2, 1, True)]
    assert len({r["u"] for r in found}) == 3


def test_recall(spark):
    """Of 1500 pairs that are just similar enough, apart from each other, all are found."""
    rows = []
    for i in range(1500):
        words = [f"p{i}w{k}" for k in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[8:] + [f"q{i}w{k}" for k in range(8)]))]  # 92 of 108
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r["kept"] for r in found) == 1500
