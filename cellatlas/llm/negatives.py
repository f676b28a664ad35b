"""Hard-negative mining: product quantisation with stored residual norms, and an exact rerank of what these let through.

A vector of whole numbers is kept with a code of one byte for each pair of its components and the norm of what the code
leaves out. For an anchor, a table of its products with all centroids gives a row's score up to anchor norm times
residual norm, so a row whose bounds miss a window can't be in it; all others are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

SAMPLE = 4096  # rows, at most, that the codebooks are fitted on; which, a hash of their vectors decides
CENTROIDS, WIDTH, STEPS = 256, 2, 8
BLOCK, SLICE = 1 << 14, 1 << 16  # anchors and rows that meet in one task
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def codebooks(own: np.ndarray) -> np.ndarray:
    """(components / WIDTH, CENTROIDS, WIDTH) centroids by Lloyd's method, from some of own's values."""
    parts = own.reshape(len(own), -1, WIDTH).astype(np.float32)
    out = np.zeros((parts.shape[1], CENTROIDS, WIDTH), np.float32)
    for m in range(parts.shape[1]):
        x = parts[:, m]
        c = np.resize(np.random.default_rng(m).permutation(np.unique(x, axis=0)), (CENTROIDS, WIDTH)).copy()
        for _ in range(STEPS):
            near = nearest(x, c)
            n = np.bincount(near, minlength=CENTROIDS)
            sums = np.stack([np.bincount(near, x[:, j], CENTROIDS) for j in range(WIDTH)], 1)
            c[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
        out[m] = c
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)


def coded(own: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a byte each) and, for each row, a norm that the error of its looked-up scores can't exceed, for an anchor
    of norm 1: of the residual, and of what single precision adds."""
    parts = own.reshape(len(own), -1, WIDTH).astype(np.float32)
    codes = np.stack([nearest(parts[:, m], books[m]) for m in range(len(books))], 1).astype(np.uint8)
    there = books[np.arange(len(books))[None, :], codes].reshape(len(own), -1).astype(np.float64)
    lost = np.sqrt(((own - there) ** 2).sum(1))
    return codes, lost * (1 + 1e-6) + (len(books) + 8) * 2.0**-23 * np.sqrt((there**2).sum(1)) + 1e-6


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Best:
    """The k best rows (score, then order, then number) of each of some groups, added in parts."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, LOWEST, np.int64)
        self.group = np.zeros(0, np.int64)
        self.rows = np.zeros((3, 0), np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, order: np.ndarray, number: np.ndarray) -> None:
        if not len(group):
            return
        g = np.concatenate([self.group, group])
        rows = np.concatenate([self.rows, np.stack([score, order, number])], 1)
        at = np.lexsort((rows[2], rows[1], -rows[0], g))
        g, rows = g[at], rows[:, at]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        kept = place < self.k
        self.group, self.rows = g[kept], rows[:, kept]
        full = place[kept] == self.k - 1
        self.least[self.group[full]] = self.rows[0][full]


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of a[i] and b[j] in whole numbers."""
    small = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53
    if small and 8 * len(i) > len(a) * len(b):  # so many that a whole product of floats, exact here, is less work
        return (a.astype(np.float64) @ b.astype(np.float64).T)[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 15):
        out[s : s + (1 << 15)] = np.einsum("ij,ij->i", a[i[s : s + (1 << 15)]].astype(np.int64), b[j[s : s + (1 << 15)]].astype(np.int64))
    return out


def searched(anchors: dict, rows: dict, books: np.ndarray, same: bool, k: int, block: int = 128, chunk: int = 4096) -> tuple[np.ndarray, ...]:
    """(anchor, window, score, order, number): for each anchor and each of its windows [low, high] of scores the k best
    rows of the same label, or of other ones."""
    found = []
    for s in range(0, len(anchors["q"]), block):
        q, label = anchors["q"][s : s + block], anchors["label"][s : s + block]
        low, high = anchors["low"][s : s + block], anchors["high"][s : s + block]
        windows = low.shape[1]
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None]
        tables = np.einsum("amw,mcw->mac", q.reshape(len(q), -1, WIDTH).astype(np.float32), books, optimize=True)
        best = Best(len(q) * windows, k)
        top = high.max(1, initial=LOWEST)
        for t in range(0, len(rows["q"]), chunk):
            codes, own = rows["codes"][t : t + chunk], rows["label"][t : t + chunk]
            about = np.zeros((len(q), len(codes)), np.float32)
            for m in range(len(books)):
                about += np.take(tables[m], codes[:, m], axis=1)
            bound = norm * rows["norm"][None, t : t + chunk]
            least = np.maximum(best.least.reshape(-1, windows), low).min(1, initial=HIGHEST)
            may = ((label[:, None] == own[None, :]) == same) & (about + bound >= least[:, None]) & (about - bound <= top[:, None])
            i, j = np.nonzero(may)
            score = exact(q, rows["q"][t : t + chunk], i, j)
            for w in range(windows):
                fits = (score >= np.maximum(low[i, w], best.least[i * windows + w])) & (score <= high[i, w])
                a, b = i[fits], j[fits] + t
                best.add(a * windows + w, score[fits], rows["order"][b], rows["number"][b])
        found.append((s + best.group // windows, best.group % windows, *best.rows))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _coding(vec: int, books: np.ndarray, dims: int, most: int):
    """Batches (number, label, order, vec, ...) with the vector as whole numbers in place of vec, its code and norm."""

    def run(batches):
        for b in batches:
            lists = b.column(vec)
            q = np.zeros((b.num_rows, dims), np.int32)
            sizes = np.asarray(lists.value_lengths())
            q[np.arange(dims)[None, :] < sizes[:, None]] = np.clip(np.floor(256 * np.asarray(lists.flatten(), np.float64)), -most, most)
            codes, norms = coded(q, books)
            arrays = [pa.array([x.tobytes() for x in q], pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(norms)]
            names = [n for i, n in enumerate(b.schema.names) if i != vec]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if i != vec] + arrays, names=[*names, "q", "codes", "norm"])

    return run


def _best_rows(asks: DataFrame, base: DataFrame, n_asks: int, n_base: int, books: np.ndarray, same: bool, k: int) -> DataFrame:
    """ask, w, score, order, number: the k best rows of each ask's windows, over all rows of base, in blocks."""
    spark = base.sparkSession
    blocks = -(-max(n_asks, 1) // BLOCK)
    parts = max(-(-n_base // SLICE), min(partitions(spark), -(-n_base // 2048)), 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        take = lambda t, c: np.asarray(t.column(c))
        out = (np.zeros(0, np.int64),) * 5
        if left.num_rows and right.num_rows:
            windows = [np.array(left.column(c).to_pylist(), np.int64).reshape(left.num_rows, -1) for c in ("low", "high")]
            anchors = {"q": _matrix(left.column("q"), "<i4"), "label": take(left, "label"), "low": windows[0], "high": windows[1]}
            rows = {"q": _matrix(right.column("q"), "<i4"), "codes": _matrix(right.column("codes"), "u1"), "norm": take(right, "norm"), "label": take(right, "label"), "order": take(right, "order"), "number": take(right, "number")}
            i, *rest = searched(anchors, rows, books, same, k)
            out = (take(left, "ask")[i], *rest)
        return pa.table(dict(zip(("ask", "w", "score", "order", "number"), (pa.array(x, pa.int64()) for x in out), strict=True)))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    right = base.withColumn("part", F.pmod(F.xxhash64("number", F.lit("part")), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, "ask long, w long, score long, order long, number long")
    return _first(met, ["ask", "w"], [F.desc("score"), F.col("order"), F.col("number")], k)


def _first(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vec: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each row that `anchor` is true for,
    its `positives` best other rows of the same label, and for each of these the `negatives` best rows of other labels
    whose score is from `low` to `high` percent of the positive's.

    A component x counts as floor(256 x); the score is the whole inner product; ties are by the smaller key, a null key
    behind all. Rows with a null label or vector, or a component that is null or not finite, take no part. Shorter
    vectors count as filled up with zeros; components are limited to what keeps a score in 63 bits. Repeated rows are
    rows of their own: of one vector and label each copy is ranked, and an anchor's copies may be its positives. An
    anchor without a positive, or a positive without a negative in its window, gives no row, nor does an empty table.
    Labels are whole numbers. Other columns are not read.

    Of equal vectors of one label only the first positives + 1 (by key) can be among the best of anything, so the
    others are not searched, and equal anchors are searched once; all anchors are in the result.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    own = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(HIGHEST)).alias("order"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("asks"), F.col(vec).cast("array<double>").alias("v"))
    own = own.filter(F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dims = own.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], schema)
    dims = max(WIDTH, -(-dims // WIDTH) * WIDTH)
    most = 1 << min(30, (62 - (dims - 1).bit_length()) // 2)
    drawn = own.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).collect()
    start = np.zeros((len(drawn), dims))
    for i, r in enumerate(drawn):
        start[i, : len(r["v"])] = np.clip(np.floor(256 * np.array(r["v"], np.float64)), -most, most)
    books = codebooks(start)

    kept = own.select(F.monotonically_increasing_id().alias("number"), "order", "label", "asks", "v")
    table = written(kept.mapInArrow(_coding(4, books, dims, most), "number long, order long, label long, asks boolean, q binary, codes binary, norm double"), "vectors")
    by_key = [F.col("order"), F.col("number")]
    salted = _first(table.withColumn("salt", F.pmod("number", F.lit(16))), ["q", "label", "salt"], by_key, positives + 1)
    base = written(_first(salted, ["q", "label"], by_key, positives + 1).drop("salt", "place", "asks"), "rows")
    asked = table.filter("asks").select("order", "number", "q", "label")
    asks = written(asked.groupBy("q", "label").agg(F.min("number").alias("ask")), "asks")
    n_base, n_asks = base.count(), asks.count()

    ends = lambda x: F.array(F.lit(x))
    same = _best_rows(asks.select("ask", "q", "label", ends(LOWEST).alias("low"), ends(HIGHEST).alias("high")), base, n_asks, n_base, books, True, positives + 1)
    entry = F.sort_array(F.collect_list(F.struct("place", "score", "order", "number")))
    ours = written(same.groupBy("ask").agg(entry.alias("ours")), "positives")
    # Windows of an anchor: one for each place, empty where a score is there already or nothing is at that place.
    score = F.transform(F.sequence(F.lit(0), F.lit(positives)), lambda i: F.get("ours", i)["score"])
    fresh_at = lambda x, i: x.isNotNull() & ((i == 0) | ~F.coalesce(x == F.get(score, i - 1), F.lit(False)))
    scaled = lambda x: -F.floor(-(x.cast("decimal(20,0)") * low) / 100).cast("long")
    lows = F.transform(score, lambda x, i: F.when(fresh_at(x, i), scaled(x)).otherwise(F.lit(HIGHEST)))
    highs = F.transform(score, lambda x, i: F.when(fresh_at(x, i), F.floor(x.cast("decimal(20,0)") * high / 100).cast("long")).otherwise(F.lit(LOWEST)))
    windows = asks.join(ours, "ask").select("ask", "q", "label", lows.alias("low"), highs.alias("high"))
    other = _best_rows(windows, base, n_asks, n_base, books, False, negatives)
    listed = F.sort_array(F.collect_list(F.struct("place", "score", "order"))).alias("found")
    theirs = other.groupBy("ask", "w").agg(listed).groupBy("ask").agg(F.collect_list(F.struct("w", "found")).alias("theirs"))

    # One row for each searched anchor; its copies meet it here.
    both = asks.join(ours, "ask").join(theirs, "ask").select("q", "label", "ours", "theirs")
    members = asked.withColumnsRenamed({"order": "anchor", "number": "self"}).join(both, ["q", "label"])
    first = F.slice(F.filter("ours", lambda x: x["number"] != F.col("self")), 1, positives)
    each = members.select("anchor", "ours", "theirs", F.explode(first).alias("p"))
    at = F.array_position(F.transform("ours", lambda x: x["score"]), F.col("p.score")) - 1
    hits = F.filter("theirs", lambda x: x["w"] == at)[0]["found"]
    with_hits = each.withColumn("at", at).filter(F.exists("theirs", lambda x: x["w"] == F.col("at"))).select("anchor", "p", F.explode(hits).alias("n"))
    plain = lambda c: F.nullif(c, F.lit(HIGHEST))
    return with_hits.select(plain(F.col("anchor")).alias("anchor_id"), plain(F.col("p.order")).alias("positive_id"), F.col("n.place").alias("rank"), plain(F.col("n.order")).alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    """Five positives of each row of `embeddings` whose vec_id is divisible by 100, and for each of these five negatives
    of 80 to 100 percent of its score. A label whose vec_id is divisible by 7 is first made the next one of ten.

    Nulls, ties, repeated rows, odd vectors and empty tables as `hard_negatives` states.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
