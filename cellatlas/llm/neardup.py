"""Near-duplicates by min-max hashing, bands, and a check on whole sets of shingles.

Equal sets are one class from the start. Classes that share a band are candidates; candidates that hang together form
a cluster. A cluster of at most BLOCK classes is compared exactly, all with all. In larger ones, blocks come first:
random ones of the cluster and of two bands' buckets, which join nearly all of what belongs together. What these links
leave apart is then joined by prefixes: shingles are ordered by how rare they are, and two sets that are similar enough
share one of the first few, at places that leave enough behind it. Shingles that the same sets have count as one unit
there. Sets that share a template and nothing rare never meet, so the work doesn't grow with the square of a template's
pages; where pages stay apart although they share rare passages, the pairs that do still grow with the square of these
pages. Pairs that pass are compared on all that their sets have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fresh, partitions, scratch, slices, texts, written
from .shingles import Words, band_rows, bands, set_key, shingle_set, signature, similar

PERCENT, STAGE_PERCENT = 85, 80
BLOCK = 256  # classes compared with each other at once
SALTS = 16  # tasks that the rows of one label are dealt to
_COLUMNS = 1 << 14
_BITS = 1 << 26


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def signed(df: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """key, h (a hash of the text), n (size of the set), set_key and bands (null for an empty set) of each whole text; written."""
    kind, size = dict(df.dtypes)[key], band_rows(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = Words(), {}
        for batch in slices(batches):
            n, keys, rows = [], [], []
            for x in texts(batch):
                own = shingle_set(x, words)
                k = set_key(own)
                if k not in last:  # copies often follow each other
                    if len(last) > 4096:
                        last.clear()
                    last[k] = bands(signature(own), size).view(np.int64) if len(own) else None
                n.append(len(own))
                keys.append(k)
                rows.append(last[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["key", "h", "n", "set_key", "bands"])

    return written(df.select(F.col(key).alias("key"), text_hash(text).alias("h"), F.col(text).alias("text")).mapInArrow(sign, f"key {kind}, h bigint, n bigint, set_key binary, bands array<bigint>"), "signed")


def components(edges: DataFrame) -> DataFrame:
    """id and label of the ends of the edges (a, b): label is the least id that can be reached.

    In each round a node and the one its label names take the least label among its neighbours, then labels are
    followed once; chains halve, and it ends when no label changes. Each round is a written table. A hub's edges are
    summed where they are read, in the join of edges to labels they are a skewed side, which Spark splits, and the rows
    of a label are dealt to SALTS tasks.
    """
    once = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    own = written(once, "edges")
    both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    mark = None
    while True:
        mark, before = tuple(labels.agg(F.count("*"), F.sum(F.col("label").cast("decimal(38,0)"))).first()), mark
        if mark == before or not mark[0]:
            return labels
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        seen = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", "label", F.least("label", "m").alias("m"))
        lower = seen.select("id", "m").unionByName(seen.select(F.col("label").alias("id"), "m")).groupBy("id").agg(F.min("m").alias("label"))
        step = written(lower, "labels")
        heads = step.join(step.select(F.col("label").alias("id")).distinct(), "id").select(F.col("id").alias("label"), F.col("label").alias("next"))
        follow = by_label(step, heads)
        labels = written(follow.select("id", F.least("label", "next").alias("label")), "labels")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    column = np.cumsum(np.r_[0, np.diff(column) != 0]) if len(column) else column
    out = np.zeros((m, m))
    at = 0
    while at < len(column):
        end = int(np.searchsorted(column, column[at] + _COLUMNS))
        part = np.zeros((m, int(column[end - 1] - column[at]) + 1), np.float32)
        part[owner[at:end], column[at:end] - column[at]] = 1
        out += part @ part.T
        at = end
    return out.astype(np.int64)


def forest(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of which each joins what the ones before had not joined."""
    n = np.array([len(s) for s in sets])
    common = _common(sets)
    hit = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    root = list(range(len(ids)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        a, b = top(int(i)), top(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def compared(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside the groups (id, g), each of some BLOCK classes, by exact comparison of their sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, ids, own = None, [], []

        def close() -> list[tuple[int, int]]:
            return forest(ids, own, percent) if len(ids) > 1 else []

        for batch in batches:
            out = []
            for group, i, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if group != g:
                    out += close()
                    g, ids, own = group, [], []
                ids.append(i)
                own.append(np.frombuffer(raw, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out = close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = groups.join(sets, "id").select("g", "id", "set")
    return rows.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "id").mapInArrow(compare, "a bigint, b bigint")


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter, of bounded size, of rows of two 64-bit hashes; its words are put together on the executors."""
    bits = min(_BITS, max(1 << 12, 1 << (16 * max(1, hashes.count())).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for c in (0, 1):
                p = batch.column(c).to_numpy().view(np.uint64) & np.uint64(bits - 1)
                np.bitwise_or.at(own, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at].view(np.int64))], names=["at", "word"])

    found = hashes.toDF("x", "y").mapInArrow(words, "at int, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return out


def let_through(bloom: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of hashes the filter lets through: all that it was made of, and a few others."""
    keep = np.ones(len(x), bool)
    for h in (x, y):
        p = h.view(np.uint64) & np.uint64(64 * len(bloom) - 1)
        keep &= (bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)) == 1
    return keep


def _sets_of(docs: DataFrame, members: DataFrame, once: bool) -> DataFrame:
    """id and set (sorted 64-bit numbers) of the members (id, key, set_key), read from their texts once more.

    A Bloom filter of the keys spares all other texts a shuffle; the join by set_key drops what it let through by
    mistake, and tells apart the texts of rows that repeat a key. If no key repeats (`once`), each set comes once by
    itself and need not be shuffled for that.
    """
    hashes = (F.xxhash64("key", F.lit(1)), F.xxhash64("key", F.lit(2)))
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(members.select(*hashes)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches):
            some = batch.filter(pa.array(let_through(shared.value, batch.column(2).to_numpy(), batch.column(3).to_numpy())))
            found = [shingle_set(x, known) for x in texts(some)]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, found), pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["set_key", "set"])

    each = docs.filter("key IS NOT NULL").select("key", "text", *hashes).toDF("key", "text", "x", "y").mapInArrow(sets, "set_key binary, set binary").filter("length(set) > 0")
    found = each.join(members.select("set_key", "id"), "set_key").select("id", "set")
    return written(found if once else found.dropDuplicates(["id"]), "sets")


def in_buckets(classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """id and h: the bands (h) of the classes (id, bands) that are among the buckets (h), and a few others.

    Most bands are of one class alone; a Bloom filter of the buckets spares them the shuffle to the join.
    """
    shared = classes.sparkSession.sparkContext.broadcast(bloom_filter(buckets.select("h", F.shiftright("h", 32))))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).flatten().to_numpy()
            keep = let_through(shared.value, h, h >> 32)
            ids = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(h[keep])], names=["id", "h"])

    return classes.select("id", "bands").mapInArrow(some, "id bigint, h bigint")


def _blocks(n: str) -> str:
    return f"CAST(ceil({n} / {BLOCK}) AS int)"


def by_label(rows: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """rows (id, label, ...) with what `labels` has of their label; a hot label's rows are dealt to SALTS tasks."""
    salted = labels.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS).cast("long"))).join(salted, ["label", "salt"], how).drop("salt")


def elements(members: DataFrame, sets: DataFrame) -> DataFrame:
    """id, part, n and w: a row for each element of the members' (id, part) sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="set"):
            own = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            n = [len(x) for x in own]
            columns = [np.repeat(batch.column(c).to_numpy(), n) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.repeat(np.array(n, np.int64), n)), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], names=["id", "part", "n", "w"])

    return members.join(sets, "id").select("id", "part", "set").mapInArrow(each, "id bigint, part bigint, n bigint, w bigint")


def units(rows: DataFrame) -> DataFrame:
    """id, part, n, u, f, k and apart, from rows (id, part, n, w): elements that the same sets have are one unit.

    u names a unit, by a hash of the ids of its f sets, and k says how many elements it has; `apart`: whether these sets
    are of several parts. What pages took over from one passage are a few units instead of a row for each shingle.
    Elements of one set alone are left out.
    """
    of = rows.groupBy("w").agg(F.count("*").alias("f"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), (F.min("part") < F.max("part")).alias("apart")).filter("f > 1")
    named = of.select("w", "f", F.xxhash64("f", "x", "y").alias("u"), "apart")
    return rows.join(named, "w").groupBy("id", "part", "n", "f", "u", "apart").agg(F.count("*").alias("k"))


def prefix_pairs(own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different parts that may be similar enough, from units; none that is gets lost.

    The units of a set are ordered by how many sets have them, then by name; elements that only one set has stand before
    them. Let a be the longer set and `need` the least size of the intersection. The first common unit begins at place
    n - need of its set at the latest, which bounds the prefixes that are joined; and the common units of the prefixes,
    with the shorter of the two rests behind the last one, must come to `need` elements.
    """
    of = Window.partitionBy("id")
    before = F.sum("k").over(of.orderBy("f", "u").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
    placed = own.withColumn("at", F.col("n") - F.sum("k").over(of) + before)
    entries = written(placed.filter(f"apart AND at <= n - ceil(n * {percent} / 100)").select("u", "id", "part", "n", "at", "k"), "prefixes")
    a = entries.toDF("u", "a", "pa", "na", "ia", "k")
    b = entries.filter(f"at <= n - ceil(n * {2 * percent} / {100 + percent})").drop("k").toDF("u", "b", "pb", "nb", "ib")
    need = F.expr(f"CAST(ceil((na + nb) * {percent} / {100 + percent}) AS bigint)")
    longer = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    met = a.join(b, "u").filter((F.col("pa") != F.col("pb")) & longer & (F.col("ia") <= F.col("na") - need) & (F.col("ib") <= F.col("nb") - need))
    pairs = met.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("k").alias("k"), F.max(F.expr("ia + k")).alias("ia"), F.max(F.expr("ib + k")).alias("ib"))
    return pairs.filter(F.col("k") + F.least(F.expr("na - ia"), F.expr("nb - ib")) >= need).select("a", "b")


def similar_pairs(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different parts that are similar enough: all their common elements lie in common units.

    A set is sent as its units that other parts have too, which is far less than its elements where passages are shared.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, y), k = ((batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in (4, 6)), batch.column(5).values.to_numpy()
            keep = []
            for i, (na, nb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                s, e = x[0][i : i + 2]
                common = k[s:e][np.isin(x[1][s:e], y[1][slice(*y[0][i : i + 2])], assume_unique=True)].sum()
                keep.append(similar(int(common), na, nb, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = written(pairs.select("a").union(pairs.select("b")).toDF("id").distinct(), "ids")
    few = own.filter("apart").join(ids, "id", "left_semi")  # all other sets stay where they are
    sets = written(few.groupBy("id").agg(F.first("n").alias("n"), F.collect_list(F.struct("u", "k")).alias("e")).select("id", "n", "e.u", "e.k"), "unit_sets")
    both = pairs.join(sets.toDF("a", "na", "x", "kx"), "a").join(sets.drop("k").toDF("b", "nb", "y"), "b")
    return both.select("a", "b", "na", "nb", "x", "kx", "y").mapInArrow(check, "a bigint, b bigint")


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, once: bool = False) -> DataFrame:
    """Links (a, b) that join all similar classes (id, key, set_key, bands) which hang together by bands.

    docs: key, text; `once` says that no key repeats there.
    """
    rows = classes.select("id", F.explode("bands").alias("h"))
    buckets = written(rows.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m"), "buckets")
    near = written(in_buckets(classes, buckets).join(buckets, "h").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "near")
    clusters = written(components(near), "clusters")
    large = written(clusters.groupBy("label").agg(F.count("*").alias("m")).filter(f"m > {BLOCK}"), "large")
    sets = _sets_of(docs, written(clusters.select("id").join(classes.select("id", "key", "set_key"), "id"), "members"), once)
    dealt = written(by_label(clusters, large, "left"), "dealt")
    one = dealt.filter("m IS NULL").select("id", F.concat_ws(".", F.lit("c"), "label").alias("g"))
    many = dealt.filter("m IS NOT NULL")
    if many.isEmpty():
        return written(compared(one, sets, percent), "links")
    blocks = [many.select("id", F.explode(F.array(*[F.concat_ws(".", F.lit(f"d{s}"), "label", F.expr(f"pmod(xxhash64(id, {s}), {_blocks('m')})")) for s in (1, 2)])).alias("g"))]
    two = classes.join(many.select("id"), "id", "left_semi").select("id", F.explode(F.slice("bands", 1, 2)).alias("h"))
    sizes = two.groupBy("h").agg(F.count("*").alias("m"))
    blocks.append(two.join(sizes, "h").select("id", F.concat_ws(".", F.lit("b"), "h", F.expr(f"pmod(xxhash64(id, 3), {_blocks('m')})")).alias("g")))
    groups = written(one.unionByName(blocks[0]).unionByName(blocks[1]), "groups")  # narrow: its size says how to join
    first = written(compared(groups, sets, percent), "links")
    joined = components(first.join(many.select(F.col("id").alias("a")), "a", "left_semi"))
    parts = written(many.select("id").join(joined.withColumnRenamed("label", "part"), "id", "left").select("id", F.coalesce("part", "id").alias("part")), "parts")
    own = written(units(elements(parts, sets)), "units")
    pairs = written(prefix_pairs(own, percent), "pairs")
    return first.unionByName(written(similar_pairs(pairs, own, percent), "links"))


def grouped(df: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """key, h (a hash of the text), n, component and group (null without a word; names the component by a class) of each row."""
    kind = dict(df.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be a whole number, not {kind}")
    signs = signed(df, key, text, percent)
    with scratch(df.sparkSession):
        docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        # a class has an id of its own until labels are made, as classes of different texts may have the same least key
        each = signs.filter("n > 0 AND key IS NOT NULL").groupBy("set_key").agg(F.min("key").cast("long").alias("key"), F.any_value("bands").alias("bands"))
        classes = written(each.withColumn("id", F.monotonically_increasing_id()), "classes")
        once = signs.groupBy("key").count().filter("count > 1").isEmpty()
        linked = written(classes.select("id", "set_key", "key").join(components(links(docs, classes, percent, once)), "id"), "linked")
        least = linked.groupBy("label").agg(F.min("key").alias("component"))
        named = by_label(linked, least).select("set_key", "component", "label")
        where = written(classes.select("set_key", "id", "key").join(named, "set_key", "left").select("set_key", F.coalesce("component", "key").cast(kind).alias("component"), F.coalesce("label", "id").alias("group")), "components", keep=True)
    found = signs.select("key", "h", "n", "set_key").join(where, "set_key", "left")
    return found.select("key", "h", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"), "group")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id (the least key that links reach, itself included) and kept (key = component_id).

    key is a whole number that names a document (another kind raises ValueError); a row that repeats it with another
    text links what that text links, and gets that text's component. Repeated rows have one component and are kept
    alike. A null, empty or blank text has an empty set and is linked with nothing: its component is its own key. Rows
    with a null key get the component of their set's other rows, or null, and are not kept. Texts of any length are
    read whole. Of pairs that are just similar enough, the share that is missed is below 1e-4; there are no other ties,
    as components don't depend on order. An empty table gives an empty one; other columns are not read.
    """
    found = grouped(df, key, text, percent)
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    """near_duplicates over all documents, at 85; nulls, empty and long texts, ties and repeated rows as stated there."""
    return near_duplicates(documents(spark, sf_dir))


def neardup_stage(spark, docs: DataFrame, sf_dir: str, percent: int = STAGE_PERCENT) -> DataFrame:
    """One document of each group: that with the least id. Rows without an id stay, and ids whose text has no word.

    Of rows that repeat an id and a text one stays. If an id repeats with other texts, each stands for its own group;
    in one group, the text with the lowest hash stays. No column of docs is renamed or lost. An empty table stays empty.
    """
    h = fresh(docs, "h")
    found = grouped(docs, "doc_id", "text", percent).filter("key IS NOT NULL")
    rows = written(found.groupBy("key", "h", "group", "component").agg(F.count("*").alias("m")), "rows")
    wordy = rows.filter("group IS NOT NULL")
    best = wordy.filter("key = component").groupBy("key", "group").agg(F.min("h").alias("h"))
    gone = written(wordy.select("key", "h").join(best.select("key", "h"), ["key", "h"], "left_anti").toDF("doc_id", h), "gone")
    again = written(rows.filter("m > 1").select("key", "h").toDF("doc_id", h), "again")
    hashed = docs.withColumn(h, text_hash("text"))
    left = hashed.join(gone, ["doc_id", h], "left_anti")
    if not again.isEmpty():
        one = left.join(again, ["doc_id", h], "left_semi").dropDuplicates(["doc_id", h])
        left = left.join(again, ["doc_id", h], "left_anti").unionByName(one)
    return left.select(*docs.columns)
