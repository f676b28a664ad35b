import pytest

ODD = [
    (1, "the cat sat on the mat and the dog ran off"),
    (2, "the cat sat on the mat and the dog ran off"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "x"),
    (6, "x"),
    (7, "123 456 !!"),
    (8, "word " * 30_000),
    (9, "Zażółć gęślą jaźń 😀 ß İ Σας\x1c end"),
    (None, "a row without an id has a text of some words"),
]


#: Names that operators give to columns of theirs, or once gave.
CLASHING = "_host _rate _base _more _slice _at _start h r k host rate kept base_failed host_rate host_kept n_words secrets pii masked lang_pred lang_accepted toxicity held_out ids decoded key component_id n_shingles set_key bands id label group part place n own_1 slice at first slot size".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that nothing may crash on, with columns whose names clash with what operators add."""
    rows = [(i, t, "en" if i and i % 2 else None, "s", len(t or ""), "mine", 1, *range(len(CLASHING))) for i, t in ODD]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, media string, shard int, {', '.join(f'`{c}` int' for c in CLASHING)}")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def folder(spark, odd, tmp_path_factory):
    """The odd rows as a folder of tables, and an empty one."""
    out = {}
    for name, df in (("odd", odd), ("empty", odd.limit(0))):
        root = tmp_path_factory.mktemp(name)
        df.write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int").filter(str(name == "odd")).write.parquet(f"{root}/labels.parquet")
        out[name] = str(root)
    return out


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
