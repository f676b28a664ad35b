"""Queries against their SQL, and all of them over odd and over empty tables."""

import pytest

import oracle
from cellatlas.llm import registry
from llm.conftest import ODD, SF


@pytest.mark.parametrize("name", list(registry.SQL))
def test_sql(spark, name):
    assert oracle.differ(registry.QUERIES[name](spark, SF), oracle.connect(SF), registry.SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.OTHER_TABLES])
def test_odd_rows(spark, folder, name):
    rows = registry.QUERIES[name](spark, folder["odd"]).collect()
    if name == "op9_packing":
        assert sum(r["start"] == 0 for r in rows) == len(ODD)
    else:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in ODD)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.OTHER_TABLES])
def test_empty_table(spark, folder, name):
    assert registry.QUERIES[name](spark, folder["empty"]).collect() == []
