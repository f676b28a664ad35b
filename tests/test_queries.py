"""Every query that has SQL against DuckDB on the smallest tables."""

import pytest

import oracle
from cellatlas.plans import registry
from cellatlas.plans.fixture import Atlas

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    if name in SQL:
        assert oracle.differ(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_token_sequences_are_whole(spark):
    found = registry.queries()["cell_token_sequences"](spark, SF)
    expr = Atlas(spark, SF).dense
    assert found.count() == expr.count() > registry.queries()["cell_token_order"](spark, SF).count()


def test_default_numbers_of_genes(spark, con):
    """The queries with the operators' own numbers find more than those with few genes."""
    q = registry.queries()
    assert q["variable_genes_default"](spark, SF).count() > q["variable_genes"](spark, SF).count()
    few, all_ = (q[n](spark, SF).first()["n_found"] for n in ("compare_recall", "compare_recall_default"))
    assert all_ > few
    assert all(f"<= {n}" in SQL[name] for name, n in (("gene_recall_default", 500), ("session_evidence_default", 500), ("cluster_summaries_default", 400)))
