"""Plans of the registered queries, and the contract of the entry module."""

import pytest

import __spark_entry__ as contract
from panelmill.plans import catalog

CHECKED = ["trend_summary", "persistence_asof", "sequence_patterns_3", "transactions", "duplicate_rows", "roc_curve", "group_share"]


def test_every_query_has_sql():
    assert set(catalog.QUERIES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark, sf):
    rows = contract.entry(spark).collect()
    assert len(rows) == 210 and {r.level for r in rows} == {"High", "Low"}


@pytest.mark.parametrize("name", CHECKED)
def test_plans_stay_distributed(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "MapInPandas" not in plan


def test_scans_read_only_what_a_query_needs(spark, sf):
    plan = catalog.QUERIES["label_threshold"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" in plan and "l_tax" not in plan and "p_retailprice" not in plan
    plan = catalog.QUERIES["trimmed_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_linestatus" in plan and "PushedFilters" in plan


def test_queries_agree_with_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sqls = contract.oracle_sql()
    for name in ("history_means", "lag_levels", "frequent_itemsets", "curve_downsample", "stratified_folds", "cluster_quality"):
        df = catalog.QUERIES[name](spark, sf)
        result = con.execute(sqls[name])
        columns = [d[0] for d in result.description]
        expected = sorted((tuple(row) for row in result.fetchall()), key=str)
        found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
        assert found == expected, name
