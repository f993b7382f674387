"""Driver contract, plan shape and the DuckDB oracle on the smallest fixture tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as se
from retailcast.plans.queries import ORACLE, QUERIES
from retailcast.sources.tables import TABLE_NAMES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver fixtures missing")


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert "promo_last_7_days" in df.columns


def test_every_query_of_the_library_has_an_oracle():
    # searches that SQL can't express; test_subsets and test_tuning hold them against plain versions
    assert set(QUERIES) - set(ORACLE) == {"q_subset_search", "q_hybrid_search"}
    assert set(ORACLE) <= set(QUERIES) and set(ORACLE) <= set(se.queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _sorted_joins(plan: str) -> set[str]:
    """Left keys of the sort-merge joins of the panel."""
    found = {re.sub(r"#\d+", "", keys) for keys in re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)}
    return {keys for keys in found if re.search("store_nbr|city|family", keys)}


@pytest.fixture
def no_automatic_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lags_share_one_series_exchange(spark, no_automatic_broadcast):
    plan = _plan(se.queries()["q_lags"](spark, SF))
    # one hash exchange by the series serves all 14 lags (no per-lag shuffles)
    assert plan.count("hashpartitioning(store_nbr") == 1
    assert not _sorted_joins(plan)


def test_feature_table_reads_the_lines_once(spark, no_automatic_broadcast, monkeypatch):
    from retailcast.sources import standins
    scans = []
    read = standins.read_table
    monkeypatch.setattr(standins, "read_table", lambda s, d, name, *c: scans.append(name) or read(s, d, name, *c))
    plan = _plan(se.queries()["q_feature_table"](spark, SF))
    assert scans.count("lineitem") == 1
    assert "lineitem" not in plan  # the written panel is read instead
    assert not _sorted_joins(plan) and plan.count("BroadcastHashJoin") >= 6
    assert plan.count("hashpartitioning(store_nbr") == 1


def test_promo_totals_shuffle_no_panel_rows(spark, no_automatic_broadcast):
    plan = _plan(se.queries()["q_promo_totals"](spark, SF))
    assert not _sorted_joins(plan) and "Window" not in plan


def test_scan_prunes_columns(spark):
    df = se.queries()["q_store_join"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "l_tax" not in plan


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = se.queries()[name](spark, SF)
    ours = df.collect()
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    theirs = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, ours) == _rows(dcols, theirs)


@pytest.mark.parametrize("name", ["q_feature_table", "q_knn_regress", "q_trend_slope"])
def test_same_result_for_any_partitioning(spark, name):
    """Results do not depend on spark.sql.shuffle.partitions (1 vs 4)."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = se.queries()[name](spark, SF)
        one = _rows(a.columns, a.collect())
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        b = se.queries()[name](spark, SF)
        four = _rows(b.columns, b.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == four
