"""Every named query against its SQL, and the plans of the ones that must scale."""

import importlib.util
import pathlib

import pytest

import __spark_entry__ as entry
from solvenza.plans.oracles import all_oracles
from solvenza.plans.queries import all_queries

ROOT = pathlib.Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"

_spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def sql():
    return check.connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    rows, found = check.differences(QUERIES[name](spark, FOLDER), sql, ORACLES[name])
    assert not found
    assert rows > 0


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan_of(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


@pytest.mark.parametrize("name", BATCH)
def test_plan_scales(spark, name):
    """No all-pairs join, no Python, and one partition for aggregated rows only."""
    plan = plan_of(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert bad not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "Aggregate" in lines[i + 1] and "partial_" in lines[i + 1]


@pytest.mark.parametrize("name", [
    "credit_buckets", "credit_retention", "grade_asof", "rating_alerts", "news_warnings", "watchlist_add",
    "feature_changes", "notification_mark_read", "notification_summary", "notification_view",
])
def test_rows_are_combined_by_hash(spark, name):
    """No aggregate sorts the rows it reads."""
    assert "SortAggregate" not in plan_of(spark, name)


@pytest.mark.parametrize("name,columns", [
    ("company_search", "c_name:string,c_mktsegment:string"),
    ("nonfin_score", "doc_id:bigint,source:string"),
    ("link_host", "page_id:bigint,url:string"),
    ("weekly_sentiment", "ts:timestamp_ntz,user_id:bigint,event_type:string"),
])
def test_scans_read_the_needed_columns(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan_of(spark, name)


@pytest.mark.parametrize("name,pushed", [
    ("metrics_year", "GreaterThanOrEqual(l_shipdate,1997-01-01"),
    ("watchlist_semi", "LessThan(c_acctbal,0.0)"),
    ("news_sentiment", "GreaterThan(ts,"),
    ("credit_retention", "GreaterThanOrEqual(ts,"),
])
def test_filters_reach_the_scan(spark, name, pushed):
    plan = plan_of(spark, name)
    assert any("PushedFilters" in line and pushed in line for line in plan.splitlines())


def test_direction_is_one_shuffle_and_window_where_no_company_is_frequent(spark):
    plan = plan_of(spark, "grade_direction")
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["news_recent", "market_dominance"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    limits = [line for line in plan_of(spark, name).splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits)


def test_chosen_years_prune_the_folders_at_run_time(spark):
    assert "dynamicpruning" in plan_of(spark, "metrics_years")


def test_indexed_search_does_not_read_the_catalog(spark):
    for name in ("company_search_indexed", "search_bulk_indexed"):
        plan = plan_of(spark, name)
        assert "c_name" not in plan and "gram" in plan


@pytest.mark.parametrize("name,columns,scans", [
    ("watchlist_add", "o_custkey", 1), ("watchlist_add", "s_name", 1), ("risk_indicators", "l_suppkey", 0),
    ("search_bulk", "c_name", 0),
])
def test_tables_are_read_once(spark, name, columns, scans):
    """Beside the written summary, of which the plan starts."""
    plan = plan_of(spark, name)
    assert sum("ReadSchema" in line and columns in line for line in plan.splitlines()) == scans
