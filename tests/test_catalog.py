import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from solvenza.operators import catalog

NAMES = ["KB금융", "LG전자", "KT&G", "HL D&I", "100% 기업", "a_b", "3S", "AKB48"]


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame([(n, "업종", None) for n in NAMES], "name STRING, industry STRING, description STRING")


def found(companies, query):
    return sorted(r.name for r in catalog.search(companies, query).collect())


def test_search(companies):
    assert found(companies, "kb") == ["AKB48", "KB금융"]
    assert found(companies, " kb") == []
    assert found(companies, "%") == ["100% 기업"]
    assert found(companies, "_") == ["a_b"]
    assert found(companies, "&") == ["HL D&I", "KT&G"]
    assert found(companies, " d&i") == ["HL D&I"]
    assert found(companies, "") == found(companies, " ") == found(companies, "　") == []


def test_search_count(companies):
    assert tuple(catalog.search_count(companies, "kb").first()) == (2, False)
    assert tuple(catalog.search_count(companies, "zz").first()) == (0, True)
    assert tuple(catalog.search_count(companies, " ").first()) == (0, True)


def test_search_flagged_matches_names_exactly(companies, spark):
    listed = spark.createDataFrame([("AKB48",), ("AKB48",), ("kb금융",)], "name STRING")
    rows = catalog.search_flagged(companies, listed, "kb").collect()
    assert {r.name: r.is_added for r in rows} == {"AKB48": True, "KB금융": False}


def test_search_bulk_has_no_all_pairs_join(companies, spark):
    terms = spark.createDataFrame([("kb",)], "term STRING")
    plan = catalog.search_bulk(companies, terms)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_search_bulk_cuts_names_in_many_tasks_and_moves_none_by_sequence(companies, spark):
    terms = spark.createDataFrame([("kb",), ("3s",), ("zz",)], "term STRING")
    plan = catalog.search_bulk(companies.coalesce(1), terms)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(4)" in plan and "hashpartitioning(_gram" not in plan


texts = st.text(alphabet="abAB금 %", min_size=0, max_size=6)


@settings(max_examples=6, deadline=None)
@given(st.lists(texts, min_size=1, max_size=20, unique=True), st.lists(texts, min_size=1, max_size=8))
def test_search_bulk_equals_single_searches(spark, names, terms):
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    wanted = spark.createDataFrame([(t,) for t in terms], "term STRING")
    expected = {(t, n) for t in terms if t.strip() for n in names if t.lower() in n.lower()}
    got = catalog.search_bulk(df, wanted).collect()
    assert len(got) == len(expected) and {(r.term, r.name) for r in got} == expected


def requests_of(spark, names):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i // 2), n) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "request_id BIGINT, request_ts TIMESTAMP_NTZ, name STRING")


@pytest.mark.parametrize("split_rows", [1, 2, 100])
def test_requests_one_after_the_other(companies, spark, split_rows):
    names = ["3S", "3S", "없음", "LG전자", "없음", "a_b", "3S", "lg전자"]
    listed = spark.createDataFrame([("LG전자",)], "name STRING")
    rows = catalog.classify_requests(requests_of(spark, names), listed, companies, split_rows).collect()
    assert len(rows) == len(names)
    outcome = {r.request_id: r.outcome for r in rows}

    watchlist, expected = {"LG전자"}, {}
    for i, name in enumerate(names):
        if name in watchlist:
            expected[i] = "already_added"
        elif name not in NAMES:
            expected[i] = "unknown"
        else:
            expected[i] = "added"
            watchlist.add(name)
    assert outcome == expected
    after = catalog.append_new(listed, requests_of(spark, names), companies).collect()
    assert sorted(r.name for r in after) == sorted(watchlist)


def test_adding_twice_adds_nothing(companies, spark):
    requests = requests_of(spark, ["3S", "a_b"])
    once = catalog.append_new(spark.createDataFrame([], "name STRING"), requests, companies).select("name")
    twice = catalog.append_new(once, requests, companies).select("name")
    assert sorted(twice.collect()) == sorted(once.collect())


def test_semi_and_anti(companies, spark):
    listed = spark.createDataFrame([("3S",), ("a_b",)], "name STRING")
    assert sorted(r.name for r in catalog.on_watchlist(companies, listed).collect()) == ["3S", "a_b"]
    requests = requests_of(spark, ["3S", "KT&G", "KT&G"])
    assert [r.name for r in catalog.not_on_watchlist(requests, listed).collect()] == ["KT&G"]


def test_managed_list(spark):
    broken = ['["A","B"', '{"x":1}', "no list"]
    rows = [('["a","b"]', "b"), ('["a"]', "c"), (None, "x"), ("[]", "y"), (" ", "z"), *((b, "n") for b in broken)]
    df = spark.createDataFrame(rows, "stored STRING, name STRING")
    out = [r[0] for r in df.select(catalog.add_to_managed(F.col("stored"), F.col("name"))).collect()]
    assert out == ['["a","b"]', '["a","c"]', '["x"]', '["y"]', '["z"]', *broken]
