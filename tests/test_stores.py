"""The stored name index and the metrics kept by year."""

import pytest
from hypothesis import given, settings, strategies as st

from solvenza.operators import catalog
from solvenza.schemas import METRICS
from solvenza.session import shared_dir
from solvenza.sources import metrics_store, responses, search_index

NAMES = ["KB금융", "LG전자", "KT&G", "HL D&I", "100% 기업", "a_b", "3S", "AKB48", "kbkb", "İstanbul"]


def companies(spark, names):
    return spark.createDataFrame([(n, f"of {n}") for n in names], "name STRING, industry STRING")


@pytest.fixture(scope="module")
def index(spark):
    """Names that came in three batches, one of them empty."""
    path = shared_dir(spark, "test-index")
    for part in (NAMES[:3], [], NAMES[3:]):
        search_index.extend(companies(spark, part), path)
    return search_index.read(spark, path)


@pytest.mark.parametrize("query", ["kb", " kb", "%", "_", "&", " d&i", "금", "kbk", "bkb4", "KB48", "전자", "zz", "", "  ", "100% 기업", "i̇s"])
def test_search_equals_the_scan(spark, index, query):
    expected = catalog.search(companies(spark, NAMES), query)
    assert sorted(search_index.search(index, query).collect()) == sorted(expected.select("name", "industry").collect())


texts = st.text(alphabet="abAB금 %", min_size=0, max_size=6)


@settings(max_examples=4, deadline=None)
@given(st.lists(texts, min_size=2, max_size=20, unique=True), st.lists(texts, min_size=1, max_size=8))
def test_bulk_search_equals_single_searches(spark, names, terms):
    path = shared_dir(spark, "test-index")
    search_index.extend(companies(spark, names[:1]), path)
    search_index.extend(companies(spark, names[1:]), path)
    wanted = spark.createDataFrame([(t,) for t in terms], "term STRING")
    got = search_index.search_bulk(search_index.read(spark, path), wanted).collect()
    expected = {(t, n) for t in terms if t.strip() for n in names if t.lower() in n.lower()}
    assert len(got) == len(expected) and {(r.term, r.name) for r in got} == expected


def test_frequent_sequences_have_several_lists(spark, monkeypatch):
    monkeypatch.setattr(search_index, "LIST_ROWS", 10)
    path, names = shared_dir(spark, "test-index"), [f"firm{i}" for i in range(100)]
    search_index.extend(companies(spark, names), path)
    index = search_index.read(spark, path)
    lists = [r.n for r in index.filter("gram = 'irm'").collect()]
    assert sum(lists) == 100 and len(lists) > 5 and max(lists) < 30
    assert search_index.search(index, "firm").count() == 100


def test_one_file_of_names_is_cut_up_by_many_tasks(spark):
    path, group = shared_dir(spark, "test-index"), "index-of-one-file"
    spark.sparkContext.setJobGroup(group, group)
    try:
        search_index.extend(companies(spark, NAMES).coalesce(1), path)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = [i for j in status.getJobIdsForGroup(group) for i in status.getJobInfo(j).stageIds]
    assert 4 in {s.numTasks for s in map(status.getStageInfo, stages) if s}


def test_search_opens_the_folders_of_its_sequences(index):
    plan = search_index.search(index, "kb금")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_saving_replaces_only_the_years_it_has(spark):
    path = shared_dir(spark, "test-metrics")

    def rows(*values):
        return spark.createDataFrame([(c, y, v, *[None] * 5) for c, y, v in values], METRICS)

    metrics_store.save(rows((1, 2019, 0.1), (1, 2020, 0.2), (2, 2020, 0.3)), path)
    metrics_store.save(rows((1, 2020, 0.5)), path)
    kept = metrics_store.read(spark, path)
    assert sorted((r.company, r.fiscal_year, r.debt_ratio) for r in kept.collect()) == [(1, 2019, 0.1), (1, 2020, 0.5)]
    years = spark.createDataFrame([(2019,), (2019,), (2050,)], "fiscal_year INT").filter("fiscal_year > 0")
    assert [r.fiscal_year for r in metrics_store.of_years(kept, years).collect()] == [2019]


def test_unreadable_responses_are_told_apart(spark):
    bodies = [('{"a":1}',), ('{"a":',), (None,), ("",), ("[1, 2]",), ("  ",)]
    df = spark.createDataFrame(bodies, "body STRING")
    assert sorted(r.body for r in responses.readable(df).collect()) == ["[1, 2]", '{"a":1}']
    found = {(r.body, r.reason) for r in responses.unreadable(df).collect()}
    assert found == {('{"a":', "not JSON"), (None, "missing"), ("", "empty"), ("  ", "empty")}


def test_rating_of_a_name(spark):
    df = spark.createDataFrame([('{"ratings":{"a":"AA","b":""}}', n) for n in "abc"] + [("{", "a"), (None, "a")], "body STRING, name STRING")
    got = df.select(responses.rating_of(df.body, df.name).alias("r")).collect()
    assert [r.r for r in got] == ["AA", "-", "-", "-", "-"]
