"""Chunked ordered operators against plain windows, hot key included."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from solvenza.operators import ordered

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows under one key; several rows share a time."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = 0 if i % 3 == 0 else rng.randrange(1, 40)
        at = START + dt.timedelta(minutes=rng.randrange(0, 3 * 24 * 60))
        data.append((key, i, at, rng.choice([None, 1, 2, 3])))
    return spark.createDataFrame(data, "k INT, id BIGINT, ts TIMESTAMP_NTZ, v INT").cache()


def plain():
    return Window.partitionBy("k").orderBy("ts", "id")


def same(got, expected):
    assert sorted(got.collect(), key=repr) == sorted(expected.collect(), key=repr)


# Every key cut, the frequent one cut, none cut.
CUTS = pytest.mark.parametrize("split_rows", [20, 500, 10_000])


def test_frequent_keys(rows):
    assert [(r.k, r.n) for r in ordered.frequent_keys(rows, ["k"], 500).collect()] == [(0, 1000)]
    assert ordered.frequent_keys(rows, ["k"], 10_000).count() == 0


@CUTS
def test_latest_known(rows, split_rows):
    got = ordered.latest_known(rows, ["k"], ["ts", "id"], F.col("v"), "p", split_rows)
    w = plain().rowsBetween(Window.unboundedPreceding, 0)
    expected = F.last("v", ignorenulls=True).over(w).alias("p")
    same(got.select("k", "id", "p"), rows.select("k", "id", expected))


@pytest.mark.parametrize("slices", [None, 1, 50])
def test_position(rows, slices):
    got = ordered.position(rows, ["k"], ["ts", "id"], "p", slices)
    expected = F.row_number().over(plain()).cast("long").alias("p")
    same(got.select("k", "id", "p"), rows.select("k", "id", expected))


def test_a_burst_of_one_second_is_cut_by_rows(spark):
    """20,000 rows of one key and time, and ten keys of 2,000: no slice is much larger
    than asked for."""
    burst = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(START).cast("timestamp_ntz").alias("ts"), "id")
    rows, cut = ordered.in_slices(burst, ["k"], ["ts", "id"], 1000)
    sizes = [r["count"] for r in rows.groupBy("k", "_slice").count().collect()]
    assert cut and len(sizes) >= 15 and max(sizes) <= 3000
    inboxes = burst.withColumn("k", (F.col("id") % 10).cast("int"))
    parts = ordered.sliced(inboxes, ["k"], ["ts", "id"], 40).groupBy("k", "_slice").count()
    assert max(r["count"] for r in parts.collect()) <= 1500


def test_nothing_is_cut_where_no_key_is_frequent(rows):
    got = ordered.latest_known(rows, ["k"], ["ts", "id"], F.col("v"), "p", 10_000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == 1


def test_no_task_sees_a_whole_key(rows):
    """Windows over rows run by key and slice."""
    got = ordered.position(rows, ["k"], ["ts", "id"], "p")
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number" in line]
    assert windows and all("_slice" in line for line in windows)
