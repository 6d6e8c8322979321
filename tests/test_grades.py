import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from solvenza.operators import grades
from solvenza.schemas import GRADE_OBSERVATIONS, GRADE_SCALE

DAY = dt.datetime(2024, 5, 1)


def at(hour, minute, second=0):
    return DAY.replace(hour=hour, minute=minute, second=second)


@pytest.fixture(scope="module")
def series(spark):
    rows = [
        (1, 1, at(9, 0, 10), "AA"), (1, 2, at(9, 1), "A"), (1, 3, at(9, 2), "NR"),
        (1, 4, at(9, 3), "A"), (1, 5, at(9, 7, 30), "AAA"), (1, 6, at(9, 8), ""),
    ]
    return spark.createDataFrame(rows, GRADE_OBSERVATIONS)


CUTS = pytest.mark.parametrize("split_rows", [1, 7, 200, 10**6])


@CUTS
def test_direction_and_last_change(series, split_rows):
    rows = grades.with_changes(series, split_rows).orderBy("id").collect()
    assert [(r.id, r.direction, r.last_change, r.prev_score) for r in rows] == [
        (1, "유지", "", None), (2, "하향", "AA → A", 2), (4, "유지", "AA → A", 5), (5, "상향", "A → AAA", 5),
    ]


def test_buckets_keep_the_last_write(series):
    rows = grades.in_time_order(grades.credit_buckets(series)).collect()
    assert [(r.bucket_start, r.score, r.label) for r in rows] == [
        (at(9, 0), 5, "A"), (at(9, 3), 5, "A"), (at(9, 6), 0, "AAA"),
    ]
    extent = grades.extent(grades.credit_buckets(series)).first()
    assert tuple(extent) == (1, at(9, 0), at(9, 6))


def test_same_time_is_decided_by_id(spark):
    rows = [(1, 8, at(9, 0), "AA"), (1, 7, at(9, 0), "D")]
    df = spark.createDataFrame(rows, GRADE_OBSERVATIONS)
    assert grades.credit_buckets(df).first().label == "AA"


def test_retention_keeps_its_edge(spark):
    asof = DAY + dt.timedelta(days=180)
    rows = [(DAY,), (DAY - dt.timedelta(milliseconds=1),), (asof,)]
    df = spark.createDataFrame(rows, "ts TIMESTAMP_NTZ")
    kept = {r.ts for r in grades.retained(df, "ts", F.lit(asof).cast("timestamp_ntz")).collect()}
    assert kept == {DAY, asof}


def test_retained_buckets_equal_filtered_buckets(spark):
    rows = [(1, i, DAY + dt.timedelta(seconds=50 * i), GRADE_SCALE[i % 20]) for i in range(200)]
    df = spark.createDataFrame(rows, GRADE_OBSERVATIONS)
    asof = F.lit(DAY + dt.timedelta(days=180, minutes=31)).cast("timestamp_ntz")
    expected = grades.retained(grades.credit_buckets(df), "bucket_start", asof)
    assert sorted(grades.retained_buckets(df, asof).collect()) == sorted(expected.collect())
    assert 0 < expected.count() < grades.credit_buckets(df).count()


def random_observations(spark, n=1500, seed=3):
    rng = random.Random(seed)
    grade_choices = ["AAA", "AA", "A", "NR", "D"]
    rows = [
        (1 if i % 3 == 0 else rng.randrange(2, 20), i,
         DAY + dt.timedelta(seconds=rng.randrange(0, 5 * 86400)), rng.choice(grade_choices))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, GRADE_OBSERVATIONS)


def brute_changes(rows):
    out, last, text = {}, {}, {}
    for company, i, ts, grade in sorted(rows, key=lambda r: (r[2], r[1])):
        if grade not in GRADE_SCALE:
            continue
        idx, prev = GRADE_SCALE.index(grade), last.get(company)
        direction = "유지" if prev is None or prev == idx else ("상향" if idx < prev else "하향")
        if prev is not None and prev != idx:
            text[company] = f"{GRADE_SCALE[prev]} → {grade}"
        out[i] = (direction, text.get(company, ""))
        last[company] = idx
    return out


@CUTS
def test_changes_equal_brute_force(spark, split_rows):
    rows, df = random_observations(spark)
    changes = grades.with_changes(df, split_rows)
    got = {r.id: (r.direction, r.last_change) for r in changes.collect()}
    assert got == brute_changes(rows)


def test_direction_agrees_with_index_difference(spark):
    _, df = random_observations(spark)
    for r in grades.with_changes(df).collect():
        if r.prev_score is None:
            assert r.direction == "유지"
        else:
            sign = (r.score > r.prev_score) - (r.score < r.prev_score)
            assert r.direction == {0: "유지", -1: "상향", 1: "하향"}[sign]


def test_moved_weeks_equal_weeks_with_a_change(spark):
    rows, df = random_observations(spark, 400, 11)
    rows = [(c, i, DAY + (ts - DAY) * 12, g if c % 4 else "AA") for c, i, ts, g in rows]
    df = spark.createDataFrame(rows, GRADE_OBSERVATIONS)
    changes = grades.with_changes(df).filter("direction <> '유지'")
    week = F.window("ts", "7 days").getField("start")
    expected = changes.select("company", week.alias("week_start")).distinct()
    got = grades.moved_weeks(df)
    assert sorted(got.collect()) == sorted(expected.collect())
    assert got.count() < df.select("company", week).distinct().count()


@CUTS
def test_grade_asof(spark, split_rows):
    rows, df = random_observations(spark, 600, 5)
    points = grades.credit_buckets(df)
    probes = spark.createDataFrame(
        [(c, 10_000 + i, ts + dt.timedelta(minutes=1)) for c, i, ts, _ in rows[::2]]
        + [(99, 1, DAY)] + [(p.company, 50_000 + n, p.bucket_start) for n, p in enumerate(points.collect())],
        "company BIGINT, id BIGINT, ts TIMESTAMP_NTZ",
    )
    series = {}
    for p in points.collect():
        series.setdefault(p.company, []).append((p.bucket_start, p.label))
    got = {r.id: r.grade_asof for r in grades.grade_asof(probes, points, split_rows).collect()}
    expected = {}
    for r in probes.collect():
        before = [p for p in series.get(r.company, []) if p[0] <= r.ts]
        expected[r.id] = max(before)[1] if before else None
    assert got == expected


@CUTS
def test_following_in_stretches_equals_following_at_once(spark, split_rows):
    rows, df = random_observations(spark, 900, 21)
    cut = F.lit(DAY + dt.timedelta(days=2)).cast("timestamp_ntz")
    first = grades.follow(df.filter(F.col("ts") < cut), split_rows)
    state = first.groupBy("company").agg(F.max_by(F.struct("score", "change"), F.struct("ts", "id")).alias("s"))
    kept = state.select("company", "s.score", "s.change").unionByName(
        spark.createDataFrame([(777, 3, None)], "company BIGINT, score INT, change INT")
    )
    second = grades.follow(df.filter(F.col("ts") >= cut), split_rows, kept)
    got = grades.described(first.unionByName(second)).collect()
    assert {r.id: (r.direction, r.last_change) for r in got} == brute_changes(rows)
