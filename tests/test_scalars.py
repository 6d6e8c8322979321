import datetime as dt
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from solvenza.functions import labels, scalars as S
from solvenza.schemas import GRADE_SCALE


def test_percentage_of_missing_and_non_finite(one):
    values = [None, math.nan, math.inf, -math.inf, 0.123456, -0.00001, -0.5, 12.0, 1.005]
    expected = ["0.00%", "-", "-", "-", "12.35%", "-0.00%", "-50.00%", "1200.00%", "100.50%"]
    assert one(S.to_percentage, values, "DOUBLE") == expected
    assert one(lambda c: S.to_percentage(c, "null"), [None, 0.25], "DOUBLE") == ["-", "25.00%"]


def test_parse_percentage(one):
    assert one(S.parse_percentage, ["12.35%", "-", "0.5", None, "x%", "-3.00%"]) == [
        0.1235, None, 0.5, None, None, -0.03,
    ]


def test_stored_ratio_equals_parsing_the_print(spark):
    values = [None, math.nan, math.inf, 0.123456, -0.98765, 0.00004, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for missing in ("zero", "null"):
        printed = S.parse_percentage(S.to_percentage(df.v, missing))
        assert df.select(
            F.count_if(~printed.eqNullSafe(S.stored_ratio(df.v, missing))).alias("n")
        ).first().n == 0


def test_percentage_round_trip_stays_close(spark):
    df = spark.range(20001).select(((F.col("id") - 10000) / 7919.0).alias("v"))
    error = F.abs(S.parse_percentage(S.to_percentage(df.v)) - df.v)
    assert df.agg(F.max(error).alias("e")).first().e <= 5e-5 + 1e-12


def test_round_half_up_sends_ties_up(one):
    assert one(S.round_half_up, [2.5, -2.5, 3.49, -0.5], "DOUBLE") == [3, -2, 3, 0]


def test_displayed_count(spark):
    df = spark.createDataFrame([(0.35, 10), (None, None), (0.5, None)], "r DOUBLE, n BIGINT")
    assert [r[0] for r in df.select(S.displayed_count(df.r, df.n)).collect()] == [4, 0, 0]


def test_grade_index_and_back(one):
    assert one(S.grade_index, ["AAA", "D", "NR", "", None]) == [0, 19, -1, -1, -1]
    assert one(S.grade_label, [0, 19, 20, -1, None], "INT") == ["AAA", "D", "", "", ""]
    assert one(lambda c: S.grade_label(S.grade_index(c)), list(GRADE_SCALE)) == list(GRADE_SCALE)


def test_host(one):
    urls = [
        "http://U@Host.Example.com:8080/a", "https://x.kr:443/a", "not a url", None, "",
        "http://x.kr:443/", "HTTPS://A.B?q=1#f", "mailto:a@b.c", "http://x.kr:80", "ftp://f.kr:21/z",
        "http://u:p@h.kr/x@y", "http://a b.kr/",
    ]
    assert one(S.url_host, urls) == [
        "host.example.com:8080", "x.kr", "not a url", "-", "-",
        "x.kr:443", "a.b", "mailto:a@b.c", "x.kr", "f.kr", "h.kr", "http://a b.kr/",
    ]


def test_likely_url(one):
    assert one(S.is_likely_url, [" HTTP://a ", "https://", "http://a b", "ftp://a", None]) == [
        True, False, False, False, False,
    ]


def test_trim_and_slash(one):
    assert one(S.trim_spaces, ["　 a b ﻿", " \t"]) == ["a b", ""]
    assert one(S.is_blank, ["　 ", "", None, " x"]) == [True, True, True, False]
    assert one(S.strip_trailing_slash, ["http://a/", "http://a//", "b"]) == ["http://a", "http://a/", "b"]


def test_defaults_and_maps(spark):
    df = spark.createDataFrame([({"a": "AA", "b": "", "c": None},)], "m MAP<STRING,STRING>")
    row = df.select(*[S.map_lookup(df.m, F.lit(k)).alias(k) for k in "abcd"]).first()
    assert tuple(row) == ("AA", "-", "-", "-")


def test_numbers(one):
    assert one(S.to_number, ["1.5", "x", "NaN", "Infinity", None, "-2"]) == [
        1.5, None, None, None, None, -2.0,
    ]
    assert one(S.plain_number, [3.0, 3.1, 4.9], "DOUBLE") == ["3", "3.1", "4.9"]
    assert one(S.thousands, [1234567, 999], "BIGINT") == ["1,234,567", "999"]


TIMES = [
    dt.datetime(2025, 10, 9, 0, 5, 7), dt.datetime(2025, 1, 2, 12, 0, 0),
    dt.datetime(2025, 12, 31, 15, 9, 59), dt.datetime(2025, 3, 4, 11, 59, 1),
]


def test_time_labels(one):
    assert one(S.short_time_label, TIMES, "TIMESTAMP_NTZ") == [
        "10. 09. 오전 12:05", "01. 02. 오후 12:00", "12. 31. 오후 03:09", "03. 04. 오전 11:59",
    ]
    assert one(S.full_time_label, TIMES, "TIMESTAMP_NTZ")[:3] == [
        "2025. 10. 9. 오전 12:05:07", "2025. 1. 2. 오후 12:00:00", "2025. 12. 31. 오후 3:09:59",
    ]


def test_quarters(spark):
    df = spark.createDataFrame([(dt.date(2024, 11, 5), True), (dt.date(2024, 2, 1), False)], "d DATE, e BOOLEAN")
    rows = df.select(
        S.quarter_label(df.d, df.e).alias("l"), S.quarter_label(df.d).alias("p"),
        S.quarter_start(df.d).alias("s"), S.quarter_number(df.d).alias("n"),
    ).collect()
    assert [(r.l, r.p, r.s) for r in rows] == [
        ("Q4 2024 (E)", "Q4 2024", dt.datetime(2024, 10, 1)), ("Q1 2024", "Q1 2024", dt.datetime(2024, 1, 1)),
    ]
    assert rows[0].n - rows[1].n == 3


def test_bucket_width_must_divide_the_hour():
    with pytest.raises(ValueError):
        S.bucket_start(F.col("ts"), 7)


def test_bucketing_is_idempotent(spark):
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) for s in range(0, 7200, 37)]
    df = spark.createDataFrame([(t,) for t in times], "ts TIMESTAMP_NTZ")
    once = df.select("ts", S.bucket_start(F.col("ts")).alias("b"))
    for r in once.select("ts", "b", S.bucket_start(F.col("b")).alias("bb")).collect():
        assert r.b == r.bb == r.ts.replace(minute=r.ts.minute // 3 * 3, second=0, microsecond=0)


def test_epoch_seconds(one):
    expected = [int(t.replace(tzinfo=dt.timezone.utc).timestamp()) for t in TIMES]
    assert one(S.epoch_seconds, TIMES, "TIMESTAMP_NTZ") == expected


def test_labels(one):
    assert one(labels.rating_change_label, ["상승", "하락", "유지", "x"]) == [
        "등급 상승", "등급 하락", "등급 유지", "등급 유지",
    ]
    assert one(labels.delinquency_label, ["연체", "기타"]) == ["연체", "기타"]
    assert one(labels.notification_label, ["down", "warning", "up", "x"]) == [
        "등급 하락", "하락 위험", "등급 상승", None,
    ]
    assert one(labels.sentiment_label, ["positive", "negative", "neutral", None]) == ["긍정", "부정", "중립", None]
    assert one(labels.direction_label, ["상향", "하향", "유지"]) == ["등급상승", "등급하락", "등급유지"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=20, max_size=60))
def test_basis_points_agree_with_exact_rounding(spark, values):
    from decimal import Decimal, ROUND_HALF_UP

    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for r in df.select("v", S.basis_points(df.v).alias("p")).collect():
        exact = (Decimal(r.v) * 10000).quantize(Decimal(1), ROUND_HALF_UP)
        # Doubles next to a tie may fall to either side.
        assert abs(int(exact) - r.p) <= (1 if abs(abs(Decimal(r.v) * 10000) % 1 - Decimal("0.5")) < Decimal("1e-5") else 0)


def test_numbers_follow_the_whole_text(one):
    texts = ["", " ", "1d", "1f", "1e3", " 2.5 ", ".5", "5.", "+1", "-", "abc", "NaN", "Infinity", "1e999", None]
    assert one(S.to_number, texts) == [0, 0, None, None, 1000, 2.5, 0.5, 5, 1, None, None, None, None, None, None]
    assert one(S.parse_percentage, ["12.5%", "%", "1d", "1d%", "-", "0.3", ""]) == [0.125, 0, None, None, None, 0.3, 0]


def test_large_ratios_do_not_saturate(one):
    values = [1e14, -1e15, 1e15, 12345.678, 1e30]
    assert one(S.to_percentage, values, "double") == [
        "10000000000000000.00%", "-100000000000000000.00%", "100000000000000000.00%", "1234567.80%",
        "100000000000000000000000000000000.00%",
    ]
    assert one(S.stored_ratio, values, "double") == [1e14, -1e15, 1e15, 12345.678, 1e30]


def test_moments_order_by_time_and_number(spark):
    rows = [("1969-12-31 23:59:59.5", 1), ("1970-01-01", -5), ("1970-01-01", 3), ("2024-01-01 00:00:00.000001", -9),
            ("2024-01-01 00:00:00.000002", 2**62), ("9999-12-31 23:59:59.999999", 2**63 - 1)]
    df = spark.createDataFrame(rows, "t STRING, id BIGINT").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    found = [r.m for r in df.select(S.moment("ts", "id").alias("m")).collect()]
    assert found == sorted(set(found)) and None not in found
