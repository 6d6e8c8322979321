import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from solvenza.operators import features
from solvenza.schemas import FEATURE_TYPES, METRICS, RATIOS
from solvenza.sources import responses, sinks

BLOCK = (
    "company BIGINT, news_count BIGINT, aggregate STRUCT<POSITIVE: BIGINT, NEGATIVE: BIGINT, "
    "NEUTRAL: BIGINT, positive_ratio: DOUBLE, negative_ratio: DOUBLE, neutral_ratio: DOUBLE>, "
    "news_sentiment_score DOUBLE, sentiment_volatility DOUBLE, recency_weight_mean DOUBLE"
)


def sources(spark, with_=(1, 1, 1, 1)):
    def frame(rows, kind, keep):
        return spark.createDataFrame(rows if keep else [], kind)

    return (
        frame([(1, 2024, None, 0.123456, 0.5, 0.1, 1.0, float("nan"))], METRICS, with_[0]),
        frame([(1, "AA")], "company BIGINT, rating STRING", with_[1]),
        frame([(1, 4, (1, 2, 1, 0.25, 0.5, 0.25), -0.25, 0.8, 0.6)], BLOCK, with_[2]),
        frame([(1, 0.7)], "company BIGINT, final_score DOUBLE", with_[3]),
    )


def test_assembly(spark):
    row = sinks.feature_columns(features.assemble(*sources(spark))).first()
    assert row.asDict() == {
        "company": 1, "debt_ratio": 0.0, "roa": 0.1235, "total_asset_growth_rate": 0.5,
        "cfo_to_total_debt": 0.1, "current_ratio": 1.0, "quick_ratio": None,
        "news_sentiment_score": -0.25, "news_count": 4, "sentiment_volatility": 0.8,
        "positive_ratio": 0.25, "negative_ratio": 0.5, "recency_weight_mean": 0.6,
        "business_report_text_score": 0.7, "public_credit_rating": "AA",
    }
    assert len(FEATURE_TYPES) == 15
    assert features.assemble(*sources(spark), missing="null").first().debt_ratio is None


@pytest.mark.parametrize("present", list(itertools.product((0, 1), repeat=4)))
def test_ready_needs_all_four(spark, present):
    companies = spark.createDataFrame([(1,)], "company BIGINT")
    r = features.readiness(companies, *sources(spark, present)).first()
    assert list(r)[1:5] == [bool(p) for p in present]
    assert r.is_ready == all(present) == (features.assemble(*sources(spark, present)).count() == 1)


@pytest.mark.parametrize("rating", [None, "", "-"])
def test_no_rating_is_not_ready(spark, rating):
    metrics, _, block, scores = sources(spark)
    ratings = spark.createDataFrame([(1, rating)], "company BIGINT, rating STRING")
    companies = spark.createDataFrame([(1,)], "company BIGINT")
    assert not features.readiness(companies, metrics, ratings, block, scores).first().is_ready
    assert features.assemble(metrics, ratings, block, scores).count() == 0


def test_rating_lookup(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name STRING")
    ratings = spark.createDataFrame([("a", "AA"), ("b", "")], "name STRING, rating STRING")
    assert {r.name: r.public_rating for r in features.rating_lookup(names, ratings).collect()} == {
        "a": "AA", "b": "-", "c": "-",
    }


def snapshots(spark, rows):
    kinds = "company BIGINT, snapshot_ts TIMESTAMP_NTZ, " + ", ".join(f"{r} DOUBLE" for r in RATIOS)
    kinds += ", public_credit_rating STRING, news_sentiment_score DOUBLE, business_report_text_score DOUBLE, news_count BIGINT"
    full = [
        (c, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), *[0.1] * 6, rating, score, 0.5, n)
        for c, d, rating, score, n in rows
    ]
    return spark.createDataFrame(full, kinds)


SNAPSHOTS = [
    (1, 0, "AA", 0.1, 1), (1, 1, "AA", 0.1, 2), (1, 2, "AA", 0.2, 2), (1, 40, "AA", 0.2, 2),
    (1, 80, "AA", 0.1, 2), (1, 81, None, 0.1, 2), (1, 82, None, 0.1, 2), (1, 83, "AA", None, 2),
    (2, 5, "A", 0.1, 1),
]
CHANGED = [(1, 0), (1, 2), (1, 80), (1, 81), (1, 83), (2, 5)]


def days(rows):
    return sorted((r.company, (r.snapshot_ts - dt.datetime(2024, 1, 1)).days) for r in rows)


def test_changed(spark):
    """News counts alone do not change a row; going back to old values and to NULL does."""
    got = features.changed(snapshots(spark, SNAPSHOTS)).collect()
    assert days(got) == CHANGED


def test_changed_continues_from_the_kept_hash(spark):
    first = features.changed(snapshots(spark, SNAPSHOTS[:3]))
    kept = first.groupBy("company").agg(F.max_by("change_hash", "snapshot_ts").alias("change_hash"))
    assert days(features.changed(snapshots(spark, SNAPSHOTS[3:]), kept=kept).collect()) == CHANGED[2:]


def test_sink_round_trip(spark, tmp_path):
    rows = features.assemble(*sources(spark))
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        sinks.append_features(rows, path, kind)
        sinks.append_features(rows, path, kind)
        back = sinks.read_features(spark, path, kind)
        assert back.count() == 2 and back.columns == list(FEATURE_TYPES)
        assert back.first() == sinks.feature_columns(rows).first()


def test_managed_store(spark, tmp_path):
    lists = spark.createDataFrame([(1, '["a"]')], "owner INT, stored STRING")
    sinks.write_managed(lists, str(tmp_path / "m"))
    assert sinks.read_managed(spark, str(tmp_path / "m")).collect() == lists.collect()
    after = spark.createDataFrame([(1, '["a","b"]')], "owner INT, stored STRING")
    sinks.write_managed(after, str(tmp_path / "m"))
    assert sinks.read_managed(spark, str(tmp_path / "m")).collect() == after.collect()


def bodies(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "body STRING")


def test_metrics_responses(spark):
    df = bodies(
        spark, '{"data":[{"stock_code":"1","debt_ratio":0.5,"roa":null},{"stock_code":"2"}]}',
        '{"data":[]}', "{}", None,
    )
    assert [r.stock_code for r in responses.metrics(df).collect()] == ["1", "2"]
    first = responses.first_metrics(df).collect()
    assert [(r.stock_code, r.debt_ratio, r.roa) for r in first] == [("1", 0.5, None)]


def test_credit_responses(spark):
    df = bodies(spark, '{"ratings":{"a":"AA","b":"","c":"-","d":null}}')
    assert {r.name: r.rating for r in responses.credit(df).collect()} == {"a": "AA", "b": None, "c": None, "d": None}


def test_news_responses(spark):
    body = (
        '{"results":[{"query":"a","news_count":1,"aggregate":{"POSITIVE":1,"positive_ratio":1.0},'
        '"news_sentiment_score":1.0,"items":[{"title":"t","link":"l","press":"p","published_at":"x"}]}]}'
    )
    block = responses.news_blocks(bodies(spark, body)).first()
    assert (block.query, block.aggregate.POSITIVE, block.sentiment_volatility) == ("a", 1, None)
    article = responses.news_articles(bodies(spark, body)).first()
    assert (article.company, article.title, article.sentiment) == ("a", "t", None)


def test_nonfinancial_responses(spark):
    scores = {"a": "0.5", "b": '"x"', "d": '"0.7"', "e": "null", "f": "7", "g": "{}"}
    results = ",".join(f'{{"company":"{n}","score":{{"final_score":{v}}}}}' for n, v in scores.items())
    body = f'{{"results":[{results},{{"company":"c"}}]}}'
    rows = features.nonfinancial_scores(responses.nonfinancial(bodies(spark, body))).collect()
    found = {r.company: r.final_score for r in rows}
    assert found == {"a": 0.5, "b": None, "c": None, "d": None, "e": None, "f": 7.0, "g": None}


def test_numbers_as_text_are_no_scores(spark):
    text = spark.createDataFrame([("a", ("0.7",))], "company STRING, score STRUCT<final_score: STRING>")
    assert features.nonfinancial_scores(text).first().final_score is None
