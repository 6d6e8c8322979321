import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from solvenza.operators import news
from solvenza.schemas import NEWS_ITEMS

NOW = dt.datetime(2024, 6, 15, 12)


def asof():
    return F.lit(NOW).cast("timestamp_ntz")


def items(spark, rows):
    full = [(c, i, f"t{i}", None, None, ts, None, s) for c, i, ts, s in rows]
    return spark.createDataFrame(full, NEWS_ITEMS)


@pytest.fixture(scope="module")
def articles(spark):
    kinds = ["positive", "negative", "neutral", None]
    rows = [(1, i, NOW - dt.timedelta(hours=i), kinds[i % 4]) for i in range(100)]
    rows += [(2, 200, NOW - dt.timedelta(days=3), "positive"), (2, 201, NOW, "negative")]
    rows += [(3, 300 + i, NOW - dt.timedelta(hours=1), "neutral") for i in range(25)]
    return rows, items(spark, rows)


def test_recent_cuts_days_first_then_the_limit(articles):
    rows, df = articles
    got = news.recent(df, asof()).collect()
    by = {c: sorted(r.id for r in got if r.company == c) for c in (1, 2, 3)}
    assert by[1] == list(range(20))
    assert by[2] == [201]  # exactly three days old is out
    assert by[3] == list(range(300, 320))  # ties by id
    assert sorted(r.recency_rank for r in got if r.company == 1) == list(range(1, 21))


def test_three_day_default_does_not_bind_for_wide_limit(articles):
    assert news.recent(articles[1], asof(), limit=1000).filter("company = 1").count() == 72


def test_block(articles):
    rows, df = articles
    r = news.sentiment_block(df, asof()).filter("company = 1").first()
    used = [x for x in rows if x[0] == 1][:20]
    values = [{"positive": 1, "negative": -1}.get(x[3], 0) for x in used]
    assert (r.news_count, r.aggregate.POSITIVE, r.aggregate.NEGATIVE, r.aggregate.NEUTRAL) == (20, 5, 5, 5)
    assert r.aggregate.positive_ratio == 0.25
    assert r.news_sentiment_score == statistics.fmean(values)
    assert r.sentiment_volatility == pytest.approx(statistics.pstdev(values), abs=1e-12)
    weights = [1 - x[1] * 3600 / (3 * 86400) for x in used]
    assert r.recency_weight_mean == pytest.approx(statistics.fmean(weights), abs=1e-12)


def test_display(articles):
    r = news.display(news.sentiment_block(articles[1], asof())).filter("company = 1").first()
    assert (r.positive_shown, r.positive_percent, r.negative_shown, r.overall_label) == (5, "25.00%", 5, "중립")


def test_weekly_counts(spark):
    rows = [
        (1, 1, dt.datetime(1970, 1, 8), "positive"), (1, 2, dt.datetime(1970, 1, 14, 23, 59), "negative"),
        (1, 3, dt.datetime(1970, 1, 15), "neutral"), (1, 4, dt.datetime(1970, 1, 15), None),
    ]
    got = news.weekly_sentiment(items(spark, rows)).orderBy("week_start").collect()
    assert [tuple(r) for r in got] == [
        (1, dt.datetime(1970, 1, 8), 1, 1, 0), (1, dt.datetime(1970, 1, 15), 0, 0, 1),
    ]


def test_weekly_counts_equal_the_pivot(articles):
    df = articles[1]
    pivoted = (
        df.withColumn("week_start", F.window("published_at", "7 days").getField("start"))
        .groupBy("company", "week_start").pivot("sentiment", ["positive", "negative", "neutral"])
        .count().fillna(0)
    )
    assert sorted(news.weekly_sentiment(df).collect()) == sorted(pivoted.collect())


def test_group_limit_comes_before_the_shuffle(articles):
    plan = news.recent(articles[1], asof())._jdf.queryExecution().executedPlan().toString()
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits) and any("Final" in line for line in limits)
