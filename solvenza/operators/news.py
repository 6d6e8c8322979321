"""News: recent articles, sentiment block, weekly counts, display.

Formulas of our own choice: sentiment counts +1, 0, -1; the score is their mean, the
volatility their population standard deviation; an article's recency weight is
``1 - age_seconds / (days * 86400)``. Articles are first cut to the last ``days``,
then to the latest ``limit`` per company, then aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from solvenza.functions import labels, scalars as S
from solvenza.schemas import NEWS_DAYS, NEWS_LIMIT

_DAY_SECONDS = 86400


def recent(items: DataFrame, asof: Column, days: int = NEWS_DAYS, limit: int = NEWS_LIMIT) -> DataFrame:
    """Latest ``limit`` articles per company published after ``asof`` minus ``days``.

    The rank filter becomes a group limit before the shuffle, so every task sends
    at most ``limit`` articles per company.
    """
    latest = Window.partitionBy("company").orderBy(F.desc("published_at"), "id")
    return (
        items.filter(
            (F.col("published_at") > asof - F.make_dt_interval(F.lit(days)))
            & (F.col("published_at") <= asof)
        )
        .withColumn("recency_rank", F.row_number().over(latest))
        .filter(F.col("recency_rank") <= limit)
    )


def sentiment_block(
    items: DataFrame, asof: Column, days: int = NEWS_DAYS, limit: int = NEWS_LIMIT
) -> DataFrame:
    """One row per company with counts, ratios, score, volatility and recency.

    All sums are over integers, so a retried task gives the same doubles.
    """
    return block_of(recent(items, asof, days, limit), asof, days)


def block_of(recent_items: DataFrame, asof: Column, days: int = NEWS_DAYS) -> DataFrame:
    """The block of articles that are cut to the days and the limit already."""
    age = S.epoch_seconds(asof) - S.epoch_seconds(F.col("published_at"))
    return _blocks(recent_items.withColumn("_age", age), ["company"], days)


def daily_blocks(items: DataFrame) -> DataFrame:
    """The same per company and day, ``snapshot_ts``, over all articles of the day and as
    of its end."""
    daily = items.withColumn("snapshot_ts", F.window("published_at", "1 day").getField("start"))
    end = S.epoch_seconds(F.col("snapshot_ts")) + _DAY_SECONDS
    age = end - S.epoch_seconds(F.col("published_at"))
    return _blocks(daily.withColumn("_age", age), ["company", "snapshot_ts"], 1)


def _blocks(scored: DataFrame, keys: list[str], days: int) -> DataFrame:
    n, pos, neg = F.col("news_count"), F.col("positive"), F.col("negative")
    balance = pos - neg
    span = n * days * _DAY_SECONDS
    return (
        scored.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("news_count"),
            F.count_if(F.col("sentiment") == "positive").alias("positive"),
            F.count_if(F.col("sentiment") == "negative").alias("negative"),
            F.count_if(F.col("sentiment") == "neutral").alias("neutral"),
            F.sum("_age").alias("_age"),
        )
        .select(
            *keys, "news_count",
            F.struct(
                pos.alias("POSITIVE"), neg.alias("NEGATIVE"), F.col("neutral").alias("NEUTRAL"),
                (pos / n).alias("positive_ratio"), (neg / n).alias("negative_ratio"),
                (F.col("neutral") / n).alias("neutral_ratio"),
            ).alias("aggregate"),
            (balance / n).alias("news_sentiment_score"),
            (F.sqrt(n * (pos + neg) - balance * balance) / n).alias("sentiment_volatility"),
            ((span - F.col("_age")) / span).alias("recency_weight_mean"),
        )
    )


def display(block: DataFrame) -> DataFrame:
    """Shown counts and percentages of a sentiment block."""
    shown = []
    for kind in ("positive", "negative"):
        ratio = F.col(f"aggregate.{kind}_ratio")
        shown += [
            S.displayed_count(ratio, F.col("news_count")).alias(f"{kind}_shown"),
            S.to_percentage(ratio).alias(f"{kind}_percent"),
        ]
    score = F.col("news_sentiment_score")
    overall = F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")
    return block.select(
        "company", "news_count", *shown, labels.sentiment_label(overall).alias("overall_label")
    )


def weekly_sentiment(items: DataFrame) -> DataFrame:
    """Articles per company, week and sentiment, one column each.

    Conditional counts give the pivoted form in one aggregation and also run on a
    stream. Weeks are 7-day windows counted from 1970-01-01.
    """
    return (
        items.withColumn("week_start", F.window("published_at", "7 days").getField("start"))
        .groupBy("company", "week_start")
        .agg(
            *[
                F.count_if(F.col("sentiment") == kind).alias(kind)
                for kind in ("positive", "negative", "neutral")
            ]
        )
    )


def link_hosts(links: DataFrame) -> DataFrame:
    return links.select(
        "*", S.is_likely_url(F.col("link")).alias("is_url"), S.url_host(F.col("link")).alias("host")
    )
