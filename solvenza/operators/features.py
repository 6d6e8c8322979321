"""Feature rows per company: assembly, readiness, ratings lookup, change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from solvenza.functions import scalars as S
from solvenza.schemas import RATIOS

# What decides whether a row is saved again. News counts, ratios by class,
# volatility and recency are not part of it.
CHANGE_KEY = (
    "company", *RATIOS, "public_credit_rating", "news_sentiment_score",
    "business_report_text_score",
)


def rating_lookup(names: DataFrame, ratings: DataFrame) -> DataFrame:
    """Public rating of every name, ``-`` when there is none or it is empty."""
    return names.join(ratings, "name", "left").withColumn(
        "public_rating", S.or_default(F.col("rating"))
    ).drop("rating")


def nonfinancial_scores(scores: DataFrame) -> DataFrame:
    """Final scores that are numbers; anything else, also a number as text, counts as
    missing."""
    kind = scores.select("score.final_score").schema[0].dataType
    number = F.col("score.final_score") if isinstance(kind, NumericType) else F.lit(None)
    return scores.select("company", number.cast("double").alias("final_score"))


def _rated(ratings: DataFrame) -> DataFrame:
    return ratings.filter(S.or_default(F.col("rating")) != "-")


def assemble(
    metrics: DataFrame, ratings: DataFrame, news: DataFrame, scores: DataFrame, missing: str = "zero"
) -> DataFrame:
    """The 15 feature columns of the companies all four sources know.

    Each input has one row per company, so no key of these joins is hot.
    """
    return feature_row(
        metrics.join(_rated(ratings), "company")
        .join(news, "company")
        .join(scores.filter(F.col("final_score").isNotNull()), "company"), missing
    )


def feature_row(joined: DataFrame, missing: str = "zero", beside: Sequence[str] = ()) -> DataFrame:
    """The feature columns of rows that hold what all four sources say, and ``beside``.

    Ratios pass through their printed percentage, so they keep four decimals and
    with ``missing="zero"`` a NULL ratio is stored as 0.
    """
    return joined.select(
        "company",
        *[S.stored_ratio(F.col(r), missing).alias(r) for r in RATIOS],
        "news_sentiment_score", "news_count", "sentiment_volatility",
        F.col("aggregate.positive_ratio").alias("positive_ratio"),
        F.col("aggregate.negative_ratio").alias("negative_ratio"),
        "recency_weight_mean",
        F.col("final_score").alias("business_report_text_score"),
        F.col("rating").alias("public_credit_rating"), *beside,
    )


def readiness(
    companies: DataFrame, metrics: DataFrame, ratings: DataFrame, news: DataFrame, scores: DataFrame
) -> DataFrame:
    """Which of the four sources know each company, and whether all do."""
    present = {
        "has_metrics": metrics.select("company"),
        "has_rating": _rated(ratings).select("company"),
        "has_news": news.select("company"),
        "has_score": scores.filter(F.col("final_score").isNotNull()).select("company"),
    }
    out = companies.select("company")
    for flag, source in present.items():
        out = out.join(source.withColumn(flag, F.lit(True)), "company", "left")
    flags = [F.coalesce(F.col(f), F.lit(False)) for f in present]
    all_of = flags[0] & flags[1] & flags[2] & flags[3]
    return out.select("company", *[c.alias(f) for f, c in zip(present, flags)], all_of.alias("is_ready"))


def change_hash(columns: Sequence[str] = CHANGE_KEY) -> Column:
    """NULLs are written into the JSON, so a value turning NULL is a change."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def compared(
    snapshots: DataFrame, ts: str = "snapshot_ts", columns: Sequence[str] = CHANGE_KEY,
    kept: DataFrame | None = None,
) -> DataFrame:
    """Snapshots with their key's hash as ``change_hash``, and ``is_changed`` where it
    differs from the company's snapshot before.

    ``kept`` holds ``company, change_hash`` from before the first snapshot. A company
    has one snapshot a day, so the calendar bounds its rows and a plain window holds them.
    """
    rows = snapshots.withColumn("change_hash", change_hash(columns))
    earliest = F.lit("0001-01-01 00:00:00").cast(snapshots.schema[ts].dataType)
    if kept is not None:
        past = kept.select("company", earliest.alias(ts), "change_hash")
        rows = rows.unionByName(past, allowMissingColumns=True)
    before = F.lag("change_hash").over(Window.partitionBy("company").orderBy(ts))
    marked = rows.withColumn("is_changed", ~F.col("change_hash").eqNullSafe(before))
    return marked.filter(F.col(ts) > earliest)


def changed(
    snapshots: DataFrame, ts: str = "snapshot_ts", columns: Sequence[str] = CHANGE_KEY,
    kept: DataFrame | None = None,
) -> DataFrame:
    """Snapshots whose key differs from the company's snapshot before."""
    return compared(snapshots, ts, columns, kept).filter("is_changed").drop("is_changed")
