"""Rating alerts and the notification inbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from solvenza.functions import labels, scalars as S
from solvenza.operators import grades, ordered
from solvenza.schemas import LOWERED, RAISED, WARNING_GROWTH

# Alert titles.
_LOWERED_TITLE = ("신용 등급이 ", "로 하향 조정되었습니다.")
_RAISED_TITLE = ("신용 등급이 ", "로 상향 조정되었습니다.")
_WARNING_TITLE = "등급 하향 가능성이 있습니다."

_COLUMNS = ["id", "type", "company", "title", "rating_change", "news_keywords", "ts"]


def alert_columns(changes: DataFrame) -> DataFrame:
    """Alerts of observations that carry their direction and change text."""
    lowered = F.col("direction") == LOWERED
    grade = F.col("grade")
    return changes.select(
        "id",
        F.when(lowered, "down").otherwise("up").alias("type"),
        "company",
        F.when(lowered, F.concat(F.lit(_LOWERED_TITLE[0]), grade, F.lit(_LOWERED_TITLE[1])))
        .otherwise(F.concat(F.lit(_RAISED_TITLE[0]), grade, F.lit(_RAISED_TITLE[1])))
        .alias("title"),
        F.col("last_change").alias("rating_change"),
        "news_keywords", "ts",
    )


def grade_alerts(observations: DataFrame) -> DataFrame:
    """``up`` and ``down`` alerts, one per observation that moved the grade."""
    changes = grades.with_changes(observations)
    return alert_columns(changes.filter(F.col("direction").isin(RAISED, LOWERED)))


def news_warnings(
    observations: DataFrame, items: DataFrame, growth: float = WARNING_GROWTH
) -> DataFrame:
    """``warning`` alerts: negative news grew by ``growth`` or more over a week in
    which no observation moved the grade.

    A rule of our own choice. The alert takes the id, time and headline of the week's
    last negative article. The window runs over the weeks of a company.
    """
    negative = F.col("sentiment") == "negative"
    last = F.when(negative, S.moment("published_at", "id"))
    weeks = (
        items.withColumn("week_start", F.window("published_at", "7 days").getField("start"))
        .groupBy("company", "week_start")
        .agg(
            F.count_if(negative).alias("_n"), F.max_by("id", last).alias("id"),
            F.max_by("published_at", last).alias("ts"),
        )
    )
    week_number = F.unix_date(F.col("week_start").cast("date"))
    before = F.first("_n").over(
        Window.partitionBy("company").orderBy(week_number).rangeBetween(-7, -7)
    )
    rising = weeks.withColumn("_before", before).filter(
        F.try_divide(F.col("_n") - F.col("_before"), F.col("_before")) >= growth
    )
    moved = grades.moved_weeks(observations)
    warned = rising.join(moved, ["company", "week_start"], "left_anti").select("company", "id", "ts")
    # The headline is text, which would make the aggregate sort; it is fetched for the
    # few weeks that warn.
    headlines = items.filter(negative).select(
        "company", "id", F.col("published_at").alias("ts"), F.col("title").alias("news_keywords")
    )
    return warning_columns(warned.join(headlines, ["company", "id", "ts"]))


def warning_columns(warned: DataFrame) -> DataFrame:
    """Alerts of the articles that close a week that warns."""
    return warned.select(
        "id",
        F.lit("warning").alias("type"),
        "company",
        F.lit(_WARNING_TITLE).alias("title"),
        F.lit(None).cast("string").alias("rating_change"),
        "news_keywords", "ts",
    )


def rating_alerts(
    observations: DataFrame, items: DataFrame, growth: float = WARNING_GROWTH
) -> DataFrame:
    return grade_alerts(observations).unionByName(
        news_warnings(observations, items, growth)
    ).select(*_COLUMNS)


# --- inbox ------------------------------------------------------------------

def mark_read(notifications: DataFrame, read_ids: DataFrame) -> DataFrame:
    """Set ``is_read`` on every notification whose id is in ``read_ids``.

    By id, not by row: copies of one id change together. Read ids arrive as a table
    of their own, so marking never rewrites the feed.
    """
    receipts = read_ids.select("id").distinct().withColumn("_receipt", F.lit(True))
    was_read = F.col("is_read") if "is_read" in notifications.columns else F.lit(False)
    return (
        notifications.join(receipts, "id", "left")
        .withColumn("is_read", was_read | F.coalesce("_receipt", F.lit(False)))
        .drop("_receipt")
    )


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.filter(~F.col("is_read"))


def read(notifications: DataFrame) -> DataFrame:
    return notifications.filter("is_read")


def summary(notifications: DataFrame) -> DataFrame:
    return notifications.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(~F.col("is_read")).alias("n_unread"),
        F.count_if(F.col("is_read")).alias("n_read"),
    )


def with_ordinal(notifications: DataFrame, inbox: str = "inbox") -> DataFrame:
    """Number each inbox from 1, the oldest notification first.

    There are few inboxes, so all are sliced, which makes the feed once.
    """
    return ordered.position(notifications, [inbox], ["ts", "id"], "ordinal")


def newest_first(notifications: DataFrame) -> DataFrame:
    return notifications.orderBy(F.desc("ts"), F.desc("id"))


def view(notifications: DataFrame) -> DataFrame:
    return notifications.select(
        "id", "company",
        labels.notification_label(F.col("type")).alias("type_label"),
        labels.read_label(F.col("is_read")).alias("read_label"),
        "title", "rating_change", "news_keywords",
        S.full_time_label(F.col("ts")).alias("time_text"),
    )
