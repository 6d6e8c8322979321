"""Grade observations: direction, last change, buckets, retention, as-of lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from solvenza.functions import labels, scalars as S
from solvenza.operators import ordered
from solvenza.schemas import GRADE_SCALE, RETENTION_DAYS

_N = len(GRADE_SCALE)
_ORDER = ["ts", "id"]


def on_scale(observations: DataFrame) -> DataFrame:
    """Add ``score`` and drop observations whose grade is empty or not on the scale."""
    return observations.withColumn("score", S.grade_index(F.col("grade"))).filter("score >= 0")


def follow(
    observations: DataFrame, split_rows: int = ordered.SPLIT_ROWS, kept: DataFrame | None = None,
) -> DataFrame:
    """Each observation's score with the one before it and the latest change.

    A change is one integer, ``before * 20 + after``; the ``grade`` text is dropped.
    So rows and slice summaries stay narrow, and summaries aggregate in fixed-width
    hash buffers. ``kept`` holds ``company, score, change`` from before the first row.
    """
    scored = on_scale(observations).drop("grade")
    rows = scored.withColumn("_kept", F.lit(None).cast("int"))
    if kept is not None:
        rows = rows.unionByName(_past(kept, scored), allowMissingColumns=True)
    parts, cut = ordered.in_slices(rows, ["company"], _ORDER, split_rows)
    w = ordered.slice_window(["company"], _ORDER)
    local = parts.select(
        "*", F.lag("score").over(w).alias("_before"), F.lead("score").over(w).alias("_after")
    )
    change = F.coalesce("_kept", change_code(F.col("_before"), F.col("score")))
    local = local.withColumn(
        "_change", F.last(change, ignorenulls=True).over(ordered.up_to_here(w))
    ).withColumn("_first", F.first("score").over(ordered.up_to_here(w)))

    def carry(summaries: DataFrame, over: WindowSpec) -> DataFrame:
        handed = summaries.withColumn("_carried_score", F.lag("_last").over(over))
        handed = handed.withColumn("_entry", change_code(F.col("_carried_score"), F.col("_opening")))
        earlier = F.last(F.coalesce("_slice_change", "_entry"), ignorenulls=True)
        change = F.coalesce(F.col("_entry"), earlier.over(ordered.before_here(over)))
        return handed.withColumn("_carried_change", change)

    ends = F.col("_after").isNull()
    joined = ordered.carry_over(
        local, ["company"],
        [
            F.max(F.when(ends, F.col("_first"))).alias("_opening"),
            F.max(F.when(ends, F.col("score"))).alias("_last"),
            F.max(F.when(ends, F.col("_change"))).alias("_slice_change"),
        ],
        carry, {"_carried_score": "int", "_carried_change": "int"}, cut,
    )
    if kept is not None:
        joined = joined.filter(F.col("ts") > _before_all(scored))
    return joined.select(
        *[F.col(c) for c in scored.columns],
        F.coalesce("_before", "_carried_score").alias("prev_score"),
        F.coalesce("_change", "_carried_change").alias("change"),
    )


def _before_all(observations: DataFrame) -> Column:
    return F.lit("0001-01-01 00:00:00").cast(observations.schema["ts"].dataType)


def _past(kept: DataFrame, observations: DataFrame) -> DataFrame:
    """The kept state as one row per company ahead of all observations."""
    return kept.select(
        "company", _before_all(observations).alias("ts"), "score", F.col("change").alias("_kept")
    )


def described(followed: DataFrame) -> DataFrame:
    """Add grade, direction and the "before → after" text to followed observations."""
    change = F.col("change")
    text = S.change_text(S.grade_label(F.floor(change / _N)), S.grade_label(change % _N))
    return followed.select(
        *[F.col(c) for c in followed.columns if c != "change"],
        S.grade_label(F.col("score")).alias("grade"),
        S.direction(F.col("prev_score"), F.col("score")).alias("direction"),
        F.when(change.isNull(), F.lit("")).otherwise(text).alias("last_change"),
    )


def with_changes(observations: DataFrame, split_rows: int = ordered.SPLIT_ROWS) -> DataFrame:
    """Compare every observation with the one before it.

    Adds ``prev_score`` (NULL for a company's first observation), ``direction`` and
    ``last_change``, the latest "before → after" text up to the row, empty before
    any change. The comparison is with the last observation, also one of the same
    bucket, and reaches back without limit.
    """
    return described(follow(observations, split_rows))


def change_code(before: Column, now: Column) -> Column:
    return F.when(before != now, before * _N + now)


def moved_weeks(observations: DataFrame) -> DataFrame:
    """The company weeks in which at least one observation changed the grade.

    A week holds a change when it has two grades, or opens with another grade than
    the week before closed with. That needs only per-week aggregates, combined before
    the shuffle, and no order of the single rows.
    """
    weeks = (
        on_scale(observations)
        .withColumn("week_start", F.window("ts", "7 days").getField("start"))
        .groupBy("company", "week_start")
        .agg(
            F.min("score").alias("_best"), F.max("score").alias("_worst"),
            F.max_by("score", S.moment("ts", "id")).alias("_last"),
        )
    )
    before = F.lag("_last").over(Window.partitionBy("company").orderBy("week_start"))
    return (
        weeks.withColumn("_before", before)
        .filter((F.col("_best") != F.col("_worst")) | (F.col("_before") != F.col("_best")))
        .select("company", "week_start")
    )


def directions(observations: DataFrame) -> DataFrame:
    return with_changes(observations).select(
        "company", "id", "ts", "grade", "score", "direction",
        labels.direction_label(F.col("direction")).alias("direction_label"),
    )


def last_of_buckets(observations: DataFrame, minutes: int = 3) -> DataFrame:
    """The last observation of every company and bucket, with its time and id."""
    points = on_scale(observations).select(
        "company", S.bucket_start(F.col("ts"), minutes).alias("bucket_start"), "score", "ts", "id",
        S.moment("ts", "id").alias("_moment"),
    )
    last = [F.max_by(c, "_moment").alias(c) for c in ("score", "ts", "id")]
    return points.groupBy("company", "bucket_start").agg(*last).withColumn(
        "label", S.grade_label(F.col("score"))
    )


def credit_buckets(observations: DataFrame, minutes: int = 3) -> DataFrame:
    """The last grade of every company and bucket."""
    return last_of_buckets(observations, minutes).drop("ts", "id")


def in_time_order(points: DataFrame) -> DataFrame:
    return points.orderBy("company", "bucket_start")


def extent(points: DataFrame) -> DataFrame:
    return points.groupBy("company").agg(
        F.min("bucket_start").alias("first_bucket"), F.max("bucket_start").alias("last_bucket")
    )


def retained(df: DataFrame, ts: str, asof: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows at most ``days`` times 24 hours older than ``asof``, the edge included."""
    return df.filter(F.col(ts) >= asof - F.make_dt_interval(F.lit(days)))


def retained_buckets(
    observations: DataFrame, asof: Column, minutes: int = 3, days: int = RETENTION_DAYS
) -> DataFrame:
    """Buckets inside the retention.

    A kept bucket has no observation before the cutoff, so the same cutoff prunes
    the observations in the scan before they are grouped.
    """
    recent = retained(observations, "ts", asof, days)
    return retained(credit_buckets(recent, minutes), "bucket_start", asof, days)


def grade_asof(probes: DataFrame, points: DataFrame, split_rows: int = ordered.SPLIT_ROWS) -> DataFrame:
    """The grade in force at each probe: the last point at or before it.

    ``probes`` has ``company, id, ts``; ``points`` has ``company, bucket_start,
    score``. A probe before the first point has no grade and score -1.
    """
    both = points.select(
        "company", F.lit(None).cast("long").alias("id"), F.col("bucket_start").alias("ts"),
        F.lit(0).alias("side"), "score",
    ).unionByName(
        probes.select(
            "company", "id", "ts", F.lit(1).alias("side"), F.lit(None).cast("int").alias("score")
        )
    )
    known = ordered.latest_known(
        both, ["company"], ["ts", "side", "id"], F.col("score"), "score_asof", split_rows
    )
    return known.filter("side = 1").select(
        "company", "id", "ts", F.coalesce("score_asof", F.lit(-1)).alias("score_asof"),
        F.when(F.col("score_asof").isNotNull(), S.grade_label(F.col("score_asof"))).alias("grade_asof"),
    )
