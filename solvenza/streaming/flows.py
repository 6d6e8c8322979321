"""Grade, news, alert and feature flows on streams, on Spark's own state.

Each flow gives what its batch operator gives over all rows that have arrived, for any
layout of the files and any order of the rows.

* Buckets and weekly counts are windowed aggregates in update mode. A window stays open
  for late rows for 180 days of event time; then the watermark ends its state.
* What compares a company's rows with each other keeps keyed state (``processors``) and
  appends to Spark's file sink, which takes every micro-batch once.

State, its versions, restarts and clean-up are the state store's and the checkpoint's. The
tables that are written hold versions: a row that is told again, because a late one came
before it, has a greater version, and ``served`` takes the greatest of each.

A company is one key of the state, so its rows of a micro-batch go to one task; the files
of a micro-batch are bounded (``inputs.event_stream``), and with them what a hot company
brings at a time.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from solvenza.functions import scalars as S
from solvenza.operators import alerts, features, grades, news
from solvenza.schemas import BUCKET, LOWERED, NEWS_DAYS, NEWS_LIMIT, RAISED, RETENTION_DAYS, SENTIMENTS, WARNING_GROWTH
from solvenza.session import by_value, on_disk_state
from solvenza.sources import responses
from solvenza.streaming import processors
from solvenza.streaming.inputs import poll
from solvenza.streaming.processors import WEEK, Follow, LatestNews, NewsWeeks, Sources


@dataclass(frozen=True)
class Flow:
    """``online`` turns streams into rows of ``schema``, ``served`` the rows written so far
    into the result. With ``updates`` the rows are a window's new values."""
    online: Callable[..., DataFrame]
    served: Callable[[DataFrame], DataFrame]
    schema: str
    updates: bool = False


def keyed(rows: DataFrame, processor: StatefulProcessor, time_mode: str = "None") -> DataFrame:
    """``rows`` through keyed state per company."""
    by_value(processors.__name__)
    return rows.groupBy("company").transformWithStateInPandas(processor, processor.OUT, "Append", time_mode)


def newest(rows: DataFrame, *keys: str, version: str = "version") -> DataFrame:
    """The row of the greatest version of each key."""
    values = [c for c in rows.columns if c not in (*keys, version)]
    return rows.groupBy(*keys).agg(*[F.max_by(c, version).alias(c) for c in values])


def _retained(rows: DataFrame, ts: str, days: int) -> DataFrame:
    return grades.retained(rows, ts, rows.agg(F.max(ts).alias("_newest")).scalar(), days)


def _seen(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """With the clock time as an instant, late by ``days`` at most."""
    return rows.withColumn("seen", F.timestamp_micros(S.micros(F.col(ts)))).withWatermark("seen", f"{days} days")


def _clock(instant: str):
    return S.from_micros(F.unix_micros(instant))


# --- windows --------------------------------------------------------------------

def _bucket_updates(observations: DataFrame) -> DataFrame:
    points = _seen(grades.on_scale(observations), "ts", RETENTION_DAYS)
    last = points.groupBy("company", F.window("seen", BUCKET).alias("w")).agg(
        F.max_by("score", S.moment("ts", "id")).alias("score"))
    return last.select("company", _clock("w.start").alias("bucket_start"), "score")


def _served_buckets(rows: DataFrame) -> DataFrame:
    return _retained(newest(rows, "company", "bucket_start", version="batch_id"), "bucket_start", RETENTION_DAYS)


def _week_updates(items: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("sentiment") == kind).alias(kind) for kind in SENTIMENTS]
    weeks = _seen(items, "published_at", RETENTION_DAYS).groupBy("company", F.window("seen", "7 days").alias("w"))
    return weeks.agg(*counts).select("company", _clock("w.start").alias("week_start"), *SENTIMENTS)


BUCKETS = Flow(
    _bucket_updates, _served_buckets, "company BIGINT, bucket_start TIMESTAMP_NTZ, score INT", updates=True)
WEEKLY_SENTIMENT = Flow(
    _week_updates, lambda rows: newest(rows, "company", "week_start", version="batch_id"),
    "company BIGINT, week_start TIMESTAMP_NTZ, " + ", ".join(f"{s} BIGINT" for s in SENTIMENTS), updates=True)


# --- comparisons ----------------------------------------------------------------

def _followed(observations: DataFrame) -> DataFrame:
    scored = grades.on_scale(observations).select(
        "company", S.micros(F.col("ts")).alias("at"), "id", F.col("score").cast("string").alias("value"),
        F.col("news_keywords").alias("payload"))
    return keyed(scored, Follow(RETENTION_DAYS))


def _served_changes(rows: DataFrame) -> DataFrame:
    """Observations inside the retention as ``grades.follow`` has them."""
    number = lambda c: F.col(c).cast("int")
    found = newest(rows, "company", "at", "id").select(
        "company", "id", S.from_micros(F.col("at")).alias("ts"), F.col("payload").alias("news_keywords"),
        number("value").alias("score"), number("before").alias("prev_score"),
        grades.change_code(number("change_from"), number("change_to")).alias("change"),
    )
    return _retained(found, "ts", RETENTION_DAYS)


CHANGES = Flow(_followed, _served_changes, Follow.OUT)


def alerts_of(followed: DataFrame) -> DataFrame:
    """``up`` and ``down`` alerts of followed observations."""
    moved = grades.described(followed).filter(F.col("direction").isin(RAISED, LOWERED))
    return alerts.alert_columns(moved)


def features_flow(snapshots: T.StructType) -> Flow:
    """Feature snapshots whose key differs from the one before; ``snapshots`` is their
    schema."""
    own = "company", "snapshot_ts"
    kept = T.StructType([f for f in snapshots if f.name not in own])

    def online(arriving: DataFrame) -> DataFrame:
        values = F.struct(*kept.names)
        return keyed(arriving.select(
            "company", S.micros(F.col("snapshot_ts")).alias("at"), F.lit(0).cast("bigint").alias("id"),
            features.change_hash().alias("value"), F.to_json(values).alias("payload"),
        ), Follow(RETENTION_DAYS))

    def served(rows: DataFrame) -> DataFrame:
        found = newest(rows, "company", "at", "id").filter("NOT value <=> before")
        return _retained(found.select(
            "company", S.from_micros(F.col("at")).alias("snapshot_ts"), F.from_json("payload", kept).alias("v"),
        ).select(*own, "v.*"), "snapshot_ts", RETENTION_DAYS)

    return Flow(online, served, Follow.OUT)


# --- news -----------------------------------------------------------------------

def _weeks_that_warn(observations: DataFrame, items: DataFrame) -> DataFrame:
    moves = grades.on_scale(observations).select(
        "company", S.micros(F.col("ts")).alias("at"), "id", F.lit("grade").alias("kind"),
        F.col("score").cast("string").alias("value"), F.lit(None).cast("string").alias("payload"))
    articles = items.select(
        "company", S.micros(F.col("published_at")).alias("at"), "id", F.lit("news").alias("kind"),
        F.col("sentiment").alias("value"), F.col("title").alias("payload"))
    return keyed(moves.unionByName(articles), NewsWeeks(WARNING_GROWTH, RETENTION_DAYS))


def _served_warnings(rows: DataFrame) -> DataFrame:
    warned = newest(rows, "company", "week").filter("warns").select(
        "company", "id", S.from_micros(F.col("at")).alias("ts"), F.col("payload").alias("news_keywords"))
    return alerts.warning_columns(warned)


WARNINGS = Flow(_weeks_that_warn, _served_warnings, NewsWeeks.OUT)


def _latest_news(items: DataFrame) -> DataFrame:
    seen = _seen(items, "published_at", NEWS_DAYS)
    return keyed(
        seen.select("company", S.micros(F.col("published_at")).alias("at"), "id", "sentiment", "seen"),
        LatestNews(NEWS_LIMIT), "EventTime")


def _served_news(rows: DataFrame) -> DataFrame:
    """The sentiment block of every company as of the newest article of all."""
    items = newest(rows, "company").select("company", F.inline(F.arrays_zip("at", "sentiment")))
    end = items.agg(F.max("at").alias("_asof")).scalar()
    recent = items.filter((F.col("at") > end - NEWS_DAYS * WEEK // 7) & (F.col("at") <= end))
    recent = recent.select("company", S.from_micros(F.col("at")).alias("published_at"), "sentiment")
    return news.block_of(recent, S.from_micros(end))


NEWS_BLOCKS = Flow(_latest_news, _served_news, LatestNews.OUT)


# --- features on live data --------------------------------------------------------

def ready_features(polled: DataFrame) -> DataFrame:
    """Feature rows of the companies of which all four services have spoken, each as soon
    as the last response is there and again when one changes, with ``ready`` and
    ``version``."""
    told = keyed(responses.said(polled), Sources(responses.SOURCES))
    beside = "ready", "version"
    return features.feature_row(responses.joined(told), beside=beside)


def served_features(rows: DataFrame) -> DataFrame:
    return newest(rows, "company").filter("ready").drop("ready")


# --- running ------------------------------------------------------------------

def _rows(path: str) -> str:
    return os.path.join(path, "rows")


def start(flow: Flow, path: str, *streams: DataFrame, available_now: bool = False) -> StreamingQuery:
    """Run the flow, with its rows and its checkpoint below ``path``.

    New values of windows are written per micro-batch, each to a folder of its own that a
    batch that runs again replaces; appended rows go through the file sink.
    """
    spark = streams[0].sparkSession
    out = flow.online(*streams).writeStream.option("checkpointLocation", os.path.join(path, "checkpoint"))
    out = out.trigger(**poll(available_now))
    # Readers find the columns before the first row.
    nothing = spark.createDataFrame([], flow.schema).coalesce(1)
    nothing.write.mode("ignore").parquet(os.path.join(_rows(path), *(["batch_id=-1"] if flow.updates else [])))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(_rows(path), f"batch_id={batch_id}"))

    with on_disk_state(spark):
        if flow.updates:
            return out.outputMode("update").foreachBatch(write).start()
        return out.outputMode("append").format("parquet").option("path", _rows(path)).start()


def served(spark: SparkSession, flow: Flow, path: str) -> DataFrame:
    schema = flow.schema + (", batch_id BIGINT" if flow.updates else "")
    return flow.served(spark.read.schema(schema).parquet(_rows(path)))


def run_available(flow: Flow, path: str, *streams: DataFrame) -> DataFrame:
    """Process what the sources hold now; returns what the flow serves."""
    start(flow, path, *streams, available_now=True).awaitTermination()
    return served(streams[0].sparkSession, flow, path)
