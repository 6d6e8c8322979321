"""Writers for feature rows and managed lists."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from solvenza.schemas import FEATURE_TYPES, FEATURES


def feature_columns(rows: DataFrame, *beside: str) -> DataFrame:
    """The 15 sink columns in their order and types, after the columns ``beside``."""
    return rows.select(*beside, *[F.col(name).cast(kind).alias(name) for name, kind in FEATURE_TYPES.items()])


def append_features(rows: DataFrame, path: str, file_format: str = "parquet") -> None:
    writer = feature_columns(rows).write.mode("append")
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


def read_features(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(FEATURES)
    if file_format == "csv":
        reader = reader.option("header", True)
    return reader.format(file_format).load(path)


MANAGED = "owner INT, stored STRING, saved BIGINT"


def write_managed(lists: DataFrame, path: str) -> None:
    """Save stored lists over what is there, per owner: rows are appended with the time of
    the save, and readers take each owner's newest."""
    saved = lists.select("owner", "stored", F.lit(time.time_ns()).alias("saved"))
    saved.write.mode("append").parquet(path)


def read_managed(spark: SparkSession, path: str) -> DataFrame:
    saves = spark.read.schema(MANAGED).parquet(path)
    return saves.groupBy("owner").agg(F.max_by("stored", "saved").alias("stored"))
