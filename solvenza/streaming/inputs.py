"""Streams of the event table and how often they run."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from solvenza.schemas import TABLES
from solvenza.sources import tables

POLL = "3 minutes"


def event_stream(
    spark: SparkSession, root: str, pattern: str = "events*.parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """Event files as they arrive, at most ``files_per_trigger`` to a micro-batch.

    What matches ``pattern`` may be a file or a folder of part files. Files may hold
    rows of any time and come in any order.
    """
    return (
        spark.readStream.schema(TABLES["events"])
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(os.path.join(root, pattern))
    )


def observation_stream(spark: SparkSession, root: str, **options: Any) -> DataFrame:
    return tables.observations_of(event_stream(spark, root, **options))


def value_stream(spark: SparkSession, root: str, **options: Any) -> DataFrame:
    return tables.values_of(event_stream(spark, root, **options))


def item_stream(spark: SparkSession, root: str, **options: Any) -> DataFrame:
    return tables.items_of(event_stream(spark, root, **options))


def poll(available_now: bool = False) -> dict[str, Any]:
    """Trigger arguments: once over what there is, or every three minutes."""
    return {"availableNow": True} if available_now else {"processingTime": POLL}
