"""Metrics kept by fiscal year, so that a choice of years opens those folders only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from solvenza.schemas import METRICS

# Where a user's first and last selectable year lie is up to them; a table of chosen
# years is one row per year, which bounds its broadcast.
YEAR = "fiscal_year"


def save(metrics: DataFrame, path: str) -> None:
    """Replace the folders of the years in ``metrics``; other years stay."""
    columns = [c.split()[0] for c in METRICS.split(", ")]
    metrics.select(*columns).repartition(YEAR, "company").write.mode("overwrite").partitionBy(YEAR).option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path)


def of_years(metrics: DataFrame, years: DataFrame) -> DataFrame:
    """The metrics of the years in the ``fiscal_year`` column of ``years``. The years are
    only known at run time; the scan waits for them and skips all other folders."""
    return metrics.join(F.broadcast(years.select(YEAR).distinct()), YEAR, "left_semi")
