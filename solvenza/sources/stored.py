"""Entities kept as tables of their own, read under their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from solvenza import schemas

ENTITIES = {
    "catalog": schemas.CATALOG,
    "portfolio": schemas.PORTFOLIO,
    "add_requests": schemas.ADD_REQUESTS,
    "notifications": schemas.NOTIFICATIONS,
    "metrics": schemas.METRICS,
    "statements": schemas.STATEMENTS,
    "news_items": schemas.NEWS_ITEMS,
    "grade_observations": schemas.GRADE_OBSERVATIONS,
    "credit_points": schemas.CREDIT_POINTS,
    "features": schemas.FEATURES,
}


def read(spark: SparkSession, entity: str, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.schema(ENTITIES[entity]).format(file_format).load(path)


def stream(spark: SparkSession, entity: str, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(ENTITIES[entity]).format(file_format).load(path)
