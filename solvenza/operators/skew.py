"""A join that splits the rows of frequent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from solvenza.operators.ordered import SPLIT_ROWS


def join_split(
    rows: DataFrame, per_key: DataFrame, counts: DataFrame, key: str, spread: Column,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row per key.

    ``counts`` has ``key`` and ``n``, the rows of each key. A key with more than
    ``split_rows`` rows is spread over several join keys by the hash of ``spread``
    and its ``per_key`` row repeated for each. There are at most ``1 / split_rows``
    as many such keys as rows, which bounds the broadcast: 200,000 short rows for
    10^12.

    Adaptive execution splits a skewed join by itself only when both inputs come
    straight from a shuffle; this is for a ``per_key`` that is itself the result of
    joins or an aggregation on the key.
    """
    splits = F.ceil(F.col("n") / split_rows).cast("int")
    frequent = counts.filter(F.col("n") > split_rows).select(key, splits.alias("_splits"))
    salt = F.when(
        F.col("_splits").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_splits")).cast("int")
    ).otherwise(0)
    salted = rows.join(F.broadcast(frequent), key, "left").withColumn("_salt", salt).drop("_splits")
    repeated = (
        per_key.join(F.broadcast(frequent), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)))
        .drop("_splits")
    )
    return salted.join(repeated, [key, "_salt"]).drop("_salt")
