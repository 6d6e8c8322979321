"""Ordered per-key operators that never hold a frequent key in one task.

A plain window over ``partitionBy(key)`` sends every row of a key to one task, so
a key with a third of the rows decides the run time. The operators here cut the rows of
frequent keys into slices: a range partition over key and order, of about ``split_rows``
rows each, however the rows lie in time. The window runs inside ``(key, slice)``, one
summary row per slice is carried forward over the slices of its key, and the carried
state is joined back. Results equal those of the plain window. Every row needs a key, and
``order`` has no ties within it.

Keys are counted first, which is one map-side combined job; a slice must be the same
wherever it is read, so sliced rows are written to the shared folder. Where no key is
frequent, nothing is cut, and the plan is that of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from solvenza.session import shared_dir

# Rows of one key that one task may hold.
SPLIT_ROWS = 5_000_000

# The slice of a frequent key's row; NULL for the rows of other keys.
_SLICE = "_slice"


def frequent_keys(df: DataFrame, keys: Sequence[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Keys with more than ``split_rows`` rows, and how many; at most one key per
    ``split_rows`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > split_rows)


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """``df`` written in ranges of key and order, with the number of the range."""
    ranges = [slices] if slices else []
    placed = df.repartitionByRange(*ranges, *keys, *order).withColumn(_SLICE, F.spark_partition_id())
    spark = df.sparkSession
    path = shared_dir(spark, "slices")
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def in_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], split_rows: int = SPLIT_ROWS
) -> tuple[DataFrame, bool]:
    """``df`` with the rows of frequent keys sliced, and whether there are any."""
    frequent = frequent_keys(df, keys, split_rows)
    rows = frequent.agg(F.sum("n")).first()[0]
    if not rows:
        return df.withColumn(_SLICE, F.lit(None).cast("int")), False
    # Small by construction: see ``frequent_keys``.
    marked = df.join(F.broadcast(frequent.withColumnRenamed("n", "_many")), list(keys), "left")
    cut = sliced(marked.filter("_many IS NOT NULL").drop("_many"), keys, order, -(-rows // max(1, split_rows)))
    others = marked.filter("_many IS NULL").drop("_many").withColumn(_SLICE, F.lit(None).cast("int"))
    return others.unionByName(cut), True


def slice_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, _SLICE).orderBy(*order)


def up_to_here(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_here(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def carry_over(
    local: DataFrame,
    keys: Sequence[str],
    summary: Sequence[Column],
    carry: Callable[[DataFrame, WindowSpec], DataFrame],
    carried: dict[str, str],
    cut: bool,
) -> DataFrame:
    """Give every row what the earlier slices of its key hand over, NULL if none do.

    ``summary`` aggregates one slice; ``carry`` turns the summaries, given the window
    over a key's slices, into the columns ``carried`` (name to type) to join back. There
    is one summary per ``split_rows`` rows of a frequent key.
    """
    if not cut:
        return local.drop(_SLICE).withColumns({n: F.lit(None).cast(t) for n, t in carried.items()})
    summaries = local.filter(F.col(_SLICE).isNotNull()).groupBy(*keys, _SLICE).agg(*summary)
    handed = carry(summaries, Window.partitionBy(*keys).orderBy(_SLICE))
    return local.join(handed.select(*keys, _SLICE, *carried), [*keys, _SLICE], "left").drop(_SLICE)


def latest_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, into: str,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Latest non-NULL ``value`` per key at or before each row."""
    kind = df.select(value.alias("v")).schema[0].dataType.simpleString()
    rows, cut = in_slices(df, keys, order, split_rows)
    w = slice_window(keys, order)
    known = F.last(value, ignorenulls=True).over(up_to_here(w))
    local = rows.select("*", known.alias("_known"), F.lead(F.lit(1)).over(w).isNull().alias("_ends"))
    joined = carry_over(
        local, keys, [F.max(F.when(F.col("_ends"), F.col("_known"))).alias("_slice_known")],
        lambda s, over: s.withColumn(
            "_carried", F.last("_slice_known", ignorenulls=True).over(before_here(over))
        ),
        {"_carried": kind}, cut,
    )
    return joined.withColumn(into, F.coalesce("_known", "_carried")).drop("_known", "_ends", "_carried")


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str, slices: int | None = None
) -> DataFrame:
    """1-based position per key, as BIGINT.

    For few keys with many rows: all rows are sliced, without counting the keys before.
    """
    rows = sliced(df, keys, order, slices)
    counts = rows.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    ahead = F.sum("_rows").over(before_here(Window.partitionBy(*keys).orderBy(_SLICE)))
    ahead = counts.select(*keys, _SLICE, F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    local = rows.withColumn("_n", F.row_number().over(slice_window(keys, order)))
    placed = local.join(ahead, [*keys, _SLICE])
    return placed.withColumn(into, F.col("_ahead") + F.col("_n")).drop("_n", "_ahead", _SLICE)
