"""What several operators share: tables, stages written to the shared folder, null-safe keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from solvenza import session
from solvenza.session import shared_dir

# What separates words: space and the five control characters from tab on.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
# Bytes that a task gets at a time, and rows that it hands back.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS_OUT = 4096


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once per application, as ``--py-files`` does.

    Also bounds the batches that Python gets by bytes: texts differ in length by orders
    of magnitude, and a batch is held several times while it is read. A bound that is
    set lower already stays.
    """
    if int(spark.conf.get(_BATCH_BYTES).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    session.ship(spark)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as a table to the cluster's shared folder and read again.

    Cuts the lineage, survives lost executors, and gives joins inputs that come
    straight from a shuffle, so that adaptive execution can split frequent keys.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of id and text that is never NULL: rows equal in both share it."""
    present = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc_id, text)]
    return F.xxhash64(*present, F.col(doc_id).isNull(), F.col(text).isNull())


def map_rows(df: DataFrame, schema: str | T.StructType, function: Any) -> DataFrame:
    """``mapInArrow`` with tuples: ``function`` gets an iterator of column lists, one
    per Arrow batch, and yields tuples in the order of ``schema``."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(function(map(column_lists, batches)), arrow)

    return df.mapInArrow(run, kind)


def column_lists(batch: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def to_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def bit_table(keys: DataFrame, key: str, bits: int) -> bytearray:
    """A bit for every 64-bit ``key``, at its lowest bits. Spark combines them by blocks of
    4 KB, so what reaches the driver has the size of the table, however many keys."""
    bits = max(bits, 1 << 15)       # a power of two
    at = F.pmod(key, F.lit(bits)) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    found = bytearray(bits // 8)
    for r in blocks.toLocalIterator():
        found[(r.block - 1) << 12: r.block << 12] = r.bits
    return found


def maybe_repeated(df: DataFrame, key: str, bits: int) -> DataFrame:
    """The rows of ``df`` whose 64-bit ``key`` occurs more than once, and few others, told
    without a shuffle by a table of a fixed size. With very many keys most others pass."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return maybe_in(df, key, bit_table(twice, key, bits))


def maybe_in(df: DataFrame, key: str, table: bytearray) -> DataFrame:
    """The rows of ``df`` whose 64-bit ``key`` has its bit set."""
    held, place = df.sparkSession.sparkContext.broadcast(bytes(table)), df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(bits_of(batch.column(place), held.value))

    return df.mapInArrow(run, df.schema)


def bits_of(keys: pa.Array, table: bytes) -> pa.Array:
    """Whether the bit of each key is set."""
    return pa.array(has_bit(keys.to_numpy().view(np.uint64), table))


def has_bit(keys: np.ndarray, table: bytes) -> np.ndarray:
    at = keys & np.uint64(8 * len(table) - 1)
    found = np.frombuffer(table, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
    return found.astype(bool)
