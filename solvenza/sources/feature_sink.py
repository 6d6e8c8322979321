"""Feature rows written by a stream, each micro-batch once.

The sink ``feature_rows`` writes a file per task. Only when all tasks of a batch are done,
the driver notes their files under the batch's number; a batch that is noted already is
not noted again, and the files of a batch that fails are removed. Readers take the files
that are noted, so neither a failed task nor a repeated batch shows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from solvenza.session import on_disk_state
from solvenza.sources.polled import file_system, register
from solvenza.streaming.inputs import poll


def start(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    spark = rows.sparkSession
    register(spark, FeatureRows)
    out = rows.writeStream.format(FeatureRows.name()).option("path", path)
    with on_disk_state(spark):
        return out.option("checkpointLocation", checkpoint).trigger(**poll(available_now)).start()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all noted files; none before the first batch."""
    files, base = file_system(path)
    if files.get_file_info(f"{base}/noted").type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    noted = spark.read.schema("files ARRAY<STRING>").json(f"{path}/noted/*.json").select(F.explode("files").alias("_file"))
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.withColumn("_file", F.col("_metadata.file_name")).join(noted, "_file", "left_semi").drop("_file")


class FeatureRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_rows"

    def streamWriter(self, schema: StructType, overwrite: bool) -> "FeatureWriter":
        return FeatureWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class FeatureWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self._path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = file_system(self._path)
        name, writer = f"{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if writer is None:
                files.create_dir(f"{base}/rows", recursive=True)
                writer = pq.ParquetWriter(f"{base}/rows/{name}", batch.schema, filesystem=files)
            writer.write_batch(batch)
        if writer is None:
            return Written(None)
        writer.close()
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, base = file_system(self._path)
        noted = f"{base}/noted/{batchId:012}.json"
        if files.get_file_info(noted).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)
        files.create_dir(f"{base}/noted", recursive=True)
        files.create_dir(f"{base}/rows", recursive=True)
        # Readers see a note whole or not at all.
        hidden = f"{base}/noted/.{batchId:012}-{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as out:
            out.write(json.dumps({"files": [m.file for m in messages if m and m.file]}).encode())
        files.move(hidden, noted)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        files, base = file_system(self._path)
        for m in messages:
            if m and m.file and files.get_file_info(f"{base}/rows/{m.file}").type != fs.FileType.NotFound:
                files.delete_file(f"{base}/rows/{m.file}")
