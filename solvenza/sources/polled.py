"""Stored service responses as a streaming source: every poll is read once.

``store`` keeps the responses of one poll as a folder ``poll=N`` of JSON lines. The stream
``stored_responses`` has the number of polls as its offset: Spark notes it in the
checkpoint, so a restarted stream goes on with the first poll that it has not taken in.
A poll counts when its folder is complete, and polls are taken in order.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from solvenza.session import by_value

SCHEMA = "poll BIGINT, source STRING, body STRING"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store behind a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def store(responses: DataFrame, path: str, poll: int) -> None:
    """Keep the (source, body) rows of one poll; polls count from 0 without gaps."""
    responses.select("source", "body").write.json(os.path.join(path, f"poll={poll}"))


def register(spark: SparkSession, source: type[DataSource]) -> None:
    by_value(__name__, source.__module__)
    spark.dataSource.register(source)


def stream(spark: SparkSession, path: str) -> DataFrame:
    register(spark, StoredResponses)
    return spark.readStream.format(StoredResponses.name()).option("path", path).load()


class StoredResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_responses"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PollReader(self.options["path"])


@dataclass
class ResponseFile(InputPartition):
    poll: int
    path: str


class PollReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self._path = path

    def _folder(self, poll: int) -> tuple[fs.FileSystem, str]:
        files, base = file_system(self._path)
        return files, f"{base}/poll={poll}"

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        polls = getattr(self, "_polls", 0)
        while self._complete(polls):
            polls += 1
        self._polls = polls
        return {"polls": polls}

    def _complete(self, poll: int) -> bool:
        files, folder = self._folder(poll)
        return files.get_file_info(f"{folder}/_SUCCESS").type == fs.FileType.File

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        found = []
        for poll in range(start["polls"], end["polls"]):
            files, folder = self._folder(poll)
            for info in files.get_file_info(fs.FileSelector(folder)):
                if info.is_file and info.extension == "json":
                    found.append(ResponseFile(poll, info.path))
        return found

    def read(self, partition: ResponseFile) -> Iterator[tuple]:
        files, _ = file_system(self._path)
        with files.open_input_stream(partition.path) as stored:
            for line in _lines(stored):
                row = json.loads(line)
                yield partition.poll, row.get("source"), row.get("body")

    def commit(self, end: dict) -> None:
        """The responses stay where they are."""


def _lines(stream: fs.FileSystem, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from (line for line in whole if line)
    if rest:
        yield rest
