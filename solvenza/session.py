"""Session settings and the shared folder for anything written between stages."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import pathlib
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Skewed shuffle partitions are split at run time and small sides become
# broadcasts only after their real size is known, so no operator carries a hint
# for data that can grow.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Stream state on disk with uploads of what changed, not in the heap.
    _PROVIDER: _ROCKSDB,
}


def build_session(app: str = "solvenza", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_folder() -> str:
    """One folder per process for local sessions, removed at its end."""
    folder = tempfile.TemporaryDirectory(prefix="solvenza-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return folder.name


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python, once per application, as ``--py-files``
    does. The archive is the driver's own; Spark serves it to the executors."""
    context = spark.sparkContext
    if getattr(context, "_solvenza_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory(prefix="solvenza-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    path = os.path.join(folder.name, "solvenza_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    context._solvenza_shipped = True


def by_value(*modules: str) -> None:
    """Send the classes of these modules with their code. Processes of the driver that
    start keyed state, list polls and note batches are not given the package as tasks are."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


@contextlib.contextmanager
def on_disk_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs a state store on disk, whatever the session's is; a query keeps the
    one that it starts with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before:
            spark.conf.set(_PROVIDER, before)
        else:
            spark.conf.unset(_PROVIDER)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    Only a local session may fall back to a folder of this machine: on a cluster
    executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _own_folder()
    return os.path.join(root, "solvenza", f"{purpose}-{uuid.uuid4().hex}")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written below the shared folder and read again: what uses it more than once
    computes it once, and lost executors lose none of it."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Short rows that much is made of, dealt evenly over the tasks of a shuffle: a table of
    few megabytes is one file, and one task would make all of it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
