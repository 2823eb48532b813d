"""Session settings, the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import contextlib
import functools
import math
import os
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# AQE splits skewed join and rebalance partitions at run time and only
# broadcasts sides whose measured size is below the threshold.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Stream state lives off the heap and is checkpointed as changes only.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


SHUFFLE_TARGET_BYTES = 256 * 1024 * 1024


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions for an input size; adaptive execution merges those that stay small."""
    return max(math.ceil(input_bytes / SHUFFLE_TARGET_BYTES), 200)


def build_session(
    app: str = "tapewright", master: str | None = None, input_bytes: int | None = None, **extra: str
) -> SparkSession:
    """A session with the library's settings; ``input_bytes`` sizes the shuffles of large jobs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sized = {"spark.sql.shuffle.partitions": str(shuffle_partitions(input_bytes))} if input_bytes else {}
    for key, value in {**SETTINGS, **sized, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextlib.contextmanager
def sized(spark: SparkSession, input_bytes: int):
    """Shuffles sized for an input while the scope lasts; a larger setting stays."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if input_bytes > SHUFFLE_TARGET_BYTES:
        spark.conf.set(name, str(max(int(before), shuffle_partitions(input_bytes))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def small_splits(spark: SparkSession, most: int = 16 * 1024 * 1024):
    """Tasks read at most ``most`` bytes of a file, but a whole row group, while the scope lasts; a smaller setting stays.

    A task that sorts all that it reads then needs the same memory for any size of table.
    """
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > most:
        spark.conf.set(name, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Python functions get their rows in Arrow batches of ``most`` at most while the scope lasts; a smaller setting stays.

    Rows of several kilobytes in batches of the usual 10,000 fill the memory of the JVM and of the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def whole_state(spark: SparkSession):
    """Streams that start while the scope lasts checkpoint their state whole, RocksDB's new files only, not as changes.

    A run that goes on from such a checkpoint loads the state as it is. From changes alone it would repeat all of them
    since the beginning, those of keys long released, too.
    """
    name = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tapewright-")


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the intermediate tables that ``materialize`` writes inside the scope when it ends."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table that was written below ``scratch_path`` and is no longer read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Land a written folder at ``target`` as a whole; one that was not written, for want of rows, lands as an empty one."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    old, new = Path(source), Path(target)
    system = new.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(new.getParent() if system.exists(old) else new)
    if system.exists(old) and not system.rename(old, new):
        raise OSError(f"{source} cannot be moved to {target}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names.

    Only a single-machine master may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_if_present(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A Parquet table, or None when nothing has been written to ``path`` yet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so a lost executor re-reads files instead of recomputing, and
    gives the planner the real file size, so that it can pick a broadcast join
    for a small lookup table and a shuffled join for a large one.
    """
    path = scratch_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _zipped() -> str:
    """This package as a zip file below a folder of the driver, from where Spark serves it."""
    package = os.path.dirname(os.path.abspath(__file__))
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tapewright-code-"), "tapewright"), "zip", os.path.dirname(package), os.path.basename(package))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once; operators with Python functions need it there."""
    if spark.sparkContext.applicationId not in _shipped:
        spark.sparkContext.addPyFile(_zipped())
        _shipped.add(spark.sparkContext.applicationId)
