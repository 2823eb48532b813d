"""Stream sources, sinks and the bounded run used for landed folders."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tapewright import params as P
from tapewright.functions.clock import parse_time
from tapewright.functions.contract import contract_symbol
from tapewright.operators.ranking import first_per_key
from tapewright.schemas import TICK
from tapewright.session import read_if_present, scratch_path, whole_state


def stream_landed_ticks(
    spark: SparkSession, path: str, schema: T.StructType = TICK, max_files: int | None = None
) -> DataFrame:
    """New CSV files of the landing folder as a stream of ticks with event time and trade date.

    ``schema`` lists the columns in file order; a file with another header fails the batch.
    """
    reader = (
        spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    ts = parse_time(F.col("time")).cast("timestamp")
    return reader.csv(path).withColumns(
        {"ts": ts, "trade_date": F.to_date(ts), "symbol": contract_symbol(F.col("code"))}
    )


def stream_landed_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of new CSV files with the path of their file; a micro-batch holds whole files, so each keeps its own header."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table or a single file as a stream with the schema it has now.

    A stream reads a folder or a pattern. The pattern here matches exactly
    ``path``, so that a table kept as one file streams as well.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def append_partitions(
    stream: DataFrame, path: str, checkpoint: str, partitions: Sequence[str] = ("trade_date", "symbol"),
    seconds: int = P.FLUSH_SECONDS,
) -> StreamingQuery:
    """Append each micro-batch to date and symbol partitions. The checkpoint restores state after a restart."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy(*partitions).trigger(processingTime=f"{seconds} seconds").start()
    )


def run_available(stream: DataFrame, name: str, partitions: Sequence[str] = (), at: tuple[str, str] | None = None) -> DataFrame:
    """Process what has landed, append the results to a table in the shared folder and read it.

    ``at`` names table and checkpoint of an earlier run to go on from; state and progress are those of that run.
    """
    spark = stream.sparkSession
    path, checkpoint = at or (scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint"))
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    with whole_state(spark) if at else contextlib.nullcontext():
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, keys: Sequence[str], name: str, at: tuple[str, str] | None = None) -> DataFrame:
    """Like ``run_available`` for aggregates that change: every update is kept and the last one per key returned.

    Append mode would hold back groups the watermark has not passed; update
    mode also delivers those that are still open when the input ends.
    """
    spark = stream.sparkSession
    path, checkpoint = at or (scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint"))

    def save(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a replayed batch harmless.
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    with whole_state(spark) if at else contextlib.nullcontext():
        writer.trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    updates = read_if_present(spark, path, schema)
    if updates is None:
        return spark.createDataFrame([], stream.schema)
    return first_per_key(updates, keys, [F.desc("batch")]).drop("batch")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
