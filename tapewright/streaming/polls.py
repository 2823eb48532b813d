"""Poll-driven streams: underlying quotes, intraday chain states and the watch list."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright import params as P
from tapewright.functions.contract import contract_symbol
from tapewright.operators.chain import liquid_contracts, watch_additions
from tapewright.operators.columns import keep_listed
from tapewright.schemas import INTRADAY, UNDERLYING
from tapewright.session import delete_path, read_if_present


def stamp_polls(quotes: DataFrame, poll_time: Column | None = None) -> DataFrame:
    """Underlying quotes with the time of the poll that read them."""
    stamp = F.current_timestamp() if poll_time is None else poll_time
    stamped = quotes.withColumn("poll_time", stamp)
    return keep_listed(stamped, [*UNDERLYING.fieldNames(), "poll_time"]).withColumn("poll_date", F.to_date("poll_time"))


def intraday_pass(chain: DataFrame, snap_time: Column) -> DataFrame:
    """Chain states of one pass with its time and the contract's symbol; unknown codes are left out."""
    stamped = chain.withColumn("snap_time", snap_time)
    return (
        keep_listed(stamped, [*INTRADAY.fieldNames(), "snap_time"])
        .withColumns({"snap_date": F.to_date("snap_time"), "symbol": contract_symbol(F.col("code"))})
        .filter(F.col("symbol").isNotNull())
    )


def refresh_watch_list(spark: SparkSession, watch_path: str, chain: DataFrame, n: int) -> None:
    """Add the chain's liquid contracts that are not watched yet; nothing is removed."""
    watched = spark.read.parquet(watch_path).select("code")
    watch_additions(liquid_contracts(chain, n=n), watched).write.mode("append").parquet(watch_path)


def _started(spark: SparkSession, watch_path: str, ticks: DataFrame) -> DataFrame | None:
    """When the watch began (one row): the first tick of the first ticks that came, noted beside the list."""
    path = f"{watch_path.rstrip('/')}_started"
    held = read_if_present(spark, path, T.StructType([T.StructField("started", T.TimestampNTZType())]))
    if held is not None:
        return held
    first = ticks.agg(F.min("ts").cast("timestamp_ntz").alias("started")).filter("started is not null")
    if first.isEmpty():
        return None
    first.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def start_watch(codes: DataFrame, watch_path: str) -> None:
    """A watch list of ``codes`` that holds from the beginning; what was noted of an earlier one goes."""
    for path in (f"{watch_path.rstrip('/')}{end}" for end in ("_started", "_repicked")):
        delete_path(codes.sparkSession, path)
    codes.select("code", F.lit(None).cast("timestamp_ntz").alias("since")).distinct().write.mode("overwrite").parquet(watch_path)


def watched_ticks(
    ticks: DataFrame, watch_path: str, pick: Callable[[], DataFrame], minutes: int = P.REPICK_MINUTES
) -> DataFrame:
    """Ticks (code, ts, ...) of a micro-batch whose contracts are watched at their time.

    The list (see ``start_watch``) is re-picked once: when a tick comes that lies ``minutes`` or more after the first
    one, the codes that ``pick`` gives join it from that time on; nothing leaves it. Start, list and re-pick are kept in
    tables, so a restart goes on from them, and a micro-batch that is replayed gives the same rows. ``ticks`` is read a
    few times.
    """
    spark = ticks.sparkSession
    started, noted = _started(spark, watch_path, ticks), f"{watch_path.rstrip('/')}_repicked"
    if started is None:
        return ticks.limit(0)
    due = F.lit(str(started.first()["started"] + dt.timedelta(minutes=minutes))).cast("timestamp_ntz")
    own = F.col("ts").cast("timestamp_ntz")
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("since", T.TimestampNTZType())])
    if read_if_present(spark, noted, schema) is None and not ticks.filter(own >= due).isEmpty():
        added = watch_additions(pick(), spark.read.parquet(watch_path)).select("code", due.alias("since"))
        # A table of its own: it is whole or absent, however often the micro-batch is tried.
        added.write.mode("overwrite").parquet(noted)
    watched, late = spark.read.parquet(watch_path), read_if_present(spark, noted, schema)
    both = (watched if late is None else watched.unionByName(late)).groupBy("code").agg(F.when(F.every(F.col("since").isNotNull()), F.min("since")).alias("_since"))
    return ticks.join(both, "code").filter(F.col("_since").isNull() | (own >= F.col("_since"))).drop("_since")


def watched_batches(watch_path: str, handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that keeps ticks of watched contracts, reading the list anew for each batch."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        watched = batch.sparkSession.read.parquet(watch_path).select("code").distinct()
        handle(batch.join(watched, "code", "left_semi"), batch_id)

    return on_batch
