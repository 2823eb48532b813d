"""Cleaning a tick tape: duplicates, sealed sessions, gaps, newest-wins merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.operators.ranking import first_per_key

TICK_KEY = ("code", "sequence")
# Sequence numbers start anew each day, so a stored tick is known by its session as well.
SESSION_KEY = ("code", "trade_date", "sequence")


def dedup_ticks(tape: DataFrame, keys: Sequence[str] = TICK_KEY, order: Sequence[Column | str] = ()) -> DataFrame:
    """One row per key, the first in ``order`` (a total order makes this repeatable)."""
    return first_per_key(tape, keys, list(order) or [c for c in tape.columns if c not in keys])


def new_ticks(batch: DataFrame, seen: DataFrame, keys: Sequence[str] = TICK_KEY, order: Sequence[Column | str] = ()) -> DataFrame:
    """Rows of ``batch`` whose key was not seen before, without repeats inside the batch.

    The history is first cut to keys of the batch. A poll is small, so that
    step is a filter over the history's scan and the history is not shuffled.
    """
    by = list(keys)
    known = seen.select(*by).join(batch.select(*by).distinct(), by, "left_semi").distinct()
    return dedup_ticks(batch, keys, order).join(known, by, "left_anti")


def seal_session(tape: DataFrame, session: Column) -> DataFrame:
    """Rows of the session date; ticks of other sessions are left out."""
    return tape.filter(F.col("trade_date") == session)


def seal_counts(tape: DataFrame, session: Column, keys: Sequence[str] = ("code",)) -> DataFrame:
    """Per group: rows kept by the seal and rows refused."""
    fresh = F.coalesce(F.col("trade_date") == session, F.lit(False))
    return tape.groupBy(*keys).agg(
        F.count_if(fresh).alias("fresh_rows"), F.count_if(~fresh).alias("stale_rows")
    )


def latest_per_key(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Newest row per key over batches listed oldest first; ``order`` breaks ties inside a batch."""
    stamped = frames[0].withColumn("_batch", F.lit(0))
    for i, frame in enumerate(frames[1:], start=1):
        stamped = stamped.unionByName(frame.withColumn("_batch", F.lit(i)), allowMissingColumns=True)
    return first_per_key(stamped, keys, [F.col("_batch").desc(), *order]).drop("_batch")


# Blocks that a block of the level above spans, at least, and the number of 64-bit values.
LEVEL, VALUES = 1 << 22, 1 << 64


def value_gaps(
    df: DataFrame, keys: Sequence[str], value: str, block_size: int, distance: Callable[[Column, Column], Column], limit: Column | int
) -> DataFrame:
    """Neighbouring whole numbers per key that lie more than ``limit`` apart.

    Numbers are cut into blocks of ``block_size``; neighbours inside a block come from a window over it. What is left
    of a block are its gaps and its first and last number; those meet in blocks of the level above, ``LEVEL`` times as
    wide, and so on up to the whole range. However hot a key and however far apart its numbers, no window partition
    holds more than ``block_size`` or twice ``LEVEL`` rows. Gaps that are found travel on in their first block's partition.
    """
    steps = [int(block_size)]
    while steps[-1] < VALUES:
        steps.append(steps[-1] * max(steps[0], LEVEL))
    # A row asks for the number before it until a level knows it; it is done when it lies inside a block.
    rows = df.select(*keys, value).filter(F.col(value).isNotNull()).distinct().withColumns(
        {"gap_from": F.lit(None).cast("bigint"), "_asks": F.lit(True), "_done": F.lit(False)}
    )
    first = F.expr(f"`{value}` div {steps[0]}")
    for step in steps:
        own = F.lit(0).cast("bigint") if step >= VALUES // 2 else F.expr(f"`{value}` div {step}")
        here = Window.partitionBy(*keys, "_done", "_block").orderBy(value)
        seen = rows.withColumn("_block", F.when(F.col("_done"), first).otherwise(own)).withColumns(
            {"_before": F.lag(value).over(here), "_after": F.lead(value).over(here)}
        )
        inside = F.col("_before").isNotNull() & F.col("_after").isNotNull()
        found = F.col("_asks") & ~F.col("_done") & (distance(F.col("_before"), F.col(value)) > limit)
        rows = seen.select(
            *keys, value, F.when(found, F.col("_before")).otherwise(F.col("gap_from")).alias("gap_from"),
            (F.col("_asks") & F.col("_before").isNull()).alias("_asks"), (F.col("_done") | inside).alias("_done"),
        ).filter(F.col("gap_from").isNotNull() | ~F.col("_done"))
    return rows.filter(F.col("gap_from").isNotNull()).select(*keys, "gap_from", F.col(value).alias("gap_to"))


def sequence_gaps(tape: DataFrame, keys: Sequence[str] = ("code", "trade_date"), block_size: int = 1 << 20) -> DataFrame:
    """Holes in the tick sequence of a contract-day, whether its numbers count up or are clock times."""
    found = value_gaps(tape, keys, "sequence", block_size, lambda a, b: b - a, 1)
    return found.withColumn("missing", F.col("gap_to") - F.col("gap_from") - 1)


def gap_free(tape: DataFrame, keys: Sequence[str] = ("code", "trade_date")) -> DataFrame:
    """Per contract-day: whether every sequence number between the first and last is present."""
    numbers = tape.filter(F.col("sequence").isNotNull()).select(*keys, "sequence").distinct()
    span = F.max("sequence") - F.min("sequence") + 1
    return numbers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("present"), span.alias("expected"), (F.count(F.lit(1)) == span).alias("gap_free")
    )


def silences(ticks: DataFrame, minutes: int = P.SILENCE_MINUTES, keys: Sequence[str] = ()) -> DataFrame:
    """Stretches of at least ``minutes`` without a tick, one row per silence.

    Ticks are first reduced to (first, last) per minute. A silence is longer
    than a minute, so it always lies between two of those rows; what the
    window sees is bounded by the minutes of a day and then by the days.
    """
    grouped = list(keys)
    minute = (
        ticks.filter(F.col("ts").isNotNull())
        .groupBy(*grouped, F.to_date("ts").alias("_day"), F.hour("ts").alias("_hour"), F.minute("ts").alias("_minute"))
        .agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    )
    inside_w = Window.partitionBy(*grouped, "_day").orderBy("_first")
    inside = minute.select(*grouped, F.lag("_last").over(inside_w).alias("last_tick"), F.col("_first").alias("next_tick"))
    days = minute.groupBy(*grouped, "_day").agg(F.min("_first").alias("next_tick"), F.max("_last").alias("_last"))
    across_w = Window.partitionBy(*(grouped or [F.lit(1)])).orderBy("_day")
    across = days.select(*grouped, F.lag("_last").over(across_w).alias("last_tick"), "next_tick")
    length = F.expr(f"interval {int(minutes)} minutes")
    return (
        inside.unionByName(across)
        .filter(F.col("next_tick") >= F.col("last_tick") + length)
        .withColumn("alert_time", F.col("last_tick") + length)
    )


def tick_counters(pushed: DataFrame, watch: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Feed counters before and after duplicate removal, and the k busiest contracts."""
    per_key = pushed.groupBy(*TICK_KEY).agg(F.count(F.lit(1)).alias("copies"))
    per_code = per_key.groupBy("code").agg(
        F.count(F.lit(1)).alias("ticks"), F.sum(F.col("copies") - 1).alias("duplicates")
    )
    joined = per_code.join(watch.select("code").distinct().withColumn("watched", F.lit(1)), "code", "full_outer")
    totals = joined.agg(
        F.coalesce(F.sum("ticks"), F.lit(0)).alias("ticks"),
        F.count("ticks").alias("active_contracts"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("watched").isNotNull() & F.col("ticks").isNull()).alias("silent_contracts"),
    )
    busiest = per_code.select("code", "ticks").orderBy(F.desc("ticks"), "code").limit(k)
    return totals, busiest


def running_totals(ticks: DataFrame, keys: Sequence[str] = ("trade_date",)) -> DataFrame:
    """New rows per poll (hour) and the cumulative total within the session."""
    hourly = ticks.groupBy(*keys, F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("new_ticks"))
    w = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return hourly.withColumn("cumulative", F.sum("new_ticks").over(w))
