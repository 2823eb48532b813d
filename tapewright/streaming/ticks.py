"""Tape operators on a stream: duplicates, sealed sessions, clusters, heartbeat, silence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions.measures import aggressor
from tapewright.operators.tape import TICK_KEY


def dedup_within(stream: DataFrame, keys: Sequence[str] = TICK_KEY, delay: str = "1 day") -> DataFrame:
    """Drop repeats of a key that arrive within ``delay`` of its first tick; use the session length."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def dedup_sessions(stream: DataFrame, keys: Sequence[str] = TICK_KEY, delay: str = "1 day") -> DataFrame:
    """Drop repeats of a key within its session day; state of past sessions is released by the watermark."""
    session = stream.withColumn("session_start", F.date_trunc("day", "ts")).withWatermark("session_start", delay)
    return session.dropDuplicates([*keys, "session_start"])


def seal_stream(stream: DataFrame, session: Column, name: str = "seal") -> DataFrame:
    """Ticks of the session date; kept and refused rows are reported as observed metrics ``name``."""
    fresh = F.coalesce(F.col("trade_date") == session, F.lit(False))
    observed = stream.observe(name, F.count_if(fresh).alias("fresh_rows"), F.count_if(~fresh).alias("stale_rows"))
    return observed.filter(fresh)


def cluster_stream(
    stream: DataFrame, keys: Sequence[str] = ("code",), time: str = "ts", delay: str = "10 minutes",
    min_prints: int = P.MIN_PRINTS, min_notional: float = P.MIN_NOTIONAL,
) -> DataFrame:
    """BUY and SELL clusters as they build up; run in update mode."""
    sided = stream.filter(aggressor(F.col("ticker_direction"))).withWatermark(time, delay)
    return (
        sided.groupBy(*keys, time, F.col("ticker_direction").alias("direction"))
        .agg(F.count(F.lit(1)).alias("prints"), F.sum("volume").alias("volume"), F.sum("turnover").alias("notional"))
        .filter((F.col("prints") >= min_prints) & (F.col("notional") >= min_notional))
    )


def heartbeat(stream: DataFrame, keys: Sequence[str] = (), every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Ticks per hour."""
    return (
        stream.withWatermark("ts", delay).groupBy(*keys, F.window("ts", every).alias("_w"))
        .agg(F.count(F.lit(1)).alias("ticks"))
        .select(*keys, F.col("_w.start").alias("hour_start"), "ticks")
    )


def silence_alerts(
    stream: DataFrame, minutes: int = P.SILENCE_MINUTES, keys: Sequence[str] = (), delay: str = "0 seconds"
) -> DataFrame:
    """One row per silence, once: a session of ticks ends ``minutes`` after its last tick.

    Without keys the whole feed is one session. Tasks then merge their own
    ticks into sessions before the shuffle, so that one key does not mean that
    every tick travels to one task.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    # A session window needs a key the optimizer cannot fold away; this one is 0 for every tick.
    by = list(keys) or [F.pmod(F.year("ts"), F.lit(1)).alias("_feed")]
    return (
        stream.withWatermark("ts", delay).groupBy(*by, F.session_window("ts", f"{minutes} minutes").alias("_s"))
        .agg(F.count(F.lit(1)).alias("ticks"))
        .select(*keys, F.col("_s.start").alias("first_tick"), F.col("_s.end").alias("alert_time"), "ticks")
    )


def feed_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Copies per session day and (code, sequence), the base of the feed counters; run in update mode."""
    day = F.window("ts", "1 day")
    return (
        stream.withWatermark("ts", delay).groupBy(*TICK_KEY, day.alias("_w"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .select(*TICK_KEY, F.col("_w.start").alias("session_start"), "copies")
    )
