"""Collection reports: day summary, daily detail, event status."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions.clock import hms, seconds_between
from tapewright.operators.capture import capture_contracts, capture_days
from tapewright.operators.coverage import snapshot_coverage, zero_filled
from tapewright.operators.events import events_by, qualify_events
from tapewright.operators.flow import cells, cluster_events, is_event


def event_status(
    tape: DataFrame, official: DataFrame, captured: DataFrame, min_notional: float = P.MIN_NOTIONAL,
    cutoff_hour: int = P.CUTOFF_HOUR, threshold: float = P.CAPTURE_THRESHOLD,
) -> DataFrame:
    """Cluster events of a tape with their qualification and reason."""
    contracts = capture_contracts(captured, official, threshold)
    events = cluster_events(tape, ["code", "symbol", "trade_date"], min_notional).withColumnRenamed("trade_date", "day")
    return qualify_events(events, capture_days(contracts), contracts, cutoff_hour, threshold)


def day_summary(tape: DataFrame, min_notional: float = P.MIN_NOTIONAL, cutoff_hour: int = P.CUTOFF_HOUR) -> DataFrame:
    """Per day and symbol, with a TOTAL row per day: span, contracts, prints, raw and counted events.

    One pass over the tape: every report column is read off its cells.
    """
    keys = ["trade_date", "symbol"]
    event = is_event(min_notional)
    span = [F.min("ts").alias("first"), F.max("ts").alias("last")]
    per_code = cells(tape, [*keys, "code"], span).groupBy(*keys, "code").agg(
        F.sum("prints").alias("prints"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.count_if(event).alias("raw"), F.count_if(event & (F.hour("time") < cutoff_hour)).alias("counted"),
    )
    per_symbol = per_code.groupBy(*keys).agg(
        F.sum("prints").alias("prints"), F.count(F.lit(1)).alias("contracts"), F.min("first").alias("first"),
        F.max("last").alias("last"), F.sum("raw").alias("raw"), F.sum("counted").alias("counted"),
    )
    totals = (
        per_symbol.groupingSets([["trade_date", "symbol"], ["trade_date"]], "trade_date", "symbol")
        .agg(
            F.grouping("symbol").alias("is_total"), F.min("first").alias("first_tick"),
            F.max("last").alias("last_tick"), F.sum("contracts").alias("contracts"), F.sum("prints").alias("prints"),
            F.sum("raw").alias("raw_events"), F.sum("counted").alias("counted_events"),
        )
    )
    return totals.select(
        F.col("trade_date").alias("day"),
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("symbol").cast("string")).alias("symbol"),
        "first_tick", "last_tick", hms(seconds_between(F.col("first_tick"), F.col("last_tick"))).alias("span"),
        "contracts", "prints", "raw_events", "counted_events",
    )


def full_day_summary(summary: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """A day summary with a row for every listed symbol and TOTAL, zeros where nothing was collected."""
    measures = ["contracts", "prints", "raw_events", "counted_events"]
    return zero_filled(summary, [*symbols, "TOTAL"], measures)


def daily_detail(
    tape: DataFrame, qualified: DataFrame, capture: DataFrame, snaps: DataFrame, symbols: Sequence,
    universe_size: int, start: dt.date = P.EXPERIMENT_START, threshold: float = P.CAPTURE_THRESHOLD,
) -> DataFrame:
    """One row per day: capture status, contracts, prints, events per symbol, snapshots."""
    per_code = tape.groupBy(F.col("trade_date").alias("day"), "symbol", "code").agg(F.count(F.lit(1)).alias("prints"))
    volume = per_code.groupBy("day").agg(F.count(F.lit(1)).alias("contracts"), F.sum("prints").alias("prints"))
    events = qualified.groupBy("day").agg(
        *[
            F.count_if((F.col("qualified") == 1) & (F.col("symbol") == s)).alias(f"events_{s}")
            for s in symbols
        ],
        F.sum("qualified").alias("counted_events"), F.count(F.lit(1)).alias("raw_events"),
    )
    counts = [f"events_{s}" for s in symbols] + ["counted_events", "raw_events"]
    status = F.when(F.col("overall").isNull(), "unchecked").when(F.col("overall") >= threshold, "ok").otherwise("below")
    return (
        volume.join(events, "day", "left").fillna(0, counts)
        .join(capture.select("day", "overall"), "day", "left")
        .join(snapshot_coverage(volume, snaps, universe_size), "day", "left")
        .withColumn("capture_status", status)
        .withColumn("universe", F.lit(universe_size))
        .withColumn("pre_experiment", (F.col("day") < F.lit(start)).cast("int"))
    )


def event_reports(qualified: DataFrame) -> dict[str, DataFrame]:
    """Event counts by day and by symbol."""
    return {"by_day": events_by(qualified, ["day"]), "by_symbol": events_by(qualified, ["symbol"])}
