"""Which days, symbols and bars are there, and which are missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions.clock import is_weekday
from tapewright.operators.flow import cells, is_event


def symbol_dimension(days: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Every day with every symbol of a parameter list."""
    return days.select("day", F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol"))


def missing_bars(days: DataFrame, bars: DataFrame, symbols: Sequence[str] = P.EVENT_SYMBOLS) -> DataFrame:
    """Collection days and symbols without minute bars."""
    wanted = symbol_dimension(days.select("day").distinct(), symbols)
    return wanted.join(bars.select("day", "symbol").distinct(), ["day", "symbol"], "left_anti")


def bars_inventory(bars: DataFrame) -> DataFrame:
    """Bars per symbol-day with the first and last bar time."""
    return bars.groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("bars"), F.min("time_key").alias("first_bar"), F.max("time_key").alias("last_bar")
    )


def snapshot_coverage(days: DataFrame, snaps: DataFrame, universe_size: int) -> DataFrame:
    """Distinct symbols with a snapshot per collection day, 0 where there is none."""
    per_day = snaps.select("day", "symbol").distinct().groupBy("day").agg(F.count(F.lit(1)).alias("snapshots"))
    return (
        days.select("day").distinct().join(per_day, "day", "left").fillna(0, ["snapshots"])
        .withColumn("missing", F.lit(universe_size) - F.col("snapshots"))
    )


def snapshot_depth(snaps: DataFrame) -> DataFrame:
    """Days banked per symbol."""
    return snaps.select("day", "symbol").distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("days_banked"))


def weekday_gaps(days: DataFrame) -> DataFrame:
    """Weekdays between the first and last collection day without a collection.

    One pass: the distinct days, one row per calendar date, list what lies
    between each of them and the next.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("day")
    steps = days.select("day").distinct().withColumn("_next", F.lead("day").over(w))
    holes = steps.filter(F.col("_next") > F.date_add("day", 1))
    between = F.sequence(F.date_add("day", 1), F.date_sub("_next", 1))
    return holes.select(F.explode(between).alias("day")).filter(is_weekday(F.col("day")))


def collection_counts(tape: DataFrame, min_notional: float = P.MIN_NOTIONAL) -> DataFrame:
    """Prints, contracts and cluster events per day and symbol, one pass over the tape."""
    keys = ["trade_date", "symbol"]
    per_code = cells(tape, [*keys, "code"]).groupBy(*keys, "code").agg(
        F.sum("prints").alias("prints"), F.count_if(is_event(min_notional)).alias("events")
    )
    return per_code.groupBy(*keys).agg(
        F.sum("prints").alias("prints"), F.count(F.lit(1)).alias("contracts"), F.sum("events").alias("events")
    )


def wide_counts(counts: DataFrame, measure: str, symbols: Sequence) -> DataFrame:
    """One row per day, one column per symbol of a parameter list."""
    return counts.groupBy("trade_date").pivot("symbol", list(symbols)).agg(F.sum(measure)).fillna(0)


def zero_filled(counts: DataFrame, symbols: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Counts for every symbol of the list, 0 where the day has no row for it."""
    grid = symbol_dimension(counts.select("day").distinct(), symbols)
    return grid.join(counts, ["day", "symbol"], "left").fillna(0, list(measures))


def feed_comparison(polled: DataFrame, pushed: DataFrame) -> DataFrame:
    """Prints per contract-day in two feeds; a contract-day one feed lacks counts 0 there."""
    keys = ["trade_date", "code"]
    a = polled.groupBy(*keys).agg(F.count(F.lit(1)).alias("polled_prints"))
    b = pushed.groupBy(*keys).agg(F.count(F.lit(1)).alias("pushed_prints"))
    both = a.join(b, keys, "full_outer").fillna(0, ["polled_prints", "pushed_prints"])
    return both.withColumn("difference", F.col("pushed_prints") - F.col("polled_prints"))


def rows_on_disk(tape: DataFrame) -> DataFrame:
    return tape.agg(F.count(F.lit(1)).alias("rows_on_disk"))
