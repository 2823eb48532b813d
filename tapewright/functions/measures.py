"""Arithmetic with the missing-value rules of the data model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; a zero denominator gives null."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def number(text: Column) -> Column:
    """Text to double; markers such as "N/A" and NaN become null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded to one decimal, the form thresholds are tested on."""
    return F.round(100 * ratio(part, whole), 1)


def spread_pct(bid: Column, ask: Column) -> Column:
    return ratio(100 * (ask - bid), (ask + bid) / 2)


def liquidity_score(open_interest: Column, volume: Column, spread: Column) -> Column:
    return open_interest + volume - spread * 100


def aggressor(direction: Column) -> Column:
    return direction.isin("BUY", "SELL")


def implied_sign(right: Column, direction: Column) -> Column:
    """+1 when the trade reads bullish, -1 when bearish, null otherwise."""
    bullish = ((right == "CALL") & (direction == "BUY")) | ((right == "PUT") & (direction == "SELL"))
    bearish = ((right == "PUT") & (direction == "BUY")) | ((right == "CALL") & (direction == "SELL"))
    return F.when(bullish, 1).when(bearish, -1)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def any_of(column: Column, values: Iterable[str]) -> Column:
    return flag(column.isin(list(values)))
