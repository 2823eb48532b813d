"""Time, calendar and duration expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright import params as P


def parse_time(text: Column) -> Column:
    """Wall-clock time with or without a fraction; unparsable text becomes null."""
    return text.try_cast("timestamp_ntz")


def truncate(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def add_weekdays(day: Column, n: Column) -> Column:
    """The n-th weekday after ``day``; n = 0 gives ``day`` itself."""
    slot = F.least(F.weekday(day), F.lit(4))
    friday_or_day = F.date_sub(day, F.weekday(day) - slot)
    rest = F.pmod(n, F.lit(5))
    jump = F.floor(n / 5) * 7 + rest + F.when(slot + rest > 4, 2).otherwise(0)
    return F.when(n > 0, F.date_add(friday_or_day, jump.cast("int"))).otherwise(day)


def date_spans(start: Column, end: Column, span_days: int = P.SPAN_DAYS) -> Column:
    """Consecutive [start, stop] spans that cover start..end; one array element each."""
    starts = F.sequence(start, end, F.expr(f"interval {span_days + 1} days"))
    return F.transform(
        starts,
        lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, span_days), end).alias("stop")),
    )


def hms(seconds: Column) -> Column:
    """Whole seconds as ``H:MM:SS``."""
    s = seconds.cast("bigint")
    return F.format_string(
        "%d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    )


def seconds_between(first: Column, last: Column) -> Column:
    return F.timestamp_diff("SECOND", first, last)
