"""Trailing window expressions over one row per (symbol, trading day).

All frames count rows, never calendar days, and end at the previous row
unless stated otherwise. A symbol has at most one row per trading day, so a
window partition is bounded by the calendar, not by the volume of the tape.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions.measures import ratio


def by_symbol(key: str = "symbol", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def _enough(x: Column, frame: WindowSpec, min_obs: int) -> Column:
    return F.count(x).over(frame) >= min_obs


def zscore(x: Column, w: WindowSpec, n: int = P.WINDOW, min_obs: int = P.MIN_OBS) -> Column:
    frame = w.rowsBetween(-n, -1)
    spread = F.nullif(F.stddev_samp(x).over(frame), F.lit(0.0))
    return F.when(_enough(x, frame, min_obs), (x - F.avg(x).over(frame)) / spread)


def ratio_to_median(x: Column, w: WindowSpec, n: int = P.WINDOW, min_obs: int = P.MIN_OBS) -> Column:
    frame = w.rowsBetween(-n, -1)
    return F.when(_enough(x, frame, min_obs), ratio(x, F.percentile(x, F.lit(0.5)).over(frame)))


def change(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x, 1).over(w)


def over_previous(x: Column, base: Column, w: WindowSpec) -> Column:
    return ratio(x, F.lag(base, 1).over(w))


def log_return(price: Column, w: WindowSpec) -> Column:
    return F.ln(ratio(price, F.lag(price, 1).over(w)))


def realized_vol(ret: Column, w: WindowSpec, n: int = P.WINDOW, min_obs: int = P.MIN_OBS) -> Column:
    frame = w.rowsBetween(-n, -1)
    yearly = math.sqrt(P.TRADING_DAYS_PER_YEAR)
    return F.when(_enough(ret, frame, min_obs), F.stddev_samp(ret).over(frame) * yearly)


def days_above(x: Column, w: WindowSpec, level: float = 2.0, n: int = 5) -> Column:
    """Days above ``level`` among the last n rows, today included; never null."""
    return F.sum(F.when(x > level, 1).otherwise(0)).over(w.rowsBetween(-(n - 1), 0))


def full_sum(x: Column, w: WindowSpec, n: int) -> Column:
    """Sum of the last n rows, today included; null unless all n are present."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, F.sum(x).over(frame))


def run_length(positive: Column, position: Column, w: WindowSpec) -> Column:
    """Rows since ``positive`` last failed; ``position`` is the 1-based row number in ``w``."""
    up = F.coalesce(positive, F.lit(False))
    last_reset = F.max(F.when(~up, position)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return position - F.coalesce(last_reset, F.lit(0))


def percentile_rank(x: Column, group: str) -> Column:
    """Average rank of x within ``group`` over the count of present values.

    A range frame that ends at the current row covers all its ties, so that
    its count is the last tied rank and ``rank()`` the first.
    """
    w = Window.partitionBy(group).orderBy(x.asc_nulls_last())
    upto = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    present = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / 2 / present)
