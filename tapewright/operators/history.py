"""Symbol-day features: trailing statistics, changes, persistence, ranks, splits.

Input is unique per (symbol, date), so a symbol's window holds one row per
trading day and a date's window one row per symbol.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions import rolling as R
from tapewright.functions.measures import any_of, flag, ratio
from tapewright.operators.columns import rename, to_numbers

# Vendor names and our names.
CANONICAL_NAMES = {
    "time": "date",
    "option_open_interest": "option_oi",
    "call_open_interest": "call_oi",
    "put_open_interest": "put_oi",
    "put_call_volume_ratio": "pc_volume_ratio",
    "put_call_open_interest_ratio": "pc_oi_ratio",
}
MEASURES = [
    "pc_volume_ratio", "pc_oi_ratio", "iv", "hv", "underlying_price", "option_volume", "call_volume",
    "put_volume", "option_oi", "call_oi", "put_oi",
]
OI_COLUMNS = ["option_oi", "call_oi", "put_oi", "pc_oi_ratio"]


def join_history(stat: DataFrame, vol: DataFrame) -> DataFrame:
    """Statistics and volatility of the same symbol and day, canonical names, numeric measures."""
    joined = stat.join(vol.select("symbol", "time", "iv", "hv"), ["symbol", "time"])
    typed = to_numbers(rename(joined, CANONICAL_NAMES), MEASURES)
    return typed.withColumn("date", F.to_date("date")).select("symbol", "date", *MEASURES)


def mask_open_interest(history: DataFrame) -> DataFrame:
    """Open interest 0 means not published: flag it and blank the four OI measures."""
    valid = flag(F.col("option_oi") > 0)
    return history.withColumns(
        {"oi_valid": valid, **{c: F.when(valid == 1, F.col(c)) for c in OI_COLUMNS}}
    )


def row_features(history: DataFrame) -> DataFrame:
    return history.withColumns(
        {
            "iv_hv_spread": F.col("iv") - F.col("hv"),
            "iv_hv_ratio": ratio(F.col("iv"), F.col("hv")),
        }
    )


def change_features(history: DataFrame) -> DataFrame:
    """Differences and returns against the previous row, history length."""
    w = R.by_symbol()
    oi = F.col("option_oi")
    return history.withColumns(
        {
            "oi_change": R.change(oi, w),
            "call_oi_change": R.change(F.col("call_oi"), w),
            "put_oi_change": R.change(F.col("put_oi"), w),
            "oi_change_pct": R.over_previous(R.change(oi, w), oi, w),
            "vol_oi_ratio": R.over_previous(F.col("option_volume"), oi, w),
            "ret_1d": R.log_return(F.col("underlying_price"), w),
            "_row": F.row_number().over(w),
            "symbol_history_days": F.count("date").over(
                w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        }
    )


# Output column and the measure it standardises.
ZSCORES = {
    "iv_z20": "iv",
    "hv_z20": "hv",
    "iv_hv_spread_z20": "iv_hv_spread",
    "vol_z20": "option_volume",
    "pc_vol_z20": "pc_volume_ratio",
    "pc_oi_z20": "pc_oi_ratio",
    "oi_change_z20": "oi_change",
    "price_z20": "underlying_price",
}


def trailing_features(changed: DataFrame) -> DataFrame:
    """Trailing scores over the rows before today, sums and runs up to today."""
    w = R.by_symbol()
    change = F.col("oi_change")
    return changed.withColumns(
        {
            **{name: R.zscore(F.col(source), w) for name, source in ZSCORES.items()},
            "vol_ratio_20": R.ratio_to_median(F.col("option_volume"), w),
            "realized_vol_20": R.realized_vol(F.col("ret_1d"), w),
            "oi_change_sum_3d": R.full_sum(change, w, 3),
            "oi_change_sum_5d": R.full_sum(change, w, 5),
            "consec_oi_up": R.run_length(change > 0, F.col("_row"), w),
        }
    ).drop("_row")


def persistence_features(trailing: DataFrame) -> DataFrame:
    w = R.by_symbol()
    return trailing.withColumns(
        {
            "days_iv_z_gt2_last5": R.days_above(F.col("iv_z20"), w),
            "days_vol_z_gt2_last5": R.days_above(F.col("vol_z20"), w),
        }
    )


def symbol_features(history: DataFrame) -> DataFrame:
    """All per-symbol features; one exchange and one sort by (symbol, date)."""
    return persistence_features(trailing_features(change_features(row_features(mask_open_interest(history)))))


def market_returns(history: DataFrame, spy: str = "SPY", qqq: str = "QQQ") -> DataFrame:
    """Returns of two market symbols as columns, one row per date."""
    wide = (
        history.filter(F.col("symbol").isin(spy, qqq))
        .groupBy("date").pivot("symbol", [spy, qqq]).agg(F.first("ret_1d"))
    )
    return wide.select("date", F.col(f"`{spy}`").alias("spy_ret_1d"), F.col(f"`{qqq}`").alias("qqq_ret_1d"))


def with_market_context(history: DataFrame, spy: str = "SPY", qqq: str = "QQQ") -> DataFrame:
    """The market returns joined to every symbol of the date."""
    return history.join(market_returns(history, spy, qqq), "date", "left")


def date_features(features: DataFrame, spy: str = "SPY", qqq: str = "QQQ") -> DataFrame:
    """Cross-sectional ranks and market returns, all from one exchange by date.

    The market columns equal ``with_market_context``; taking them from the
    date's window saves the second pass over the history and its join.
    """
    day = Window.partitionBy("date")

    def of(symbol: str):
        return F.max(F.when(F.col("symbol") == symbol, F.col("ret_1d"))).over(day)

    return features.withColumns(
        {
            "spy_ret_1d": of(spy),
            "qqq_ret_1d": of(qqq),
            "iv_z20_xs_rank": R.percentile_rank(F.col("iv_z20"), "date"),
            "vol_z20_xs_rank": R.percentile_rank(F.col("vol_z20"), "date"),
        }
    )


def assign_splits(
    features: DataFrame, cutoff: dt.date = P.TIME_CUTOFF, holdout: Sequence[str] = P.SYMBOL_HOLDOUT,
    etfs: Sequence[str] = P.ETFS, min_days: int = P.MIN_HISTORY_DAYS,
) -> DataFrame:
    """Frozen time and symbol splits, history and usability flags."""
    time_split = F.when(F.col("date") <= F.lit(cutoff), "discovery").otherwise("holdout")
    symbol_split = F.when(F.col("symbol").isin(list(holdout)), "holdout").otherwise("discovery")
    enough = F.col("symbol_history_days") >= min_days
    return features.withColumns(
        {
            "is_etf": any_of(F.col("symbol"), etfs),
            "time_split": time_split,
            "symbol_split": symbol_split,
            "min_history_ok": flag(enough),
            "usable_for_discovery": flag((time_split == "discovery") & (symbol_split == "discovery") & enough),
        }
    )


def draw_holdout(symbols: DataFrame, k: int, seed: int) -> DataFrame:
    """k symbols by seeded digest order, the repeatable form of a random holdout."""
    draw = F.md5(F.concat_ws("|", "symbol", F.lit(str(seed))))
    return symbols.select("symbol").distinct().orderBy(draw, "symbol").limit(k)


def missing_sources(symbols: Sequence[str], stat: DataFrame, vol: DataFrame) -> DataFrame:
    """Symbols of a parameter list that lack the statistics or the volatility history."""
    wanted = stat.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    both = stat.select("symbol").distinct().join(vol.select("symbol").distinct(), "symbol", "left_semi")
    return wanted.join(both, "symbol", "left_anti")


def split_counts(features: DataFrame) -> DataFrame:
    """Rows, usable rows, symbols and date range per split."""
    per_symbol = features.groupBy("time_split", "symbol_split", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("usable_for_discovery").alias("usable_rows"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    return per_symbol.groupBy("time_split", "symbol_split").agg(
        F.sum("rows").alias("rows"), F.sum("usable_rows").alias("usable_rows"),
        F.count(F.lit(1)).alias("symbols"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
    )


def missing_rates(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent missing per column, one pass, only columns with any, highest first."""
    rates = features.agg(
        *[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 1).alias(c) for c in columns]
    )
    long = rates.unpivot([], list(columns), "feature", "missing_pct")
    return long.filter(F.col("missing_pct") > 0).orderBy(F.desc("missing_pct"), "feature")


def oi_validity(features: DataFrame) -> DataFrame:
    """Rows whose open interest was not published, and their percentage."""
    invalid = F.col("oi_valid") == 0
    return features.agg(
        F.count_if(invalid).alias("invalid_rows"),
        F.round(F.avg(invalid.cast("int")) * 100, 1).alias("invalid_pct"),
    )
