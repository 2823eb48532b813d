"""The symbol-day feature table and the separate outcome table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.operators.columns import forbid_outcomes
from tapewright.operators.history import assign_splits, date_features, symbol_features
from tapewright.operators.study import forward_returns
from tapewright.schemas import FEATURE_COLUMNS


def feature_table(
    history: DataFrame, spy: str = "SPY", qqq: str = "QQQ", cutoff: dt.date = P.TIME_CUTOFF,
    holdout: Sequence[str] = P.SYMBOL_HOLDOUT, etfs: Sequence[str] = P.ETFS,
) -> DataFrame:
    """All features of every symbol-day; two exchanges, by symbol and by date."""
    features = date_features(symbol_features(history), spy, qqq)
    return forbid_outcomes(assign_splits(features, cutoff, holdout, etfs).select(*FEATURE_COLUMNS))


def outcome_table(history: DataFrame) -> DataFrame:
    """Forward returns and abnormal moves, keyed like the feature table but stored apart from it."""
    features = symbol_features(history).select("symbol", "date", "underlying_price", "realized_vol_20")
    return forward_returns(features).drop("underlying_price", "realized_vol_20")


def date_range(features: DataFrame) -> DataFrame:
    """Rows, symbols and first and last date of a feature table."""
    per_symbol = features.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    return per_symbol.agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("symbols"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
    )
