"""Explicit table schemas. Column names are fixed values: they must match the landed files."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "bigint": T.LongType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string;double>": T.MapType(T.StringType(), T.DoubleType()),
}


def _schema(text: str) -> T.StructType:
    """``name type`` pairs; usable before a session exists."""
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TICK = _schema(
    "code string, time string, price double, volume double, turnover double, "
    "ticker_direction string, sequence bigint"
)

TAPE = _schema(
    "code string, symbol string, time string, ts timestamp_ntz, trade_date date, price double, "
    "volume double, turnover double, ticker_direction string, sequence bigint"
)

CHAIN = _schema(
    "code string, option_type string, option_strike_price double, option_open_interest double, "
    "option_implied_volatility double, option_premium double, option_delta double, option_gamma double, "
    "option_vega double, option_theta double, option_rho double, option_expiry_date_distance double, "
    "strike_time date, bid_price double, ask_price double, volume double, turnover double, last_price double"
)

INTRADAY = _schema(
    "code string, update_time string, last_price double, bid_price double, ask_price double, bid_vol double, "
    "ask_vol double, volume double, turnover double, option_implied_volatility double, option_delta double, "
    "option_gamma double, option_vega double, option_theta double, option_rho double, "
    "option_open_interest double, option_strike_price double, option_type string, "
    "option_expiry_date_distance double"
)

UNDERLYING = _schema(
    "code string, update_time string, last_price double, bid_price double, ask_price double, volume double, "
    "turnover double, high_price double, low_price double, open_price double, prev_close_price double"
)

BARS = _schema("code string, time_key string, open double, close double, high double, low double, volume double")

DAILY_VOLUME = _schema("code string, day date, volume double")

# Landed as text because the vendor writes "N/A" for missing measures.
SYMBOL_STAT = _schema(
    "time string, underlying_price string, option_volume string, call_volume string, put_volume string, "
    "option_open_interest string, call_open_interest string, put_open_interest string, "
    "put_call_volume_ratio string, put_call_open_interest_ratio string"
)

SYMBOL_VOL = _schema("time string, iv string, hv string")

CAPTURE_DAY = _schema(
    "day date, overall double, contracts map<string;double>, below_threshold array<string>, "
    "sampled bigint, failed_calls bigint, fingerprint string, checked_at timestamp"
)

TEXT = _schema("doc_id string, text string")

SCREEN_COLUMNS = [
    "option_type", "option_strike_price", "option_open_interest", "option_implied_volatility",
    "option_premium", "option_delta", "option_expiry_date_distance", "bid_price", "ask_price",
    "volume", "code",
]

FEATURE_COLUMNS = [
    "date", "symbol", "is_etf", "time_split", "symbol_split", "symbol_history_days", "min_history_ok",
    "usable_for_discovery", "oi_valid",
    "underlying_price", "option_volume", "call_volume", "put_volume", "pc_volume_ratio",
    "call_oi", "put_oi", "option_oi", "pc_oi_ratio", "iv", "hv",
    "iv_hv_spread", "iv_hv_ratio", "iv_z20", "hv_z20", "iv_hv_spread_z20",
    "vol_z20", "vol_ratio_20", "pc_vol_z20", "pc_oi_z20",
    "oi_change", "call_oi_change", "put_oi_change", "oi_change_pct", "oi_change_z20",
    "vol_oi_ratio", "ret_1d", "realized_vol_20", "price_z20",
    "days_iv_z_gt2_last5", "days_vol_z_gt2_last5", "oi_change_sum_3d", "oi_change_sum_5d", "consec_oi_up",
    "spy_ret_1d", "qqq_ret_1d", "iv_z20_xs_rank", "vol_z20_xs_rank",
]

# Columns of the feature table that are keys or flags, not measures.
FEATURE_FLAGS = [
    "date", "symbol", "is_etf", "time_split", "symbol_split", "usable_for_discovery", "oi_valid",
]
