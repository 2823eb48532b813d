"""Named queries over the given tables, each with the SQL that checks it.

``cols`` lists the result columns with a kind; it shapes both sides alike:
i = bigint, f = double rounded to 6 places, m = the same from whole cents,
s = string, d = date text,
t = timestamp text to the second, u = timestamp text to the microsecond.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The engines break ties at the last digit differently; this shift moves exact ties off the edge.
OFF_TIE = 1.234e-08

_SPARK: dict[str, Callable[[Column], Column]] = {
    "i": lambda c: c.cast("bigint"),
    "f": lambda c: F.round(c.cast("double") + F.lit(OFF_TIE), 6) + F.lit(0.0),
    "m": lambda c: F.round(c / 100 + F.lit(OFF_TIE), 6) + F.lit(0.0),
    "s": lambda c: c.cast("string"),
    "d": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
    "u": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
}
_SQL = {
    "i": "CAST({0} AS BIGINT)",
    "f": f"round(CAST({{0}} AS DOUBLE) + CAST({OFF_TIE} AS DOUBLE), 6) + CAST(0 AS DOUBLE)",
    "m": f"round(CAST({{0}} AS DOUBLE) + CAST({OFF_TIE} AS DOUBLE), 6) + CAST(0 AS DOUBLE)",
    "s": "CAST({0} AS VARCHAR)",
    "d": "strftime(CAST({0} AS DATE), '%Y-%m-%d')",
    "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
    "u": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')",
}


def query(cols: str, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its name, with its result columns and check SQL."""
    shape = [c.split(":") for c in cols.split()]

    def register(build: Query) -> Query:
        key = name or build.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return df.select(*[_SPARK[kind](F.col(c)).alias(c) for c, kind in shape])

        QUERIES[key] = run
        if sql is not None:
            picked = ", ".join(f"{_SQL[kind].format('r.' + c)} AS {c}" for c, kind in shape)
            ORACLES[key] = f"SELECT {picked} FROM (\n{sql.strip()}\n) AS r"
        return build

    return register


# The adapters of ``workload.adapters`` in SQL.
TAPE = """tape AS (
  SELECT l_suppkey AS code, l_suppkey % 5 AS symbol, l_shipdate AS time, CAST(l_shipdate AS DATE) AS trade_date,
         l_quantity AS volume, CAST(l_extendedprice AS DECIMAL(18,2)) AS turnover,
         CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' WHEN 'N' THEN 'NEUTRAL' END AS ticker_direction,
         l_orderkey * 10 + l_linenumber AS sequence, l_partkey AS part, l_tax AS tax, l_linestatus AS status
  FROM lineitem)"""

EVENTS = """ev AS (
  SELECT user_id % 10 AS code, user_id % 3 AS symbol, date_trunc('hour', ts) AS time, ts,
         CAST(ts AS DATE) AS trade_date, event_id AS sequence, value AS price,
         CAST(value AS DECIMAL(18,2)) AS volume, CAST(value AS DECIMAL(18,2)) AS turnover,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'BUY' WHEN event_type IN ('error', 'click') THEN 'SELL'
              ELSE 'NEUTRAL' END AS ticker_direction,
         CAST(value AS DECIMAL(18,2)) * (1000 - CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER)) AS captured
  FROM events)"""

CHAIN = """chain AS (
  SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS code, l_suppkey % 5 AS symbol,
         CASE l_returnflag WHEN 'A' THEN 'CALL' WHEN 'R' THEN 'PUT' ELSE 'OTHER' END AS option_type,
         l_extendedprice / l_quantity AS strike, CAST(l_orderkey % 1000 AS DOUBLE) AS oi, l_tax AS iv,
         l_extendedprice AS premium,
         l_quantity / 100 * (CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END) AS delta,
         l_linenumber * 4 AS dte, l_linenumber AS expiry, l_extendedprice * (1 - l_discount) AS bid,
         l_extendedprice AS ask, l_quantity AS volume
  FROM lineitem)"""

HISTORY = """base AS (
  SELECT CAST(l_suppkey % 5 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         sum(l_quantity) AS option_volume,
         sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS call_volume,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS put_volume,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS raw_oi,
         CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END) AS DOUBLE) AS raw_call_oi,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS DOUBLE) AS raw_put_oi,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS underlying_price,
         CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS iv,
         CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS hv
  FROM lineitem GROUP BY 1, 2),
hist AS (
  SELECT symbol, date, option_volume, call_volume, put_volume, underlying_price, iv, hv,
         put_volume / nullif(call_volume, 0) AS pc_volume_ratio,
         CASE WHEN raw_oi > 0 THEN 1 ELSE 0 END AS oi_valid,
         CASE WHEN raw_oi > 0 THEN raw_oi END AS option_oi,
         CASE WHEN raw_oi > 0 THEN raw_call_oi END AS call_oi,
         CASE WHEN raw_oi > 0 THEN raw_put_oi END AS put_oi,
         CASE WHEN raw_oi > 0 THEN raw_put_oi / nullif(raw_call_oi, 0) END AS pc_oi_ratio,
         iv - hv AS iv_hv_spread, iv / nullif(hv, 0) AS iv_hv_ratio
  FROM base),
chg AS (
  SELECT *, option_oi - lag(option_oi) OVER s AS oi_change, call_oi - lag(call_oi) OVER s AS call_oi_change,
         put_oi - lag(put_oi) OVER s AS put_oi_change,
         (option_oi - lag(option_oi) OVER s) / nullif(lag(option_oi) OVER s, 0) AS oi_change_pct,
         option_volume / nullif(lag(option_oi) OVER s, 0) AS vol_oi_ratio,
         ln(underlying_price / nullif(lag(underlying_price) OVER s, 0)) AS ret_1d,
         count(*) OVER (PARTITION BY symbol) AS symbol_history_days
  FROM hist WINDOW s AS (PARTITION BY symbol ORDER BY date))"""


def _z(name: str, x: str) -> str:
    return (
        f"CASE WHEN count({x}) OVER b >= 15 THEN ({x} - avg({x}) OVER b) / "
        f"nullif(stddev_samp({x}) OVER b, 0) END AS {name}"
    )


TRAILING = HISTORY + """,
trail AS (
  SELECT *, """ + ",\n         ".join(
    [
        _z("iv_z20", "iv"), _z("hv_z20", "hv"), _z("iv_hv_spread_z20", "iv_hv_spread"),
        _z("vol_z20", "option_volume"), _z("pc_vol_z20", "pc_volume_ratio"), _z("pc_oi_z20", "pc_oi_ratio"),
        _z("oi_change_z20", "oi_change"), _z("price_z20", "underlying_price"),
    ]
) + """,
         CASE WHEN count(option_volume) OVER b >= 15
              THEN option_volume / nullif(quantile_cont(option_volume, 0.5) OVER b, 0) END AS vol_ratio_20,
         CASE WHEN count(ret_1d) OVER b >= 15 THEN stddev_samp(ret_1d) OVER b * sqrt(252) END AS realized_vol_20,
         CASE WHEN count(oi_change) OVER r3 = 3 THEN sum(oi_change) OVER r3 END AS oi_change_sum_3d,
         CASE WHEN count(oi_change) OVER r5 = 5 THEN sum(oi_change) OVER r5 END AS oi_change_sum_5d,
         sum(CASE WHEN oi_change > 0 THEN 0 ELSE 1 END) OVER upto AS reset_id
  FROM chg
  WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
         r3 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
         r5 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         upto AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
feat AS (
  SELECT *, sum(CASE WHEN iv_z20 > 2 THEN 1 ELSE 0 END) OVER r5 AS days_iv_z_gt2_last5,
         sum(CASE WHEN vol_z20 > 2 THEN 1 ELSE 0 END) OVER r5 AS days_vol_z_gt2_last5,
         sum(CASE WHEN oi_change > 0 THEN 1 ELSE 0 END)
           OVER (PARTITION BY symbol, reset_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS consec_oi_up
  FROM trail
  WINDOW r5 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def _rank(name: str, x: str) -> str:
    """Average rank over the count, written with ties counted in a partition of their own."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END AS {name}"
    )


TABLE = TRAILING + """,
mkt AS (
  SELECT date, max(CASE WHEN symbol = '0' THEN ret_1d END) AS spy_ret_1d,
         max(CASE WHEN symbol = '1' THEN ret_1d END) AS qqq_ret_1d
  FROM chg GROUP BY date),
full_table AS (
  SELECT f.*, m.spy_ret_1d, m.qqq_ret_1d,
         """ + _rank("iv_z20_xs_rank", "iv_z20") + """,
         """ + _rank("vol_z20_xs_rank", "vol_z20") + """,
         CASE WHEN symbol IN ('0', '1') THEN 1 ELSE 0 END AS is_etf,
         CASE WHEN date <= DATE '1999-12-31' THEN 'discovery' ELSE 'holdout' END AS time_split,
         CASE WHEN symbol = '4' THEN 'holdout' ELSE 'discovery' END AS symbol_split,
         CASE WHEN symbol_history_days >= 60 THEN 1 ELSE 0 END AS min_history_ok,
         CASE WHEN date <= DATE '1999-12-31' AND symbol <> '4' AND symbol_history_days >= 60 THEN 1 ELSE 0 END
           AS usable_for_discovery
  FROM feat f LEFT JOIN mkt m USING (date))"""
