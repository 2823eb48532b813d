"""Feature-table queries on the symbol-day history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tapewright.functions.measures import ratio
from tapewright.operators import history as H
from tapewright.plans import feature_table as plan
from tapewright.schemas import FEATURE_COLUMNS, FEATURE_FLAGS
from workload import adapters as A
from workload.registry import HISTORY, TABLE, TRAILING, query

CUTOFF = dt.date(1999, 12, 31)
KEY = "symbol:s date:d "


def changed(spark, sf_dir):
    return H.change_features(H.row_features(H.mask_open_interest(A.symbol_history(spark, sf_dir))))


def trailing(spark, sf_dir):
    return H.trailing_features(changed(spark, sf_dir))


@query(KEY + " ".join(f"{z}:f" for z in H.ZSCORES), f"WITH {TRAILING}\nSELECT * FROM trail")
def zscores(spark, sf_dir):
    return trailing(spark, sf_dir)


@query(KEY + "vol_ratio_20:f", f"WITH {TRAILING}\nSELECT * FROM trail")
def ratio_to_median(spark, sf_dir):
    return trailing(spark, sf_dir)


@query(KEY + "ret_1d:f realized_vol_20:f", f"WITH {TRAILING}\nSELECT * FROM trail")
def realized_vol(spark, sf_dir):
    return trailing(spark, sf_dir)


@query(
    KEY + "oi_valid:i option_oi:f oi_change:f call_oi_change:f put_oi_change:f oi_change_pct:f vol_oi_ratio:f "
    "oi_change_sum_3d:f oi_change_sum_5d:f",
    f"WITH {TRAILING}\nSELECT * FROM trail",
)
def oi_change_features(spark, sf_dir):
    return trailing(spark, sf_dir)


@query(
    KEY + "days_iv_z_gt2_last5:i days_vol_z_gt2_last5:i", f"WITH {TRAILING}\nSELECT * FROM feat"
)
def persistence_features(spark, sf_dir):
    return H.persistence_features(trailing(spark, sf_dir))


@query(KEY + "oi_change:f consec_oi_up:i", f"WITH {TRAILING}\nSELECT * FROM feat")
def consecutive_runs(spark, sf_dir):
    return trailing(spark, sf_dir)


@query(
    KEY + "iv_z20_xs_rank:f vol_z20_xs_rank:f spy_ret_1d:f qqq_ret_1d:f", f"WITH {TABLE}\nSELECT * FROM full_table"
)
def xs_rank(spark, sf_dir):
    return H.date_features(trailing(spark, sf_dir), "0", "1")


@query(
    KEY + "ret_1d:f spy_ret_1d:f qqq_ret_1d:f",
    f"""WITH {HISTORY}
SELECT c.symbol, c.date, c.ret_1d, a.ret_1d AS spy_ret_1d, b.ret_1d AS qqq_ret_1d FROM chg c
LEFT JOIN chg a ON a.date = c.date AND a.symbol = '0' LEFT JOIN chg b ON b.date = c.date AND b.symbol = '1'""",
)
def market_context(spark, sf_dir):
    return H.with_market_context(changed(spark, sf_dir), "0", "1")


def features(spark, sf_dir):
    return plan.feature_table(A.symbol_history(spark, sf_dir), "0", "1", CUTOFF, ["4"], ["0", "1"])


_KINDS = {
    "date": "d", "symbol": "s", "time_split": "s", "symbol_split": "s", "is_etf": "i", "symbol_history_days": "i",
    "min_history_ok": "i", "usable_for_discovery": "i", "oi_valid": "i", "days_iv_z_gt2_last5": "i",
    "days_vol_z_gt2_last5": "i", "consec_oi_up": "i",
}


@query(" ".join(f"{c}:{_KINDS.get(c, 'f')}" for c in FEATURE_COLUMNS), f"WITH {TABLE}\nSELECT * FROM full_table")
def feature_table(spark, sf_dir):
    return features(spark, sf_dir)


@query(
    "time_split:s symbol_split:s rows:i usable_rows:i symbols:i first_date:d last_date:d",
    f"""WITH {TABLE}
SELECT time_split, symbol_split, count(*) AS rows, sum(usable_for_discovery) AS usable_rows,
       count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date
FROM full_table GROUP BY time_split, symbol_split""",
)
def split_counts(spark, sf_dir):
    return H.split_counts(features(spark, sf_dir))


MEASURED = [c for c in FEATURE_COLUMNS if c not in FEATURE_FLAGS]


@query(
    "feature:s missing_pct:f",
    f"WITH {TABLE}\nSELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(100.0 * (count(*) - count({c})) / count(*), 1) AS missing_pct FROM full_table"
        for c in MEASURED
    )
    + ") WHERE missing_pct > 0",
)
def missing_rates(spark, sf_dir):
    return H.missing_rates(features(spark, sf_dir), MEASURED)


@query(
    "invalid_rows:i invalid_pct:f",
    f"""WITH {HISTORY}
SELECT count(*) FILTER (oi_valid = 0) AS invalid_rows, round(100.0 * count(*) FILTER (oi_valid = 0) / count(*), 1)
  AS invalid_pct FROM hist""",
)
def oi_validity(spark, sf_dir):
    return H.oi_validity(H.mask_open_interest(A.symbol_history(spark, sf_dir)))


@query(
    "rows:i symbols:i first_date:d last_date:d",
    """SELECT count(DISTINCT (l_suppkey % 5, l_shipdate)) AS rows, count(DISTINCT l_suppkey % 5) AS symbols,
       min(l_shipdate) AS first_date, max(l_shipdate) AS last_date FROM lineitem""",
)
def date_range(spark, sf_dir):
    return plan.date_range(A.symbol_history(spark, sf_dir))


@query(
    "symbol:s",
    """SELECT symbol FROM (SELECT DISTINCT p_brand AS symbol FROM part)
ORDER BY md5(concat_ws('|', symbol, '20260822')), symbol LIMIT 7""",
)
def holdout_draw(spark, sf_dir):
    return H.draw_holdout(A.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")), 7, 20260822)


def _fwd(k: int) -> str:
    return f"ln(lead(underlying_price, {k}) OVER s / nullif(underlying_price, 0)) AS ret_fwd_{k}d"


@query(
    KEY + "ret_fwd_1d:f ret_fwd_3d:f ret_fwd_5d:f abnormal_move_5d:i abnormal_up_5d:i abnormal_down_5d:i",
    f"""WITH {TRAILING},
f AS (SELECT symbol, date, {_fwd(1)}, {_fwd(3)}, {_fwd(5)}, 2 * realized_vol_20 * sqrt(5) AS bound
      FROM trail WINDOW s AS (PARTITION BY symbol ORDER BY date))
SELECT *, CAST(abs(ret_fwd_5d) >= bound AS INTEGER) AS abnormal_move_5d,
       CAST(ret_fwd_5d >= bound AS INTEGER) AS abnormal_up_5d, CAST(ret_fwd_5d <= -bound AS INTEGER) AS abnormal_down_5d
FROM f""",
)
def forward_returns(spark, sf_dir):
    return plan.outcome_table(A.symbol_history(spark, sf_dir))


JOINED = """WITH stat AS (
  SELECT l_suppkey % 5 AS symbol, l_shipdate AS time, sum(l_quantity) AS volume,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)
           / nullif(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END), 0) AS pc
  FROM lineitem GROUP BY 1, 2),
vol AS (SELECT l_suppkey % 5 AS symbol, l_shipdate AS time, sum(CAST(l_tax AS DECIMAL(18,2))) AS iv
        FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)"""


@query(
    "symbol:i date:d option_volume:f pc_volume_ratio:f iv:f hv:f",
    f"""{JOINED}
SELECT symbol, time AS date, volume AS option_volume, pc AS pc_volume_ratio, iv, CAST(NULL AS DOUBLE) AS hv
FROM stat JOIN vol USING (symbol, time)""",
)
def history_join(spark, sf_dir):
    """Statistics landed as text, "N/A" where a ratio has no denominator, joined to another table's days."""
    lines = A.table(spark, sf_dir, "lineitem").withColumn("symbol", F.col("l_suppkey") % 5)
    part = {f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0)) for f in "AR"}
    pc = ratio(part["R"], part["A"]).cast("string")
    text = {
        c: F.lit("N/A")
        for c in (
            "underlying_price", "call_volume", "put_volume", "option_open_interest", "call_open_interest",
            "put_open_interest", "put_call_open_interest_ratio",
        )
    }
    day = F.date_format("l_shipdate", "yyyy-MM-dd").alias("time")
    stat = lines.groupBy("symbol", day).agg(
        F.sum("l_quantity").cast("string").alias("option_volume"),
        F.coalesce(pc, F.lit("N/A")).alias("put_call_volume_ratio"),
    ).withColumns(text)
    vol = lines.filter("l_linestatus = 'F'").groupBy("symbol", day).agg(
        F.sum(F.col("l_tax").cast("decimal(18,2)")).cast("string").alias("iv")
    ).withColumn("hv", F.lit("NaN"))
    return H.join_history(stat, vol)
