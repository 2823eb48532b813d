"""Trailing features against pandas, and the rules the table must keep."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.operators import history as H
from tapewright.operators.columns import forbid_outcomes
from tapewright.plans.feature_table import feature_table, outcome_table
from tapewright.schemas import FEATURE_COLUMNS

SCHEMA = "symbol string, date date, " + ", ".join(f"{m} double" for m in H.MEASURES)


def make(days=90, symbols=("SPY", "QQQ", "TSLA", "ARM"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        price = 100.0
        for i in range(days):
            price *= float(np.exp(rng.normal(0, 0.02)))
            day = dt.date(2026, 3, 2) + dt.timedelta(days=i + (i // 7))
            hole = lambda v, p=0.1: None if rng.random() < p else float(v)
            iv = 0.3 if 25 <= i < 50 else rng.normal(0.3, 0.05)
            rows.append(
                (
                    s, day, hole(rng.choice([0.5, 1.0, 1.5])), hole(rng.normal(1, 0.2)), hole(iv), hole(rng.choice([0.0, 0.2, 0.25])),
                    price, hole(rng.integers(0, 50)), float(rng.integers(0, 30)), float(rng.integers(0, 30)),
                    float(rng.choice([0, 90, 100, 110, 120])), hole(rng.integers(1, 60)), hole(rng.integers(1, 60)),
                )
            )
    return pd.DataFrame(rows, columns=["symbol", "date", *H.MEASURES])


def frame(spark, pdf):
    clean = pdf.astype(object).where(pd.notna(pdf), None)
    return spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], SCHEMA)


def expected(pdf):
    """The definitions, symbol by symbol, on dense NumPy arrays."""
    out = []
    for symbol, g in pdf.sort_values("date").groupby("symbol", sort=False):
        g = g.reset_index(drop=True)
        valid = g.option_oi.gt(0)
        col = {c: g[c].astype(float).to_numpy(copy=True) for c in H.MEASURES}
        for c in H.OI_COLUMNS:
            col[c][~valid] = np.nan
        n = len(g)

        def past(x, i):
            w = x[max(0, i - 20):i]
            return w[~np.isnan(w)]

        def z(x):
            r = np.full(n, np.nan)
            for i in range(n):
                w = past(x, i)
                if len(w) >= 15 and np.ptp(w) > 0:
                    r[i] = (x[i] - w.mean()) / w.std(ddof=1)
            return r

        def prev(x):
            return np.concatenate([[np.nan], x[:-1]])

        with np.errstate(all="ignore"):
            oi = col["option_oi"]
            change = oi - prev(oi)
            ret = np.log(col["underlying_price"] / prev(col["underlying_price"]))
            f = {
                "iv_z20": z(col["iv"]), "hv_z20": z(col["hv"]), "iv_hv_spread_z20": z(col["iv"] - col["hv"]),
                "vol_z20": z(col["option_volume"]), "pc_vol_z20": z(col["pc_volume_ratio"]), "pc_oi_z20": z(col["pc_oi_ratio"]),
                "oi_change": change, "oi_change_z20": z(change), "price_z20": z(col["underlying_price"]), "ret_1d": ret,
                "oi_change_pct": change / prev(oi), "vol_oi_ratio": col["option_volume"] / prev(oi),
                "iv_hv_ratio": np.where(col["hv"] == 0, np.nan, col["iv"] / col["hv"]),
            }
        med, real = np.full(n, np.nan), np.full(n, np.nan)
        sums = {3: np.full(n, np.nan), 5: np.full(n, np.nan)}
        up, days = np.zeros(n), {"iv_z20": np.zeros(n), "vol_z20": np.zeros(n)}
        for i in range(n):
            w = past(col["option_volume"], i)
            if len(w) >= 15 and np.median(w) != 0:
                med[i] = col["option_volume"][i] / np.median(w)
            w = past(ret, i)
            if len(w) >= 15:
                real[i] = w.std(ddof=1) * np.sqrt(252)
            for k, s in sums.items():
                if i + 1 >= k:
                    s[i] = change[i + 1 - k:i + 1].sum()
            up[i] = (up[i - 1] if i else 0) + 1 if change[i] > 0 else 0
            for c in days:
                days[c][i] = (f[c][max(0, i - 4):i + 1] > 2).sum()
        f |= {
            "vol_ratio_20": med, "realized_vol_20": real, "oi_change_sum_3d": sums[3], "oi_change_sum_5d": sums[5],
            "consec_oi_up": up, "days_iv_z_gt2_last5": days["iv_z20"], "days_vol_z_gt2_last5": days["vol_z20"],
            "symbol": symbol, "date": g.date,
        }
        out.append(pd.DataFrame(f))
    df = pd.concat(out)
    for c in ("iv_z20", "vol_z20"):
        df[f"{c}_xs_rank"] = df.groupby("date")[c].rank(pct=True)
    for s, name in (("SPY", "spy_ret_1d"), ("QQQ", "qqq_ret_1d")):
        df[name] = df.date.map(df[df.symbol == s].set_index("date").ret_1d)
    return df.sort_values(["date", "symbol"]).reset_index(drop=True)


def test_features_match_pandas(spark):
    pdf = make()
    # A market symbol that lacks one date.
    pdf = pdf[~((pdf.symbol == "QQQ") & (pdf.date == sorted(pdf.date.unique())[40]))]
    got = feature_table(frame(spark, pdf)).toPandas().sort_values(["date", "symbol"]).reset_index(drop=True)
    want = expected(pdf)
    assert list(got.columns) == FEATURE_COLUMNS and len(got) == len(want)
    for c in [c for c in want.columns if c not in ("symbol", "date")]:
        a, b = got[c].astype(float), want[c].astype(float)
        assert (a.isna() == b.isna()).all(), c
        assert np.allclose(a.fillna(0), b.fillna(0), rtol=1e-9, atol=1e-9), c


def test_no_look_ahead(spark):
    pdf = make(days=60, symbols=("SPY", "TSLA"))
    cut = sorted(pdf.date.unique())[39]
    later = pdf.copy()
    for c in H.MEASURES:
        later.loc[later.date > cut, c] = later.loc[later.date > cut, c] * 3 + 1
    cols = [c for c in FEATURE_COLUMNS if c not in ("symbol_history_days", "min_history_ok", "usable_for_discovery")]
    a, b = (
        feature_table(frame(spark, p)).filter(F.col("date") <= F.lit(cut)).select(*cols).orderBy("date", "symbol").collect()
        for p in (pdf, later)
    )
    assert a == b


def test_oi_zero_masks_the_day_and_both_changes(spark):
    pdf = make(days=6, symbols=("TSLA",))
    pdf["option_oi"] = [100.0, 110.0, 0.0, 120.0, 130.0, 125.0]
    got = H.symbol_features(frame(spark, pdf)).orderBy("date").collect()
    assert [r.oi_valid for r in got] == [1, 1, 0, 1, 1, 1]
    assert [r.oi_change for r in got] == [None, 10.0, None, None, 10.0, -5.0]
    assert [r.consec_oi_up for r in got] == [0, 1, 0, 0, 1, 0]
    assert got[2].call_oi is None and got[2].pc_oi_ratio is None


def test_window_needs_fifteen_observations(spark):
    pdf = make(days=18, symbols=("TSLA",))
    pdf["iv"] = np.linspace(0.1, 0.9, 18)
    got = [r.iv_z20 for r in H.symbol_features(frame(spark, pdf)).orderBy("date").collect()]
    assert got[:15] == [None] * 15 and got[15] is not None
    pdf.loc[3, "iv"] = None
    got = [r.iv_z20 for r in H.symbol_features(frame(spark, pdf)).orderBy("date").collect()]
    assert got[15] is None and got[16] is not None


def test_splits_and_history(spark):
    pdf = pd.concat([make(59, ("SKHY",)), make(60, ("TSLA", "NVDA", "IWM"))])
    got = feature_table(frame(spark, pdf), cutoff=dt.date(2026, 4, 1)).collect()
    by = {}
    for r in got:
        by.setdefault(r.symbol, []).append(r)
    assert {r.min_history_ok for r in by["SKHY"]} == {0} and {r.min_history_ok for r in by["TSLA"]} == {1}
    assert {r.symbol_split for r in by["NVDA"]} == {"holdout"} and {r.is_etf for r in by["IWM"]} == {1}
    assert all((r.time_split == "discovery") == (r.date <= dt.date(2026, 4, 1)) for r in got)
    assert all(r.usable_for_discovery == (r.symbol in ("TSLA", "IWM") and r.date <= dt.date(2026, 4, 1)) for r in got)
    assert P.TIME_CUTOFF == dt.date(2026, 5, 21) and len(P.UNIVERSE) == 28 and set(P.SYMBOL_HOLDOUT) < set(P.UNIVERSE)


def test_percentile_rank_ties_and_nulls(spark):
    rows = [("d", v) for v in (1.0, 2.0, 2.0, None, 5.0)]
    from tapewright.functions.rolling import percentile_rank

    df = spark.createDataFrame(rows, "g string, x double").withColumn("r", percentile_rank(F.col("x"), "g"))
    assert sorted((r.x or 99, r.r) for r in df.collect())[:4] == [(1.0, 0.25), (2.0, 0.625), (2.0, 0.625), (5.0, 1.0)]
    assert df.filter("x is null").first().r is None


def test_history_join_and_bad_numbers(spark):
    names = list(H.CANONICAL_NAMES)[1:] + ["underlying_price", "option_volume", "call_volume", "put_volume"]
    stat = spark.createDataFrame(
        [("TSLA", "2026-08-03", *["N/A"] * len(names)), ("TSLA", "2026-08-04", *["1.5"] * len(names)), ("XOM", "2026-08-03", *["1"] * len(names))],
        "symbol string, time string, " + ", ".join(f"{n} string" for n in names),
    )
    vol = spark.createDataFrame([("TSLA", "2026-08-03", "0.3", "NaN"), ("TSLA", "2026-08-04", "0.4", "0.2")], "symbol string, time string, iv string, hv string")
    got = H.join_history(stat, vol).orderBy("date").collect()
    assert [(str(r.date), r.option_oi, r.pc_oi_ratio, r.iv, r.hv) for r in got] == [
        ("2026-08-03", None, None, 0.3, None), ("2026-08-04", 1.5, 1.5, 0.4, 0.2),
    ]
    assert sorted(r.symbol for r in H.missing_sources(["TSLA", "XOM", "LLY"], stat, vol).collect()) == ["LLY", "XOM"]


def test_market_join_equals_market_window(spark):
    base = H.change_features(H.row_features(H.mask_open_interest(frame(spark, make(days=30)))))
    joined = H.with_market_context(base).select("date", "symbol", "spy_ret_1d", "qqq_ret_1d")
    windowed = H.date_features(H.trailing_features(base)).select("date", "symbol", "spy_ret_1d", "qqq_ret_1d")
    assert joined.exceptAll(windowed).count() == 0 and windowed.exceptAll(joined).count() == 0


def test_outcomes_stay_out(spark):
    with pytest.raises(ValueError, match="ret_fwd_1d"):
        forbid_outcomes(outcome_table(frame(spark, make(days=30, symbols=("TSLA",)))))


def test_forward_returns(spark):
    pdf = make(days=40, symbols=("TSLA",))
    got = outcome_table(frame(spark, pdf)).orderBy("date").toPandas()
    p = pdf.sort_values("date").underlying_price.to_numpy()
    assert np.allclose(got.ret_fwd_3d[:-3].astype(float), np.log(p[3:] / p[:-3]))
    assert got.ret_fwd_5d[-5:].isna().all() and got.abnormal_move_5d[:15].isna().all()


def test_seeded_holdout_is_repeatable(spark):
    symbols = spark.createDataFrame([(s,) for s in P.UNIVERSE], "symbol string")
    a, b = (sorted(r.symbol for r in H.draw_holdout(symbols.repartition(n), 7, 1).collect()) for n in (1, 5))
    assert a == b and len(a) == 7


def test_profiles(spark):
    table = feature_table(frame(spark, make(days=30)))
    rates = {r.feature: r.missing_pct for r in H.missing_rates(table, ["iv", "underlying_price", "iv_z20"]).collect()}
    assert "underlying_price" not in rates and rates["iv_z20"] > rates["iv"] > 0
    rows = H.split_counts(table).collect()
    assert sum(r.rows for r in rows) == 120
    assert H.oi_validity(table).first().invalid_rows == table.filter("oi_valid = 0").count()
