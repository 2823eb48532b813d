"""Screener bounds and contract pickers."""

import pytest
from pyspark.sql import functions as F

from tapewright.functions import clock, contract
from tapewright.operators import chain
from tapewright.plans import screening

SCHEMA = (
    "code string, option_type string, option_strike_price double, option_open_interest double, "
    "option_implied_volatility double, option_premium double, option_delta double, "
    "option_expiry_date_distance double, bid_price double, ask_price double, volume double"
)


def row(code="c", kind="CALL", strike=100.0, oi=500.0, iv=0.3, premium=2.5, delta=0.30, dte=14.0, bid=2.4, ask=2.6, volume=200.0):
    return (code, kind, strike, oi, iv, premium, delta, dte, bid, ask, volume)


def screen(spark, rows):
    got = chain.screen_options(spark.createDataFrame(rows, SCHEMA)).orderBy("option_type", "screen_rank").collect()
    return {k: [r for r in got if r.option_type == k] for k in ("CALL", "PUT")}


def test_top_five_by_score(spark):
    calls = [row(f"c{i}", oi=1000.0 + i * 100, volume=300.0 + i * 50) for i in range(7)]
    puts = [row(f"p{i}", "PUT", oi=800.0 + i * 120, volume=250.0 + i * 40, delta=-0.3) for i in range(7)]
    bad = [
        row(premium=0.0), row(iv=0.0), row(oi=50.0), row(bid=0.0), row(ask=0.0), row(dte=6.0), row(dte=22.0),
        row(delta=0.2), row(delta=0.5), row(bid=1.0, ask=1.5), row(premium=-1.0), row(kind="OTHER"),
    ]
    got = screen(spark, calls + puts + bad)
    assert [r.code for r in got["CALL"]] == ["c6", "c5", "c4", "c3", "c2"]
    assert [r.code for r in got["PUT"]] == ["p6", "p5", "p4", "p3", "p2"]
    top = got["CALL"][0]
    spread = 100 * (2.6 - 2.4) / ((2.6 + 2.4) / 2)
    assert top.spread_pct == pytest.approx(spread) and top.liquidity_score == pytest.approx(1600 + 600 - spread * 100)


def test_fewer_empty_and_all_filtered(spark):
    got = screen(spark, [row("a"), row("b"), row("p", "PUT", delta=-0.35)])
    assert (len(got["CALL"]), len(got["PUT"])) == (2, 1)
    assert screen(spark, []) == {"CALL": [], "PUT": []}
    assert screen(spark, [row(premium=0.0), row(iv=0.0), row(dte=5.0)]) == {"CALL": [], "PUT": []}


def test_inclusive_bounds(spark):
    got = screen(spark, [row("a", dte=7.0), row("b", dte=21.0), row("p", "PUT", delta=0.25), row("q", "PUT", delta=-0.40)])
    assert (len(got["CALL"]), len(got["PUT"])) == (2, 2)


def test_spread_bound_has_a_tolerance(spark):
    assert len(screen(spark, [row(bid=1.9, ask=2.1)])["CALL"]) == 1
    assert len(screen(spark, [row(bid=1.89, ask=2.11)])["CALL"]) == 0


def test_null_measures_count_as_zero(spark):
    assert screen(spark, [row(oi=None)])["CALL"] == []
    assert len(screen(spark, [row(volume=None)])["CALL"]) == 1


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="option_delta"):
        chain.screen_options(spark.createDataFrame([row()], SCHEMA).drop("option_delta"))


def test_tickers_are_screened_in_one_plan(spark):
    rows = [(*row(f"{s}{i}", oi=500.0 + i), s) for s in ("TSLA", "NVDA", "XOM") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA + ", symbol string")
    got = screening.screen_tickers(df, ["tsla", "US.NVDA"]).groupBy("symbol").count().collect()
    assert {r.symbol: r["count"] for r in got} == {"TSLA": 5, "NVDA": 5}


def test_liquid_contracts_and_additions(spark):
    rows = [
        ("a", "T", 1.0, 50.0, 5.0), ("b", "T", 1.0, 90.0, 5.0), ("c", "T", 0.0, 99.0, 5.0), ("d", "T", 1.0, 0.0, 5.0),
        ("e", "T", 1.0, 95.0, 1.0), ("f", "U", 1.0, 1.0, 2.0),
    ]
    df = spark.createDataFrame(rows, "code string, symbol string, option_premium double, volume double, option_expiry_date_distance double")
    fresh = chain.liquid_contracts(df, n=2)
    assert sorted(r.code for r in fresh.collect()) == ["a", "b", "f"]
    watched = spark.createDataFrame([("b",), ("z",)], "code string")
    assert sorted(r.code for r in chain.watch_additions(fresh, watched).collect()) == ["a", "f"]


def test_nearest_strikes_on_either_side(spark):
    rows = [(f"k{k}", "T", "e", "CALL", float(k)) for k in range(90, 131)] + [("null", "T", None, "CALL", 100.0)]
    df = spark.createDataFrame(rows, "code string, symbol string, expiry string, option_type string, option_strike_price double")
    spot = spark.createDataFrame([("T", 92.0)], "symbol string, spot double")
    got = sorted(r.option_strike_price for r in chain.nearest_strikes(df, spot, n=20).collect())
    assert got == [float(k) for k in range(90, 110)]


def test_busiest_ties_go_to_the_last_code(spark):
    rows = [("d", "T", c) for c in "aabbcde"]
    df = spark.createDataFrame(rows, "trade_date string, symbol string, code string")
    got = chain.busiest_contracts(df).orderBy("sample_rank").collect()
    assert [r.code for r in got] == ["b", "a", "e"]


@pytest.mark.parametrize(
    "strike, text", [(250000, "250"), (2500, "2.5"), (1234567, "1234.57"), (105, "0.105"), (100000, "100"), (12345600, "12345.6")]
)
def test_contract_code(spark, strike, text):
    code = F.lit(f"US.TSLA260821C{strike}")
    got = spark.range(1).select(
        contract.contract_symbol(code), contract.contract_expiry(code).cast("string"), contract.contract_right(code),
        contract.contract_strike(code), contract.contract_label(code), contract.contract_symbol(F.lit("TSLA")),
    ).first()
    assert tuple(got) == ("TSLA", "2026-08-21", "CALL", strike / 1000, f"TSLA C{text} 260821", None)
    assert text == f"{strike / 1000:g}"


def test_clock_helpers(spark):
    got = spark.range(1).select(
        clock.hms(F.lit(3661)), clock.hms(F.lit(59)), clock.hms(F.lit(360000)),
        F.to_json(clock.date_spans(F.lit("2026-08-01").cast("date"), F.lit("2026-09-15").cast("date"))),
        clock.parse_time(F.lit("2026-08-01 09:30:00.125")).cast("string"), clock.parse_time(F.lit("x")),
        contract.normalize_ticker(F.lit("tsla")), contract.normalize_ticker(F.lit("US.nvda")),
    ).first()
    assert got[:3] == ("1:01:01", "0:00:59", "100:00:00")
    assert got[3] == '[{"start":"2026-08-01","stop":"2026-08-29"},{"start":"2026-08-30","stop":"2026-09-15"}]'
    assert got[4:] == ("2026-08-01 09:30:00.125", None, "US.TSLA", "US.nvda")


def test_weekday_projection_against_a_calendar_walk(spark):
    import datetime as dt

    start = dt.date(2026, 8, 3)
    cases = [(start + dt.timedelta(days=d), n) for d in range(9) for n in range(0, 14)]
    df = spark.createDataFrame(cases, "day date, n int")
    for r in df.withColumn("got", clock.add_weekdays(F.col("day"), F.col("n"))).collect():
        want, left = r.day, r.n
        while left:
            want += dt.timedelta(days=1)
            left -= want.weekday() < 5
        assert r.got == want, r


def test_the_chain_is_not_shuffled_by_symbol_for_its_spot(spark, tmp_path):
    """The size of an aggregated spot is unknown to the plan; five symbols would be five tasks."""
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.range(20000).select(
        F.concat(F.lit("c"), "id").alias("code"), (F.col("id") % 5).alias("symbol"), (F.col("id") % 3).alias("expiry"), F.lit("CALL").alias("option_type"),
        F.when(F.col("id") % 997 > 0, (F.col("id") * 7919 % 1000) / 10.0).alias("option_strike_price"),
    )
    rows.write.parquet(str(tmp_path / "chain"))
    held = spark.read.parquet(str(tmp_path / "chain"))
    spot = held.groupBy("symbol").agg((F.count(F.lit(1)) / 100).alias("spot"))
    try:
        spark.conf.set(name, "20k")
        picked = chain.nearest_strikes(held, spot, n=4)
        assert "SortMergeJoin" not in picked._jdf.queryExecution().executedPlan().toString()
        got = {(r.symbol, r.expiry, r.strike_rank): r.code for r in picked.collect()}
    finally:
        spark.conf.set(name, before)
    groups = {}
    for i in range(20000):
        strike = i * 7919 % 1000 / 10 if i % 997 > 0 else None
        groups.setdefault((i % 5, i % 3), []).append((strike is not None, abs(strike - 40) if strike is not None else 0, f"c{i}"))
    want = {(*key, k + 1): row[2] for key, held in groups.items() for k, row in enumerate(sorted(held)[:4])}
    assert got == want
