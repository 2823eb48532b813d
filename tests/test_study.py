"""Event study on small tables."""

import datetime as dt
import hashlib
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tapewright.functions.measures import implied_sign
from tapewright.operators import study

DAY = dt.datetime(2026, 8, 12)


def at(minute):
    return DAY + dt.timedelta(minutes=minute)


def bars(spark, closes):
    return spark.createDataFrame([("T", at(m), c) for m, c in closes], "symbol string, minute timestamp_ntz, close double")


def test_minute_closes_take_the_last_price(spark):
    quotes = spark.createDataFrame(
        [("T", at(0) + dt.timedelta(seconds=s), p) for s, p in [(1, 1.0), (59, 3.0), (30, 2.0), (60, 9.0)]],
        "symbol string, ts timestamp_ntz, price double",
    )
    assert sorted((r.minute, r.close) for r in study.minute_closes(quotes).collect()) == [(at(0), 3.0), (at(1), 9.0)]


def test_grid_holds_the_last_close_to_the_session_end(spark):
    got = {r.minute: r.close for r in study.minute_grid(bars(spark, [(570, 1.0), (573, 2.0)]), day_end_minute=575).collect()}
    assert got == {at(570): 1.0, at(571): 1.0, at(572): 1.0, at(573): 2.0, at(574): 2.0, at(575): 2.0}
    ends = {r.minute for r in study.minute_grid(bars(spark, [(571, 1.0)]), day_end_minute=571, label="end").collect()}
    assert ends == {at(570), at(571)}


def test_returns_stop_at_the_session_end(spark):
    grid = study.minute_grid(bars(spark, [(570 + i, 100.0 + i) for i in range(100)]), day_end_minute=669)
    got = {r.minute: r.ret for r in study.minute_returns(grid).collect()}
    assert got[at(570)] == pytest.approx(0.6) and got[at(609)] == pytest.approx(199 / 139 - 1) and got[at(610)] is None


def event_frame(spark, rows):
    df = spark.createDataFrame(rows, "code string, symbol string, time timestamp_ntz, direction string, right string")
    return df.withColumn("day", F.to_date("time")).withColumn("sign", implied_sign(F.col("right"), F.col("direction")))


def test_event_returns_and_controls(spark):
    price = {m: 100 + math.sin(m) for m in range(570, 800)}
    returns = study.minute_returns(study.minute_grid(bars(spark, list(price.items())), day_end_minute=799))
    rows = [
        ("a", "T", at(605) + dt.timedelta(seconds=30), "BUY", "CALL"), ("b", "T", at(605), "BUY", "PUT"),
        ("c", "T", at(10), "BUY", "CALL"), ("d", "T", at(759), "SELL", "PUT"),
    ]
    key = ["code", "symbol", "time", "direction"]
    got = {r.code: r for r in study.matched_controls(study.event_returns(event_frame(spark, rows), returns), key, seed=3).collect()}
    ret = price[665] / price[605] - 1
    assert got["a"].signed_return == pytest.approx(ret) and got["b"].signed_return == pytest.approx(-ret)
    assert got["c"].signed_return is None and got["c"].controls is None
    assert got["d"].ret is None and len(got["d"].controls) == 20
    drawn = [c.minute for c in got["b"].controls]
    assert len(set(drawn)) == 20 and all(m.hour == 10 for m in drawn)
    name = "b|T|2026-08-12 10:05:00|BUY|3"
    digest, prime = hashlib.md5(name.encode()).hexdigest(), study.DRAW_PRIME
    scale, shift = int(digest[:8], 16) % prime + 1, int(digest[8:16], 16) % prime
    order = sorted(range(600, 660), key=lambda m: ((scale * m + shift) % prime) ** 2 % prime)
    assert drawn == [at(m) for m in order[:20]]
    excess = {r.code: r.excess for r in study.event_excess(study.matched_controls(study.event_returns(event_frame(spark, rows), returns), key, seed=3)).collect()}
    mean = statistics.fmean(price[m + 60] / price[m] - 1 for m in order[:20])
    assert excess["b"] == pytest.approx(-ret + mean) and excess["c"] is None


def decide(spark, by_symbol):
    rows = [(s, x, x, 0.0) for s, xs in by_symbol.items() for x in xs]
    df = spark.createDataFrame(rows, "symbol string, excess double, signed_return double, control_return double")
    return study.study_decision(df).first()


def test_decisions(spark):
    go = {s: [0.002, 0.0021, 0.0019, 0.0022] for s in ("A", "B", "C")}
    r = decide(spark, go)
    xs = go["A"] * 3
    assert r.decision == "GO" and r.t_stat == pytest.approx(statistics.fmean(xs) / (statistics.stdev(xs) / math.sqrt(12)))
    assert decide(spark, {"A": [0.0005, 0.0006], "B": [0.0005, 0.0004]}).decision == "KILL"
    assert decide(spark, {"A": [0.05, -0.04], "B": [0.03, -0.02]}).decision == "KILL"
    assert decide(spark, {"A": [0.1] * 20 + [0.11], "B": [-0.001] * 2, "C": [-0.001] * 2}).decision == "KILL"
    assert decide(spark, {"A": [0.002] * 9 + [0.0021], "B": [0.002] * 9 + [0.0021], "C": [-0.0001]}).decision == "AMBIGUOUS"
    assert decide(spark, {"A": [0.0012, 0.0013, 0.0012]}).decision == "AMBIGUOUS"


def test_unmeasured_events_do_not_count(spark):
    df = spark.createDataFrame([("A", 0.002, 0.002, 0.0), ("A", 0.003, 0.003, 0.0), ("B", None, 0.5, None)], "symbol string, excess double, signed_return double, control_return double")
    r = study.study_decision(df).first()
    assert (r.events, r.symbols, r.positive_symbols) == (2, 1, 1) and r.mean_signed_return == pytest.approx(0.0025)
