"""Flow analysis on small hand-made tapes."""

import pytest
from pyspark.sql import functions as F

from tapewright.operators import flow

SCHEMA = "time string, price double, volume double, turnover double, ticker_direction string, sequence bigint"


def tape(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def analyze(spark, rows):
    return flow.analyze_flow(tape(spark, rows)).first()


def test_mixed_tape(spark):
    r = analyze(
        spark,
        [
            ("09:30", 100.0, 60.0, 6000.0, "BUY"), ("09:30", 101.0, 55.0, 5555.0, "BUY"),
            ("09:31", 99.0, 30.0, 2970.0, "SELL"), ("09:31", 98.0, 20.0, 1960.0, "SELL"),
            ("09:32", 100.0, 10.0, 1000.0, "NEUTRAL"), ("09:32", 100.0, 50.0, 5000.0, "BUY"),
        ],
    )
    assert (r.buy_notional, r.sell_notional, r.net_notional) == (16555.0, 4930.0, 11625.0)
    assert r.buy_share == pytest.approx(16555 / 21485)
    assert r.total_prints == 6 and r.label == "UNUSUAL_BUY_PRESSURE"
    assert [(b.volume, b.turnover) for b in r.blocks] == [(60.0, 6000.0), (55.0, 5555.0), (50.0, 5000.0)]
    assert [(c.time, c.direction, c.prints, c.volume, c.notional) for c in r.clusters] == [
        ("09:30", "BUY", 2, 115.0, 11555.0), ("09:31", "SELL", 2, 50.0, 4930.0),
    ]


def test_empty_tape(spark):
    r = analyze(spark, [])
    assert (r.buy_notional, r.sell_notional, r.net_notional, r.buy_share, r.total_prints) == (0, 0, 0, 0.0, 0)
    assert r.blocks == [] and r.clusters == [] and r.label == "BALANCED"


def test_sell_pressure(spark):
    r = analyze(
        spark,
        [("10:00", 50.0, 100.0, 5000.0, "SELL"), ("10:00", 50.0, 80.0, 4000.0, "SELL"), ("10:01", 51.0, 10.0, 510.0, "BUY")],
    )
    assert r.label == "UNUSUAL_SELL_PRESSURE" and r.net_notional == -8490.0
    assert [b.volume for b in r.blocks] == [100.0, 80.0] and len(r.clusters) == 1


def test_blocks_are_capped(spark):
    r = analyze(spark, [(f"09:{i:02d}", 100.0, 50.0 + i, 100.0, "BUY") for i in range(15)])
    assert [b.volume for b in r.blocks] == [float(v) for v in range(64, 54, -1)]


def test_clusters_are_capped(spark):
    rows = [(f"09:{i:02d}", 100.0, 10.0, i * 100 + 50.0, "BUY") for i in range(15) for _ in range(2)]
    notionals = [c.notional for c in analyze(spark, rows).clusters]
    assert len(notionals) == 10 and notionals[0] == 2900.0 and notionals == sorted(notionals, reverse=True)


@pytest.mark.parametrize(
    "buy, sell, label",
    [(0.65, 0.35, "UNUSUAL_BUY_PRESSURE"), (0.35, 0.65, "UNUSUAL_SELL_PRESSURE"), (1000.0, 1000.0, "BALANCED")],
)
def test_label_bounds(spark, buy, sell, label):
    r = analyze(spark, [("10:00", 1.0, 1.0, buy, "BUY"), ("10:01", 1.0, 1.0, sell, "SELL")])
    assert r.label == label and r.buy_share == pytest.approx(buy / (buy + sell))


def test_neutral_only_is_balanced_and_clusters(spark):
    r = analyze(spark, [("10:00", 1.0, 10.0, 1000.0, "NEUTRAL"), ("10:00", 1.0, 20.0, 2000.0, "NEUTRAL")])
    assert r.label == "BALANCED" and r.buy_share == 0.0 and r.total_prints == 2
    assert [(c.direction, c.volume, c.notional) for c in r.clusters] == [("NEUTRAL", 30.0, 3000.0)]


def test_single_tick(spark):
    r = analyze(spark, [("09:00", 100.0, 5.0, 500.0, "BUY")])
    assert r.buy_share == 1.0 and r.clusters == [] and r.blocks == [] and r.label == "UNUSUAL_BUY_PRESSURE"


def test_directions_at_one_time_are_separate(spark):
    rows = [("11:00", 1.0, v, t, d) for v, t, d in [(10.0, 1000.0, "BUY"), (12.0, 1200.0, "BUY"), (8.0, 792.0, "SELL"), (9.0, 891.0, "SELL")]]
    r = analyze(spark, rows)
    assert [(c.direction, c.volume, c.notional) for c in r.clusters] == [("BUY", 22.0, 2200.0), ("SELL", 17.0, 1683.0)]


def test_time_text_is_the_cluster_key(spark):
    rows = [("09:30:00", 1.0, 1.0, 1.0, "BUY"), ("09:30:00.000", 1.0, 1.0, 1.0, "BUY")]
    assert flow.clusters(tape(spark, rows), []).count() == 0


def test_events_drop_neutral_and_small(spark):
    rows = [("a", 1.0, 1.0, 130_000.0, "BUY")] * 2 + [("a", 1.0, 1.0, 200_000.0, "NEUTRAL")] * 2
    rows += [("b", 1.0, 1.0, 124_999.0, "SELL")] * 2 + [("c", 1.0, 1.0, 900_000.0, "SELL")] + [("d", 1.0, 1.0, 125_000.0, "SELL")] * 2
    got = flow.cluster_events(tape(spark, rows).withColumn("code", F.lit("x"))).orderBy("time").collect()
    assert [(e.time, e.direction, e.notional) for e in got] == [("a", "BUY", 260_000.0), ("d", "SELL", 250_000.0)]


def test_grouped_analysis_keeps_groups_apart(spark):
    rows = [("x", "t1", 1.0, 60.0, 10.0, "BUY", 1), ("x", "t1", 1.0, 50.0, 10.0, "BUY", 2), ("y", "t1", 1.0, 5.0, 7.0, "SELL", 1)]
    df = spark.createDataFrame(rows, "code string, " + SCHEMA)
    got = {r.code: r for r in flow.analyze_flow(df, ["code"]).collect()}
    assert len(got["x"].blocks) == 2 and len(got["x"].clusters) == 1
    assert got["y"].blocks == [] and got["y"].clusters == [] and got["y"].label == "UNUSUAL_SELL_PRESSURE"
