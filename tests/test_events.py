"""Capture, qualification, progress and alerts on small tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.operators import capture, events
from tapewright.plans import collection as plan

D = [dt.date(2026, 8, d) for d in (11, 12, 13, 14)]


def cap(spark, ours, truth):
    schema = "day date, code string, volume double"
    return capture.capture_contracts(spark.createDataFrame(ours, schema), spark.createDataFrame(truth, schema))


def test_capture_drops_contracts_without_truth_and_rounds_first(spark):
    ours = [(D[0], "a", 40.0), (D[0], "a", 54.95), (D[0], "b", 94.94), (D[0], "c", 5.0), (D[0], "z", 1.0)]
    truth = [(D[0], "a", 100.0), (D[0], "b", 100.0), (D[0], "c", 0.0)]
    got = {r.code: (r.pct, r.below_threshold) for r in cap(spark, ours, truth).collect()}
    assert got == {"a": (95.0, 0), "b": (94.9, 1)}
    day = capture.capture_days(cap(spark, ours, truth)).first()
    assert (day.overall, day.sampled, day.n_below) == (94.9, 2, 1)


def test_records_round_trip(spark):
    rows = cap(spark, [(D[0], "a", 90.0), (D[0], "b", 99.0)], [(D[0], "a", 100.0), (D[0], "b", 100.0)])
    records = capture.capture_records(rows)
    r = records.first()
    assert r.contracts == {"a": 90.0, "b": 99.0} and r.below_threshold == ["a"] and r.overall == 94.5 and r.sampled == 2
    back = {x.code: (x.pct, x.below) for x in capture.record_contracts(records).collect()}
    assert back == {"a": (90.0, 1), "b": (99.0, 0)}


def test_changed_days(spark):
    now = spark.createDataFrame([(D[0], "1:5"), (D[1], "2:9"), (D[2], "1:1")], "day date, fingerprint string")
    cached = spark.createDataFrame([(D[0], "1:5"), (D[1], "2:8")], "day date, fingerprint string")
    assert sorted(r.day for r in capture.changed_days(now, cached).collect()) == [D[1], D[2]]


def sample_events(spark):
    rows = [
        (D[0], "a", "TSLA", "2026-08-11 10:00:00", 300_000.0), (D[0], "a", "TSLA", "2026-08-11 15:00:00", 700_000.0),
        (D[0], "b", "NVDA", "2026-08-11 14:59:59", 1_500_000.0), (D[0], "u", "NVDA", "2026-08-11 09:31:00", 2_000_000.0),
        (D[1], "a", "TSLA", "2026-08-12 10:00:00", 260_000.0), (D[2], "a", "TSLA", "2026-08-13 10:00:00", 9_000_000.0),
    ]
    return spark.createDataFrame(rows, "day date, code string, symbol string, time string, notional double").withColumn(
        "direction", F.lit("BUY")
    )


def tables(spark):
    days = spark.createDataFrame([(D[0], 97.0, 2, 1), (D[1], 94.9, 1, 0)], "day date, overall double, sampled int, n_below int")
    contracts = spark.createDataFrame([(D[0], "a", 0), (D[0], "b", 1), (D[1], "a", 0)], "day date, code string, below_threshold int")
    return days, contracts


def test_reasons_in_order(spark):
    days, contracts = tables(spark)
    got = [r.reason for r in events.qualify_events(sample_events(spark), days, contracts).orderBy("time").collect()]
    assert got == [
        "counted", "counted", "contract below threshold", "after 15:00", "day below threshold", "day unchecked",
    ]
    lax = events.qualify_events(sample_events(spark), days, contracts, exclude_bad_days=False)
    assert lax.filter("qualified = 1").count() == 3


def test_reports(spark):
    days, contracts = tables(spark)
    q = events.qualify_events(sample_events(spark), days, contracts).cache()
    sizes = {r.bucket: r.events for r in events.notional_histogram(q).collect()}
    assert sizes == {"250k-500k": 2, "500k-1M": 1, "1M-2M": 1, "2M-5M": 1, "5M+": 1}
    assert {r.bucket: r.events for r in events.notional_histogram(q.filter("false")).collect()} == dict.fromkeys(sizes, 0)
    hours = {r.hour: (r.events, r.excluded_hour) for r in events.hour_histogram(q).collect()}
    assert hours == {9: (1, 0), 10: (3, 0), 14: (1, 0), 15: (1, 1)}
    by = {r.symbol: (r.raw_events, r.before_cutoff_events, r.counted_events) for r in plan.event_reports(q)["by_symbol"].collect()}
    assert by == {"TSLA": (4, 3, 1), "NVDA": (2, 2, 1)}
    assert [r.notional for r in events.events_of_day(q, D[0]).collect()] == [2e6, 1.5e6, 7e5, 3e5]
    total = {r.day: (r.events, r.counted, r.total_notional) for r in events.event_totals(q).collect()}
    assert total[D[0]] == (4, 2, 4_500_000.0)


@pytest.mark.parametrize("n_days, n_events", [(0, 0), (3, 5), (10, 150), (20, 40), (20, 150), (25, 400)])
def test_progress_against_a_calendar_walk(spark, n_days, n_events):
    first = dt.date(2026, 8, 12)
    days = spark.createDataFrame([(first + dt.timedelta(days=i), 99.0) for i in range(n_days)], "day date, overall double")
    rows = spark.createDataFrame([(first, 1)] * n_events + [(dt.date(2026, 8, 1), 1)], "day date, qualified int")
    as_of = dt.date(2026, 8, 21)
    r = events.progress(rows, days, as_of).first()
    need_days, need_events = max(0, 20 - n_days), max(0, 150 - n_events)
    per_day = n_events / n_days if n_days else 0
    left = eta = max(need_days, need_events / per_day if per_day else 0)
    finish = as_of
    while left > 0:
        finish += dt.timedelta(days=1)
        left -= finish.weekday() < 5
    assert (r.valid_days, r.qualifying_events, r.need_days, r.need_events) == (n_days, n_events, need_days, need_events)
    assert math.isclose(r.eta_days, eta) and r.projected_finish == min(finish, P.HARD_STOP)
    assert r.stop == int(need_days == 0 and need_events == 0)


def test_hard_stop_ends_the_experiment(spark):
    days = spark.createDataFrame([], "day date, overall double")
    rows = spark.createDataFrame([], "day date, qualified int")
    assert events.progress(rows, days, P.HARD_STOP).first().stop == 1


def test_alerts(spark):
    days = spark.createDataFrame([(d,) for d in (D[0], D[1], D[3], dt.date(2026, 8, 18))], "day date")
    capture_day = spark.createDataFrame([(D[1], 94.9, 3), (D[3], 99.0, 2)], "day date, overall double, n_below int")
    snaps = spark.createDataFrame([(D[1], "A"), (D[1], "B"), (D[3], "A")], "day date, symbol string")
    got = {
        (r.kind, str(r.day), r.severity)
        for r in events.quality_alerts(days, capture_day, snaps, dt.date(2026, 8, 18), 2).collect()
    }
    assert got == {
        ("pending", "2026-08-12", "warn"), ("pending", "2026-08-18", "warn"), ("day", "2026-08-12", "bad"),
        ("contracts", "2026-08-14", "warn"), ("snapshots", "2026-08-14", "warn"), ("snapshots", "2026-08-18", "bad"),
        ("gap", "2026-08-13", "warn"), ("gap", "2026-08-17", "warn"),
    }


def test_day_summary_with_every_symbol(spark):
    rows = [(D[1], "TSLA", c, f"2026-08-12 {t}", 200_000.0, "BUY") for c, t in [("a", "09:30:00"), ("a", "09:30:00"), ("b", "15:59:59")]]
    tape = spark.createDataFrame(rows, "trade_date date, symbol string, code string, time string, turnover double, ticker_direction string")
    tape = tape.withColumn("ts", F.col("time").cast("timestamp_ntz")).withColumn("volume", F.lit(1.0))
    summary = plan.day_summary(tape)
    full = {r.symbol: r for r in plan.full_day_summary(summary, ["TSLA", "NVDA"]).collect()}
    assert (full["TSLA"].contracts, full["TSLA"].prints, full["TSLA"].raw_events, full["TSLA"].counted_events) == (2, 3, 1, 1)
    assert full["TOTAL"].span == "6:29:59" and full["TOTAL"].prints == 3
    assert (full["NVDA"].contracts, full["NVDA"].prints) == (0, 0)


def test_eligible_clusters(spark):
    found = spark.createDataFrame([("a", D[1]), ("b", D[1]), ("c", D[1])], "code string, trade_date date")
    checks = spark.createDataFrame([("a", D[1], True), ("b", D[1], False), ("c", D[1], True)], "code string, trade_date date, gap_free boolean")
    expiry = F.when(F.col("code") == "c", F.lit(D[2])).otherwise(F.lit(dt.date(2026, 8, 21)))
    assert [r.code for r in events.eligible_clusters(found, expiry, checks).collect()] == ["a"]
