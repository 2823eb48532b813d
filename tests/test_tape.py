"""Tape cleaning against brute force, hot keys included."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tapewright.operators import coverage, tape

TICKS = "code string, sequence bigint, time string, volume double"


def test_dedup_is_first_wins_and_idempotent(spark):
    rows = [("a", 1, "t2", 2.0), ("a", 1, "t1", 1.0), ("b", 1, "t3", 3.0), ("a", 2, "t4", 4.0), ("a", 1, "t1", 1.0)]
    df = spark.createDataFrame(rows, TICKS)
    once = tape.dedup_ticks(df, order=["time", "volume"])
    got = sorted(tuple(r) for r in once.collect())
    assert got == [("a", 1, "t1", 1.0), ("a", 2, "t4", 4.0), ("b", 1, "t3", 3.0)]
    assert sorted(tuple(r) for r in tape.dedup_ticks(once, order=["time"]).collect()) == got


def test_sequences_are_per_contract(spark):
    batch = spark.createDataFrame([("a", 1, "t", 1.0), ("b", 1, "t", 1.0), ("b", 2, "t", 1.0), ("b", 2, "t", 1.0)], TICKS)
    seen = spark.createDataFrame([("a", 1)], "code string, sequence bigint")
    got = sorted((r.code, r.sequence) for r in tape.new_ticks(batch, seen).collect())
    assert got == [("b", 1), ("b", 2)]


def test_seal_counts_every_row(spark):
    rows = [("a", dt.date(2026, 8, 12)), ("a", dt.date(2026, 8, 11)), ("a", None), ("b", dt.date(2026, 8, 12))]
    df = spark.createDataFrame(rows, "code string, trade_date date")
    session = F.lit(dt.date(2026, 8, 12))
    got = {r.code: (r.fresh_rows, r.stale_rows) for r in tape.seal_counts(df, session).collect()}
    assert got == {"a": (1, 2), "b": (1, 0)}
    assert tape.seal_session(df, session).count() == 2


def test_newest_batch_wins(spark):
    a = spark.createDataFrame([("d1", 1.0), ("d2", 2.0)], "time string, x double")
    b = spark.createDataFrame([("d2", 9.0), ("d3", 3.0)], "time string, x double").withColumn("extra", F.lit("e"))
    got = {r.time: (r.x, r.extra) for r in tape.latest_per_key([a, b], ["time"], ["x"]).collect()}
    assert got == {"d1": (1.0, None), "d2": (9.0, "e"), "d3": (3.0, "e")}


def _brute_gaps(numbers):
    s = sorted(set(numbers))
    return [(a, b, b - a - 1) for a, b in zip(s, s[1:]) if b - a > 1]


def test_gaps_across_blocks_and_copies(spark):
    rng = random.Random(1)
    hot = [n for n in range(-40, 400) if rng.random() > 0.1] + [7] * 500 + [5000, 9000]
    rows = [("hot", n) for n in hot] + [("one", 3)] + [("full", n) for n in range(100)]
    df = spark.createDataFrame(rows, "code string, sequence bigint")
    for size in (1, 3, 16, 1 << 20):
        got = sorted((r.gap_from, r.gap_to, r.missing) for r in tape.sequence_gaps(df, ["code"], size).collect())
        assert got == _brute_gaps(hot), size
    clean = {r.code: r.gap_free for r in tape.gap_free(df, ["code"]).collect()}
    assert clean == {"hot": False, "one": True, "full": True}


def test_gaps_of_numbers_far_apart(spark):
    rng = random.Random(4)
    clock = [1_700_000_000_000_000 + rng.randrange(10**14) for _ in range(300)]
    wide = clock + [n + 1 for n in clock[:50]] + [-(1 << 61), -3, -1, 0, 2, (1 << 42) - 1, 1 << 42, 1 << 61]
    df = spark.createDataFrame([(n,) for n in wide], "sequence bigint")
    for size in (2, 1 << 20):
        got = sorted((r.gap_from, r.gap_to, r.missing) for r in tape.sequence_gaps(df, [], size).collect())
        assert got == _brute_gaps(wide), size


def test_silences_against_a_sorted_walk(spark):
    rng = random.Random(2)
    ts, now = [], dt.datetime(2026, 8, 12, 9, 30)
    for _ in range(800):
        now += dt.timedelta(seconds=rng.choice([1, 30, 300, 1199, 1200, 1201, 40_000]))
        ts.append(now)
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    want = [(a, b) for a, b in zip(ts, ts[1:]) if b - a >= dt.timedelta(minutes=20)]
    got = sorted((r.last_tick, r.next_tick) for r in tape.silences(df).collect())
    assert got == want and len(want) > 100


def test_counters(spark):
    pushed = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1)], "code string, sequence bigint")
    watch = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    totals, busiest = tape.tick_counters(pushed, watch)
    assert tuple(totals.first()) == (3, 2, 1, 1)
    assert [tuple(r) for r in busiest.collect()] == [("a", 2), ("b", 1)]


def test_coverage_and_gaps_fill_the_calendar(spark):
    days = [dt.date(2026, 8, 3), dt.date(2026, 8, 4), dt.date(2026, 8, 7), dt.date(2026, 8, 8), dt.date(2026, 8, 12)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    got = sorted(r.day for r in coverage.weekday_gaps(df).collect())
    assert got == [dt.date(2026, 8, d) for d in (5, 6, 10, 11)]
    bars = spark.createDataFrame([(days[0], "TSLA"), (days[0], "NVDA")], "day date, symbol string")
    missing = coverage.missing_bars(df, bars, ["TSLA", "NVDA", "GOOGL"])
    assert missing.count() == 5 * 3 - 2
    cover = {r.day: (r.snapshots, r.missing) for r in coverage.snapshot_coverage(df, bars, 3).collect()}
    assert cover[days[0]] == (2, 1) and cover[days[1]] == (0, 3)


def test_zero_fill_covers_every_symbol(spark):
    counts = spark.createDataFrame([(dt.date(2026, 8, 3), "TSLA", 5)], "day date, symbol string, prints bigint")
    got = {r.symbol: r.prints for r in coverage.zero_filled(counts, ["TSLA", "NVDA"], ["prints"]).collect()}
    assert got == {"TSLA": 5, "NVDA": 0}


def test_feed_comparison_keeps_one_sided_days(spark):
    a = spark.createDataFrame([("d", "x")] * 3, "trade_date string, code string")
    b = spark.createDataFrame([("d", "x"), ("d", "y")], "trade_date string, code string")
    got = {r.code: (r.polled_prints, r.pushed_prints, r.difference) for r in coverage.feed_comparison(a, b).collect()}
    assert got == {"x": (3, 1, -2), "y": (0, 1, 1)}
