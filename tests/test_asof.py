"""As-of lookups against a sorted walk."""

import bisect
import datetime as dt
import random

from pyspark.sql import functions as F

from tapewright.operators import asof, study

START = dt.datetime(2026, 8, 12, 9, 30)
KNOWN, ROWS = "symbol string, ts timestamp_ntz, price double, nth bigint", "id bigint, symbol string, ts timestamp_ntz"


def tables():
    """A symbol with most ticks, some at one time; one without ticks; gaps of days; null keys, times and values."""
    rng = random.Random(3)
    when = lambda: START + dt.timedelta(seconds=rng.choice([rng.randrange(900), rng.randrange(8000), rng.randrange(400_000)]))
    known = [("hot" if rng.random() < 0.8 else "cold", when(), rng.choice([None, float(k)]), k) for k in range(400)]
    known += [(None, START, 1.0, 500), ("hot", None, 2.0, 501)]
    rows = [(k, rng.choice(["hot", "hot", "cold", "none"]), when()) for k in range(300)]
    rows += [(301, None, START), (302, "hot", None), (303, "hot", START - dt.timedelta(days=3)), (304, "hot", START + dt.timedelta(days=90))]
    return known, rows + rows[:5] + [(400 + k, s, t) for k, (s, t, _, _) in enumerate(known[:50])]


def walk(known, rows, tolerance=None):
    last = {}
    for s, t, p, n in known:
        if s is not None and t is not None and last.get((s, t), (None, -1))[1] < n:
            last[s, t] = (p, n)
    times = {}
    for s, t in sorted(last):
        times.setdefault(s, []).append(t)
    out = []
    for k, s, t in rows:
        at = times.get(s, [])
        i = bisect.bisect_right(at, t) if t is not None else 0
        found = at[i - 1] if i and (tolerance is None or at[i - 1] + tolerance >= t) else None
        out.append((k, s, t, found, last[s, found][0] if found else None))
    return sorted(out, key=repr)


def test_asof_join_equals_a_sorted_walk(spark):
    known, rows = tables()
    k, r = spark.createDataFrame(known, KNOWN), spark.createDataFrame(rows, ROWS)
    for block in ("minute", "hour", "year"):
        for tolerance in (None, 600):
            interval = None if tolerance is None else F.expr(f"interval {tolerance} seconds")
            got = asof.asof_join(r, k, ["symbol"], "ts", ["price"], ["nth"], interval, block).select("id", "symbol", "ts", "asof_ts", "asof_price")
            want = walk(known, rows, None if tolerance is None else dt.timedelta(seconds=tolerance))
            assert sorted(map(tuple, got.collect()), key=repr) == want, (block, tolerance)


def test_asof_join_of_empty_tables(spark):
    known, rows = tables()
    none = spark.createDataFrame([], KNOWN)
    got = asof.asof_join(spark.createDataFrame(rows, ROWS), none, ["symbol"], "ts", ["price"]).collect()
    assert len(got) == len(rows) and all(g.asof_ts is None for g in got)
    assert asof.asof_join(spark.createDataFrame([], ROWS), none, ["symbol"], "ts", ["price"]).count() == 0


def test_tick_returns(spark):
    tick = lambda m, p: ("T", START + dt.timedelta(minutes=m), p)
    ticks = spark.createDataFrame([tick(0, 100.0), tick(59.5, 110.0), tick(61, 999.0)], "symbol string, time timestamp_ntz, price double")
    rows = spark.createDataFrame([(1, *tick(0, -1)), (2, *tick(30, 1)), (3, *tick(300, 1))], "id bigint, symbol string, time timestamp_ntz, sign bigint")
    got = {r.id: (r.close, r.close_later, r.signed_return) for r in study.tick_returns(rows, ticks, tolerance_minutes=40).collect()}
    assert got[1][:2] == (100.0, 110.0) and abs(got[1][2] + 0.1) < 1e-12
    assert got[2][:2] == (100.0, 999.0) and got[3] == (None, None, None)
