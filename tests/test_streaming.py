"""Streams over several micro-batches equal their batch forms."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tapewright.operators import flow, tape
from tapewright.schemas import TICK
from tapewright.streaming import polls, source, ticks

HEADER = "code,time,price,volume,turnover,ticker_direction,sequence"


def make_rows(n=600, seed=4):
    rng = random.Random(seed)
    now, rows = dt.datetime(2026, 8, 12, 9, 30), []
    for i in range(n):
        now += dt.timedelta(seconds=rng.choice([0, 0, 1, 20, 400, 1300]))
        code = rng.choice(["US.TSLA260821C250000", "US.NVDA260821P9500", "US.TSLA260821C250000"])
        rows.append((code, now, 1.0, float(rng.randint(1, 80)), float(rng.randint(1, 9) * 50_000), rng.choice(["BUY", "SELL", "NEUTRAL"]), i // 2))
    return rows


def land(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(HEADER + "\n")
        for code, ts, price, volume, turnover, direction, seq in rows:
            f.write(f"{code},{ts:%Y-%m-%d %H:%M:%S},{price},{volume},{turnover},{direction},{seq}\n")
    stamp = 1_760_000_000 + int(name.split(".")[0])
    os.utime(f"{folder}/{name}", (stamp, stamp))


def landed(tmp_path, rows, size=150):
    folder = str(tmp_path / "landing")
    for i in range(0, len(rows), size):
        land(folder, f"{i:05d}.csv", rows[i:i + size])
    return folder


def batch(spark, rows):
    df = spark.createDataFrame(rows, "code string, ts timestamp, price double, volume double, turnover double, ticker_direction string, sequence bigint")
    return df.withColumn("trade_date", F.to_date("ts"))


def test_dedup_over_batches(spark, tmp_path):
    rows = make_rows()
    folder = landed(tmp_path, rows + rows[-150:])
    want = {(r[0], r[6]) for r in rows}
    for unique in (ticks.dedup_within, ticks.dedup_sessions):
        stream = source.stream_landed_ticks(spark, folder, max_files=1)
        got = source.run_available(unique(stream, delay="30 days").select("code", "sequence", "trade_date"), "dedup").collect()
        assert {(r.code, r.sequence) for r in got} == want
        if unique is ticks.dedup_within:
            assert len(got) == len(want)
        else:
            assert len(got) == len({(r[0], r[6], r[1].date()) for r in rows})


def test_clusters_heartbeat_and_counts_over_batches(spark, tmp_path):
    rows = make_rows()
    stream = source.stream_landed_ticks(spark, landed(tmp_path, rows), max_files=1)
    data = batch(spark, rows)
    found = source.run_updates(ticks.cluster_stream(stream), ["code", "ts", "direction"], "clusters")
    got = sorted((r.code, r.ts, r.direction, r.prints, r.notional) for r in found.collect())
    clusters = flow.cluster_events(data.withColumn("time", F.col("ts")), ["code"])
    want = sorted((r.code, r.time, r.direction, r.prints, r.notional) for r in clusters.collect())
    assert got == want and want
    beats = source.run_updates(ticks.heartbeat(stream), ["hour_start"], "beats")
    hours = data.groupBy(F.date_trunc("hour", "ts").alias("h")).count()
    assert sorted(map(tuple, beats.collect())) == sorted(map(tuple, hours.collect()))
    counts = source.run_updates(ticks.feed_counts(stream), ["code", "sequence", "session_start"], "counts")
    assert counts.agg(F.sum("copies")).first()[0] == len(rows)


def test_each_silence_once(spark, tmp_path):
    rows = make_rows()
    stream = source.stream_landed_ticks(spark, landed(tmp_path, rows), max_files=1)
    alerts = source.run_available(ticks.silence_alerts(stream), "silence").collect()
    plain = spark.createDataFrame([(r[1],) for r in rows], "ts timestamp_ntz")
    want = sorted(r.alert_time for r in tape.silences(plain).collect())
    assert sorted(r.alert_time for r in alerts) == want and len(want) > 20


def test_seal_reports_refused_rows(spark, tmp_path):
    rows = make_rows(40)
    old = [(r[0], r[1] - dt.timedelta(days=1), *r[2:]) for r in rows[:7]]
    stream = source.stream_landed_ticks(spark, landed(tmp_path, rows[:20] + old))
    sealed = ticks.seal_stream(stream, F.lit("2026-08-12").cast("date"))
    assert source.run_available(sealed.select("code", "sequence"), "seal").count() == 20


def test_append_survives_a_restart(spark, tmp_path):
    rows, folder = make_rows(300), str(tmp_path / "landing")
    out, checkpoint = str(tmp_path / "tape"), str(tmp_path / "checkpoint")

    def run():
        unique = ticks.dedup_sessions(source.stream_landed_ticks(spark, folder), delay="30 days")
        query = source.append_partitions(unique.drop("session_start"), out, checkpoint, seconds=1)
        query.processAllAvailable()
        query.stop()

    land(folder, "00001.csv", rows[:150])
    run()
    land(folder, "00002.csv", rows[100:])
    run()
    tape_rows = spark.read.parquet(out)
    assert tape_rows.count() == len({(r[0], r[6], r[1].date()) for r in rows})
    assert {"trade_date", "symbol"} <= set(tape_rows.columns) and tape_rows.select("symbol").distinct().count() == 2


def test_polls_and_passes(spark):
    quotes = spark.createDataFrame([("US.TSLA", 1.5, "x")], "code string, last_price double, other string")
    r = polls.stamp_polls(quotes, F.lit("2026-08-12 10:00:00").cast("timestamp")).first()
    assert r.asDict() == {
        "code": "US.TSLA", "last_price": 1.5, "poll_time": dt.datetime(2026, 8, 12, 10), "poll_date": dt.date(2026, 8, 12),
    }
    chain = spark.createDataFrame([("US.TSLA260821C250000", 7.0), ("bad", 1.0)], "code string, bid_vol double")
    got = polls.intraday_pass(chain, F.lit("2026-08-12 10:00:00").cast("timestamp_ntz")).collect()
    assert [(r.symbol, r.snap_date) for r in got] == [("TSLA", dt.date(2026, 8, 12))]


def test_watch_list_is_additive_and_read_anew(spark, tmp_path):
    path = str(tmp_path / "watch")
    spark.createDataFrame([("a",)], "code string").write.parquet(path)
    kept = []
    handle = polls.watched_batches(path, lambda df, i: kept.append(sorted(r.code for r in df.collect())))
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    handle(rows, 0)
    chain = spark.createDataFrame(
        [(c, "T", 1.0, v, 5.0) for c, v in [("a", 9.0), ("b", 8.0), ("c", 1.0)]],
        "code string, symbol string, option_premium double, volume double, option_expiry_date_distance double",
    )
    polls.refresh_watch_list(spark, path, chain, 2)
    polls.refresh_watch_list(spark, path, chain, 2)
    handle(rows, 1)
    assert kept == [["a"], ["a", "b"]]
    assert spark.read.parquet(path).count() == 2


def test_repick_joins_once_from_its_time_on(spark, tmp_path):
    watch, picked = str(tmp_path / "watch"), []
    at = lambda m: dt.datetime(2026, 8, 12, 9, 30) + dt.timedelta(minutes=m)

    def pick():
        picked.append(1)
        return spark.createDataFrame([("a",), ("b",)], "code string")

    def kept(*rows):
        ticks = spark.createDataFrame([(c, at(m)) for c, m in rows], "code string, ts timestamp_ntz")
        return sorted((r.code, r.ts) for r in polls.watched_ticks(ticks, watch, pick, 45).collect())

    polls.start_watch(spark.createDataFrame([("a",), ("a",)], "code string"), watch)
    assert kept() == [] and kept(("a", 0), ("b", 1), ("c", 2)) == [("a", at(0))]
    late = (("b", 44), ("b", 45), ("a", 46), ("c", 50))
    for _ in range(2):  # the second time as a replay
        assert kept(*late) == [("a", at(46)), ("b", at(45))]
    assert kept(("b", 3), ("b", 90)) == [("b", at(90))] and len(picked) == 1
    polls.start_watch(spark.createDataFrame([("c",)], "code string"), watch)
    assert kept(("b", 500), ("c", 501)) == [("c", at(501))]


def test_watched_stream(spark, tmp_path):
    rows = make_rows(100)
    watch = str(tmp_path / "watch")
    spark.createDataFrame([("US.NVDA260821P9500",)], "code string").write.parquet(watch)
    seen = []
    handle = polls.watched_batches(watch, lambda df, i: seen.append(df.count()))
    stream = source.stream_landed_ticks(spark, landed(tmp_path, rows, 50), TICK_ORDER, max_files=1)
    query = source.each_batch(stream, handle, str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    assert sum(seen) == sum(r[0].startswith("US.NVDA") for r in rows) and len(seen) == 2


def test_a_run_that_goes_on_loads_its_state_whole(spark, tmp_path):
    """Before, the checkpoint held changes alone, and each run repeated those of all runs before it."""
    rows, folder, at = make_rows(300), str(tmp_path / "landing"), (str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    name = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    setting = spark.conf.get(name)
    for k, some in enumerate((rows[:200], rows[100:])):
        land(folder, f"{k:05d}.csv", some)
        stream = source.stream_landed_ticks(spark, folder)
        counts = source.run_updates(ticks.feed_counts(stream, "30 days"), ["code", "sequence", "session_start"], "counts", at)
        unique = source.run_available(ticks.dedup_sessions(stream, delay="30 days").select("code", "sequence"), "dedup", at=(f"{at[0]}-dedup", f"{at[1]}-dedup"))
    assert counts.agg(F.sum("copies")).first()[0] == 400
    assert unique.count() == len({(r[0], r[6], r[1].date()) for r in rows})
    for checkpoint in (at[1], f"{at[1]}-dedup"):
        files = [f for _, _, names in os.walk(f"{checkpoint}/state") for f in names]
        assert any(f.endswith(".zip") for f in files) and not any(f.endswith(".changelog") for f in files)
    assert spark.conf.get(name) == setting


def test_slices_are_cut_in_one_pass(spark, monkeypatch):
    """Each slice lands with its own rows, in the order of their time; before, the table was read once for each of them."""
    from workload import streams

    lines, seen = "/root/testdata/sf0.001", []
    times = sorted(r["ts"] for r in streams.A.lineitem_tape(spark, lines).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")).collect())
    paths = []
    monkeypatch.setattr(streams, "scratch_path", lambda s, name, make=streams.scratch_path: (paths.append(make(s, name)), paths[-1])[1])

    def run(stream, at):
        seen.append(sorted(r["ts"] for r in spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(paths[0]).select(F.unix_micros("ts").alias("ts")).collect()))

    streams.lineitem_slices(spark, lines, "slices", run)
    assert seen[-1] == times and all(times[: len(some)] == some for some in seen)
    assert 0 < len(seen[0]) < len(seen[1]) < len(seen[2]) < len(seen[3])
    staged = next(p for p in paths if "slices-staged" in p)
    assert not [d for d in os.listdir(staged.removeprefix("file://")) if d.startswith("slice=")]


TICK_ORDER = type(TICK)([TICK[c] for c in HEADER.split(",")])
