"""Streams with state of their own: ranges, silences while still silent, repeats without a checkpoint, counts of batches."""

import datetime as dt
import os
import random

import numpy as np
from pyspark.sql import functions as F

from tapewright.plans import ingest
from tapewright.streaming import source, stateful

TICKS = "symbol string, ts timestamp, sequence long, trade_date date"


def test_ranges_hold_what_was_added():
    draw = random.Random(3)
    for _ in range(200):
        firsts, lasts, seen = np.empty(0, np.int64), np.empty(0, np.int64), set()
        for _ in range(4):
            values = [draw.randint(0, 40) for _ in range(draw.randint(0, 12))]
            firsts, lasts, fresh = stateful.add_to_ranges(firsts, lasts, np.array(values, np.int64))
            want = [v not in seen and v not in values[:k] for k, v in enumerate(values)]
            assert fresh.tolist() == want
            seen |= set(values)
            held = [v for a, b in zip(firsts, lasts) for v in range(a, b + 1)]
            assert sorted(seen) == held and all(b + 1 < a for b, a in zip(lasts, firsts[1:]))


def land(spark, folder, rows):
    spark.createDataFrame([(s, t, k, t.date()) for s, t, k in rows], TICKS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(TICKS).parquet(folder)


def test_a_silence_is_told_once_while_it_lasts(spark, tmp_path):
    """B falls silent and never comes back; the ticks of A move the clock. A late tick of A joins its open session."""
    at = lambda h, m: dt.datetime(2026, 1, 5, h, m)
    folder, where = str(tmp_path / "landing"), (str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    batches = [
        [("A", at(10, 0), 1), ("B", at(10, 0), 2), ("B", at(10, 5), 3)],
        [("A", at(10, 15), 4), ("A", at(10, 34), 5)],
        [("A", at(10, 30), 6), ("A", at(10, 50), 7), (None, at(10, 50), 8)],
        [("A", at(12, 0), 9)],
    ]
    told = []
    for rows in batches:
        stream = land(spark, folder, rows)
        found = source.run_available(stateful.silence_watch(stream, delay="5 minutes"), "s", at=where)
        told.append({(r["symbol"], r["alert_time"], r["ticks"], r["late_ticks"]) for r in found.collect()})
    silent_b = ("B", at(10, 25), 2, 0)
    assert told[0] == set() and told[1] == {silent_b} and told[2] == {silent_b}
    assert told[3] == {silent_b, ("A", at(11, 10), 5, 1), (None, at(11, 10), 1, 0)}


def test_a_lost_checkpoint_repeats_nothing(spark, tmp_path):
    at = dt.datetime(2026, 1, 5, 10, 0)
    folder, table = str(tmp_path / "landing"), str(tmp_path / "tape")
    keys = ("symbol", "trade_date", "sequence")
    tape = lambda: spark.read.schema(TICKS).parquet(table)
    spark.createDataFrame([], TICKS).write.parquet(table)
    parts = [[("A", at, 1), ("A", at, 1), ("A", at, 2)], [("A", at, 2), ("A", at, 3), ("B", at, 1)], [("A", at + dt.timedelta(days=1), 1), ("A", at, 5_000_000_000)]]
    for k, rows in enumerate(parts):
        stream = land(spark, folder, rows)
        fresh = stateful.dedup_from_tape(stream, tape(), keys=keys)
        source.run_available(fresh, f"fresh-{k}").write.mode("append").parquet(table)
    got = sorted((r["symbol"], r["ts"].day, r["sequence"]) for r in tape().collect())
    assert got == [("A", 5, 1), ("A", 5, 2), ("A", 5, 3), ("A", 5, 5_000_000_000), ("A", 6, 1), ("B", 5, 1)]


def test_each_batch_notes_what_it_refused_and_leaves_nothing_behind(spark, tmp_path):
    folder, table, checkpoint = str(tmp_path / "landing"), str(tmp_path / "tape"), str(tmp_path / "checkpoint")
    header = "code,time,price,volume,turnover,ticker_direction,sequence"
    code, shared = "US.TSLA260821C250000", spark.sparkContext.getConf().get("spark.checkpoint.dir")
    os.makedirs(folder)

    def write(name, lines):
        with open(f"{folder}/{name}", "w") as file:
            file.write("\n".join(lines) + "\n")

    for day in (10, 11, 12):
        rows = [f"{code},2026-08-{day} 10:00:0{k},1,1,1,BUY,{k}" for k in range(day - 8)] + [f"{code},2026-08-09 10:00:00,1,1,1,BUY,9"]
        write(f"US_TSLA260821C250000_2026-08-{day}.csv", [header, *rows])
    write("broken file.csv", ["no header here", "1,2,3"])
    before = set(os.listdir(shared))
    ingest.ingest_stream(spark, folder, table, checkpoint, max_files=1, seconds=None).awaitTermination()
    assert set(os.listdir(shared)) == before
    counts = {str(r["session"]): (r["fresh_rows"], r["stale_rows"]) for r in ingest.sealed_counts(spark, table).collect()}
    assert counts == {"2026-08-10": (2, 1), "2026-08-11": (3, 1), "2026-08-12": (4, 1)}
    noted = spark.read.parquet(ingest.note_path(table, ingest.UNREADABLE))
    assert [r["file"].rsplit("/", 1)[-1] for r in noted.filter(F.col("file").isNotNull()).collect()] == ["broken%20file.csv"]
    # The same batch once more replaces its own note.
    lines = spark.read.text(f"{folder}/US_TSLA260821C250000_2026-08-10.csv").select("value", F.col("_metadata.file_path").alias("file"))
    for _ in range(2):
        ingest._ingest(lines, 77, table)
    again = {str(r["session"]): r["fresh_rows"] for r in ingest.sealed_counts(spark, table).collect()}
    assert again["2026-08-10"] == 4


def test_streams_with_state_run_in_a_session_that_spark_made(spark, tmp_path):
    """Such a session has Spark's default state store, which holds one kind of value a stream."""
    name, default = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    at, before = dt.datetime(2026, 1, 5, 10, 0), spark.conf.get(name)
    try:
        spark.conf.set(name, default)
        stream = land(spark, str(tmp_path / "silent"), [("A", at, 1), ("B", at + dt.timedelta(hours=2), 2)])
        assert [r["symbol"] for r in source.run_available(stateful.silence_watch(stream), "plain-silence").collect()] == ["A"]
        spark.conf.set(name, default)
        stream = land(spark, str(tmp_path / "seen"), [("A", at, 1), ("A", at, 1)])
        known = spark.createDataFrame([("A", at, 2, at.date())], TICKS)
        fresh = stateful.dedup_from_tape(stream, known, keys=("symbol", "trade_date", "sequence"))
        assert [r["sequence"] for r in source.run_available(fresh, "plain-seen").collect()] == [1]
    finally:
        spark.conf.set(name, before)


def test_numbers_are_told_apart_over_the_parts_of_a_micro_batch(spark, tmp_path):
    """More rows of a contract and day than one Arrow batch holds, each twice."""
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = dt.datetime(2026, 1, 5, 10, 0)
    try:
        spark.conf.set(name, "7")
        stream = land(spark, str(tmp_path / "parts"), [("A", at, k % 30) for k in range(60)])
        fresh = stateful.dedup_from_tape(stream, spark.createDataFrame([("A", at, 3, at.date())], TICKS), keys=("symbol", "trade_date", "sequence"))
        assert sorted(r["sequence"] for r in source.run_available(fresh, "parts").collect()) == [k for k in range(30) if k != 3]
    finally:
        spark.conf.set(name, before)
