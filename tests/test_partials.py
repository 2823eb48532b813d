"""Reports by day read changed days alone and equal a full run."""

import datetime as dt

from tapewright.plans import collection, partials
from tapewright.schemas import TAPE
from tapewright.sources import readers, sinks


def tape(spark, *ticks):
    """Ticks (day of the month, symbol, sequence)."""
    rows = [
        (f"US.{s}260821C1", s, "t", dt.datetime(2026, 8, d, 10, 0, n % 60), dt.date(2026, 8, d), 1.0, 2.0, 90_000.0, "BUY", n) for d, s, n in ticks
    ]
    return spark.createDataFrame(rows, TAPE)


def test_only_changed_days_are_measured(spark, tmp_path):
    table, store, read = str(tmp_path / "tape"), str(tmp_path / "days"), []

    def summary(rows):
        return collection.day_summary(rows.withColumn("time", rows["ts"]))

    def measure(rows):
        read.append(sorted(r.trade_date.day for r in rows.select("trade_date").distinct().collect()))
        return summary(rows)

    def equal():
        got = sorted(map(str, partials.refreshed(spark, table, store, measure).select("day", "symbol", "prints", "first_tick", "raw_events").collect()))
        want = summary(readers.read_tape(spark, table)).select("day", "symbol", "prints", "first_tick", "raw_events")
        assert got == sorted(map(str, want.collect()))

    sinks.append_tape(tape(spark, (10, "A", 1), (10, "B", 2), (11, "A", 3)), table)
    equal()
    equal()
    sinks.append_tape(tape(spark, (11, "A", 4), (12, "B", 5)), table)
    equal()
    assert read == [[10, 11], [11, 12]]
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/trade_date=2026-08-10"), True)
    equal()
    assert len(read) == 2
