import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.sources import compaction


def rows(spark, k):
    day = dt.date(2026, 1, 1)
    return spark.createDataFrame([(day, "A B", k * 10 + i, 1.5) for i in range(10)] + [(day, "C", k, None)], "trade_date date, symbol string, sequence long, price double")


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "tape")
    for k in range(5):
        rows(spark, k).coalesce(1).write.mode("append").partitionBy("trade_date", "symbol").parquet(path)
    return path


def held(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("symbol", "sequence", "price").collect()), key=repr)


def count_files(spark, path):
    return spark.read.parquet(path).select(F.col("_metadata.file_path")).distinct().count()


def test_small_files_become_one_a_partition(spark, table):
    want = held(spark, table)
    assert count_files(spark, table) == 10 and compaction.compact(spark, table) == 10
    assert held(spark, table) == want and count_files(spark, table) == 2
    assert compaction.compact(spark, table) == 0


def test_bins_are_bounded(spark, table):
    """No bin takes more than the target and its last file; a file alone in its bin stays."""
    size = {r["path"]: r["length"] for r in compaction.files.list_files(spark, table).collect()}
    target = 3 * max(size.values())
    bins = {}
    for row in compaction.small_files(spark, table, target).collect():
        bins.setdefault((row["folder"], row["bin"]), []).append(size[row["path"]])
    assert len(bins) >= 2 and all(len(b) > 1 and sum(b) < target + max(b) for b in bins.values())


def test_a_run_that_broke_before_the_journal_changes_nothing(spark, table, monkeypatch):
    want = held(spark, table)
    monkeypatch.setattr(compaction, "journal_path", lambda path: f"{path}/\0")
    with pytest.raises(Exception):
        compaction._pack(spark, table, compaction.small_files(spark, table).collect(), ("trade_date", "symbol"))
    assert held(spark, table) == want


@pytest.mark.parametrize("done", [0, 1, 4])
def test_a_run_that_broke_after_the_journal_is_finished(spark, table, done):
    """Some of the moves and deletions were made; the next run makes the others."""
    want = held(spark, table)
    compaction._pack(spark, table, compaction.small_files(spark, table).collect(), ("trade_date", "symbol"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(table).getFileSystem(spark._jsc.hadoopConfiguration())
    entries = sorted(spark.read.parquet(compaction.journal_path(table)).collect(), key=lambda r: r["target"] is None)
    for row in entries[:done]:
        if row["target"] is None:
            store.delete(hadoop(row["source"]), False)
        else:
            store.rename(hadoop(row["source"]), hadoop(row["target"]))
    compaction.compact(spark, table)
    assert held(spark, table) == want and count_files(spark, table) == 2
    assert not store.exists(hadoop(compaction.journal_path(table)))


def test_an_unfinished_journal_is_dropped(spark, table):
    want = held(spark, table)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(table).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(hadoop(compaction.journal_path(table)))
    assert compaction.compact(spark, table) == 10 and held(spark, table) == want
