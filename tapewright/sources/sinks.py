"""Table writers. All data tables are Parquet, partitioned by date and symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.columns import forbid_outcomes
from tapewright.operators.tape import latest_per_key
from tapewright.session import materialize, read_if_present, small_splits


def _clustered(df: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Rows of one output folder together; AQE splits a folder that is too large and merges small ones."""
    return df.hint("rebalance", *partitions)


def append_tape(tape: DataFrame, path: str, partitions: Sequence[str] = ("trade_date", "symbol")) -> None:
    _clustered(tape, partitions).write.mode("append").partitionBy(*partitions).parquet(path)


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str] = ("snap_date", "symbol")) -> None:
    """Replace exactly the partitions present in ``df``; other partitions stay."""
    (
        _clustered(df, partitions).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    )


def _touched(old: DataFrame, new: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Rows of ``old`` in partitions that ``new`` also has; pruned at run time, never collected.

    The partitions are written first, so that their real size is known: a shuffle by partition would send all rows of one to one task.
    """
    return old.join(materialize(new.select(*partitions).distinct(), "touched"), list(partitions), "left_semi")


def upsert(
    new: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column | str], partitions: Sequence[str] = ("symbol",)
) -> None:
    """Keep every key ever seen; the newest row wins.

    ``partitions`` must be functions of the key. Only partitions the batch
    touches are rewritten. The merged rows are written to the shared folder
    first, so the table is never read while it is replaced. Map tasks sort what
    they read, so they read small pieces.
    """
    old = read_if_present(new.sparkSession, path)
    frames = [new] if old is None else [_touched(old, new, partitions), new]
    with small_splits(new.sparkSession):
        merged = materialize(latest_per_key(frames, keys, order), "upsert")
    replace_partitions(merged, path, partitions)


def write_features(features: DataFrame, path: str, csv: bool = False) -> None:
    """Feature table sorted by date and symbol; outcome columns are refused."""
    ordered = forbid_outcomes(features).orderBy("date", "symbol")
    if csv:
        ordered.write.mode("overwrite").option("header", True).csv(path)
    else:
        ordered.write.mode("overwrite").parquet(path)


def write_capture_cache(records: DataFrame, path: str) -> None:
    """Capture records as one JSON object with an entry a day, written by one task: the calendar bounds it."""
    entry = F.struct(*[c for c in records.columns if c != "day"])
    days = F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("string"), entry.alias("record"))))
    records.agg(F.to_json(days).alias("value")).write.mode("overwrite").text(path)


def write_capture(records: DataFrame, path: str) -> None:
    """Capture records, one partition per day; a re-checked day replaces its record."""
    stamped = records.withColumn("checked_at", F.current_timestamp())
    replace_partitions(stamped, path, ["day"])
