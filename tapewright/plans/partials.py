"""Reports by day that are kept and measured anew only for days whose files changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.capture import changed_days
from tapewright.session import materialize, read_if_present
from tapewright.sources import files, readers, sinks


def refreshed(spark: SparkSession, table: str, store: str, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``measure`` of the tape in ``table``, which must give the rows of a ``day`` from the ticks of that trade date alone.

    The rows of each day are kept in ``store`` beside the fingerprint of the day's files. A run reads the tape of new and
    changed days only; all others come from ``store``. Days that have left the tape are left out. A run that fails before
    its days are written measures them again.
    """
    now = materialize(files.partition_fingerprints(spark, table).select("day", "fingerprint"), "day-fingerprints")
    known = read_if_present(spark, store)
    todo = now if known is None else changed_days(now, known.select("day", "fingerprint").distinct())
    days = [r["day"] for r in todo.select("day").collect()]  # as literals they prune the partitions of the tape
    if days:
        rows = readers.read_tape(spark, table).filter(F.col("trade_date").isin(days))
        sinks.replace_partitions(measure(rows).join(now, "day"), store, ["day"])
        known = spark.read.parquet(store)
    if known is None:
        return measure(readers.read_tape(spark, table))
    # A stored day counts under its present fingerprint alone.
    return known.join(now, ["day", "fingerprint"], "left_semi").drop("fingerprint")
