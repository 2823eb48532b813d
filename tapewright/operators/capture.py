"""Tape completeness: our volume against the official daily volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions.measures import percent


def capture_contracts(ours: DataFrame, official: DataFrame, threshold: float = P.CAPTURE_THRESHOLD) -> DataFrame:
    """Percent captured per contract-day; contracts without official volume are left out.

    ``ours`` holds ticks (code, day, volume), ``official`` (code, day, volume).
    Both are summed in one aggregate, so that a task holds each contract-day once and nothing is joined or sorted.
    """
    mine = ours.select("day", "code", F.col("volume").alias("our_volume"), F.lit(True).alias("_mine"))
    both = mine.unionByName(official.select("day", "code", F.col("volume").alias("official_volume")), allowMissingColumns=True)
    sums = both.filter(F.col("day").isNotNull() & F.col("code").isNotNull()).groupBy("day", "code").agg(
        F.sum("our_volume").alias("our_volume"), F.sum("official_volume").alias("official_volume"), F.count("_mine").alias("_ticks")
    )
    pct = percent(F.col("our_volume"), F.col("official_volume"))
    return (
        sums.filter((F.col("_ticks") > 0) & (F.col("official_volume") > 0)).drop("_ticks")
        .withColumn("pct", pct)
        .withColumn("below_threshold", (F.col("pct") < threshold).cast("int"))
    )


def capture_days(contracts: DataFrame) -> DataFrame:
    """Overall percent per day, the contracts measured and how many fall below."""
    return contracts.groupBy("day").agg(
        percent(F.sum("our_volume"), F.sum("official_volume")).alias("overall"),
        F.count(F.lit(1)).alias("sampled"),
        F.sum("below_threshold").alias("n_below"),
    )


def sample_contracts(contracts: DataFrame, sample: DataFrame) -> DataFrame:
    """Only the sampled contract-days."""
    return contracts.join(sample.select("day", "code"), ["day", "code"], "left_semi")


def capture_records(sampled: DataFrame) -> DataFrame:
    """One nested record per day over a bounded sample of contracts.

    The sample holds a fixed number of contracts per symbol-day, which bounds
    the map; the unsampled measurement stays flat (``capture_contracts``).
    """
    entry = F.struct("code", "pct")
    below = F.collect_list(F.when(F.col("below_threshold") == 1, F.col("code")))
    return sampled.groupBy("day").agg(
        percent(F.sum("our_volume"), F.sum("official_volume")).alias("overall"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("contracts"),
        F.sort_array(below).alias("below_threshold"),
        F.count(F.lit(1)).alias("sampled"),
    )


def record_contracts(records: DataFrame) -> DataFrame:
    """Flat contract rows read back from nested records."""
    return records.select(
        "day", "overall", "sampled", F.col("below_threshold").alias("_below"), F.explode("contracts").alias("code", "pct")
    ).select(
        "day", "overall", "sampled", "code", "pct", F.array_contains("_below", F.col("code")).cast("int").alias("below")
    )


def fingerprint_text(files, newest):
    return F.concat_ws(":", files.cast("string"), newest.cast("string"))


def changed_days(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Days absent from the cache or whose fingerprint differs from the cached one."""
    known = cached.select("day", F.col("fingerprint").alias("cached_fingerprint"))
    return current.join(known, "day", "left").filter(
        F.col("cached_fingerprint").isNull() | (F.col("cached_fingerprint") != F.col("fingerprint"))
    )
