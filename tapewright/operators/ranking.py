"""Top-k and first-row-per-key selection.

``row_number`` under a constant bound lets Spark prune every map task to at
most k rows per group before the shuffle (WindowGroupLimit), so that neither a
hot group nor a pile of copies of one key travels whole to a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group in ``order``; all keys empty means one global group."""
    by = [F.col(c) for c in keys] or [F.lit(1)]
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_k(df, keys, order, 1)


def least_bounds(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], k: int) -> DataFrame:
    """``keys`` and ``_bound``: at least k rows of the group have a ``value`` no greater. Groups without one are left out.

    Rows are dealt over buckets by a hash; the k-th least of the buckets' least values is such a bound. An aggregate of
    few rows a group finds it, so rows above it can go before the rest is sorted, and no task sorts all that it reads.
    """
    bucket = F.pmod(F.xxhash64(value, *ties), F.lit(8 * k)).alias("_bucket")
    least = df.filter(F.col(value).isNotNull()).groupBy(*keys, bucket).agg(F.min(value).alias("_bound"))
    return top_k(least, keys, ["_bound"], k, rank="_nth").filter(F.col("_nth") == k).select(*keys, "_bound")


def within(df: DataFrame, bounds: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows that may be among the first of their group in the order of ``value``, nulls first."""
    kept = F.col("_bound").isNull() | F.col(value).isNull() | (F.col(value) <= F.col("_bound"))
    return df.join(bounds, list(keys), "left").filter(kept).drop("_bound")
