"""As-of lookups: what was last known at or before a moment, exact to the tick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.clock import truncate


def asof_values(
    moments: DataFrame, known: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], order: Sequence[str] = (),
    tolerance: Column | None = None, block: str = "hour", prefix: str = "asof_",
) -> DataFrame:
    """Per different (keys, time) of ``moments`` the last row of ``known`` with the same keys and no later time.

    Columns: keys, time, then ``prefix`` with time and with each of ``values``; null where nothing is known or, with
    ``tolerance`` (an interval), nothing recent enough. Of rows of ``known`` at one time the last in ``order`` counts
    (default: the values). Rows with a null key or time take no part.

    Both sides are first reduced to one row per key and time, which Spark begins in the tasks that read them. A window
    then carries values forward within a ``block`` of time, so that a busy key is spread over its blocks; the last value
    of each block is carried over to later ones in a second window, which holds a row per key and block.
    """
    at = [*keys, time]
    last = known.dropna(subset=at).groupBy(*at).agg(F.max_by(F.struct(*values), F.struct(*(order or values))).alias("_values"))
    quote = F.struct(F.col(time).alias("at"), F.col("_values"))
    quotes = last.select(*at, quote.alias("_quote"), F.lit(False).alias("_asked"))
    asked = moments.select(*at).dropna().distinct()
    empty = F.lit(None).cast(quotes.schema["_quote"].dataType)
    rows = quotes.unionByName(asked.select(*at, empty.alias("_quote"), F.lit(True).alias("_asked"))).withColumn("_block", truncate(F.col(time), block))

    inside = Window.partitionBy(*keys, "_block").orderBy(time, "_asked").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("_quote", F.last("_quote", ignorenulls=True).over(inside))
    ends = held.groupBy(*keys, "_block").agg(F.max_by("_quote", F.struct(time, "_asked")).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    found = held.filter("_asked").join(carried, [*keys, "_block"], "left").withColumn("_quote", F.coalesce("_quote", "_carried"))
    if tolerance is not None:
        found = found.withColumn("_quote", F.when(F.col("_quote.at") + tolerance >= F.col(time), F.col("_quote")))
    return found.select(
        *at, F.col("_quote.at").alias(f"{prefix}{time}"), *[F.col(f"_quote._values.{v}").alias(f"{prefix}{v}") for v in values]
    )


def asof_join(
    rows: DataFrame, known: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], order: Sequence[str] = (),
    tolerance: Column | None = None, block: str = "hour", prefix: str = "asof_",
) -> DataFrame:
    """All ``rows``, each with what was last known at its time; see ``asof_values``."""
    return rows.join(asof_values(rows, known, keys, time, values, order, tolerance, block, prefix), [*keys, time], "left")
