"""Signed notional, block prints and same-timestamp clusters of a tape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions.measures import aggressor, ratio
from tapewright.operators.ranking import top_k


def pressure_label(share: Column, traded: Column) -> Column:
    """Label by the buy share; a tape without BUY or SELL turnover is balanced."""
    return (
        F.when(traded == 0, "BALANCED")
        .when(share >= P.BUY_PRESSURE, "UNUSUAL_BUY_PRESSURE")
        .when(share <= P.SELL_PRESSURE, "UNUSUAL_SELL_PRESSURE")
        .otherwise("BALANCED")
    )


def _side(direction: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("ticker_direction") == direction, F.col("turnover"))), F.lit(0))


def flow_summary(tape: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Buy, sell and net notional, buy share, print count and label per group."""
    sides = tape.groupBy(*keys).agg(
        _side("BUY").alias("buy_notional"),
        _side("SELL").alias("sell_notional"),
        F.count(F.lit(1)).alias("total_prints"),
    )
    buy, sell = F.col("buy_notional"), F.col("sell_notional")
    share = F.coalesce(ratio(buy, buy + sell), F.lit(0.0))
    return sides.select(
        *keys, "buy_notional", "sell_notional", (buy - sell).alias("net_notional"), share.alias("buy_share"),
        "total_prints", pressure_label(share, buy + sell).alias("label"),
    )


def block_prints(
    tape: DataFrame, keys: Sequence[str] = (), min_volume: float = P.BLOCK_VOLUME, k: int = P.FLOW_TOP_K,
    ties: Sequence[str] = ("time", "sequence"),
) -> DataFrame:
    """Largest single prints per group, original columns kept."""
    return top_k(
        tape.filter(F.col("volume") >= min_volume), keys, [F.desc("volume"), *ties], k, rank="block_rank"
    )


def cells(tape: DataFrame, keys: Sequence[str] = ("code",), extra: Sequence[Column] = ()) -> DataFrame:
    """Prints, volume and notional per time and direction, the one pass over a tape that reports share.

    The time is compared as given, not parsed.
    """
    return tape.groupBy(*keys, "time", F.col("ticker_direction").alias("direction")).agg(
        F.count(F.lit(1)).alias("prints"), F.sum("volume").alias("volume"), F.sum("turnover").alias("notional"), *extra
    )


def is_event(min_notional: float = P.MIN_NOTIONAL, min_prints: int = P.MIN_PRINTS) -> Column:
    """Whether a cell is a cluster event; false, not null, for a cell without a time."""
    found = (
        aggressor(F.col("direction")) & F.col("time").isNotNull()
        & (F.col("prints") >= min_prints) & (F.col("notional") >= min_notional)
    )
    return F.coalesce(found, F.lit(False))


def clusters(tape: DataFrame, keys: Sequence[str] = ("code",), min_prints: int = P.MIN_PRINTS) -> DataFrame:
    """Prints that share time and direction."""
    keyed = tape.filter(F.col("time").isNotNull() & F.col("ticker_direction").isNotNull())
    return cells(keyed, keys).filter(F.col("prints") >= min_prints)


def top_clusters(tape: DataFrame, keys: Sequence[str] = (), k: int = P.FLOW_TOP_K) -> DataFrame:
    """Largest clusters per group, NEUTRAL included."""
    order = [F.desc("notional"), "time", "direction"]
    return top_k(clusters(tape, keys), keys, order, k, rank="cluster_rank")


def cluster_events(
    tape: DataFrame, keys: Sequence[str] = ("code",), min_notional: float = P.MIN_NOTIONAL,
    min_prints: int = P.MIN_PRINTS,
) -> DataFrame:
    """BUY and SELL clusters of at least ``min_notional``."""
    sided = tape.filter(aggressor(F.col("ticker_direction")))
    return clusters(sided, keys, min_prints).filter(F.col("notional") >= min_notional)


def analyze_flow(tape: DataFrame, keys: Sequence[str] = (), ties: Sequence[str] = ("time", "sequence")) -> DataFrame:
    """Summary with nested ``blocks`` and ``clusters`` arrays of at most ten rows each."""
    grouped = list(keys) or ["_all"]
    source = tape if keys else tape.withColumn("_all", F.lit(1))

    def nested(rows: DataFrame, rank: str, name: str) -> DataFrame:
        body = [c for c in rows.columns if c not in (*grouped, rank)]
        packed = F.sort_array(F.collect_list(F.struct(rank, F.struct(*body).alias("row"))))
        return rows.groupBy(*grouped).agg(F.transform(packed, lambda r: r["row"]).alias(name))

    blocks = nested(block_prints(source, grouped, ties=ties), "block_rank", "blocks")
    groups = nested(top_clusters(source, grouped), "cluster_rank", "clusters")
    summary = flow_summary(tape, keys)
    if not keys:
        summary = summary.withColumn("_all", F.lit(1))
    result = (
        summary.join(blocks, grouped, "left")
        .join(groups, grouped, "left")
        .withColumn("blocks", F.coalesce("blocks", F.array().cast(blocks.schema["blocks"].dataType)))
        .withColumn("clusters", F.coalesce("clusters", F.array().cast(groups.schema["clusters"].dataType)))
    )
    return result.drop("_all")
