"""Screening an option chain and choosing contracts to watch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions.measures import liquidity_score, spread_pct
from tapewright.operators.columns import require, zero_fill
from tapewright.operators.ranking import first_per_key, least_bounds, top_k, within
from tapewright.schemas import SCREEN_COLUMNS
from tapewright.session import materialize


def tradable(spread: Column) -> Column:
    """The screener's conditions; bounds are inclusive and only the spread has a tolerance."""
    return (
        (F.col("option_premium") > 0)
        & (F.col("option_implied_volatility") > 0)
        & (F.col("option_open_interest") >= P.SCREEN_MIN_OI)
        & (F.col("bid_price") > 0)
        & (F.col("ask_price") > 0)
        & F.col("option_expiry_date_distance").between(*P.SCREEN_DTE)
        & F.abs("option_delta").between(*P.SCREEN_ABS_DELTA)
        & (spread <= P.SCREEN_MAX_SPREAD_PCT + P.SCREEN_SPREAD_TOLERANCE)
    )


def screen_options(
    chain: DataFrame, keys: Sequence[str] = ("option_type",), k: int = P.SCREEN_TOP_K, ties: Sequence[str] = ("code",)
) -> DataFrame:
    """Liquid calls and puts by score; ``keys`` may add the symbol to screen all tickers at once."""
    spread = spread_pct(F.col("bid_price"), F.col("ask_price"))
    rows = zero_fill(require(chain, SCREEN_COLUMNS))
    scored = (
        rows.filter(F.col("option_type").isin("CALL", "PUT") & tradable(spread))
        .withColumn("spread_pct", spread)
        .withColumn(
            "liquidity_score",
            liquidity_score(F.col("option_open_interest"), F.col("volume"), F.col("spread_pct")),
        )
    )
    return top_k(scored, keys, [F.desc("liquidity_score"), *ties], k, rank="screen_rank")


def live_contracts(chain: DataFrame) -> DataFrame:
    return chain.filter(
        (F.col("option_premium") > 0) & (F.col("volume") > 0) & (F.col("option_expiry_date_distance") > 1)
    )


def liquid_contracts(
    chain: DataFrame, keys: Sequence[str] = ("symbol",), n: int = P.WATCH_POLLING, ties: Sequence[str] = ("code",)
) -> DataFrame:
    """The n live contracts of each ticker with the highest volume."""
    return top_k(live_contracts(chain), keys, [F.desc("volume"), *ties], n, rank="volume_rank")


def distinct_contracts(pages: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """One row per code where chain pages overlap, the first in ``order``."""
    return first_per_key(pages, ["code"], order)


def nearest_strikes(
    chain: DataFrame, spot: DataFrame, keys: Sequence[str] = ("symbol", "expiry", "option_type"),
    n: int = P.NEAREST_STRIKES, ties: Sequence[str] = ("code",),
) -> DataFrame:
    """The n strikes nearest the spot, on either side, per symbol, expiry and type.

    ``spot`` holds one row per symbol. It is written first: while its size is
    unknown, the chain would be shuffled by symbol, and a symbol is one task.
    """
    spot = materialize(spot.select("symbol", "spot"), "spot")
    distance = F.abs(F.col("option_strike_price") - F.col("spot"))
    keyed = chain.filter(F.col("expiry").isNotNull() & F.col("option_type").isNotNull())
    priced = keyed.join(spot, "symbol").withColumn("distance", distance)
    bounds = materialize(least_bounds(priced, keys, "distance", ties, n), "strike-bounds")
    return top_k(within(priced, bounds, keys, "distance"), keys, [F.col("distance"), *ties], n, rank="strike_rank")


def contract_universe(picked: DataFrame) -> DataFrame:
    return picked.select("code").distinct().orderBy("code")


def busiest_contracts(
    tape: DataFrame, keys: Sequence[str] = ("trade_date", "symbol"), k: int = P.SAMPLE_PER_SYMBOL
) -> DataFrame:
    """The k contracts of each symbol-day with the most prints, ties by code descending."""
    prints = tape.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("prints"))
    return top_k(prints, keys, [F.desc("prints"), F.desc("code")], k, rank="sample_rank")


def watch_additions(fresh: DataFrame, watched: DataFrame) -> DataFrame:
    """Fresh picks that are not watched yet."""
    return fresh.select("code").distinct().join(watched.select("code").distinct(), "code", "left_anti")


def snapshot_totals(chain: DataFrame) -> DataFrame:
    """Contracts per symbol with a TOTAL row."""
    return (
        chain.rollup("symbol")
        .agg(F.count(F.lit(1)).alias("contracts"), F.grouping("symbol").alias("is_total"))
        .select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("symbol")).alias("symbol"), "contracts")
    )
