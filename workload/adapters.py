"""The given tables in the shapes the operators expect. Whole tables, no row is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.clock import truncate
from tapewright.functions.measures import ratio

SYMBOLS = 5
# Amounts are kept in whole cents: 64-bit sums are exact in any order and much
# cheaper than wide decimals, whose sums leave the 64-bit range.
CENTS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hundredths(amount):
    """An amount with two decimals as a whole number."""
    return F.rint(amount * 100).cast("bigint")


def _direction(flag):
    return F.when(flag == "A", "BUY").when(flag == "R", "SELL").when(flag == "N", "NEUTRAL")


def lineitem_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as prints: supplier is the contract, ship date the time."""
    return as_lineitem_tape(table(spark, sf_dir, "lineitem"))


def as_lineitem_tape(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_suppkey").alias("code"),
        (F.col("l_suppkey") % SYMBOLS).alias("symbol"),
        F.col("l_shipdate").alias("time"),
        F.col("l_shipdate").alias("ts"),
        F.to_date("l_shipdate").alias("trade_date"),
        F.col("l_quantity").alias("volume"),
        hundredths(F.col("l_extendedprice")).alias("turnover"),
        _direction(F.col("l_returnflag")).alias("ticker_direction"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"),
        F.col("l_partkey").alias("part"),
        F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("status"),
    )


def events_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prints: the user picks contract and symbol, the hour is the cluster time."""
    return as_events_tape(table(spark, sf_dir, "events"))


def as_events_tape(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    direction = (
        F.when(kind.isin("purchase", "signup"), "BUY").when(kind.isin("error", "click"), "SELL").otherwise("NEUTRAL")
    )
    loss = F.get_json_object("props", "$.k").cast("int")
    value = hundredths(F.col("value"))
    return events.select(
        (F.col("user_id") % 10).alias("code"),
        (F.col("user_id") % 3).alias("symbol"),
        truncate(F.col("ts"), "hour").alias("time"),
        "ts",
        F.to_date("ts").alias("trade_date"),
        F.col("event_id").alias("sequence"),
        F.col("value").alias("price"),
        value.alias("volume"),
        value.alias("turnover"),
        direction.alias("ticker_direction"),
        (value * (1000 - loss)).alias("captured"),
    )


def events_official(tape: DataFrame) -> DataFrame:
    """Official volume: everything traded, in thousandths."""
    return tape.select("code", F.col("trade_date").alias("day"), (F.col("volume") * 1000).alias("volume"))


def events_captured(tape: DataFrame) -> DataFrame:
    """Captured volume: each print lost the share its properties name."""
    return tape.select("code", F.col("trade_date").alias("day"), F.col("captured").alias("volume"))


def lineitem_official(tape: DataFrame) -> DataFrame:
    return tape.select("code", F.col("trade_date").alias("day"), hundredths(F.col("volume")).alias("volume"))


def lineitem_captured(tape: DataFrame) -> DataFrame:
    """Captured volume: each print lost its tax rate."""
    kept = F.rint("volume").cast("bigint") * (100 - hundredths(F.col("tax")))
    return tape.select("code", F.col("trade_date").alias("day"), kept.alias("volume"))


def lineitem_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as chain rows."""
    flag = F.col("l_returnflag")
    price = F.col("l_extendedprice")
    sign = F.when(flag == "R", -1).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("code"),
        (F.col("l_suppkey") % SYMBOLS).alias("symbol"),
        F.when(flag == "A", "CALL").when(flag == "R", "PUT").otherwise("OTHER").alias("option_type"),
        (price / F.col("l_quantity")).alias("option_strike_price"),
        (F.col("l_orderkey") % 1000).cast("double").alias("option_open_interest"),
        F.col("l_tax").alias("option_implied_volatility"),
        price.alias("option_premium"),
        (F.col("l_quantity") / 100 * sign).alias("option_delta"),
        (F.col("l_linenumber") * 4).cast("double").alias("option_expiry_date_distance"),
        F.col("l_linenumber").alias("expiry"),
        (price * (1 - F.col("l_discount"))).alias("bid_price"),
        price.alias("ask_price"),
        F.col("l_quantity").alias("volume"),
    )


def symbol_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per symbol and day from order lines, with the feature table's measures."""
    flag, qty = F.col("l_returnflag"), F.col("l_quantity")
    line = F.col("l_linenumber")
    price = hundredths(F.col("l_extendedprice"))

    def total(value, which=None):
        picked = value if which is None else F.when(flag == which, value).otherwise(F.lit(0))
        return F.sum(picked).cast("double")

    def mean(name):
        return F.sum(hundredths(F.col(name))) / 100 / F.count(F.lit(1))

    grouped = (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % SYMBOLS).cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date"))
        .agg(
            total(qty).alias("option_volume"), total(qty, "A").alias("call_volume"), total(qty, "R").alias("put_volume"),
            total(qty, "N").alias("option_oi"), total(line, "A").alias("call_oi"), total(line, "R").alias("put_oi"),
            (F.sum(price) / 100 / F.sum(qty)).alias("underlying_price"),
            mean("l_tax").alias("iv"), mean("l_discount").alias("hv"),
        )
    )
    return grouped.withColumns(
        {
            "pc_volume_ratio": ratio(F.col("put_volume"), F.col("call_volume")),
            "pc_oi_ratio": ratio(F.col("put_oi"), F.col("call_oi")),
        }
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days and priorities as snapshot days and symbols."""
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("symbol")
    )


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as underlying quotes."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("symbol"), "ts", F.col("value").alias("price")
    )
