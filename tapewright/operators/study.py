"""Event study: bars at and after an event, matched controls, decision rules.

Outcomes live here, in tables of their own, never in the feature table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions.clock import truncate
from tapewright.functions.measures import ratio
from tapewright.functions.rolling import by_symbol
from tapewright.operators.asof import asof_values


# Modulus of the control draw.
DRAW_PRIME = 2_147_483_647


def minute_closes(quotes: DataFrame) -> DataFrame:
    """Last price per symbol and minute from (symbol, ts, price) quotes."""
    keyed = quotes.select("symbol", truncate(F.col("ts"), "minute").alias("minute"), "ts", "price")
    return keyed.groupBy("symbol", "minute").agg(F.max_by("price", "ts").alias("close"))


def minute_grid(bars: DataFrame, day_end_minute: int = 24 * 60 - 1, label: str = "start") -> DataFrame:
    """Every minute from a symbol-day's first bar to the session end with the last close known.

    ``bars`` holds one row per symbol and minute.
    The grid turns an as-of lookup into an equality join. A symbol-day has at
    most 1,440 minutes, so the window partitions are bounded by the clock.
    ``label`` says whether a bar's time marks its start or its end.
    """
    shift = F.expr("interval 1 minute") if label == "end" else F.expr("interval 0 minute")
    own = bars.withColumn("minute", F.col("minute") - shift).withColumn("day", F.to_date("minute"))
    w = Window.partitionBy("symbol", "day").orderBy("minute")
    last = F.col("day").cast("timestamp_ntz") + F.expr(f"interval {int(day_end_minute)} minutes")
    until = F.coalesce(F.lead("minute").over(w) - F.expr("interval 1 minute"), F.greatest(last, F.col("minute")))
    held = own.withColumn("_until", until)
    return held.select(
        "symbol", "day", F.explode(F.sequence("minute", "_until", F.expr("interval 1 minute"))).alias("minute"), "close"
    )


def minute_returns(grid: DataFrame, horizon: int = P.HORIZON_MINUTES) -> DataFrame:
    """Return from each minute to ``horizon`` minutes later; null past the session end."""
    w = Window.partitionBy("symbol", "day").orderBy("minute")
    later = F.lead("close", horizon).over(w)
    return grid.withColumn("close_later", later).withColumn("ret", ratio(later, F.col("close")) - 1)


def hour_minutes(returns: DataFrame) -> DataFrame:
    """The minutes of each symbol-hour as one array, at most 60 entries."""
    slot = (F.hour("minute") * 60 + F.minute("minute")).cast("bigint").alias("slot")
    entry = F.struct("minute", "close", "close_later", "ret", slot)
    return returns.groupBy("symbol", "day", F.hour("minute").alias("hour")).agg(F.collect_list(entry).alias("minutes"))


def event_returns(events: DataFrame, returns: DataFrame) -> DataFrame:
    """Events (symbol, day, time, sign, ...) with close, later close and signed return.

    Events join the array of their own hour, which also holds the control
    minutes: the event's bar and its controls come from one join, and no
    event-by-minute pairs are shuffled.
    """
    keyed = events.withColumn("hour", F.hour("time")).withColumn("_minute", truncate(F.col("time"), "minute"))
    joined = keyed.join(hour_minutes(returns), ["symbol", "day", "hour"], "left")
    own = F.try_element_at(F.filter("minutes", lambda m: m["minute"] == F.col("_minute")), F.lit(1))
    return (
        joined.withColumn("_own", own)
        .withColumns({c: F.col(f"_own.{c}") for c in ("close", "close_later", "ret")})
        .withColumn("signed_return", F.col("sign") * F.col("ret"))
        .drop("_own", "_minute")
    )


def matched_controls(
    events: DataFrame, key: Sequence[str], n: int = P.CONTROLS_PER_EVENT, seed: int = 0
) -> DataFrame:
    """Adds ``controls``: n minutes of the event's symbol, day and hour, drawn by a seeded hash.

    Takes the output of ``event_returns`` and draws inside the event's own
    row. Two numbers from the md5 of the event's key place every minute of the
    day; the n minutes placed lowest are drawn. Integer arithmetic keeps the
    draw cheap, and any SQL engine can repeat it.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))

    def number(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint") % DRAW_PRIME

    def placed(slot: Column) -> Column:
        x = (F.col("_scale") * slot + F.col("_shift")) % DRAW_PRIME
        return x * x % DRAW_PRIME

    usable = F.filter("minutes", lambda m: m["ret"].isNotNull())
    drawn = F.transform(
        usable, lambda m: F.struct(placed(m["slot"]).alias("draw"), m["minute"].alias("minute"), m["ret"].alias("ret"))
    )
    return (
        events.withColumns({"_scale": number(1) + 1, "_shift": number(9)})
        .withColumn("controls", F.slice(F.sort_array(drawn), 1, n))
        .drop("minutes", "_scale", "_shift")
    )


def tick_returns(
    events: DataFrame, ticks: DataFrame, horizon: int = P.HORIZON_MINUTES, tolerance_minutes: int | None = None, order: Sequence[str] = (),
    block: str = "hour",
) -> DataFrame:
    """Events (symbol, time, sign, ...) with the last tick price at the event and ``horizon`` minutes later, without a minute grid.

    ``ticks`` has (symbol, time, price); of ticks at one time the last in ``order`` counts. A price older than
    ``tolerance_minutes`` is none.
    """
    timed = events.withColumn("_later", F.col("time") + F.expr(f"interval {int(horizon)} minutes"))
    moments = timed.select("symbol", "time").union(timed.select("symbol", "_later"))
    tolerance = None if tolerance_minutes is None else F.expr(f"interval {int(tolerance_minutes)} minutes")
    prices = asof_values(moments, ticks, ["symbol"], "time", ["price"], order, tolerance, block).select("symbol", "time", "asof_price")
    later = prices.select("symbol", F.col("time").alias("_later"), F.col("asof_price").alias("close_later"))
    priced = timed.join(prices.withColumnRenamed("asof_price", "close"), ["symbol", "time"], "left").join(later, ["symbol", "_later"], "left")
    ret = ratio(F.col("close_later"), F.col("close")) - 1
    return priced.drop("_later").withColumn("ret", ret).withColumn("signed_return", F.col("sign") * F.col("ret"))


def control_rows(matched: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per event and control minute."""
    # The outer form keeps the optimizer from drawing the array again in an inferred size filter.
    return matched.select(*key, F.explode_outer("controls").alias("c")).filter("c is not null").select(
        *key, F.col("c.minute").alias("control_minute"), F.col("c.ret").alias("control_return")
    )


def event_excess(matched: DataFrame) -> DataFrame:
    """Signed return of each event less the mean signed return of its controls."""
    total = F.aggregate("controls", F.lit(0.0), lambda acc, c: acc + c["ret"])
    control = F.col("sign") * ratio(total, F.size("controls"))
    return matched.withColumn("control_return", control).withColumn(
        "excess", F.col("signed_return") - F.col("control_return")
    )


def study_rows(excess: DataFrame) -> DataFrame:
    """Means, excess and t-statistic per symbol and over all events (``is_total`` = 1), in one pass."""
    measured = F.col("excess").isNotNull()
    n = F.count("excess")
    t = F.avg("excess") / F.nullif(F.stddev_samp("excess") / F.sqrt(n), F.lit(0.0))
    return excess.rollup("symbol").agg(
        F.grouping("symbol").alias("is_total"),
        n.alias("events"),
        F.avg(F.when(measured, F.col("signed_return"))).alias("mean_signed_return"),
        F.avg(F.when(measured, F.col("control_return"))).alias("mean_control_return"),
        F.avg("excess").alias("excess"),
        t.alias("t_stat"),
    )


def study_by_symbol(excess: DataFrame) -> DataFrame:
    return study_rows(excess).filter("is_total = 0").drop("is_total")


def study_decision(excess: DataFrame, symbols: Sequence | None = None) -> DataFrame:
    """Overall excess, t-statistic, agreement of the symbols and the GO / KILL / AMBIGUOUS decision.

    ``symbols`` lists the symbols of the protocol: GO needs all of them positive, so a silent one blocks it. Without
    the list, the symbols that have events count.
    """
    total, part = F.col("is_total") == 1, F.col("is_total") == 0
    measures = ["events", "mean_signed_return", "mean_control_return", "excess", "t_stat"]
    summary = study_rows(excess).agg(
        *[F.max(F.when(total, F.col(m))).alias(m) for m in measures],
        (F.count(F.when(part, F.col("excess"))) if symbols is None else F.lit(len(symbols)).cast("bigint")).alias("symbols"),
        F.count_if(part & (F.col("excess") > 0)).alias("positive_symbols"),
        F.count_if(part & (F.col("excess") < 0)).alias("negative_symbols"),
    )
    against = F.when(F.col("excess") >= 0, F.col("negative_symbols")).otherwise(F.col("positive_symbols"))
    go = (
        (F.col("excess") >= P.GO_EXCESS) & (F.col("t_stat") >= P.GO_T)
        & (F.col("positive_symbols") == F.col("symbols"))
    )
    kill = (
        (F.abs("excess") < P.KILL_EXCESS) | (F.col("t_stat") < P.KILL_T) | (against * 2 > F.col("symbols"))
    )
    return summary.withColumn("decision", F.when(go, "GO").when(kill, "KILL").otherwise("AMBIGUOUS"))


def forward_returns(prices: DataFrame, horizons: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Log returns to later rows and abnormal five-day moves, per symbol-day.

    The threshold is 2 * realized_vol_20 * sqrt(5) as the protocol states it,
    with the volatility annualised as in the feature table.
    """
    w = by_symbol()
    out = prices.withColumns(
        {
            f"ret_fwd_{k}d": F.ln(ratio(F.lead("underlying_price", k).over(w), F.col("underlying_price")))
            for k in horizons
        }
    )
    r5, bound = F.col("ret_fwd_5d"), 2 * F.col("realized_vol_20") * math.sqrt(5)
    known = r5.isNotNull() & bound.isNotNull()
    return out.withColumns(
        {
            "abnormal_move_5d": F.when(known, (F.abs(r5) >= bound).cast("int")),
            "abnormal_up_5d": F.when(known, (r5 >= bound).cast("int")),
            "abnormal_down_5d": F.when(known, (r5 <= -bound).cast("int")),
        }
    )
