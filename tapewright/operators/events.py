"""Which cluster events count, why others do not, and how far collection has come."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions.clock import add_weekdays
from tapewright.functions.measures import ratio
from tapewright.operators.coverage import snapshot_coverage, weekday_gaps


def qualify_events(
    events: DataFrame, days: DataFrame, contracts: DataFrame, cutoff_hour: int = P.CUTOFF_HOUR,
    threshold: float = P.CAPTURE_THRESHOLD, exclude_bad_days: bool = True,
) -> DataFrame:
    """Adds ``hour``, ``overall``, ``before_cutoff``, ``qualified`` and ``reason``.

    ``days`` and ``contracts`` are the capture tables. A contract that was
    never measured passes; one measured below the threshold does not.
    """
    low = contracts.filter(F.col("below_threshold") == 1).select("day", "code", F.lit(1).alias("_low"))
    overall = F.col("overall")
    bad_day = (overall < threshold) if exclude_bad_days else F.lit(False)
    reason = (
        F.when(F.col("hour") >= cutoff_hour, f"after {cutoff_hour}:00")
        .when(overall.isNull(), "day unchecked")
        .when(bad_day, "day below threshold")
        .when(F.col("_low") == 1, "contract below threshold")
        .otherwise("counted")
    )
    return (
        events.join(days.select("day", "overall"), "day", "left")
        .join(low, ["day", "code"], "left")
        .withColumn("hour", F.hour("time"))
        .withColumn("before_cutoff", (F.col("hour") < cutoff_hour).cast("int"))
        .withColumn("reason", reason)
        .withColumn("qualified", (F.col("reason") == "counted").cast("int"))
        .drop("_low")
    )


def eligible_clusters(events: DataFrame, expiry: Column, gap_checks: DataFrame, min_dte: int = 1) -> DataFrame:
    """Events whose contract has more than ``min_dte`` days left and a gap-free tape that day."""
    clean = gap_checks.filter("gap_free").select("code", "trade_date")
    return events.filter(F.datediff(expiry, F.col("trade_date")) > min_dte).join(clean, ["code", "trade_date"], "left_semi")


def valid_days(days: DataFrame, start: dt.date, threshold: float = P.CAPTURE_THRESHOLD) -> DataFrame:
    return days.filter((F.col("day") >= F.lit(start)) & (F.col("overall") >= threshold))


def hour_histogram(events: DataFrame, cutoff_hour: int = P.CUTOFF_HOUR) -> DataFrame:
    """Raw events per hour with a flag for hours that are never counted."""
    return events.groupBy("hour").agg(
        F.count(F.lit(1)).alias("events"), F.max((F.col("hour") >= cutoff_hour).cast("int")).alias("excluded_hour")
    )


def notional_bucket(notional: Column, buckets: Sequence[tuple[str, float | None]] = P.NOTIONAL_BUCKETS) -> Column:
    *bounded, (rest, _) = buckets
    names = [F.when(notional < upper, label) for label, upper in bounded]
    return F.coalesce(*names, F.lit(rest))


def notional_histogram(events: DataFrame, buckets: Sequence[tuple[str, float | None]] = P.NOTIONAL_BUCKETS) -> DataFrame:
    """Events per size bucket in one pass; empty buckets show 0."""
    label = notional_bucket(F.col("notional"), buckets)
    counts = events.agg(*[F.count_if(label == name).alias(f"b{i}") for i, (name, _) in enumerate(buckets)])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("bucket_order"), F.lit(name).alias("bucket"), F.col(f"b{i}").alias("events"))
            for i, (name, _) in enumerate(buckets)
        ]
    )
    return counts.select(F.inline(rows))


def events_by(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw and counted events per group."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_events"),
        F.sum("before_cutoff").alias("before_cutoff_events"),
        F.sum("qualified").alias("counted_events"),
    )


def events_of_day(events: DataFrame, day: dt.date) -> DataFrame:
    """A day's events, largest notional first."""
    return events.filter(F.col("day") == F.lit(day)).orderBy(F.desc("notional"), "time", "code", "direction")


def event_totals(events: DataFrame) -> DataFrame:
    """Totals of each day's event list."""
    return events.groupBy("day").agg(
        F.count(F.lit(1)).alias("events"), F.sum("qualified").alias("counted"), F.sum("notional").alias("total_notional")
    )


def progress(
    events: DataFrame, days: DataFrame, as_of: dt.date, start: dt.date = P.EXPERIMENT_START,
    target_events: int = P.TARGET_EVENTS, target_days: int = P.TARGET_DAYS, hard_stop: dt.date = P.HARD_STOP,
) -> DataFrame:
    """Distance to the stopping rule and the projected finish date, one row."""
    counted = events.filter((F.col("qualified") == 1) & (F.col("day") >= F.lit(start)))
    n_days = valid_days(days, start).agg(F.count(F.lit(1)).alias("valid_days"))
    n_events = counted.agg(F.count(F.lit(1)).alias("qualifying_events"))
    both = n_days.unionByName(n_events, allowMissingColumns=True)
    totals = both.agg(F.sum("valid_days").alias("valid_days"), F.sum("qualifying_events").alias("qualifying_events"))
    per_day = F.coalesce(ratio(F.col("qualifying_events"), F.col("valid_days")), F.lit(0.0))
    event_days = F.when(F.col("per_day") > 0, F.col("need_events") / F.col("per_day")).otherwise(0.0)
    # One weekday beyond those that are left reaches the hard stop, however far away the projection is.
    left = sum((as_of + dt.timedelta(days=d)).weekday() < 5 for d in range(1, max(0, (hard_stop - as_of).days) + 1))
    steps = F.least(F.ceil("eta_days"), F.lit(left + 1))
    return (
        totals.withColumn("per_day", per_day)
        .withColumn("need_days", F.greatest(F.lit(target_days) - F.col("valid_days"), F.lit(0)))
        .withColumn("need_events", F.greatest(F.lit(target_events) - F.col("qualifying_events"), F.lit(0)))
        .withColumn("events_pct", F.least(F.lit(100.0), 100.0 * F.col("qualifying_events") / target_events))
        .withColumn("days_pct", F.least(F.lit(100.0), 100.0 * F.col("valid_days") / target_days))
        .withColumn("eta_days", F.greatest(F.col("need_days").cast("double"), event_days))
        .withColumn("stop", ((F.col("need_days") == 0) & (F.col("need_events") == 0) | F.lit(as_of >= hard_stop)).cast("int"))
        .withColumn("projected_finish", F.least(add_weekdays(F.lit(as_of), steps), F.lit(hard_stop)))
    )


def quality_alerts(
    days: DataFrame, capture: DataFrame, snaps: DataFrame, as_of: dt.date, universe_size: int,
    start: dt.date = P.EXPERIMENT_START, threshold: float = P.CAPTURE_THRESHOLD,
) -> DataFrame:
    """Alert rows (severity, day, kind, message) for days on which data are not as they should be.

    ``capture`` is the day table with ``overall`` and ``n_below``. Every input
    is reduced to one row per calendar day, joined once, and each day then
    lists its alerts.
    """
    experiment = days.select("day").distinct().filter(F.col("day") >= F.lit(start))
    status = snapshot_coverage(experiment, snaps, universe_size).join(
        capture.select("day", "overall", "n_below"), "day", "left"
    )
    overall, snapshots = F.col("overall"), F.col("snapshots")
    unchecked, bad = overall.isNull(), overall < threshold

    def alert(condition: Column, severity: Column, kind: str, *message: Column) -> Column:
        text = F.concat(*message)
        return F.when(condition, F.struct(severity.alias("severity"), F.lit(kind).alias("kind"), text.alias("message")))

    warn, severe = F.lit("warn"), F.lit("bad")
    alerts = F.array_compact(
        F.array(
            alert(unchecked | bad, warn, "pending", F.lit("not counted yet")),
            alert(unchecked & (F.col("day") < F.lit(as_of)), warn, "unchecked", F.lit("capture not checked")),
            alert(bad, severe, "day", F.lit("capture "), overall.cast("string"), F.lit("%, day excluded")),
            alert(
                ~bad & (F.col("n_below") > 0), warn, "contracts",
                F.col("n_below").cast("string"), F.lit(" contracts excluded"),
            ),
            alert(
                F.col("missing") > 0, F.when(snapshots == 0, severe).otherwise(warn), "snapshots",
                snapshots.cast("string"), F.lit(f" of {universe_size} snapshots"),
            ),
        )
    )
    gaps = weekday_gaps(experiment).select(
        "day", warn.alias("severity"), F.lit("gap").alias("kind"), F.lit("weekday without collection").alias("message")
    )
    return status.select("day", F.inline(alerts)).unionByName(gaps)
