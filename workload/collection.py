"""Collection queries: capture, coverage, qualification, progress, alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tapewright.operators import capture, chain, coverage, events, study
from tapewright.plans import collection as plan
from workload import adapters as A
from workload.registry import EVENTS, TAPE, query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
START = dt.date(2024, 1, 5)
AS_OF = dt.date(2024, 1, 31)
STOP = dt.date(2024, 6, 28)
SIZES = [("50-75", 7_500), ("75-100", 10_000), ("100-150", 15_000), ("150-250", 25_000), ("250+", None)]

# Capture of the order-line tape and of the event tape.
LINE_CAP = """cc AS (
  SELECT trade_date AS day, code, symbol, o AS our_volume, t AS official_volume,
         round(100 * (CAST(o AS DOUBLE) / CAST(t AS DOUBLE)), 1) AS pct,
         CASE WHEN round(100 * (CAST(o AS DOUBLE) / CAST(t AS DOUBLE)), 1) < 95 THEN 1 ELSE 0 END AS below_threshold
  FROM (SELECT trade_date, code, symbol, sum(CAST(volume AS DECIMAL(18,2)) * (100 - CAST(tax * 100 AS DECIMAL(18,0)))) AS o,
               sum(CAST(volume AS DECIMAL(18,2)) * 100) AS t FROM tape GROUP BY ALL))"""
EVENT_CAP = """cc AS (
  SELECT trade_date AS day, code, o AS our_volume, t AS official_volume,
         round(100 * (CAST(o AS DOUBLE) / CAST(t AS DOUBLE)), 1) AS pct,
         CASE WHEN round(100 * (CAST(o AS DOUBLE) / CAST(t AS DOUBLE)), 1) < 95 THEN 1 ELSE 0 END AS below_threshold
  FROM (SELECT trade_date, code, sum(captured) AS o, sum(volume * 1000) AS t FROM ev GROUP BY ALL)
  WHERE t > 0)"""
CAP_DAY = """cd AS (
  SELECT day, round(100 * (CAST(sum(our_volume) AS DOUBLE) / CAST(sum(official_volume) AS DOUBLE)), 1) AS overall,
         count(*) AS sampled, sum(below_threshold) AS n_below FROM cc GROUP BY day)"""
CLUSTERS = """cl AS (
  SELECT code, symbol, trade_date AS day, time, ticker_direction AS direction, count(*) AS prints,
         sum(volume) AS volume, sum(turnover) AS notional
  FROM ev WHERE ticker_direction IN ('BUY', 'SELL') GROUP BY ALL
  HAVING count(*) >= 2 AND sum(turnover) >= 50)"""
QUALIFIED = f"""WITH {EVENTS}, {EVENT_CAP}, {CAP_DAY}, {CLUSTERS},
q0 AS (SELECT cl.*, hour(time) AS hour, cd.overall,
              CASE WHEN hour(time) >= 15 THEN 'after 15:00' WHEN cd.overall IS NULL THEN 'day unchecked'
                   WHEN cd.overall < 95 THEN 'day below threshold' WHEN cc.below_threshold = 1 THEN 'contract below threshold'
                   ELSE 'counted' END AS reason
       FROM cl LEFT JOIN cd ON cd.day = cl.day LEFT JOIN cc ON cc.day = cl.day AND cc.code = cl.code),
q AS (SELECT *, CASE WHEN hour < 15 THEN 1 ELSE 0 END AS before_cutoff,
             CASE WHEN reason = 'counted' THEN 1 ELSE 0 END AS qualified FROM q0)"""


def line_capture(spark, sf_dir):
    ticks = A.lineitem_tape(spark, sf_dir)
    return capture.capture_contracts(A.lineitem_captured(ticks), A.lineitem_official(ticks))


def event_capture(spark, sf_dir):
    ticks = A.events_tape(spark, sf_dir)
    return capture.capture_contracts(A.events_captured(ticks), A.events_official(ticks))


def qualified(spark, sf_dir):
    ticks = A.events_tape(spark, sf_dir)
    return plan.event_status(ticks, A.events_official(ticks), A.events_captured(ticks), min_notional=50 * A.CENTS)


@query("day:d code:i our_volume:f official_volume:f pct:f below_threshold:i", f"WITH {TAPE}, {LINE_CAP}\nSELECT * FROM cc")
def capture_ratio(spark, sf_dir):
    return line_capture(spark, sf_dir)


@query("day:d overall:f sampled:i n_below:i", f"WITH {TAPE}, {LINE_CAP}, {CAP_DAY}\nSELECT * FROM cd")
def capture_days(spark, sf_dir):
    return capture.capture_days(line_capture(spark, sf_dir))


@query(
    "day:d overall:f sampled:i code:i pct:f below:i",
    f"""WITH {TAPE}, {LINE_CAP},
n AS (SELECT trade_date AS day, symbol, code, count(*) AS prints FROM tape GROUP BY ALL),
s AS (SELECT day, code FROM (SELECT *, row_number() OVER (PARTITION BY day, symbol ORDER BY prints DESC, code DESC) AS rn
      FROM n) WHERE rn <= 3),
x AS (SELECT cc.* FROM cc SEMI JOIN s ON s.day = cc.day AND s.code = cc.code),
d AS (SELECT day, round(100 * (CAST(sum(our_volume) AS DOUBLE) / CAST(sum(official_volume) AS DOUBLE)), 1) AS overall,
             count(*) AS sampled FROM x GROUP BY day)
SELECT x.day, overall, sampled, code, pct, below_threshold AS below FROM x JOIN d ON d.day = x.day""",
)
def capture_records(spark, sf_dir):
    """Nested day records over the sampled contracts, read back as rows."""
    sample = chain.busiest_contracts(A.lineitem_tape(spark, sf_dir)).withColumnRenamed("trade_date", "day")
    sampled = capture.sample_contracts(line_capture(spark, sf_dir), sample)
    return capture.record_contracts(capture.capture_records(sampled))


def _fingerprints(lines):
    days = lines.groupBy(F.to_date("l_shipdate").alias("day"), "l_suppkey").agg(F.max("l_orderkey").alias("newest"))
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("files"), F.max("newest").alias("newest")).select(
        "day", capture.fingerprint_text(F.col("files"), F.col("newest")).alias("fingerprint")
    )


@query(
    "day:d fingerprint:s cached_fingerprint:s",
    """WITH a AS (SELECT CAST(l_shipdate AS DATE) AS day, concat_ws(':', count(DISTINCT l_suppkey), max(l_orderkey)) AS fp
  FROM lineitem GROUP BY 1),
b AS (SELECT CAST(l_shipdate AS DATE) AS day, concat_ws(':', count(DISTINCT l_suppkey), max(l_orderkey)) AS fp
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT a.day, a.fp AS fingerprint, b.fp AS cached_fingerprint FROM a LEFT JOIN b ON a.day = b.day
WHERE b.fp IS NULL OR b.fp <> a.fp""",
)
def changed_days(spark, sf_dir):
    """Fingerprints of the tape now against those of the part landed first."""
    lines = A.table(spark, sf_dir, "lineitem")
    return capture.changed_days(_fingerprints(lines), _fingerprints(lines.filter("l_linestatus = 'F'")))


def line_days(spark, sf_dir):
    return A.lineitem_tape(spark, sf_dir).select(F.col("trade_date").alias("day"))


@query(
    "trade_date:d symbol:i prints:i contracts:i events:i",
    f"""WITH {TAPE},
e AS (SELECT trade_date, symbol, code, time, ticker_direction FROM tape WHERE ticker_direction IN ('BUY', 'SELL')
      GROUP BY ALL HAVING count(*) >= 2 AND sum(turnover) >= 100000),
n AS (SELECT trade_date, symbol, count(*) AS events FROM e GROUP BY ALL)
SELECT t.*, coalesce(n.events, 0) AS events
FROM (SELECT trade_date, symbol, count(*) AS prints, count(DISTINCT code) AS contracts FROM tape GROUP BY ALL) t
LEFT JOIN n ON n.trade_date = t.trade_date AND n.symbol = t.symbol""",
)
def collection_counts(spark, sf_dir):
    return coverage.collection_counts(A.lineitem_tape(spark, sf_dir), 100_000 * A.CENTS)


@query(
    "trade_date:d s0:i s1:i s2:i",
    f"""WITH {EVENTS}
SELECT trade_date, count(*) FILTER (symbol = 0) AS s0, count(*) FILTER (symbol = 1) AS s1,
       count(*) FILTER (symbol = 2) AS s2 FROM ev GROUP BY trade_date""",
)
def wide_counts(spark, sf_dir):
    ticks = A.events_tape(spark, sf_dir)
    counts = ticks.groupBy("trade_date", "symbol").agg(F.count(F.lit(1)).alias("prints"))
    wide = coverage.wide_counts(counts, "prints", [0, 1, 2])
    return wide.withColumnsRenamed({str(s): f"s{s}" for s in range(3)})


@query(
    "day:d symbol:s first_tick:u last_tick:u span:s contracts:i prints:i raw_events:i counted_events:i",
    f"""WITH {EVENTS}, {CLUSTERS},
p AS (SELECT trade_date AS day, symbol, min(ts) AS f, max(ts) AS l, count(DISTINCT code) AS contracts, count(*) AS prints
      FROM ev GROUP BY ALL),
c AS (SELECT day, symbol, count(*) AS raw, count(*) FILTER (hour(time) < 15) AS counted FROM cl GROUP BY ALL),
j AS (SELECT p.*, coalesce(raw, 0) AS raw, coalesce(counted, 0) AS counted
      FROM p LEFT JOIN c ON c.day = p.day AND c.symbol = p.symbol),
r AS (SELECT day, CASE WHEN grouping(symbol) = 1 THEN 'TOTAL' ELSE CAST(symbol AS VARCHAR) END AS symbol, min(f) AS first_tick,
             max(l) AS last_tick, sum(contracts) AS contracts, sum(prints) AS prints, sum(raw) AS raw_events,
             sum(counted) AS counted_events
      FROM j GROUP BY GROUPING SETS ((day, symbol), (day))),
z AS (SELECT *, CAST(floor(epoch(last_tick - first_tick)) AS BIGINT) AS secs FROM r)
SELECT *, printf('%d:%02d:%02d', secs // 3600, (secs % 3600) // 60, secs % 60) AS span FROM z""",
)
def day_summary_rollup(spark, sf_dir):
    return plan.day_summary(A.events_tape(spark, sf_dir), 50 * A.CENTS)


@query(
    "day:d symbol:s contracts:i prints:i raw_events:i",
    f"""WITH {EVENTS}, {CLUSTERS},
d AS (SELECT DISTINCT trade_date AS day FROM ev),
s AS (SELECT unnest(['0', '1', '2', '3', 'TOTAL']) AS symbol),
p AS (SELECT trade_date AS day, CAST(symbol AS VARCHAR) AS symbol, count(DISTINCT code) AS contracts, count(*) AS prints
      FROM ev GROUP BY ALL),
e AS (SELECT day, CAST(symbol AS VARCHAR) AS symbol, count(*) AS raw_events FROM cl GROUP BY ALL),
j AS (SELECT p.*, coalesce(raw_events, 0) AS raw_events FROM p LEFT JOIN e ON e.day = p.day AND e.symbol = p.symbol),
t AS (SELECT * FROM j UNION ALL SELECT day, 'TOTAL', sum(contracts), sum(prints), sum(raw_events) FROM j GROUP BY day)
SELECT d.day, s.symbol, coalesce(contracts, 0) AS contracts, coalesce(prints, 0) AS prints,
       coalesce(raw_events, 0) AS raw_events
FROM d CROSS JOIN s LEFT JOIN t ON t.day = d.day AND t.symbol = s.symbol""",
)
def full_day_summary(spark, sf_dir):
    """The day summary with a row for every symbol of the list, also one that never traded."""
    return plan.full_day_summary(plan.day_summary(A.events_tape(spark, sf_dir), 50 * A.CENTS), ["0", "1", "2", "3"])


@query(
    "day:d symbol:s prints:i",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
s AS (SELECT DISTINCT o_orderpriority AS symbol FROM orders)
SELECT d.day, s.symbol, (SELECT count(*) FROM orders o WHERE CAST(o.o_orderdate AS DATE) = d.day
                         AND o.o_orderpriority = s.symbol) AS prints FROM d, s""",
)
def zero_filled_counts(spark, sf_dir):
    counts = A.snapshots(spark, sf_dir).groupBy("day", "symbol").agg(F.count(F.lit(1)).alias("prints"))
    return coverage.zero_filled(counts, PRIORITIES, ["prints"])


@query(
    "day:d snapshots:i missing:i",
    """SELECT l.day, count(DISTINCT o.o_orderpriority) AS snapshots, 5 - count(DISTINCT o.o_orderpriority) AS missing
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) l
LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = l.day GROUP BY l.day""",
)
def snapshot_coverage(spark, sf_dir):
    return coverage.snapshot_coverage(line_days(spark, sf_dir), A.snapshots(spark, sf_dir), len(PRIORITIES))


@query(
    "symbol:s days_banked:i",
    "SELECT o_orderpriority AS symbol, count(DISTINCT CAST(o_orderdate AS DATE)) AS days_banked FROM orders GROUP BY 1",
)
def snapshot_depth(spark, sf_dir):
    return coverage.snapshot_depth(A.snapshots(spark, sf_dir))


@query(
    "day:d",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day FROM c WHERE isodow(day) <= 5 AND day NOT IN (SELECT day FROM d)""",
)
def weekday_gaps(spark, sf_dir):
    return coverage.weekday_gaps(A.snapshots(spark, sf_dir))


@query(
    "day:d symbol:s",
    """SELECT d.day, s.symbol FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) d,
     (SELECT DISTINCT o_orderpriority AS symbol FROM orders) s
EXCEPT SELECT CAST(o_orderdate AS DATE), o_orderpriority FROM orders""",
)
def missing_bars(spark, sf_dir):
    return coverage.missing_bars(line_days(spark, sf_dir), A.snapshots(spark, sf_dir), PRIORITIES)


@query(
    "symbol:i day:d bars:i first_bar:t last_bar:t",
    f"""WITH {EVENTS}
SELECT symbol, trade_date AS day, count(DISTINCT date_trunc('minute', ts)) AS bars,
       min(date_trunc('minute', ts)) AS first_bar, max(date_trunc('minute', ts)) AS last_bar FROM ev GROUP BY ALL""",
)
def bars_inventory(spark, sf_dir):
    bars = study.minute_closes(A.event_quotes(spark, sf_dir))
    return coverage.bars_inventory(
        bars.select("symbol", F.to_date("minute").alias("day"), F.col("minute").alias("time_key"))
    )


@query(
    "day:d code:i time:t direction:s notional:m hour:i overall:f before_cutoff:i qualified:i reason:s",
    f"{QUALIFIED}\nSELECT * FROM q",
)
def event_qualification(spark, sf_dir):
    return qualified(spark, sf_dir)


@query(
    "hour:i events:i excluded_hour:i",
    f"""{QUALIFIED}
SELECT hour, count(*) AS events, CASE WHEN hour >= 15 THEN 1 ELSE 0 END AS excluded_hour
FROM q WHERE overall >= 95 AND day >= DATE '2024-01-05' GROUP BY hour""",
)
def event_hour_histogram(spark, sf_dir):
    return events.hour_histogram(events.valid_days(qualified(spark, sf_dir), START))


@query(
    "bucket_order:i bucket:s events:i",
    f"""{QUALIFIED}
SELECT b.bucket_order, b.bucket, count(q.notional) AS events
FROM (VALUES (0, '50-75', 0, 75), (1, '75-100', 75, 100), (2, '100-150', 100, 150), (3, '150-250', 150, 250),
             (4, '250+', 250, 1000000000)) b(bucket_order, bucket, lo, hi)
LEFT JOIN q ON q.qualified = 1 AND q.notional >= b.lo AND q.notional < b.hi GROUP BY ALL""",
)
def notional_buckets(spark, sf_dir):
    return events.notional_histogram(qualified(spark, sf_dir).filter("qualified = 1"), SIZES)


BY = """SELECT {0}, count(*) AS raw_events, sum(before_cutoff) AS before_cutoff_events, sum(qualified) AS counted_events
FROM q GROUP BY {0}"""
BY_COLS = "raw_events:i before_cutoff_events:i counted_events:i"


@query("day:d " + BY_COLS, f"{QUALIFIED}\n{BY.format('day')}")
def events_by_day(spark, sf_dir):
    return plan.event_reports(qualified(spark, sf_dir))["by_day"]


@query("symbol:i " + BY_COLS, f"{QUALIFIED}\n{BY.format('symbol')}")
def events_by_symbol(spark, sf_dir):
    return plan.event_reports(qualified(spark, sf_dir))["by_symbol"]


@query(
    "day:d events:i counted:i total_notional:m",
    f"""{QUALIFIED}
SELECT day, count(*) AS events, sum(qualified) AS counted, sum(notional) AS total_notional FROM q GROUP BY day""",
)
def event_totals(spark, sf_dir):
    return events.event_totals(qualified(spark, sf_dir))


@query(
    "time:t code:i direction:s prints:i volume:m notional:m reason:s",
    f"{QUALIFIED}\nSELECT * FROM q WHERE day = DATE '2024-01-10' ORDER BY notional DESC, time, code, direction",
)
def events_of_day(spark, sf_dir):
    return events.events_of_day(qualified(spark, sf_dir), dt.date(2024, 1, 10))


PROGRESS_COLS = (
    "valid_days:i qualifying_events:i per_day:f need_days:i need_events:i events_pct:f days_pct:f eta_days:f stop:i "
    "projected_finish:d"
)


@query(
    PROGRESS_COLS,
    f"""{QUALIFIED},
n AS (SELECT (SELECT count(*) FROM cd WHERE overall >= 95 AND day >= DATE '2024-01-05') AS valid_days,
             (SELECT count(*) FROM q WHERE qualified = 1 AND day >= DATE '2024-01-05') AS qualifying_events),
m AS (SELECT *, coalesce(CAST(qualifying_events AS DOUBLE) / nullif(valid_days, 0), 0) AS per_day,
             greatest(40 - valid_days, 0) AS need_days, greatest(50000 - qualifying_events, 0) AS need_events FROM n),
e AS (SELECT *, greatest(need_days, CASE WHEN per_day > 0 THEN need_events / per_day ELSE 0 END) AS eta_days FROM m)
SELECT *, least(100, 100.0 * qualifying_events / 50000) AS events_pct, least(100, 100.0 * valid_days / 40) AS days_pct,
       CASE WHEN need_days = 0 AND need_events = 0 THEN 1 ELSE 0 END AS stop,
       least(DATE '2024-06-28', coalesce(
         list_filter([DATE '2024-01-31' + CAST(i AS INTEGER) for i in range(1, 400)], lambda x: isodow(x) <= 5)[CAST(ceil(eta_days) AS BIGINT)],
         CASE WHEN eta_days = 0 THEN DATE '2024-01-31' ELSE DATE '2024-06-28' END)) AS projected_finish
FROM e""",
)
def progress(spark, sf_dir):
    days = capture.capture_days(event_capture(spark, sf_dir))
    return events.progress(qualified(spark, sf_dir), days, AS_OF, START, 50_000, 40, STOP)


ALERT_START, ALERT_AS_OF, CHECKED_UNTIL = dt.date(1996, 1, 1), dt.date(2001, 11, 1), dt.date(2001, 6, 1)


@query(
    "severity:s day:d kind:s message:s",
    f"""WITH {TAPE}, {LINE_CAP}, {CAP_DAY},
x AS (SELECT DISTINCT trade_date AS day FROM tape WHERE trade_date >= DATE '1996-01-01'),
k AS (SELECT x.day, overall, n_below FROM x LEFT JOIN (SELECT * FROM cd WHERE day < DATE '2001-06-01') c ON c.day = x.day),
s AS (SELECT x.day, count(DISTINCT o_orderpriority) AS n FROM x LEFT JOIN orders ON CAST(o_orderdate AS DATE) = x.day
      GROUP BY x.day),
c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM x), (SELECT max(day) FROM x), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT 'warn' AS severity, day, 'pending' AS kind, 'not counted yet' AS message FROM k WHERE overall IS NULL OR overall < 95
UNION ALL SELECT 'warn', day, 'unchecked', 'capture not checked' FROM k WHERE overall IS NULL AND day < DATE '2001-11-01'
UNION ALL SELECT 'bad', day, 'day', concat('capture ', overall, '%, day excluded') FROM k WHERE overall < 95
UNION ALL SELECT 'warn', day, 'contracts', concat(CAST(n_below AS BIGINT), ' contracts excluded') FROM k
  WHERE overall >= 95 AND n_below > 0
UNION ALL SELECT CASE WHEN n = 0 THEN 'bad' ELSE 'warn' END, day, 'snapshots', concat(n, ' of 5 snapshots') FROM s WHERE n < 5
UNION ALL SELECT 'warn', day, 'gap', 'weekday without collection' FROM c
  WHERE isodow(day) <= 5 AND day NOT IN (SELECT day FROM x)""",
)
def quality_alerts(spark, sf_dir):
    checked = capture.capture_days(line_capture(spark, sf_dir)).filter(F.col("day") < F.lit(CHECKED_UNTIL))
    days = line_days(spark, sf_dir).distinct()
    return events.quality_alerts(
        days, checked, A.snapshots(spark, sf_dir), ALERT_AS_OF, len(PRIORITIES), ALERT_START
    )


@query(
    "day:d capture_status:s overall:f contracts:i prints:i events_0:i events_1:i events_2:i counted_events:i raw_events:i "
    "snapshots:i universe:i pre_experiment:i",
    f"""{QUALIFIED},
v AS (SELECT trade_date AS day, count(DISTINCT (symbol, code)) AS contracts, count(*) AS prints FROM ev GROUP BY 1),
e AS (SELECT day, count(*) FILTER (qualified = 1 AND symbol = 0) AS events_0,
             count(*) FILTER (qualified = 1 AND symbol = 1) AS events_1,
             count(*) FILTER (qualified = 1 AND symbol = 2) AS events_2,
             sum(qualified) AS counted_events, count(*) AS raw_events FROM q GROUP BY day),
s AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS snapshots FROM events GROUP BY 1)
SELECT v.*, CASE WHEN overall IS NULL THEN 'unchecked' WHEN overall >= 95 THEN 'ok' ELSE 'below' END AS capture_status,
       overall, coalesce(events_0, 0) AS events_0, coalesce(events_1, 0) AS events_1, coalesce(events_2, 0) AS events_2,
       coalesce(counted_events, 0) AS counted_events, coalesce(raw_events, 0) AS raw_events,
       coalesce(snapshots, 0) AS snapshots, 5 AS universe,
       CASE WHEN v.day < DATE '2024-01-05' THEN 1 ELSE 0 END AS pre_experiment
FROM v LEFT JOIN e ON e.day = v.day LEFT JOIN cd ON cd.day = v.day LEFT JOIN s ON s.day = v.day""",
)
def daily_detail(spark, sf_dir):
    ticks = A.events_tape(spark, sf_dir)
    days = capture.capture_days(event_capture(spark, sf_dir))
    snaps = A.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("symbol"))
    return plan.daily_detail(ticks, qualified(spark, sf_dir), days, snaps, [0, 1, 2], 5, START)
