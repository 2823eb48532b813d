"""Event-study queries on the event tape."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.measures import implied_sign
from tapewright.operators import asof, events, flow, study, tape
from workload import adapters as A
from workload.collection import CLUSTERS
from workload.registry import EVENTS, query

KEY = ["code", "symbol", "time", "direction"]

# Last price at or before a minute of the same symbol and day, and 60 minutes later.
RETURNS = f"""WITH {EVENTS},
bar AS (SELECT symbol, date_trunc('minute', ts) AS minute, arg_max(price, ts) AS close FROM ev GROUP BY ALL),
grid AS (SELECT symbol, day, unnest(generate_series(CAST(day AS TIMESTAMP), day + INTERVAL 1439 MINUTE, INTERVAL 1 MINUTE)) AS minute
         FROM (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM ev)),
held AS (SELECT * FROM (
           SELECT g.symbol, g.day, g.minute,
                  last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol, g.day ORDER BY g.minute) AS close
           FROM grid g LEFT JOIN bar b ON b.symbol = g.symbol AND b.minute = g.minute) WHERE close IS NOT NULL),
late AS (SELECT *, lead(close, 60) OVER (PARTITION BY symbol, day ORDER BY minute) AS close_later FROM held),
ret AS (SELECT symbol, day, minute, close, close_later, close_later / nullif(close, 0) - 1 AS ret FROM late)"""

RETURNED = f"""{RETURNS}, {CLUSTERS},
sgn AS (SELECT *, CASE WHEN (code % 2 = 0) = (direction = 'BUY') THEN 1 ELSE -1 END AS sign FROM cl),
e AS (SELECT s.*, r.close, r.close_later, r.ret, s.sign * r.ret AS signed_return
      FROM sgn s LEFT JOIN ret r ON r.symbol = s.symbol AND r.minute = date_trunc('minute', s.time))"""

STUDY = f"""{RETURNED},
named AS (SELECT *, md5(concat_ws('|', code, symbol, strftime(time, '%Y-%m-%d %H:%M:%S'), direction, '7')) AS digest FROM e),
seeded AS (SELECT *, CAST(concat('0x', substr(digest, 1, 8)) AS BIGINT) % 2147483647 + 1 AS scale,
                  CAST(concat('0x', substr(digest, 9, 8)) AS BIGINT) % 2147483647 AS shift FROM named),
spot AS (SELECT e.*, r.minute AS control_minute, r.ret AS control_return,
                (e.scale * (hour(r.minute) * 60 + minute(r.minute)) + e.shift) % 2147483647 AS x
         FROM seeded e JOIN ret r ON r.symbol = e.symbol AND r.day = e.day AND hour(r.minute) = hour(e.time) AND r.ret IS NOT NULL),
pick AS (SELECT *, row_number() OVER (PARTITION BY code, symbol, time, direction
                  ORDER BY x * x % 2147483647, control_minute) AS draw FROM spot),
ctl AS (SELECT * FROM pick WHERE draw <= 20),
x AS (SELECT e.code, e.symbol, e.time, e.direction, any_value(e.signed_return) AS signed_return,
             any_value(e.sign) * (sum(ctl.control_return) / nullif(count(ctl.control_return), 0)) AS control_return
      FROM e LEFT JOIN ctl ON ctl.code = e.code AND ctl.symbol = e.symbol AND ctl.time = e.time
                          AND ctl.direction = e.direction GROUP BY ALL),
xs AS (SELECT *, signed_return - control_return AS excess FROM x)"""

STATS = """count(excess) AS events, avg(CASE WHEN excess IS NOT NULL THEN signed_return END) AS mean_signed_return,
       avg(CASE WHEN excess IS NOT NULL THEN control_return END) AS mean_control_return, avg(excess) AS excess,
       avg(excess) / nullif(stddev_samp(excess) / sqrt(count(excess)), 0) AS t_stat"""
STAT_COLS = "events:i mean_signed_return:f mean_control_return:f excess:f t_stat:f"


def event_rows(spark, sf_dir):
    found = flow.cluster_events(A.events_tape(spark, sf_dir), ["code", "symbol", "trade_date"], 50 * A.CENTS)
    right = F.when(F.col("code") % 2 == 0, "CALL").otherwise("PUT")
    return found.withColumnRenamed("trade_date", "day").withColumn("sign", implied_sign(right, F.col("direction")))


def minute_table(spark, sf_dir):
    return study.minute_returns(study.minute_grid(study.minute_closes(A.event_quotes(spark, sf_dir))))


def returned(spark, sf_dir):
    return study.event_returns(event_rows(spark, sf_dir), minute_table(spark, sf_dir))


def matched(spark, sf_dir):
    return study.matched_controls(returned(spark, sf_dir), KEY, seed=7)


@query(
    "symbol:i day:d minute:t close:f close_later:f ret:f", f"{RETURNS}\nSELECT * FROM ret"
)
def minute_returns(spark, sf_dir):
    return minute_table(spark, sf_dir)


@query(
    "code:i symbol:i time:t direction:s notional:m sign:i close:f close_later:f signed_return:f",
    f"{RETURNED}\nSELECT * FROM e",
)
def asof_returns(spark, sf_dir):
    return returned(spark, sf_dir)


@query(
    "code:i symbol:i time:t direction:s close:f close_later:f ret:f signed_return:f",
    f"""WITH {EVENTS}, {CLUSTERS},
sgn AS (SELECT *, CASE WHEN (code % 2 = 0) = (direction = 'BUY') THEN 1 ELSE -1 END AS sign, time + INTERVAL 60 MINUTE AS later FROM cl),
k AS (SELECT symbol, ts, arg_max(price, sequence) AS price FROM ev GROUP BY symbol, ts),
p AS (SELECT s.*, CASE WHEN a.ts + INTERVAL 20 MINUTE >= s.time THEN a.price END AS close FROM sgn s
      ASOF LEFT JOIN k a ON a.symbol = s.symbol AND s.time >= a.ts),
l AS (SELECT p.*, CASE WHEN b.ts + INTERVAL 20 MINUTE >= p.later THEN b.price END AS close_later FROM p
      ASOF LEFT JOIN k b ON b.symbol = p.symbol AND p.later >= b.ts)
SELECT *, close_later / nullif(close, 0) - 1 AS ret, sign * (close_later / nullif(close, 0) - 1) AS signed_return FROM l""",
)
def asof_tick_returns(spark, sf_dir):
    """Prices of the last tick at an event and an hour later, none older than 20 minutes."""
    ticks = A.events_tape(spark, sf_dir).select("symbol", F.col("ts").alias("time"), "price", "sequence")
    return study.tick_returns(event_rows(spark, sf_dir), ticks, tolerance_minutes=20, order=["sequence"])


@query(
    "sequence:i symbol:i ts:u asof_ts:u asof_price:f asof_volume:m",
    f"""WITH {EVENTS}, k AS (SELECT symbol, ts, arg_max(price, sequence) AS price, arg_max(volume, sequence) AS volume FROM ev
                              WHERE ticker_direction = 'BUY' GROUP BY symbol, ts)
SELECT ev.sequence, ev.symbol, ev.ts, k.ts AS asof_ts, k.price AS asof_price, k.volume AS asof_volume
FROM ev ASOF LEFT JOIN k ON k.symbol = ev.symbol AND ev.ts >= k.ts""",
)
def asof_last_buy(spark, sf_dir):
    """Every tick with the last buy of its symbol at or before it."""
    ticks = A.events_tape(spark, sf_dir)
    rows = ticks.select("sequence", "symbol", "ts")
    return asof.asof_join(rows, ticks.filter("ticker_direction = 'BUY'"), ["symbol"], "ts", ["price", "volume"], ["sequence"])


@query(
    "code:i symbol:i time:t direction:s control_minute:t control_return:f", f"{STUDY}\nSELECT * FROM ctl"
)
def matched_controls(spark, sf_dir):
    return study.control_rows(matched(spark, sf_dir), KEY)


@query("symbol:i " + STAT_COLS, f"{STUDY}\nSELECT symbol, {STATS} FROM xs GROUP BY symbol")
def study_by_symbol(spark, sf_dir):
    return study.study_by_symbol(study.event_excess(matched(spark, sf_dir)))


@query(
    STAT_COLS + " symbols:i positive_symbols:i negative_symbols:i decision:s",
    f"""{STUDY},
o AS (SELECT {STATS} FROM xs),
s AS (SELECT count(m) AS symbols, count(*) FILTER (m > 0) AS positive_symbols, count(*) FILTER (m < 0) AS negative_symbols
      FROM (SELECT symbol, avg(excess) AS m FROM xs GROUP BY symbol))
SELECT *, CASE WHEN excess >= 0.0015 AND t_stat >= 2.5 AND positive_symbols = symbols THEN 'GO'
               WHEN abs(excess) < 0.0010 OR t_stat < 2.0
                 OR 2 * (CASE WHEN excess >= 0 THEN negative_symbols ELSE positive_symbols END) > symbols THEN 'KILL'
               ELSE 'AMBIGUOUS' END AS decision FROM o, s""",
)
def event_study(spark, sf_dir):
    return study.study_decision(study.event_excess(matched(spark, sf_dir)))


PROTOCOL_SYMBOLS = [0, 1, 2, 3]


@query(
    STAT_COLS + " symbols:i positive_symbols:i decision:s",
    f"""{STUDY},
o AS (SELECT {STATS} FROM xs),
s AS (SELECT count(*) FILTER (m > 0) AS positive_symbols, count(*) FILTER (m < 0) AS negative_symbols
      FROM (SELECT symbol, avg(excess) AS m FROM xs GROUP BY symbol))
SELECT *, 4 AS symbols, CASE WHEN excess >= 0.0015 AND t_stat >= 2.5 AND positive_symbols = 4 THEN 'GO'
               WHEN abs(excess) < 0.0010 OR t_stat < 2.0
                 OR 2 * (CASE WHEN excess >= 0 THEN negative_symbols ELSE positive_symbols END) > 4 THEN 'KILL'
               ELSE 'AMBIGUOUS' END AS decision FROM o, s""",
)
def event_study_protocol(spark, sf_dir):
    """The decision over a protocol of four symbols, one of which has no events and so blocks GO."""
    return study.study_decision(study.event_excess(matched(spark, sf_dir)), PROTOCOL_SYMBOLS).drop("negative_symbols")


@query(
    "code:i trade_date:d time:t direction:s notional:m",
    f"""WITH {EVENTS}, {CLUSTERS},
n AS (SELECT code, trade_date, row_number() OVER (PARTITION BY code, trade_date ORDER BY sequence) AS nth FROM ev),
g AS (SELECT code, trade_date FROM n WHERE NOT (code % 3 = 0 AND nth = 4) GROUP BY ALL
      HAVING count(*) = max(nth) - min(nth) + 1)
SELECT cl.code, cl.day AS trade_date, time, direction, notional FROM cl SEMI JOIN g ON g.code = cl.code AND g.trade_date = cl.day
WHERE date_diff('day', cl.day, DATE '2024-01-20') > 1""",
)
def eligible_clusters(spark, sf_dir):
    """Events with more than one day to expiry on gap-free tapes: numbered densely, with a hole in every third contract."""
    ticks = A.events_tape(spark, sf_dir)
    numbered = ticks.withColumn("sequence", F.row_number().over(Window.partitionBy("code", "trade_date").orderBy("sequence")))
    checks = tape.gap_free(numbered.filter("not (code % 3 = 0 and sequence = 4)"))
    found = flow.cluster_events(ticks, ["code", "symbol", "trade_date"], 50 * A.CENTS)
    return events.eligible_clusters(found, F.lit("2024-01-20").cast("date"), checks)
