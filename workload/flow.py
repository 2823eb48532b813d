"""Tape queries: clusters, flow, blocks, duplicates, sessions, gaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tapewright.operators import columns, coverage, flow, tape
from workload import adapters as A
from workload.registry import EVENTS, TAPE, query

LINE_ORDER = ["time", "sequence", "code", "part", "turnover", "ticker_direction"]


@query(
    "code:i time:d direction:s prints:i volume:f notional:m",
    f"""WITH {TAPE}
SELECT code, time, ticker_direction AS direction, count(*) AS prints, sum(volume) AS volume, sum(turnover) AS notional
FROM tape WHERE ticker_direction IN ('BUY', 'SELL')
GROUP BY code, time, ticker_direction HAVING count(*) >= 2 AND sum(turnover) >= 100000""",
)
def cluster_events(spark, sf_dir):
    return flow.cluster_events(A.lineitem_tape(spark, sf_dir), ["code"], 100_000 * A.CENTS)


FLOW_SQL = """SELECT {keys} b AS buy_notional, s AS sell_notional, b - s AS net_notional,
       CASE WHEN b + s = 0 THEN 0 ELSE CAST(b AS DOUBLE) / CAST(b + s AS DOUBLE) END AS buy_share, n AS total_prints,
       CASE WHEN b + s = 0 THEN 'BALANCED' WHEN CAST(b AS DOUBLE) / CAST(b + s AS DOUBLE) >= 0.65 THEN 'UNUSUAL_BUY_PRESSURE'
            WHEN CAST(b AS DOUBLE) / CAST(b + s AS DOUBLE) <= 0.35 THEN 'UNUSUAL_SELL_PRESSURE' ELSE 'BALANCED' END AS label
FROM (SELECT {keys} sum(CASE WHEN ticker_direction = 'BUY' THEN turnover ELSE 0 END) AS b,
             sum(CASE WHEN ticker_direction = 'SELL' THEN turnover ELSE 0 END) AS s, count(*) AS n
      FROM tape {group})"""
FLOW_COLS = "buy_notional:m sell_notional:m net_notional:m buy_share:f total_prints:i label:s"


@query(
    "code:i trade_date:d " + FLOW_COLS,
    f"WITH {TAPE}\n" + FLOW_SQL.format(keys="code, trade_date,", group="GROUP BY code, trade_date"),
)
def flow_summary(spark, sf_dir):
    return flow.flow_summary(A.lineitem_tape(spark, sf_dir), ["code", "trade_date"])


@query(FLOW_COLS, f"WITH {TAPE}\n" + FLOW_SQL.format(keys="", group=""))
def flow_summary_total(spark, sf_dir):
    return flow.flow_summary(A.lineitem_tape(spark, sf_dir))


@query(
    "symbol:i block_rank:i code:i time:d sequence:i volume:f turnover:m",
    f"""WITH {TAPE}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol
    ORDER BY volume DESC, time, sequence, code, part, turnover, ticker_direction) AS block_rank
  FROM tape WHERE volume >= 50) WHERE block_rank <= 10""",
)
def block_prints_top10(spark, sf_dir):
    return flow.block_prints(A.lineitem_tape(spark, sf_dir), ["symbol"], ties=LINE_ORDER)


TOP_CLUSTERS = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol
    ORDER BY notional DESC, time, direction) AS cluster_rank
  FROM (SELECT symbol, time, ticker_direction AS direction, count(*) AS prints, sum(volume) AS volume,
               sum(turnover) AS notional
        FROM tape GROUP BY ALL HAVING count(*) >= 2)) WHERE cluster_rank <= 10"""


@query(
    "symbol:i cluster_rank:i time:d direction:s prints:i volume:f notional:m", f"WITH {TAPE}\n{TOP_CLUSTERS}"
)
def clusters_top10(spark, sf_dir):
    return flow.top_clusters(A.lineitem_tape(spark, sf_dir), ["symbol"])


@query(
    "symbol:i total_prints:i n_blocks:i blocks_volume:f n_clusters:i top_notional:m last_notional:m",
    f"""WITH {TAPE},
top_c AS ({TOP_CLUSTERS}),
top_b AS (SELECT symbol, volume, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC) AS rn
          FROM tape WHERE volume >= 50),
b AS (SELECT symbol, count(*) AS n_blocks, sum(volume) AS blocks_volume FROM top_b WHERE rn <= 10 GROUP BY symbol),
c AS (SELECT symbol, count(*) AS n_clusters, max(notional) AS top_notional, min(notional) AS last_notional
      FROM top_c GROUP BY symbol)
SELECT t.symbol, t.n AS total_prints, coalesce(n_blocks, 0) AS n_blocks, coalesce(blocks_volume, 0) AS blocks_volume,
       coalesce(n_clusters, 0) AS n_clusters, top_notional, last_notional
FROM (SELECT symbol, count(*) AS n FROM tape GROUP BY symbol) t
LEFT JOIN b USING (symbol) LEFT JOIN c USING (symbol)""",
)
def analyze_flow(spark, sf_dir):
    nested = flow.analyze_flow(A.lineitem_tape(spark, sf_dir), ["symbol"], LINE_ORDER)
    volume = F.aggregate("blocks", F.lit(0.0), lambda acc, b: acc + b["volume"])
    return nested.select(
        "symbol", "total_prints", F.size("blocks").alias("n_blocks"), volume.alias("blocks_volume"),
        F.size("clusters").alias("n_clusters"),
        F.try_element_at("clusters", F.lit(1))["notional"].alias("top_notional"),
        F.try_element_at("clusters", F.lit(-1))["notional"].alias("last_notional"),
    )


FIRST = "ORDER BY time, part, volume, turnover, ticker_direction, tax"
FIRST_ORDER = ["time", "part", "volume", "turnover", "ticker_direction", "tax"]
TICK_COLS = "code:i sequence:i time:d volume:f turnover:m ticker_direction:s"


@query(
    TICK_COLS,
    f"""WITH {TAPE}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, sequence {FIRST}) AS rn FROM tape) WHERE rn = 1""",
)
def dedup_ticks(spark, sf_dir):
    return tape.dedup_ticks(A.lineitem_tape(spark, sf_dir), order=FIRST_ORDER)


@query(
    TICK_COLS,
    f"""WITH {TAPE}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, sequence {FIRST}) AS rn
  FROM tape WHERE status = 'O') n
WHERE rn = 1 AND NOT EXISTS (
  SELECT 1 FROM tape s WHERE s.status = 'F' AND s.code = n.code AND s.sequence = n.sequence)""",
)
def new_ticks(spark, sf_dir):
    ticks = A.lineitem_tape(spark, sf_dir)
    return tape.new_ticks(ticks.filter("status = 'O'"), ticks.filter("status = 'F'"), order=FIRST_ORDER)


SESSION = dt.date(1999, 6, 15)


@query(
    "symbol:i fresh_rows:i stale_rows:i",
    f"""WITH {TAPE}
SELECT symbol, count(*) FILTER (trade_date = DATE '1999-06-15') AS fresh_rows,
       count(*) FILTER (trade_date <> DATE '1999-06-15') AS stale_rows FROM tape GROUP BY symbol""",
)
def session_seal_counts(spark, sf_dir):
    return tape.seal_counts(A.lineitem_tape(spark, sf_dir), F.lit(SESSION), ["symbol"])


@query(
    "code:i sequence:i volume:f", f"WITH {TAPE}\nSELECT code, sequence, volume FROM tape WHERE trade_date = DATE '1999-06-15'"
)
def sealed_session(spark, sf_dir):
    return tape.seal_session(A.lineitem_tape(spark, sf_dir), F.lit(SESSION))


UPSERT = """SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY batch DESC, o_totalprice, o_custkey, o_orderdate) AS rn
  FROM (SELECT 0 AS batch, o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'P'
        UNION ALL
        SELECT 1, o_orderkey, o_custkey, o_totalprice + 1, o_orderdate FROM orders WHERE o_orderstatus <> 'O'))
WHERE rn = 1"""


def order_batches(spark, sf_dir):
    """Two overlapping batches of orders by status; the second one changes the price."""
    orders = A.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    newer = orders.filter("o_orderstatus <> 'O'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return orders.filter("o_orderstatus <> 'P'"), newer


ORDER_TIES = ["o_totalprice", "o_custkey", "o_orderdate"]


@query("o_orderkey:i o_custkey:i o_totalprice:f", UPSERT)
def upsert_latest(spark, sf_dir):
    return tape.latest_per_key(order_batches(spark, sf_dir), ["o_orderkey"], ORDER_TIES)


@query(
    "code:i gap_from:i gap_to:i missing:i",
    f"""WITH {TAPE}, s AS (SELECT DISTINCT code, sequence FROM tape),
l AS (SELECT code, lag(sequence) OVER (PARTITION BY code ORDER BY sequence) AS gap_from, sequence AS gap_to FROM s)
SELECT *, gap_to - gap_from - 1 AS missing FROM l WHERE gap_to - gap_from > 1""",
)
def sequence_gaps(spark, sf_dir):
    return tape.sequence_gaps(A.lineitem_tape(spark, sf_dir), ["code"])


@query(
    "code:i gap_from:i gap_to:i missing:i",
    f"""WITH {EVENTS}, s AS (SELECT DISTINCT code, epoch_us(ts) AS sequence FROM ev),
g AS (SELECT code, lag(sequence) OVER (PARTITION BY code ORDER BY sequence) AS gap_from, sequence AS gap_to FROM s)
SELECT *, gap_to - gap_from - 1 AS missing FROM g WHERE gap_to - gap_from > 1""",
)
def clock_sequence_gaps(spark, sf_dir):
    """Sequence numbers that are clock times in microseconds."""
    ticks = A.events_tape(spark, sf_dir).withColumn("sequence", F.unix_micros(F.col("ts").cast("timestamp")))
    return tape.sequence_gaps(ticks, ["code"])


@query(
    "code:i trade_date:d present:i expected:i clean:i",
    f"""WITH {EVENTS}
SELECT code, trade_date, count(DISTINCT sequence) AS present, max(sequence) - min(sequence) + 1 AS expected,
       CASE WHEN count(DISTINCT sequence) = max(sequence) - min(sequence) + 1 THEN 1 ELSE 0 END AS clean
FROM ev GROUP BY code, trade_date""",
)
def gap_free(spark, sf_dir):
    return tape.gap_free(A.events_tape(spark, sf_dir)).withColumn("clean", F.col("gap_free").cast("int"))


@query(
    "last_tick:u next_tick:u alert_time:u",
    """SELECT last_tick, next_tick, last_tick + INTERVAL 20 MINUTE AS alert_time
FROM (SELECT lag(ts) OVER (ORDER BY ts) AS last_tick, ts AS next_tick FROM events)
WHERE next_tick >= last_tick + INTERVAL 20 MINUTE""",
)
def silences(spark, sf_dir):
    return tape.silences(A.events_tape(spark, sf_dir))


@query(
    "symbol:i last_tick:u next_tick:u alert_time:u",
    f"""WITH {EVENTS}
SELECT symbol, last_tick, next_tick, last_tick + INTERVAL 20 MINUTE AS alert_time
FROM (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS last_tick, ts AS next_tick FROM ev)
WHERE next_tick >= last_tick + INTERVAL 20 MINUTE""",
)
def silences_by_symbol(spark, sf_dir):
    return tape.silences(A.events_tape(spark, sf_dir), keys=["symbol"])


COUNTERS_CTE = f"""WITH {TAPE}, k AS (SELECT code, sequence, count(*) AS copies FROM tape GROUP BY code, sequence),
c AS (SELECT code, count(*) AS ticks, sum(copies - 1) AS duplicates FROM k GROUP BY code)"""


def watch_list(spark, sf_dir):
    return A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"))


@query(
    "ticks:i active_contracts:i duplicates:i silent_contracts:i",
    f"""{COUNTERS_CTE}
SELECT sum(ticks) AS ticks, count(*) AS active_contracts, sum(duplicates) AS duplicates,
       (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT code FROM c)) AS silent_contracts FROM c""",
)
def tick_counters(spark, sf_dir):
    return tape.tick_counters(A.lineitem_tape(spark, sf_dir), watch_list(spark, sf_dir))[0]


@query("code:i ticks:i", f"{COUNTERS_CTE}\nSELECT code, ticks FROM c ORDER BY ticks DESC, code LIMIT 5")
def busiest_codes(spark, sf_dir):
    return tape.tick_counters(A.lineitem_tape(spark, sf_dir), watch_list(spark, sf_dir))[1]


@query(
    "trade_date:d hour:i new_ticks:i cumulative:i",
    f"""WITH {EVENTS}, h AS (SELECT trade_date, hour(ts) AS hour, count(*) AS new_ticks FROM ev GROUP BY ALL)
SELECT *, sum(new_ticks) OVER (PARTITION BY trade_date ORDER BY hour) AS cumulative FROM h""",
)
def running_totals(spark, sf_dir):
    return tape.running_totals(A.events_tape(spark, sf_dir))


@query("rows_on_disk:i", "SELECT count(*) AS rows_on_disk FROM lineitem")
def rows_on_disk(spark, sf_dir):
    return coverage.rows_on_disk(A.lineitem_tape(spark, sf_dir))


@query(
    "trade_date:d code:i polled_prints:i pushed_prints:i difference:i",
    f"""WITH {TAPE}
SELECT trade_date, code, count(*) FILTER (status = 'F') AS polled_prints, count(*) FILTER (tax < 0.06) AS pushed_prints,
       count(*) FILTER (tax < 0.06) - count(*) FILTER (status = 'F') AS difference
FROM tape WHERE status = 'F' OR tax < 0.06 GROUP BY trade_date, code""",
)
def feed_comparison(spark, sf_dir):
    ticks = A.lineitem_tape(spark, sf_dir)
    return coverage.feed_comparison(ticks.filter("status = 'F'"), ticks.filter("tax < 0.06"))


@query(
    "status:s rows:i with_sizes:i",
    """SELECT l_linestatus AS status, count(*) AS rows, count(*) FILTER (l_linestatus = 'O') AS with_sizes
FROM lineitem GROUP BY 1""",
)
def union_by_name(spark, sf_dir):
    """Pages with different columns as one table; the column one page lacks is null there."""
    ticks = A.lineitem_tape(spark, sf_dir).select("code", "volume", "status")
    pages = [ticks.filter("status = 'F'").drop("volume"), ticks.filter("status = 'O'")]
    merged = columns.union_all(pages)
    return merged.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.count("volume").alias("with_sizes"))
