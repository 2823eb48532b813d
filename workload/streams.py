"""Streaming queries over the given tables, and sinks read back; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import capture, chain
from tapewright.session import materialize, move_folder, scratch_path
from tapewright.sources import compaction, files, readers, sinks
from tapewright.streaming import polls, source, stateful, ticks
from workload import adapters as A
from workload.collection import EVENT_CAP, event_capture
from workload.flow import ORDER_TIES, UPSERT, order_batches
from workload.registry import EVENTS, TAPE, query


def lineitem_stream(spark, sf_dir):
    rows = A.as_lineitem_tape(source.stream_table(spark, f"{sf_dir}/lineitem.parquet"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def events_stream(spark, sf_dir):
    rows = A.as_events_tape(source.stream_table(spark, f"{sf_dir}/events.parquet"))
    return rows.withColumns({"ts": F.col("ts").cast("timestamp"), "time": F.col("time").cast("timestamp")})


SLICES = 4


def lineitem_slices(spark, sf_dir, name, run):
    """The order lines landing slice by slice in the order of their time; the stream stops and goes on from its checkpoint.

    ``run`` takes the stream and the table and checkpoint to go on with.
    """
    rows = A.lineitem_tape(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = rows.agg(F.percentile_approx(F.unix_micros("ts"), [k / SLICES for k in range(1, SLICES)]).alias("b")).first()["b"]
    landing, at = scratch_path(spark, f"{name}-landing"), (scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint"))
    nth = sum((F.when(F.unix_micros("ts") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    # All slices are cut in one pass over the table; each lands as a folder when its turn comes.
    staged = scratch_path(spark, f"{name}-staged")
    rows.withColumn("slice", nth).write.partitionBy("slice").parquet(staged)
    stream = lambda: spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(landing)
    for k in range(SLICES):
        move_folder(spark, f"{staged}/slice={k}", f"{landing}/slice-{k}")
        result = run(stream(), at)
    return result


@query("code:i trade_date:d sequence:i", f"WITH {TAPE}\nSELECT DISTINCT code, trade_date, sequence FROM tape")
def stream_dedup(spark, sf_dir):
    unique = ticks.dedup_sessions(lineitem_stream(spark, sf_dir)).select("code", "trade_date", "sequence")
    return source.run_available(unique, "stream-dedup")


@query("code:i trade_date:d sequence:i", f"WITH {TAPE}\nSELECT DISTINCT code, trade_date, sequence FROM tape")
def stream_dedup_slices(spark, sf_dir):
    """Over several micro-batches and restarts; rows in the order of their time, so none is late."""
    return lineitem_slices(
        spark, sf_dir, "stream-dedup",
        lambda rows, at: source.run_available(ticks.dedup_sessions(rows).select("code", "trade_date", "sequence"), "stream-dedup", at=at),
    )


@query("code:i sequence:i", f"WITH {TAPE}\nSELECT DISTINCT code, sequence FROM tape")
def stream_dedup_within(spark, sf_dir):
    unique = ticks.dedup_within(lineitem_stream(spark, sf_dir), delay="3650 days").select("code", "sequence")
    return source.run_available(unique, "stream-dedup-within")


@query("code:i sequence:i volume:f", f"WITH {TAPE}\nSELECT code, sequence, volume FROM tape WHERE trade_date = DATE '1999-06-15'")
def stream_seal(spark, sf_dir):
    sealed = ticks.seal_stream(lineitem_stream(spark, sf_dir), F.lit("1999-06-15").cast("date"))
    return source.run_available(sealed.select("code", "sequence", "volume"), "stream-seal")


@query("hour_start:t ticks:i", "SELECT date_trunc('hour', ts) AS hour_start, count(*) AS ticks FROM events GROUP BY 1")
def stream_heartbeat(spark, sf_dir):
    return source.run_updates(ticks.heartbeat(events_stream(spark, sf_dir)), ["hour_start"], "stream-heartbeat")


SILENT = """WITH g AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM events),
s AS (SELECT ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 20 MINUTE THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS n FROM g)
SELECT min(ts) AS first_tick, max(ts) + INTERVAL 20 MINUTE AS alert_time, count(*) AS ticks FROM s GROUP BY n
HAVING max(ts) + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM events)"""


@query("first_tick:u alert_time:u ticks:i", SILENT)
def stream_silence(spark, sf_dir):
    return source.run_available(ticks.silence_alerts(events_stream(spark, sf_dir)), "stream-silence")


@query(
    "code:i time:t direction:s prints:i notional:m",
    f"""WITH {EVENTS}
SELECT code, time, ticker_direction AS direction, count(*) AS prints, sum(turnover) AS notional FROM ev
WHERE ticker_direction IN ('BUY', 'SELL') GROUP BY ALL HAVING count(*) >= 2 AND sum(turnover) >= 50""",
)
def stream_clusters(spark, sf_dir):
    found = ticks.cluster_stream(events_stream(spark, sf_dir), time="time", min_notional=50 * A.CENTS)
    return source.run_updates(found, ["code", "time", "direction"], "stream-clusters")


@query(
    "ticks:i duplicates:i active_contracts:i",
    f"""WITH {TAPE}, k AS (SELECT code, trade_date, sequence, count(*) AS c FROM tape GROUP BY ALL)
SELECT count(*) AS ticks, sum(c - 1) AS duplicates, count(DISTINCT code) AS active_contracts FROM k""",
)
def stream_counters(spark, sf_dir):
    counts = lineitem_slices(
        spark, sf_dir, "stream-counters",
        lambda rows, at: source.run_updates(ticks.feed_counts(rows), ["code", "sequence", "session_start"], "stream-counters", at),
    )
    per_code = counts.groupBy("code").agg(
        F.count(F.lit(1)).alias("ticks"), F.sum(F.col("copies") - 1).alias("duplicates")
    )
    return per_code.agg(
        F.sum("ticks").alias("ticks"), F.sum("duplicates").alias("duplicates"), F.count(F.lit(1)).alias("active_contracts")
    )


@query(
    "trade_date:d symbol:i rows:i turnover:m",
    f"WITH {EVENTS}\nSELECT trade_date, symbol, count(*) AS rows, sum(turnover) AS turnover FROM ev GROUP BY ALL",
)
def stream_append(spark, sf_dir):
    """The event stream appended to date and symbol partitions, read back."""
    table = source.run_available(events_stream(spark, sf_dir), "stream-append", ["trade_date", "symbol"])
    return table.groupBy("trade_date", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("turnover").alias("turnover"))


@query(
    "code:i poll_time:u poll_date:d last_price:f",
    f"WITH {EVENTS}\nSELECT code, ts AS poll_time, trade_date AS poll_date, price AS last_price FROM ev",
)
def stream_polls(spark, sf_dir):
    quotes = events_stream(spark, sf_dir).withColumnRenamed("price", "last_price")
    return source.run_available(polls.stamp_polls(quotes, F.col("ts")), "stream-polls", ["poll_date"])


@query(
    "symbol:s snap_date:d rows:i oi:f",
    """SELECT p_type AS symbol, DATE '2024-03-01' AS snap_date, count(*) AS rows, sum(p_size) AS oi FROM part GROUP BY 1""",
)
def stream_intraday(spark, sf_dir):
    """Parts as chain states of one pass, stamped, keyed by the symbol of their code, appended."""
    parts = source.stream_table(spark, f"{sf_dir}/part.parquet")
    code = F.concat(F.lit("US."), "p_type", F.lit("240621C"), F.col("p_partkey").cast("string"))
    chain = parts.select(
        code.alias("code"), F.col("p_retailprice").alias("last_price"),
        F.col("p_size").cast("double").alias("option_open_interest"),
    )
    stamped = polls.intraday_pass(chain, F.lit("2024-03-01 10:30:00").cast("timestamp"))
    table = source.run_available(stamped, "stream-intraday", ["snap_date", "symbol"])
    return table.groupBy("symbol", "snap_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("option_open_interest").alias("oi")
    )


@query(
    "trade_date:d symbol:i rows:i turnover:m",
    f"WITH {EVENTS}\nSELECT trade_date, symbol, 2 * count(*) AS rows, 2 * sum(turnover) AS turnover FROM ev GROUP BY ALL",
)
def tape_append(spark, sf_dir):
    """The event tape appended twice to partitions, read back."""
    path = scratch_path(spark, "tape")
    rows = A.events_tape(spark, sf_dir)
    for _ in range(2):
        sinks.append_tape(rows, path)
    return spark.read.parquet(path).groupBy("trade_date", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("turnover").alias("turnover")
    )


@query(
    "snap_date:d symbol:s contracts:i price:f",
    """SELECT snap_date, symbol, count(*) AS contracts, sum(price) AS price FROM (
  SELECT date_trunc('year', o_orderdate) AS snap_date, o_orderpriority AS symbol, o_orderstatus,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)
WHERE CASE WHEN symbol < '3' THEN o_orderstatus = 'F' ELSE TRUE END GROUP BY ALL""",
)
def snapshot_replace(spark, sf_dir):
    """Snapshots of all symbols, then some symbols' partitions replaced by a smaller snapshot."""
    path = scratch_path(spark, "snapshots")
    rows = A.table(spark, sf_dir, "orders").select(
        F.trunc("o_orderdate", "year").alias("snap_date"), F.col("o_orderpriority").alias("symbol"), "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )
    sinks.replace_partitions(rows, path)
    sinks.replace_partitions(rows.filter("symbol < '3' and o_orderstatus = 'F'"), path)
    return spark.read.parquet(path).groupBy("snap_date", "symbol").agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("price").alias("price")
    )


@query("o_orderkey:i o_custkey:i o_totalprice:f", UPSERT)
def upsert_table(spark, sf_dir):
    """Two overlapping batches upserted into a table partitioned by a range of the key."""
    path = scratch_path(spark, "upsert-table")
    for batch in order_batches(spark, sf_dir):
        keyed = batch.withColumn("key_range", F.floor(F.col("o_orderkey") / 100_000_000))
        sinks.upsert(keyed, path, ["o_orderkey"], ORDER_TIES, ["key_range"])
    return spark.read.parquet(path)


@query(
    "code:i rows:i",
    """SELECT l_suppkey AS code, count(*) AS rows FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""",
)
def stream_watched(spark, sf_dir):
    """Ticks of watched contracts; the list is read anew for every batch."""
    watch, kept = scratch_path(spark, "watch"), scratch_path(spark, "watched")
    suppliers = A.table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    suppliers.select(F.col("s_suppkey").alias("code")).write.parquet(watch)
    handle = polls.watched_batches(
        watch, lambda batch, i: batch.select("code").write.mode("overwrite").parquet(f"{kept}/batch={i}")
    )
    checkpoint = scratch_path(spark, "watched-checkpoint")
    source.each_batch(lineitem_stream(spark, sf_dir), handle, checkpoint, availableNow=True).awaitTermination()
    return spark.read.parquet(kept).groupBy("code").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "day:d overall:f code:i pct:f below:i",
    f"""WITH {EVENTS}, {EVENT_CAP},
n AS (SELECT trade_date AS day, code, row_number() OVER (PARTITION BY trade_date, symbol
        ORDER BY count(*) DESC, code DESC) AS rn FROM ev GROUP BY trade_date, symbol, code),
x AS (SELECT cc.* FROM cc SEMI JOIN (SELECT * FROM n WHERE rn <= 3) s ON s.day = cc.day AND s.code = cc.code),
d AS (SELECT day, round(100 * (CAST(sum(our_volume) AS DOUBLE) / CAST(sum(official_volume) AS DOUBLE)), 1) AS overall
      FROM x GROUP BY day)
SELECT x.day, overall, code, pct, below_threshold AS below FROM x JOIN d ON d.day = x.day""",
)
def capture_table(spark, sf_dir):
    """Day records written to the capture table, re-checked days replaced, read back as contract rows."""
    path = scratch_path(spark, "capture")
    sample = chain.busiest_contracts(A.events_tape(spark, sf_dir)).withColumnRenamed("trade_date", "day")
    sampled = capture.sample_contracts(event_capture(spark, sf_dir), sample).withColumn("code", F.col("code").cast("string"))
    records = capture.capture_records(sampled)
    sinks.write_capture(records, path)
    sinks.write_capture(records.filter("overall < 95"), path)
    return capture.record_contracts(readers.read_capture(spark, path))


@query(
    "day:d overall:f code:i pct:f below:i",
    f"""WITH {EVENTS}, {EVENT_CAP},
n AS (SELECT trade_date AS day, code, row_number() OVER (PARTITION BY trade_date, symbol
        ORDER BY count(*) DESC, code DESC) AS rn FROM ev GROUP BY trade_date, symbol, code),
x AS (SELECT cc.* FROM cc SEMI JOIN (SELECT * FROM n WHERE rn <= 3) s ON s.day = cc.day AND s.code = cc.code),
d AS (SELECT day, round(100 * (CAST(sum(our_volume) AS DOUBLE) / CAST(sum(official_volume) AS DOUBLE)), 1) AS overall
      FROM x GROUP BY day)
SELECT x.day, overall, code, pct, below_threshold AS below FROM x JOIN d ON d.day = x.day""",
)
def capture_cache(spark, sf_dir):
    """Day records written as one JSON object keyed by day, read back as contract rows."""
    path = scratch_path(spark, "capture-cache")
    sample = chain.busiest_contracts(A.events_tape(spark, sf_dir)).withColumnRenamed("trade_date", "day")
    sampled = capture.sample_contracts(event_capture(spark, sf_dir), sample).withColumn("code", F.col("code").cast("string"))
    sinks.write_capture_cache(capture.capture_records(sampled), path)
    return capture.record_contracts(readers.read_capture_cache(spark, path))


@query(
    "code:s rows:i first_tick:u",
    f"""WITH {EVENTS}, s AS (SELECT min(ts) + INTERVAL 45 MINUTE AS due FROM ev)
SELECT CAST(code AS VARCHAR) AS code, count(*) AS rows, min(ts) AS first_tick FROM ev, s
WHERE code % 3 = 0 OR (code % 2 = 0 AND ts >= due) GROUP BY code""",
)
def stream_repick(spark, sf_dir):
    """Ticks of a watch list over four micro-batches and restarts; 45 minutes after the first tick a re-pick joins the list."""
    rows = A.events_tape(spark, sf_dir).select(F.col("code").cast("string").alias("code"), F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    low, high = rows.agg(F.min(us), F.max(us)).first()
    landing, kept, watch, checkpoint = (scratch_path(spark, f"repick-{name}") for name in ("landing", "kept", "list", "checkpoint"))
    codes = rows.select("code").distinct()
    polls.start_watch(codes.filter("cast(code as int) % 3 = 0"), watch)
    pick = lambda: codes.filter("cast(code as int) % 2 = 0")
    handle = lambda batch, nth: polls.watched_ticks(batch, watch, pick).write.mode("overwrite").parquet(f"{kept}/batch={nth}")
    # The first slice ends before the re-pick is due.
    bounds = [low + 30 * 60_000_000, low + (high - low) // 3, low + 2 * ((high - low) // 3), high + 1]
    for begin, end in zip([low, *bounds], bounds):
        rows.filter((us >= begin) & (us < end)).write.mode("append").parquet(landing)
        source.each_batch(spark.readStream.schema(rows.schema).parquet(landing), handle, checkpoint, availableNow=True).awaitTermination()
    return spark.read.parquet(kept).groupBy("code").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").cast("timestamp_ntz").alias("first_tick"))


LANDED = f"""WITH {EVENTS}
SELECT trade_date, chr(CAST(65 + symbol AS INTEGER)) AS symbol, count(*) AS rows, count(DISTINCT code) AS contracts,
       sum(turnover) AS turnover, min(ts) AS first_tick FROM ev GROUP BY ALL"""
LANDED_COLS = "trade_date:d symbol:s rows:i contracts:i turnover:m first_tick:u"


def land_events(spark, sf_dir):
    """The event tape as landed CSV files with vendor columns; the fraction of the time is kept as text."""
    path = scratch_path(spark, "landing")
    symbol = F.char(F.lit(65) + F.col("symbol"))
    ticks_out = A.events_tape(spark, sf_dir).select(
        F.concat(F.lit("US."), symbol, F.lit("240621C"), F.col("code").cast("string")).alias("code"),
        F.col("ts").cast("string").alias("time"), "price", "volume", "turnover", "ticker_direction", "sequence",
    )
    ticks_out.write.option("header", True).csv(path)
    return path


def landed_report(rows):
    return rows.groupBy("trade_date", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("code").alias("contracts"),
        F.sum(F.col("turnover").cast("bigint")).alias("turnover"), F.min("ts").alias("first_tick"),
    )


@query(LANDED_COLS, LANDED)
def landed_ticks(spark, sf_dir):
    """Landed CSV files read back as a typed tape."""
    return landed_report(readers.read_landed_ticks(spark, land_events(spark, sf_dir)))


@query(LANDED_COLS, LANDED)
def stream_landed(spark, sf_dir):
    """The landing folder as a stream, appended to a table and read back."""
    stream = source.stream_landed_ticks(spark, land_events(spark, sf_dir))
    return landed_report(source.run_available(stream, "stream-landed", ["trade_date"]))


@query("day:d", "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def changed_partitions(spark, sf_dir):
    """File fingerprints of a table before and after more ticks arrive for some days."""
    path = scratch_path(spark, "fingerprints")
    rows = A.events_tape(spark, sf_dir)
    sinks.append_tape(rows, path, ["trade_date"])
    before = materialize(files.partition_fingerprints(spark, path), "fingerprint-cache")
    sinks.append_tape(rows.filter("trade_date >= '2024-01-20'"), path, ["trade_date"])
    return capture.changed_days(files.partition_fingerprints(spark, path), before)


SILENCE_SLICES = 4
# Of the last tenth of a slice, every fifth tick lands with the next slice.
LATE = """x AS (SELECT symbol, ts, sequence, epoch_us(ts) AS us FROM ev),
r AS (SELECT min(us) AS lo, max(us) AS hi, (max(us) - min(us)) // 4 + 1 AS width FROM x),
p AS (SELECT x.*, hi, width, (us - lo) // width AS own,
             CASE WHEN sequence % 5 = 0 AND (us - lo) % width >= width - width // 10 AND (us - lo) // width < 3 THEN 1 ELSE 0 END AS back FROM x, r),
q AS (SELECT *, own + back AS slice FROM p),
m AS (SELECT symbol, slice, max(max(us)) OVER (PARTITION BY symbol ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
      FROM q GROUP BY symbol, slice),
t AS (SELECT q.*, CASE WHEN us // 60000000 < newest // 60000000 THEN 1 ELSE 0 END AS late FROM q JOIN m USING (symbol, slice)),
g AS (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY us) AS prev FROM t),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev >= 1200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY us) AS n FROM g)
SELECT symbol, min(ts) AS first_tick, max(ts) AS last_tick, max(ts) + INTERVAL 20 MINUTE AS alert_time, count(*) AS ticks, sum(late) AS late_ticks
FROM s GROUP BY symbol, n HAVING max(us) + 1200000000 <= max(hi) - max(width) // 10"""


@query("symbol:i first_tick:u last_tick:u alert_time:u ticks:i late_ticks:i", f"WITH {EVENTS}, {LATE}")
def stream_silence_symbols(spark, sf_dir):
    """Silences of each symbol by timers, over four micro-batches and restarts, some ticks landing a batch late."""
    rows = A.events_tape(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).select("symbol", "ts", "sequence")
    us = F.unix_micros("ts")
    low, high = rows.agg(F.min(us), F.max(us)).first()
    width = (high - low) // SILENCE_SLICES + 1
    own = F.floor((us - low) / width)
    late = (F.col("sequence") % 5 == 0) & ((us - low) % width >= width - width // 10) & (own < SILENCE_SLICES - 1)
    nth = own + F.when(late, 1).otherwise(0)
    landing, at = scratch_path(spark, "silence-landing"), (scratch_path(spark, "silence"), scratch_path(spark, "silence-checkpoint"))
    for k in range(SILENCE_SLICES):
        rows.filter(nth == k).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        found = source.run_available(stateful.silence_watch(stream, delay=f"{width // 10} microseconds"), "silence", at=at)
    return found


@query("symbol:i trade_date:d sequence:i rows:i", f"WITH {EVENTS}\nSELECT symbol, trade_date, sequence, 1 AS rows FROM ev GROUP BY ALL")
def stream_dedup_from_tape(spark, sf_dir):
    """Three runs without a checkpoint of the last one, over all that has landed, every fourth tick twice: the tape itself is what was seen."""
    rows = A.events_tape(spark, sf_dir).select("symbol", "trade_date", "sequence", F.col("ts").cast("timestamp").alias("ts"))
    landing, table = scratch_path(spark, "seen-landing"), scratch_path(spark, "seen-tape")
    spark.createDataFrame([], rows.schema).write.parquet(table)
    for k in range(3):
        part = rows.filter(F.pmod(F.xxhash64("sequence"), F.lit(3)) == k)
        part.unionByName(part.filter("sequence % 4 = 0")).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        seen = spark.read.schema(rows.schema).parquet(table)
        fresh = stateful.dedup_from_tape(stream, seen, keys=("symbol", "trade_date", "sequence"))
        source.run_available(fresh, f"seen-{k}").write.mode("append").parquet(table)
    return spark.read.schema(rows.schema).parquet(table).groupBy("symbol", "trade_date", "sequence").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "trade_date:d symbol:i rows:i turnover:m files:i",
    f"WITH {EVENTS}\nSELECT trade_date, symbol, count(*) AS rows, sum(turnover) AS turnover, 1 AS files FROM ev GROUP BY ALL",
)
def tape_compact(spark, sf_dir):
    """The tape flushed in four parts, then packed: one small file a partition, the same rows."""
    path = scratch_path(spark, "compacted-tape")
    rows = A.events_tape(spark, sf_dir)
    for k in range(4):
        sinks.append_tape(rows.filter(F.pmod(F.xxhash64("sequence"), F.lit(4)) == k), path)
    compaction.compact(spark, path)
    held = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    return held.groupBy("trade_date", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("turnover").alias("turnover"), F.countDistinct("file").alias("files")
    )
