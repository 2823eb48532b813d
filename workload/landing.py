"""Landed files with real names: ticks of contract-days and chain snapshots, ingested as they come."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import chain
from tapewright.plans import collection, ingest, partials
from tapewright.schemas import CHAIN, TAPE
from tapewright.session import scratch_path
from tapewright.sources import readers, sinks
from workload import adapters as A
from workload import history
from workload.registry import EVENTS, query

# Two writers: the second has vendor columns, one of them quoted text, in an order of its own.
HEADERS = (
    ("code", "time", "price", "volume", "turnover", "ticker_direction", "sequence"),
    ("name", "sequence", "trade_date", "turnover", "volume", "time", "ticker_direction", "code", "price"),
)


ROWS_PER_FILE = 20_000


def write_files(rows, path):
    """CSV files with the names in ``file`` and the columns that ``header`` lists, in that order.

    A name that more than ``ROWS_PER_FILE`` rows share has files in several folders, so that files are neither many and
    tiny nor large, however many rows there are.
    """
    names = rows.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).alias("_parts"))
    rows = rows.join(names, "file").withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).drop("_parts")

    def write(part):
        import pandas as pd
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        text = part[part["header"].iloc[0].split(",")].to_csv(index=False)
        folder = f"{folder}/part-{part['part'].iloc[0]}"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{part['file'].iloc[0]}") as out:
            out.write(text.encode())
        return pd.DataFrame({"rows": [len(part)]})

    rows.groupBy("file", "part").applyInPandas(write, "rows long").count()
    return path


def land_ticks(spark, sf_dir):
    """The event tape as contract-day files; every seventh tick comes twice, every eleventh again in the next day's file."""
    ticks = A.events_tape(spark, sf_dir)
    symbol = F.char(F.lit(65) + F.col("symbol"))
    again = F.when(F.col("sequence") % 7 == 0, F.array("trade_date")).otherwise(F.array().cast("array<date>"))
    stale = F.when(F.col("sequence") % 11 == 0, F.array(F.date_add("trade_date", 1))).otherwise(F.array().cast("array<date>"))
    code = F.concat(F.lit("US."), symbol, F.lit("240621C"), F.col("code").cast("string"))
    placed = ticks.withColumn("file_day", F.explode(F.concat(F.array("trade_date"), again, stale))).select(
        code.alias("code"), F.col("ts").cast("string").alias("time"), "price", "volume", "turnover", "ticker_direction", "sequence", "trade_date",
        F.concat(F.lit('Call, "'), symbol, F.lit('"')).alias("name"), "file_day",
    )
    own = placed.withColumn("file", F.concat(F.replace("code", F.lit("."), F.lit("_")), F.lit("_"), F.col("file_day").cast("string"), F.lit(".csv")))
    writer = F.when(F.crc32("file") % 2 == 0, ",".join(HEADERS[0])).otherwise(",".join(HEADERS[1]))
    return write_files(own.withColumn("header", writer).drop("file_day"), scratch_path(spark, "contract-days"))


REPORT = f"""WITH {EVENTS}
SELECT trade_date, chr(CAST(65 + symbol AS INTEGER)) AS symbol, count(*) AS rows, count(DISTINCT code) AS contracts,
       sum(turnover) AS turnover, min(ts) AS first_tick FROM ev GROUP BY ALL"""
REPORT_COLS = "trade_date:d symbol:s rows:i contracts:i turnover:m first_tick:u"


def report(spark, table):
    return spark.read.schema(TAPE).parquet(table).groupBy("trade_date", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("code").alias("contracts"),
        F.sum(F.col("turnover").cast("bigint")).alias("turnover"), F.min("ts").alias("first_tick"),
    )


@query(REPORT_COLS, REPORT)
def ingest_batch(spark, sf_dir):
    """Files ingested in two runs, the second of which finds nothing changed."""
    landing, table = land_ticks(spark, sf_dir), scratch_path(spark, "tape")
    ingest.ingest_changed(spark, landing, table)
    assert ingest.ingest_changed(spark, landing, table) is None
    return report(spark, table)


@query(REPORT_COLS, REPORT)
def ingest_stream(spark, sf_dir):
    """The same files as a stream of several micro-batches."""
    landing, table = land_ticks(spark, sf_dir), scratch_path(spark, "tape")
    ingest.ingest_stream(spark, landing, table, scratch_path(spark, "ingest-checkpoint"), max_files=320, seconds=None).awaitTermination()
    return report(spark, table)


REFUSED = f"""WITH {EVENTS}, f AS (
  SELECT trade_date, trade_date AS session, CASE WHEN sequence % 7 = 0 THEN 2 ELSE 1 END AS n FROM ev
  UNION ALL SELECT trade_date, trade_date + 1, 1 FROM ev WHERE sequence % 11 = 0)
SELECT session, sum(CASE WHEN session = trade_date THEN n ELSE 0 END) AS fresh_rows,
       sum(CASE WHEN session <> trade_date THEN n ELSE 0 END) AS stale_rows FROM f GROUP BY session"""


@query("session:d fresh_rows:i stale_rows:i", REFUSED)
def ingest_refused(spark, sf_dir):
    """Rows that the session seal kept and refused."""
    return ingest.ingest_changed(spark, land_ticks(spark, sf_dir), scratch_path(spark, "tape"))


@query("session:d fresh_rows:i stale_rows:i", REFUSED)
def ingest_stream_refused(spark, sf_dir):
    """The same counts noted by a stream of several micro-batches, stopped after half of the files and gone on from its checkpoint."""
    landing, table, checkpoint = scratch_path(spark, "refused-landing"), scratch_path(spark, "tape"), scratch_path(spark, "refused-checkpoint")
    ticks = land_ticks(spark, sf_dir)
    for half in (0, 1):
        named = readers.landed_lines(spark, ticks).withColumn("name", F.element_at(F.split("file", "/"), -1))
        copy_files(named.filter(F.crc32("name") % 2 == half), landing)
        ingest.ingest_stream(spark, landing, table, checkpoint, max_files=160, seconds=None).awaitTermination()
    return ingest.sealed_counts(spark, table)


@query(REPORT_COLS, REPORT)
def landed_mixed_headers(spark, sf_dir):
    """Files of two writers read by the header of each, without repeats and ticks of other sessions."""
    rows = readers.read_landed_ticks(spark, land_ticks(spark, sf_dir)).filter("trade_date = file_day").dropDuplicates(["code", "trade_date", "sequence"])
    return rows.groupBy("trade_date", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("file_code").alias("contracts"),
        F.sum(F.col("turnover").cast("bigint")).alias("turnover"), F.min("ts").alias("first_tick"),
    )


@query(
    "symbol:s snap_date:d tag:s contracts:i oi:f",
    """SELECT chr(CAST(65 + p_size % 5 AS INTEGER)) AS symbol, DATE '2024-03-01' + CAST(p_partkey % 3 AS INTEGER) AS snap_date, tag,
       count(*) AS contracts, sum(CAST(p_size AS DOUBLE)) AS oi
FROM part, (VALUES ('daily', 1), ('collector', 2), ('collector_repick', 3)) AS t(tag, every) WHERE p_partkey % every = 0 GROUP BY ALL""",
)
def landed_snapshots(spark, sf_dir):
    """Parts as daily chain snapshots, beside them what the collector took; each kind is read apart."""
    parts = A.table(spark, sf_dir, "part")
    symbol, day = F.char(F.lit(65) + F.col("p_size") % 5), F.date_add(F.lit("2024-03-01").cast("date"), (F.col("p_partkey") % 3).cast("int"))
    chain = parts.select(
        F.concat(F.lit("US."), symbol, F.lit("240621C"), F.col("p_partkey").cast("string")).alias("code"), F.lit("CALL").alias("option_type"),
        F.col("p_size").cast("double").alias("option_open_interest"), F.col("p_name").alias("name"), symbol.alias("of"), day.alias("day"), "p_partkey",
    )
    path = scratch_path(spark, "chains")
    for tag, every, header in (("", 1, "code,option_type,option_open_interest"), ("_collector", 2, "name,option_type,option_open_interest,code"), ("_collector_repick", 3, "option_type,code,option_open_interest")):
        name = F.concat(F.lit("US_"), "of", F.lit("_"), F.col("day").cast("string"), F.lit(f"{tag}.csv"))
        write_files(chain.filter(F.col("p_partkey") % every == 0).withColumns({"file": name, "header": F.lit(header)}), path)
    daily = readers.read_landed_chains(spark, path).withColumn("tag", F.lit("daily"))
    return daily.unionByName(readers.read_collector_chains(spark, path)).groupBy("symbol", "snap_date", "tag").agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("option_open_interest").alias("oi")
    )


@query(REPORT_COLS, REPORT)
def stream_restart(spark, sf_dir):
    """Half of the files, a restart from the checkpoint, then the other half beside files seen before."""
    ticks, table, checkpoint = land_ticks(spark, sf_dir), scratch_path(spark, "tape"), scratch_path(spark, "restart-checkpoint")
    landing = scratch_path(spark, "restart-landing")
    for half in (0, 1):
        named = readers.landed_lines(spark, ticks).withColumn("name", F.element_at(F.split("file", "/"), -1))
        copy_files(named.filter(F.crc32("name") % 2 == half), landing)
        ingest.ingest_stream(spark, landing, table, checkpoint, max_files=320, seconds=None).awaitTermination()
    return report(spark, table)


def copy_files(lines, path):
    """Lines of landed files, each file whole under its own folder and name in ``path``; the header goes first."""

    def write(part):
        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        folder, name = part["file"].iloc[0].split("/")[-2:]
        store.create_dir(f"{root}/{folder}", recursive=True)
        heads = part["value"].str.contains("ticker_direction")
        text = "\n".join([*part["value"][heads], *part["value"][~heads]]) + "\n"
        with store.open_output_stream(f"{root}/{folder}/{name}") as out:
            out.write(text.encode())
        return pd.DataFrame({"rows": [len(part)]})

    lines.select("file", "value").groupBy("file").applyInPandas(write, "rows long").count()


@query(
    "code:s option_type:s oi:f",
    """SELECT 'US.' || chr(CAST(65 + p_size % 5 AS INTEGER)) || '240621C' || p_partkey AS code, 'CALL' AS option_type, CAST(p_size AS DOUBLE) AS oi FROM part""",
)
def landed_pages(spark, sf_dir):
    """Parts as chain pages in three folders with columns of their own, which overlap; each contract once."""
    parts = A.table(spark, sf_dir, "part")
    code = F.concat(F.lit("US."), F.char(F.lit(65) + F.col("p_size") % 5), F.lit("240621C"), F.col("p_partkey").cast("string"))
    rows = parts.select(code.alias("code"), F.lit("CALL").alias("option_type"), F.col("p_size").cast("double").alias("option_open_interest"), F.col("p_name").alias("name"), "p_partkey")
    columns = (["code", "option_type", "option_open_interest"], ["name", "option_open_interest", "code", "option_type"], ["option_type", "code", "option_open_interest"])
    pages = [scratch_path(spark, "pages") for _ in columns]
    for k, (page, own) in enumerate(zip(pages, columns)):
        rows.filter((F.col("p_partkey") % 3 == k) | (F.col("p_partkey") % 5 == 0)).select(*own).write.option("header", True).csv(page)
    return chain.distinct_contracts(readers.read_pages(spark, CHAIN, pages), ["option_type"]).withColumnRenamed("option_open_interest", "oi")


@query(
    "code:s polls:i first_poll:u last_price:f",
    f"""WITH {EVENTS}
SELECT 'US.' || chr(CAST(65 + symbol AS INTEGER)) AS code, count(*) AS polls, min(ts) AS first_poll, arg_max(price, (ts, sequence)) AS last_price FROM ev GROUP BY 1""",
)
def landed_quotes(spark, sf_dir):
    """Events as polled quotes of the underlyings, appended in three runs; the last price of each."""
    ticks = A.events_tape(spark, sf_dir)
    rows = ticks.select(
        F.concat(F.lit("US."), F.char(F.lit(65) + F.col("symbol"))).alias("code"), F.col("sequence").cast("string").alias("update_time"), F.col("price").alias("last_price"),
        F.col("ts").cast("string").alias("poll_time"), "sequence",
    )
    path = scratch_path(spark, "quotes")
    for k in range(3):
        rows.filter(F.col("sequence") % 3 == k).drop("sequence").write.mode("append").option("header", True).csv(path)
    polled = readers.read_underlying(spark, path).withColumn("at", F.col("poll_time").cast("timestamp_ntz"))
    return polled.groupBy("code").agg(
        F.count(F.lit(1)).alias("polls"), F.min("at").alias("first_poll"),
        F.max_by("last_price", F.struct("at", F.col("update_time").cast("bigint"))).alias("last_price"),
    )


@query(
    "trade_date:d symbol:s rows:i name_breaks:i turnover:m",
    f"""WITH {EVENTS}
SELECT trade_date, chr(CAST(65 + symbol AS INTEGER)) AS symbol, count(*) AS rows, count(*) FILTER (sequence % 4 = 0) AS name_breaks,
       sum(turnover) AS turnover FROM ev GROUP BY ALL""",
)
def landed_line_breaks(spark, sf_dir):
    """Ticks whose vendor name, in a quoted column, holds commas and, for every fourth, line breaks; each record is one row."""
    ticks = A.events_tape(spark, sf_dir)
    symbol = F.char(F.lit(65) + F.col("symbol"))
    code = F.concat(F.lit("US."), symbol, F.lit("240621C"), F.col("code").cast("string"))
    name = F.when(F.col("sequence") % 4 == 0, F.concat(F.lit('Call,\n"two" lines,\n'), symbol)).otherwise(F.concat(F.lit("Call, "), symbol))
    rows = ticks.select(
        name.alias("option_type"), code.alias("code"), F.col("turnover").cast("string").alias("turnover"),
        F.concat(F.lit("US_"), symbol, F.lit("_"), F.col("trade_date").cast("string"), F.lit(".csv")).alias("file"),
    )
    path = scratch_path(spark, "breaks")
    for half, header in enumerate(("option_type,code,turnover", "code,turnover,option_type")):
        write_files(rows.filter(F.crc32("code") % 2 == half).withColumn("header", F.lit(header)), f"{path}/{half}")
    read = readers.read_landed_chains(spark, path)
    return read.groupBy(F.col("snap_date").alias("trade_date"), "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.contains("option_type", F.lit('\n"two" lines,\n'))).alias("name_breaks"), F.sum(F.col("turnover").cast("bigint")).alias("turnover")
    )


@query(
    "day:d symbol:s first_tick:u last_tick:u contracts:i prints:i raw_events:i counted_events:i",
    f"""WITH {EVENTS}, cl AS (SELECT code, symbol, trade_date AS day, time FROM ev WHERE ticker_direction IN ('BUY', 'SELL')
      GROUP BY code, symbol, trade_date, time, ticker_direction HAVING count(*) >= 2 AND sum(turnover) >= 50),
p AS (SELECT trade_date AS day, symbol, min(ts) AS first_tick, max(ts) AS last_tick, count(DISTINCT code) AS contracts, count(*) AS prints FROM ev GROUP BY ALL),
c AS (SELECT day, symbol, count(*) AS raw, count(*) FILTER (hour(time) < 15) AS counted FROM cl GROUP BY ALL),
j AS (SELECT p.*, coalesce(raw, 0) AS raw, coalesce(counted, 0) AS counted FROM p LEFT JOIN c ON c.day = p.day AND c.symbol = p.symbol)
SELECT day, CASE WHEN grouping(symbol) = 1 THEN 'TOTAL' ELSE CAST(symbol AS VARCHAR) END AS symbol, min(first_tick) AS first_tick, max(last_tick) AS last_tick,
       sum(contracts) AS contracts, sum(prints) AS prints, sum(raw) AS raw_events, sum(counted) AS counted_events
FROM j GROUP BY GROUPING SETS ((day, symbol), (day))""",
)
def summary_by_changed_days(spark, sf_dir):
    """The day summary kept by day over three landings: half of each day's ticks of some days, the rest, nothing new."""
    ticks = A.events_tape(spark, sf_dir).withColumns({"time": F.col("time").cast("string"), **{c: F.col(c).cast("string") for c in ("code", "symbol")}})
    rows = ticks.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TAPE.fields])
    table, store = scratch_path(spark, "summary-tape"), scratch_path(spark, "summary-days")
    early = (F.dayofyear("trade_date") % 3 != 0) & (F.col("sequence") % 2 == 0)
    for landed in (rows.filter(early), rows.filter(~early), None):
        if landed is not None:
            sinks.append_tape(landed, table)
        kept = partials.refreshed(spark, table, store, lambda read: collection.day_summary(read.withColumn("time", F.col("time").cast("timestamp_ntz")), 50 * A.CENTS))
    return kept


@query(
    "symbol:s day:d states:i volume:f snap_times:i",
    """SELECT chr(CAST(65 + p_size % 5 AS INTEGER)) AS symbol, DATE '2024-03-01' + CAST(p_partkey % 3 AS INTEGER) AS day, count(*) AS states,
       sum(CAST(p_size AS DOUBLE)) AS volume, count(DISTINCT p_size % 4) AS snap_times FROM part GROUP BY ALL""",
)
def landed_intraday(spark, sf_dir):
    """Parts as intraday states; every row carries the time of its pass, symbol and day come from the file name."""
    parts = A.table(spark, sf_dir, "part")
    symbol, day = F.char(F.lit(65) + F.col("p_size") % 5), F.date_add(F.lit("2024-03-01").cast("date"), (F.col("p_partkey") % 3).cast("int"))
    rows = parts.select(
        F.concat(F.lit("US."), symbol, F.lit("240621C"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_size").cast("double").alias("volume"),
        F.concat(day.cast("string"), F.lit(" 1"), (F.col("p_size") % 4).cast("string"), F.lit(":30:00")).alias("snap_time"),
        F.concat(F.lit("US_"), symbol, F.lit("_"), day.cast("string"), F.lit(".csv")).alias("file"), F.lit("code,volume,snap_time").alias("header"),
    )
    states = readers.read_landed_intraday(spark, write_files(rows, scratch_path(spark, "intraday")))
    return states.groupBy("symbol", F.col("snap_date").alias("day")).agg(
        F.count(F.lit(1)).alias("states"), F.sum("volume").alias("volume"), F.countDistinct("snap_time").alias("snap_times")
    )


@query(
    "symbol:s days:i first_day:d volume:f missing:i",
    """WITH h AS (SELECT chr(CAST(65 + l_suppkey % 5 AS INTEGER)) AS symbol, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS volume,
                  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS calls FROM lineitem GROUP BY ALL)
SELECT symbol, count(*) AS days, min(day) AS first_day, sum(volume) AS volume, count(*) FILTER (calls = 0) AS missing FROM h GROUP BY symbol""",
)
def landed_history(spark, sf_dir):
    """Symbol-day sums of the order lines as landed statistics; measures that are not known read "N/A"."""
    ticks = A.lineitem_tape(spark, sf_dir)
    symbol = F.char(F.lit(65) + F.col("symbol"))
    sums = ticks.groupBy(symbol.alias("of"), F.col("trade_date").cast("string").alias("time")).agg(
        F.sum("volume").alias("option_volume"), F.sum(F.when(F.col("ticker_direction") == "BUY", F.col("volume")).otherwise(0.0)).alias("call_volume")
    )
    known = sums.withColumn("call_volume", F.when(F.col("call_volume") == 0, "N/A").otherwise(F.col("call_volume").cast("string")))
    path = scratch_path(spark, "histories")
    for kind, header in (("stat", "time,option_volume,call_volume"), ("vol", "time,iv")):
        name = F.concat(F.lit("US_"), "of", F.lit(f"_{kind}.csv"))
        write_files(known.withColumns({"iv": F.lit("0.5"), "file": name, "header": F.lit(header)}), path)
    stat, vol = readers.read_symbol_history(spark, path)
    both = stat.join(vol.select("symbol", "time"), ["symbol", "time"])
    return both.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), F.min(F.to_date("time")).alias("first_day"), F.sum(F.col("option_volume").cast("double")).alias("volume"),
        F.count_if(F.col("call_volume").try_cast("double").isNull()).alias("missing"),
    )


@query(
    "symbol:s day:d bars:i close:m volume:f",
    f"""WITH {EVENTS}
SELECT chr(CAST(65 + symbol AS INTEGER)) AS symbol, trade_date AS day, count(*) AS bars, sum(turnover) AS close, count(*) * 2.0 AS volume FROM ev GROUP BY ALL""",
)
def landed_bars_and_volume(spark, sf_dir):
    """Minute bars of two fetched pages with headers of their own, and official volumes beside them."""
    ticks = A.events_tape(spark, sf_dir)
    symbol = F.char(F.lit(65) + F.col("symbol"))
    rows = ticks.select(
        F.concat(F.lit("US."), symbol).alias("code"), F.col("ts").cast("string").alias("time_key"), F.col("turnover").cast("string").alias("close"),
        F.col("trade_date").cast("string").alias("day"), F.lit("2").alias("volume"), "sequence",
    )
    pages = []
    for page, header in ((0, "code,time_key,close"), (1, "close,code,time_key")):
        own = rows.filter(F.col("sequence") % 2 == page).withColumns({"file": F.concat("code", F.lit("_"), "day", F.lit(".csv")), "header": F.lit(header)})
        pages.append(write_files(own, scratch_path(spark, "bars")))
    volumes = write_files(rows.withColumns({"file": F.concat("day", F.lit(".csv")), "header": F.lit("code,day,volume")}), scratch_path(spark, "volumes"))
    bars = [readers.read_bars(spark, p) for p in pages]
    per_day = bars[0].unionByName(bars[1]).groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("bars"), F.sum(F.col("close").cast("bigint")).alias("close"))
    official = readers.read_daily_volume(spark, volumes).groupBy(F.substring("code", 4, 9).alias("symbol"), "day").agg(F.sum("volume").alias("volume"))
    return per_day.join(official, ["symbol", "day"])


@query(
    "lang:s files:i chars:i",
    """WITH f AS (SELECT lang, doc_id // 500 AS part, sum(length(text)) + count(*) AS chars FROM documents GROUP BY ALL)
SELECT lang, count(*) AS files, sum(chars) AS chars FROM f GROUP BY lang""",
)
def text_files(spark, sf_dir):
    """Documents as text files of a language and 500 ids each, read back as whole files."""
    docs = A.table(spark, sf_dir, "documents")
    path = scratch_path(spark, "texts")

    def write(part):
        import pandas as pd
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{part['lang'].iloc[0]}-{part['part'].iloc[0]}.txt") as out:
            for text in part["text"]:
                out.write(f"{text}\n".encode())
        return pd.DataFrame({"rows": [len(part)]})

    docs.select("lang", F.floor(F.col("doc_id") / 500).alias("part"), "text").groupBy("lang", "part").applyInPandas(write, "rows long").count()
    files = readers.read_text(spark, path).withColumn("lang", F.regexp_extract("doc_id", r"([a-z]+)-\d+\.txt$", 1))
    return files.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("chars"))


@query(
    "symbol:s rows:i first_day:d last_day:d",
    """SELECT CAST(l_suppkey % 5 AS VARCHAR) AS symbol, count(DISTINCT CAST(l_shipdate AS DATE)) AS rows, min(CAST(l_shipdate AS DATE)) AS first_day,
       max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem GROUP BY 1""",
)
def feature_files(spark, sf_dir):
    """The feature table written as CSV files in order of date and symbol, read back."""
    path = scratch_path(spark, "feature-files")
    sinks.write_features(history.features(spark, sf_dir), path, csv=True)
    return spark.read.option("header", True).csv(path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").cast("date").alias("first_day"), F.max("date").cast("date").alias("last_day")
    )
