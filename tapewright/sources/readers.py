"""Typed readers for landed CSV files and for the tables written from them.

Landed columns are matched by header name, never by position: vendor files
carry extra columns in an order of their own. Ticks and chains are matched file
by file, so files of one folder may differ; a file without the header is left
out and listed by ``unreadable_files``. The other kinds come from one writer
each: there, a file with another header fails the read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright import schemas as S
from tapewright.functions.clock import parse_time
from tapewright.functions.contract import contract_expiry, contract_symbol
from tapewright.operators.columns import union_all
from tapewright.sources import files


def _csv(
    spark: SparkSession, schema: T.StructType, path: str, pattern: str = "*.csv",
    named: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Columns of ``schema`` (null when the files lack them) and columns taken from the file name."""
    reader = (
        spark.read.option("header", True).option("enforceSchema", False)
        .option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    )
    raw = reader.csv(path)
    present = {c.lower(): c for c in raw.columns}
    typed = [
        (F.col(f"`{present[f.name]}`").try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in schema.fields
    ]
    return raw.select(*typed, *[c.alias(n) for n, c in (named or {}).items()])


# Names that a line must hold to be the header of its file.
TICK_HEADER = ("time", "sequence")
CHAIN_HEADER = ("code", "option_type")

def landed_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of landed CSV files with the path of their file and where they stand in it, see ``records``."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    named = reader.text(paths if isinstance(paths, str) else list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return numbered(named)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines as they were read (``start``: where their part of the file begins) with a number that grows within a part."""
    return lines.withColumn("nth", F.monotonically_increasing_id())


def _masked(text: Column, mark: str, stand_in: str) -> Column:
    """``text`` with a stand-in for each ``mark`` inside quotes; every second piece between quotes lies inside."""
    pieces = F.transform(F.split(text, '"'), lambda p, k: F.when(k % 2 == 1, F.translate(p, mark, stand_in)).otherwise(p))
    return F.array_join(pieces, '"')


# Stand-ins for a comma and a line break inside quotes: control characters that no text file holds.
COMMA, BREAK = "\x1f", "\x1e"


def records(lines: DataFrame) -> DataFrame:
    """``lines`` with the lines of a record joined where a quoted text holds line breaks.

    Only files with a line that leaves a quote open are put together, each from its own lines; all others stay as they
    are. Whether there are such files is looked up at once.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    broken = lines.filter(quotes % 2 == 1).select("file").distinct()
    if broken.isEmpty():
        return lines
    whole = lines.join(broken, "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "nth", "value"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.rtrim(r["value"])), "\n")
    joined = whole.select("file", F.explode(F.split(_masked(text, "\n", BREAK), "\n")).alias("value"))
    joined = joined.select(F.translate("value", BREAK, "\n").alias("value"), "file", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("nth"))
    return lines.join(broken, "file", "left_anti").select("value", "file", "start", "nth").unionByName(joined)


def _fields(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    line = F.rtrim("value")
    split = F.split(F.when(F.contains(line, F.lit('"')), _masked(line, ",", COMMA)).otherwise(line), ",")
    cells = F.transform(split, lambda c: F.translate(F.replace(F.regexp_replace(c, '(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"')), COMMA, ","))
    split = lines.withColumn("cells", cells)
    return split.withColumn("is_header", F.array_size(F.array_intersect(F.transform("cells", F.lower), F.array(*map(F.lit, header)))) == len(header))


def _headers(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    """One row a file: its columns by name."""
    return _fields(lines, header).filter("is_header").groupBy("file").agg(F.first(F.transform("cells", F.lower)).alias("columns"))


def by_name(lines: DataFrame, schema: T.StructType, header: Sequence[str]) -> DataFrame:
    """Typed columns of ``schema`` of all lines, each matched by the header of its own file, and the file's name.

    A column that a file lacks is null, and so is a value that does not parse. Files without a header give nothing.
    """
    rows = _fields(lines, header).filter(~F.col("is_header")).select("file", "cells").join(_headers(lines, header), "file")
    typed = [
        F.when(F.array_contains("columns", f.name), F.try_element_at("cells", F.array_position("columns", f.name).cast("int")))
        .try_cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return rows.select(*typed, F.element_at(F.split("file", "/"), -1).alias("file_name"))


def files_without_header(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    """Paths (``file``) of the files of ``lines`` in which no line is a header."""
    return _fields(lines, header).groupBy("file").agg(F.max("is_header").alias("good")).filter(~F.col("good")).select("file")


def unreadable_files(spark: SparkSession, paths: str | Sequence[str], header: Sequence[str], lines: DataFrame | None = None) -> DataFrame:
    """Paths (``file``) of landed files, empty ones included, in which no line is a header.

    Pass the files of one run rather than a whole landing folder: their text is read, unless it is at hand as ``lines``.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    names = listed.load(paths if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("file"))
    good = _headers(landed_lines(spark, paths) if lines is None else lines, header).select("file")
    return names.join(good, "file", "left_anti")


def typed_ticks(lines: DataFrame) -> DataFrame:
    """Ticks of landed lines, of a batch or of a micro-batch of a stream; see ``read_landed_ticks``."""
    name = F.col("file_name")
    named = by_name(records(lines), S.TICK, TICK_HEADER).withColumns({"file_code": files.tick_file_code(name), "file_day": files.tick_file_day(name)})
    ts = parse_time(F.col("time"))
    return named.select(
        "code", contract_symbol(F.coalesce("file_code", "code")).alias("symbol"), "time", ts.alias("ts"),
        F.to_date(ts).alias("trade_date"), "price", "volume", "turnover", "ticker_direction", "sequence",
        "file_code", "file_day",
    )


def read_landed_ticks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Contract-day files; contract and day of the file name are added as ``file_code`` and ``file_day``."""
    return typed_ticks(landed_lines(spark, path))


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.TAPE).parquet(path)


def _chains(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    rows = by_name(records(landed_lines(spark, path)), S.CHAIN, CHAIN_HEADER)
    part = lambda group: files.named_part(pattern, group, F.col("file_name"))
    named = rows.withColumns({"symbol": part(1), "snap_date": F.to_date(part(2)), "tag": part(3) if "collector" in pattern else F.lit(None).cast("string")})
    return named.filter("symbol is not null and snap_date is not null").withColumn("expiry", contract_expiry(F.col("code"))).drop("file_name")


def read_landed_chains(spark: SparkSession, path: str) -> DataFrame:
    """Daily chain snapshots with symbol and day of the file name and the contract's expiry; collector files are left out."""
    return _chains(spark, path, files.SYMBOL_FILE).drop("tag")


def read_collector_chains(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots that the collector took when it picked contracts, with the ``tag`` of the pick."""
    return _chains(spark, path, files.COLLECTOR_FILE)


def read_landed_intraday(spark: SparkSession, path: str) -> DataFrame:
    """Intraday chain states; every row carries the time of its pass."""
    schema = T.StructType([*S.INTRADAY.fields, T.StructField("snap_time", T.StringType())])
    day = F.to_date(files.named_part(files.PASS_FILE, 2))
    return _csv(spark, schema, path, named={"symbol": files.named_part(files.PASS_FILE, 1), "snap_date": day})


def read_symbol_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Statistics and volatility histories as text measures; the symbol comes from the file name."""
    named = {"symbol": files.named_part(files.HISTORY_FILE, 1)}
    return (
        _csv(spark, S.SYMBOL_STAT, path, "US_*_stat.csv", named),
        _csv(spark, S.SYMBOL_VOL, path, "US_*_vol.csv", named),
    )


def read_underlying(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, T.StructType([*S.UNDERLYING.fields, T.StructField("poll_time", T.StringType())]), path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars with parsed minute, day and symbol."""
    minute = parse_time(F.col("time_key"))
    symbol = F.nullif(F.regexp_extract("code", r"^US\.([A-Z]+)$", 1), F.lit(""))
    return _csv(spark, S.BARS, path).withColumns({"minute": minute, "day": F.to_date(minute), "symbol": symbol})


def read_daily_volume(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, S.DAILY_VOLUME, path)


def read_pages(spark: SparkSession, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
    """Fetched pages, landed in several folders with headers of their own, as one table."""
    return union_all([_csv(spark, schema, p) for p in paths])


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CAPTURE_DAY).parquet(path)


def read_capture_json(spark: SparkSession, path: str) -> DataFrame:
    """Capture records landed as JSON lines."""
    return spark.read.schema(S.CAPTURE_DAY).json(path)


def read_capture_cache(spark: SparkSession, path: str) -> DataFrame:
    """Capture records kept as one JSON object with an entry a day.

    The object is a line of text with an entry a day and a bounded sample in each, so the calendar bounds it.
    """
    entry = T.StructType([f for f in S.CAPTURE_DAY.fields if f.name != "day"])
    days = F.from_json("value", T.MapType(T.StringType(), entry))
    held = spark.read.text(path, wholetext=True).select(F.explode(days).alias("day", "record"))
    return held.select(F.col("day").try_cast("date").alias("day"), "record.*").filter("day is not null")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )
