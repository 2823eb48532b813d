"""Facts that file names carry, and file-level fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.contract import file_to_code
from tapewright.operators.capture import fingerprint_text

# File name formats.
TICK_FILE = r"(US_[A-Z]+\d{6}[CP]\d+)_(\d{4}-\d{2}-\d{2})\.csv$"
SYMBOL_FILE = r"US_([A-Z]+)_(\d{4}-\d{2}-\d{2})\.csv$"
COLLECTOR_FILE = r"US_([A-Z]+)_(\d{4}-\d{2}-\d{2})_(collector(?:_repick)?)\.csv$"
PASS_FILE = r"US_([A-Z]+)_(\d{4}-\d{2}-\d{2})(?:_[a-z_]+)?\.csv$"
HISTORY_FILE = r"US_([A-Z]+)_(stat|vol)\.csv$"


def named_part(pattern: str, group: int, name: Column | None = None) -> Column:
    """A group of the file name; null when the name has another form."""
    source = F.col("_metadata.file_name") if name is None else name
    return F.nullif(F.regexp_extract(source, pattern, group), F.lit(""))


def tick_file_code(name: Column | None = None) -> Column:
    return file_to_code(named_part(TICK_FILE, 1, name))


def tick_file_day(name: Column | None = None) -> Column:
    return F.to_date(named_part(TICK_FILE, 2, name))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, path and modification time of every file below ``path``; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime", "length")


def total_bytes(spark: SparkSession, paths: Sequence[str]) -> int:
    """Size of all files below the paths; a path that does not exist yet counts nothing."""
    total = 0
    for path in paths:
        try:
            total += list_files(spark, path).agg(F.sum("length")).first()[0] or 0
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return total


def tick_file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Landed contract-day files: count and newest modification second per day."""
    files = list_files(spark, path).withColumn("day", tick_file_day(F.col("name"))).filter("day is not null")
    return _fingerprint(files)


def partition_fingerprints(spark: SparkSession, path: str, partition: str = "trade_date") -> DataFrame:
    """The same for a table partitioned by date."""
    day = F.to_date(F.nullif(F.regexp_extract("path", partition + r"=(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    data = F.col("name").rlike(r"^[^_.]")
    return _fingerprint(list_files(spark, path).filter(data).withColumn("day", day).filter("day is not null"))


def _fingerprint(files: DataFrame) -> DataFrame:
    grouped = files.groupBy("day").agg(
        F.count(F.lit(1)).alias("files"), F.max(F.unix_seconds("modificationTime")).alias("newest")
    )
    return grouped.withColumn("fingerprint", fingerprint_text(F.col("files"), F.col("newest")))
