"""Small files of a partitioned table packed into larger ones, with a journal that lets a broken run be finished."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.session import delete_path, read_if_present, scratch_path
from tapewright.sources import files

TARGET_BYTES = 128 * 1024 * 1024
# Files that one pass packs; more take more passes.
FILES_AT_ONCE = 10_000

_JOURNAL = "source string, target string"


def journal_path(path: str) -> str:
    return f"{path.rstrip('/')}_compaction"


def small_files(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """path, folder and bin of the data files to pack: those below half the target, in folders with several of them.

    Files of a folder fill bins in the order of their names; a bin holds about ``target_bytes``.
    """
    listed = files.list_files(spark, path).filter(F.col("name").rlike(r"^[^_.].*\.parquet$") & (F.col("length") < target_bytes // 2))
    placed = listed.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    # Rows are files of one folder, not of the table.
    before = Window.partitionBy("folder").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    binned = placed.withColumn("bin", F.floor(F.coalesce(F.sum("length").over(before), F.lit(0)) / target_bytes))
    return binned.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("folder", "bin"))).filter("n > 1").select("path", "folder", "bin")


def compact(spark: SparkSession, path: str, partitions: Sequence[str] = ("trade_date", "symbol"), target_bytes: int = TARGET_BYTES) -> int:
    """Pack the small files of the table; returns how many were replaced. Rows stay as they are.

    The packed files are written aside first. Then a journal names every move, and only then files are put in and old
    ones deleted. A run that breaks before the journal leaves the table as it was; one that breaks after it is finished
    by the next. Until then, and for the moment of the swap, a reader may see rows twice. Let one writer compact at a time.
    """
    finish(spark, path)
    replaced = 0
    while True:
        todo = small_files(spark, path, target_bytes)
        # Whole bins: a pass takes folders in their order until it has enough files.
        folders = todo.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
        first = folders.orderBy("folder").limit(FILES_AT_ONCE).withColumn("before", F.sum("n").over(Window.orderBy("folder")) - F.col("n"))
        some = todo.join(first.filter(F.col("before") < FILES_AT_ONCE).select("folder"), "folder", "left_semi").collect()
        if not some:
            return replaced
        _pack(spark, path, some, partitions)
        finish(spark, path)
        replaced += len(some)


def _pack(spark: SparkSession, path: str, some: list, partitions: Sequence[str]) -> None:
    aside = scratch_path(spark, "compaction")
    old = [r["path"] for r in some]
    bins = spark.createDataFrame([("/".join(r["path"].split("/")[-1 - len(partitions) :]), r["bin"]) for r in some], "_place string, _bin long")
    rows = spark.read.schema(spark.read.parquet(path).schema).option("basePath", path).parquet(*old)
    # The file's place below the table; the path of the metadata is that of an address, so it is decoded.
    parts = F.split(F.col("_metadata.file_path"), "/")
    place = F.array_join(F.slice(parts, -1 - len(partitions), 1 + len(partitions)), "/")
    packed = rows.withColumn("_place", F.url_decode(F.replace(place, F.lit("+"), F.lit("%2B")))).join(bins, "_place").drop("_place")
    # Rows of a folder and bin meet in one task, which writes them as one file.
    packed.repartition(*partitions, "_bin").drop("_bin").write.partitionBy(*partitions).parquet(aside)
    new = files.list_files(spark, aside).filter(F.col("name").rlike(r"^[^_.].*\.parquet$")).select("path").collect()
    root = _qualified(spark, aside)
    target = _qualified(spark, path)
    run = uuid.uuid4().hex[:8]
    moves = []
    for row in new:
        folder, name = _qualified(spark, row["path"]).removeprefix(root).rsplit("/", 1)
        moves.append((row["path"], f"{target}{folder}/packed-{run}-{name}"))
    spark.createDataFrame([*moves, *((p, None) for p in old)], _JOURNAL).coalesce(1).write.parquet(journal_path(path))


def finish(spark: SparkSession, path: str) -> None:
    """Carry out what the journal of ``path`` names, if there is one: put new files in, delete old ones, drop the journal."""
    journal = journal_path(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(journal).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(hadoop(journal)):
        return
    if store.exists(hadoop(f"{journal}/_SUCCESS")):
        entries = read_if_present(spark, journal).collect()  # one pass of files
        for row in entries:
            if row["target"] is not None and store.exists(hadoop(row["source"])) and not store.rename(hadoop(row["source"]), hadoop(row["target"])):
                raise OSError(f"could not move {row['source']} to {row['target']}")
        for row in entries:
            if row["target"] is None:
                store.delete(hadoop(row["source"]), False)
    delete_path(spark, journal)


def _qualified(spark: SparkSession, path: str) -> str:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
