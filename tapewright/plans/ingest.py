"""Landed tick files into the tape: the same steps for a job run and for each micro-batch of a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapewright import params as P
from tapewright.operators import tape
from tapewright.schemas import TAPE
from tapewright.session import materialize, read_if_present, scratch_scope
from tapewright.sources import files, readers, sinks
from tapewright.streaming import source


Keep = Callable[[DataFrame], DataFrame]


def ingest_lines(lines: DataFrame, table: str, keep: Keep | None = None) -> DataFrame:
    """Append the ticks of landed lines that are of their file's session and not in ``table`` yet.

    A tick is known by contract, session day and sequence number. Only the table's partitions of the sessions that
    landed are read. ``keep`` may leave out ticks first, such as those of contracts that are not watched. Returns rows
    kept and refused by the seal per session. Running it twice appends nothing twice.
    """
    spark = lines.sparkSession
    landed = materialize(readers.typed_ticks(lines), "landed-ticks")
    if keep is not None:
        landed = materialize(keep(landed), "kept-ticks")
    session = F.coalesce("file_day", "trade_date")
    sealed = tape.seal_session(landed, session).select(*TAPE.fieldNames())
    held = read_if_present(spark, table, TAPE)
    if held is None:
        fresh = tape.dedup_ticks(sealed, tape.SESSION_KEY)
    else:
        # One row a session day: as literals they prune the partitions of the table.
        days = [r["trade_date"] for r in sealed.select("trade_date").distinct().collect()]
        fresh = tape.new_ticks(sealed, held.filter(F.col("trade_date").isin(days)), tape.SESSION_KEY)
    sinks.append_tape(materialize(fresh, "fresh-ticks"), table)
    return tape.seal_counts(landed.withColumn("session", session), F.col("session"), ["session"])


SEALED, UNREADABLE = "sealed", "unreadable"


def note_path(table: str, kind: str) -> str:
    """Where a stream notes, beside ``table``, what each micro-batch kept and refused, or could not read."""
    return f"{table.rstrip('/')}_{kind}"


def _ingest(batch: DataFrame, batch_id: int, table: str, keep: Keep | None = None) -> None:
    """One micro-batch; what it counts is noted under its number, so that a batch that is replayed is noted once."""
    spark = batch.sparkSession
    with scratch_scope(spark):
        lines = materialize(readers.numbered(batch), "landed-batch")
        ingest_lines(lines, table, keep).write.mode("overwrite").parquet(f"{note_path(table, SEALED)}/batch={batch_id}")
        unreadable = readers.files_without_header(lines, readers.TICK_HEADER)
        unreadable.write.mode("overwrite").parquet(f"{note_path(table, UNREADABLE)}/batch={batch_id}")


def sealed_counts(spark: SparkSession, table: str) -> DataFrame:
    """Rows kept and refused per session by all micro-batches of the stream into ``table`` so far."""
    noted = spark.read.schema("session date, fresh_rows long, stale_rows long").parquet(note_path(table, SEALED))
    return noted.groupBy("session").agg(F.sum("fresh_rows").alias("fresh_rows"), F.sum("stale_rows").alias("stale_rows"))


def changed_files(spark: SparkSession, landing: str, ledger: str) -> DataFrame:
    """Landed files (path, modificationTime, length) that are new or changed since ``ledger`` was written."""
    now = files.list_files(spark, landing).filter(F.col("name").endswith(".csv")).select("path", "modificationTime", "length")
    known = read_if_present(spark, ledger)
    return now if known is None else now.join(known, ["path", "modificationTime", "length"], "left_anti")


def ingest_changed(spark: SparkSession, landing: str, table: str) -> DataFrame | None:
    """Ingest the files that changed since the last run, noted in ``<table>_files``; None if there are none.

    Those that could not be read are noted in ``<table>_unreadable`` and not read again until they change.
    """
    ledger = f"{table.rstrip('/')}_files"
    changed = materialize(changed_files(spark, landing, ledger), "changed-files")
    paths = [r["path"] for r in changed.select("path").collect()]  # the files of one run
    if not paths:
        return None
    # Written once: the steps read the lines several times, and many small files are slow to open.
    lines = materialize(readers.landed_lines(spark, paths), "landed-lines")
    counts = ingest_lines(lines, table)
    unreadable = readers.unreadable_files(spark, paths, readers.TICK_HEADER, lines).withColumn("run", F.lit(uuid.uuid4().hex))
    unreadable.write.mode("append").parquet(note_path(table, UNREADABLE))
    # Last: a run that fails before reads the same files again and appends nothing twice.
    changed.write.mode("append").parquet(ledger)
    return counts


def ingest_stream(
    spark: SparkSession, landing: str, table: str, checkpoint: str, max_files: int | None = None, seconds: int | None = P.FLUSH_SECONDS,
    keep: Keep | None = None,
) -> StreamingQuery:
    """The same steps for every micro-batch of new files; with ``seconds`` None it ends with what has landed."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return source.each_batch(
        source.stream_landed_lines(spark, landing, max_files), lambda batch, nth: _ingest(batch, nth, table, keep), checkpoint, **trigger
    )
