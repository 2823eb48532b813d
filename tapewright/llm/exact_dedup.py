"""Exact duplicates through a cuckoo-filter index of live digests.

The index has one row per bucket of the digest space: a cuckoo filter and the digests that live in it. A probe
that misses the filter is new for certain; a hit is verified against the digests kept in the same bucket. A
filter that overflows is rebuilt with twice the slots from those stored digests. Deleting a document takes its
digest out of filter and store once no document carries it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.columns import id_and_text, rows_of

SLOTS = 4
MAX_KICKS = 200
LOAD = 0.85
DIGESTS_PER_BUCKET = 100_000
SALTS = 16
# Stands for a null id inside a bucket: pandas would turn longs beside nulls into floats.
NO_ID = -(2**63)

GROUP_SCHEMA = "text_sha256 string, keep_id long, group_size long"
INDEX_SCHEMA = "bucket int, filter binary, digests binary, copies binary"


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four slots; partial-key hashing gives two buckets a digest.

    ``digests`` are 32-byte SHA-256 values, so their own bytes serve as hash values.
    """

    def __init__(self, capacity: int) -> None:
        self.rows = 1 << max(1, math.ceil(math.log2(max(1, capacity) / LOAD / SLOTS)))
        self.table = np.zeros((self.rows, SLOTS), dtype=np.uint16)
        self._victim = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        # The last bytes: the first ones choose the bucket of the index and are alike within it.
        mark = int.from_bytes(digest[-2:], "little") or 1
        first = int.from_bytes(digest[-8:-2], "little") & (self.rows - 1)
        return mark, first, self._other(first, mark)

    def _other(self, row: int, mark: int) -> int:
        return row ^ ((mark * 0x5BD1E995) & (self.rows - 1))

    def __contains__(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        return mark in self.table[first] or mark in self.table[second]

    def _put(self, row: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[row] == 0)
        if free.size:
            self.table[row, free[0]] = mark
        return bool(free.size)

    def insert(self, digest: bytes) -> bool:
        """False when no place was found; the filter must then be rebuilt, because one fingerprint was put out."""
        mark, first, second = self._places(digest)
        if self._put(first, mark) or self._put(second, mark):
            return True
        row = second
        for _ in range(MAX_KICKS):
            self._victim = (self._victim + 1) % SLOTS
            out = int(self.table[row, self._victim])
            self.table[row, self._victim] = mark
            mark, row = out, self._other(row, out)
            if self._put(row, mark):
                return True
        return False

    def delete(self, digest: bytes) -> None:
        """Take out one fingerprint of a digest that was inserted."""
        mark, first, second = self._places(digest)
        for row in (first, second):
            held = np.flatnonzero(self.table[row] == mark)
            if held.size:
                self.table[row, held[0]] = 0
                return
        raise KeyError(digest.hex())


class LiveDigests:
    """One bucket of the index: the filter in front of the stored digests and their number of copies."""

    def __init__(self, capacity: int = 64) -> None:
        self.filter = CuckooFilter(capacity)
        self.copies: dict[bytes, int] = {}

    def holds(self, digest: bytes) -> bool:
        """Filter first; only a hit looks into the store, which settles false positives."""
        return digest in self.filter and digest in self.copies

    def insert(self, digest: bytes, copies: int = 1) -> bool:
        """Add copies of a digest; True when it was not live before."""
        if self.holds(digest):
            self.copies[digest] += copies
            return False
        self.copies[digest] = copies
        if not self.filter.insert(digest):
            self._resize()
        return True

    def delete(self, digest: bytes, copies: int = 1) -> bool:
        """Remove copies of a digest; True when none is left and it no longer lives. Unknown digests are ignored."""
        if not self.holds(digest):
            return False
        self.copies[digest] -= copies
        if self.copies[digest] > 0:
            return False
        del self.copies[digest]
        self.filter.delete(digest)
        return True

    def _resize(self) -> None:
        rows = self.filter.rows
        placed = False
        while not placed:
            rows *= 2
            self.filter = CuckooFilter(int(rows * SLOTS * LOAD))
            placed = all(self.filter.insert(d) for d in self.copies)

    def row(self, bucket: int) -> pd.DataFrame:
        counts = np.fromiter(self.copies.values(), dtype=np.int64, count=len(self.copies))
        return pd.DataFrame(
            {"bucket": [bucket], "filter": [self.filter.table.tobytes()], "digests": [b"".join(self.copies)], "copies": [counts.tobytes()]}
        )

    @classmethod
    def of_row(cls, row: pd.Series) -> LiveDigests:
        out = cls()
        out.filter.table = np.frombuffer(row["filter"], dtype=np.uint16).reshape(-1, SLOTS).copy()
        out.filter.rows = len(out.filter.table)
        counts = np.frombuffer(row["copies"], dtype=np.int64).tolist()
        out.copies = {bytes(row["digests"][32 * i : 32 * i + 32]): n for i, n in enumerate(counts)}
        return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the SHA-256 of the whole text; a null text counts as empty."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def bucket_count(rows: int, per_bucket: int = DIGESTS_PER_BUCKET) -> int:
    return max(8, math.ceil(rows / per_bucket))


def _bucket(buckets: int):
    """Bucket by the first 60 bits of the digest, alike for every caller with the same number of buckets."""
    return F.pmod(F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket")


def _groups_of_bucket(part: pd.DataFrame) -> pd.DataFrame:
    """Partial groups of one bucket, largest id first, through the filter; one row per live digest."""
    live = LiveDigests(min(len(part), 1024))
    part = part.sort_values(["last_id", "text_sha256"], ascending=[False, True])
    keep: dict[bytes, int] = {}
    for text_sha256, last_id, n in zip(part["text_sha256"], part["last_id"], part["n"]):
        digest = bytes.fromhex(text_sha256)
        if live.insert(digest, int(n)):
            keep[digest] = last_id
    return pd.DataFrame(
        {
            "text_sha256": [d.hex() for d in live.copies],
            "keep_id": [keep[d] for d in live.copies],
            "group_size": list(live.copies.values()),
        }
    )


def groups(marked: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest of ``digests``: ``keep_id`` (largest id) and ``group_size``.

    Rows are counted per digest and salt before they move to their bucket, so a group of any size reaches it as
    at most ``SALTS`` rows.
    """
    salted = marked.groupBy("text_sha256", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(
        F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("last_id"), F.count(F.lit(1)).alias("n")
    )
    return (
        salted.select(_bucket(buckets), "text_sha256", "last_id", "n")
        .groupBy("bucket")
        .applyInPandas(lambda part: _groups_of_bucket(part), GROUP_SCHEMA)
        .withColumn("keep_id", F.nullif("keep_id", F.lit(NO_ID)))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty, and an empty text is a text like any other. The
    largest id of a group stays; a null id is smaller than any other and stays only among null ids. Rows that
    repeat id and text are rows of one document: all carry the same mark and each counts in ``group_size``. An
    empty table gives no rows; further columns play no part.
    """
    marked = digests(docs, id_col, text_col)
    found = groups(marked, bucket_count(docs.count()))
    # Sizes are unknown to the planner here; adaptive execution splits the partition of a hot digest.
    return marked.join(found, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per distinct text, with all columns: largest id, of rows that repeat the id the first by its JSON."""
    marks = exact_dedup(docs, id_col, text_col).withColumnRenamed("text_sha256", "text_key")
    digest = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    return rows_of(docs, marks.filter("kept"), marks, digest, id_col)


def build_index(marked: DataFrame, buckets: int) -> DataFrame:
    """The index as a table of one row per bucket; ``marked`` comes from ``digests``."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        live = LiveDigests(len(part))
        for text_sha256, n in zip(part["text_sha256"], part["n"]):
            live.insert(bytes.fromhex(text_sha256), int(n))
        return live.row(int(part["bucket"].iloc[0]))

    return _counted(marked, buckets).groupBy("bucket").applyInPandas(build, INDEX_SCHEMA)


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame, buckets: int) -> DataFrame:
    """The index after ``removed`` and then ``added`` digests; ``buckets`` is that of the build."""
    change = _counted(added, buckets).unionByName(_counted(removed, buckets).withColumn("n", -F.col("n")))

    def update(stored: pd.DataFrame, changed: pd.DataFrame) -> pd.DataFrame:
        live = LiveDigests.of_row(stored.iloc[0]) if len(stored) else LiveDigests()
        for text_sha256, n in zip(changed["text_sha256"], changed["n"]):
            if n < 0:
                live.delete(bytes.fromhex(text_sha256), -int(n))
        for text_sha256, n in zip(changed["text_sha256"], changed["n"]):
            if n > 0:
                live.insert(bytes.fromhex(text_sha256), int(n))
        return live.row(int((stored if len(stored) else changed)["bucket"].iloc[0]))

    return index.groupBy("bucket").cogroup(change.groupBy("bucket")).applyInPandas(update, INDEX_SCHEMA)


def probe_index(index: DataFrame, marked: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests of ``marked`` with ``live``: whether the index holds them."""

    def probe(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        live = LiveDigests.of_row(stored.iloc[0]) if len(stored) else LiveDigests()
        return pd.DataFrame({"text_sha256": asked["text_sha256"], "live": [live.holds(bytes.fromhex(d)) for d in asked["text_sha256"]]})

    return index.groupBy("bucket").cogroup(_counted(marked, buckets).groupBy("bucket")).applyInPandas(probe, "text_sha256 string, live boolean")


def _counted(marked: DataFrame, buckets: int) -> DataFrame:
    return marked.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).select(_bucket(buckets), "text_sha256", "n")
