"""Token ids as sorted Parquet shards with a manifest.

    <path>/data       shard, doc_id, offset (ids before the document in its shard), n_tokens, ids
    <path>/manifest   shard, documents, tokens, first_doc, last_doc, start (ids before the shard)

Documents lie in ascending order of their id, over the shards and within each. ``doc_id``, ``offset`` and
``n_tokens`` are delta-encoded, ``ids`` dictionary-encoded; row groups and pages are of bounded size and carry page
indexes, so that a reader of one range of documents, or of the counts alone, touches only those pages. The
manifest is written last: data without one is an unfinished write.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm import chunks
from tapewright.llm.bpe import encode_words, gather
from tapewright.llm.columns import id_and_text

TEXT_BYTES_PER_SHARD = 32_000_000
BLOCK_BYTES = 8_000_000
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 * 1024 * 1024),
    "parquet.page.size": str(256 * 1024),
    "parquet.page.row.count.limit": "2000",
    # Without a dictionary, the second version of the format delta-encodes integers.
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}
_DATA = "shard int, doc_id long, offset long, n_tokens long, ids array<int>"


def encode_batches(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of one shard in the order in which they come; every distinct word of a block is encoded once."""
    task = TaskContext.get()
    shard, offset = task.partitionId() if task else 0, 0
    for rows in chunks.blocks(batches, size=BLOCK_BYTES):
        words, codes, ends = chunks.factorize(rows.column("text"))
        sizes, ids = encode_words(words, tokenizer_path)
        if end_id is not None:
            # The end of a document is one more word, after all others.
            codes = np.insert(codes, ends, len(words))
            ends = ends + np.arange(1, len(ends) + 1)
            sizes, ids = np.append(sizes, 1), np.append(ids, end_id)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        n = sizes[codes].astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], ends))]
        step = 512
        for first in range(0, len(rows), step):
            last = min(first + step, len(rows))
            at = slice(ends[first - 1] if first else 0, ends[last - 1])
            own = bounds[first : last + 1] - bounds[first]
            flat = ids[gather(starts[codes[at]], n[at])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(last - first, shard, dtype=np.int32)),
                    rows.column("doc_id").slice(first, last - first).combine_chunks(),
                    pa.array(offset + bounds[first:last]),
                    pa.array(np.diff(own)),
                    pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(flat)),
                ],
                ["shard", "doc_id", "offset", "n_tokens", "ids"],
            )
        offset += int(bounds[-1])


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text",
    layout: dict[str, str] = LAYOUT,
) -> None:
    """Encode the texts of ``docs`` and write them below ``path``, which must be a folder all machines reach.

    Null ids come first, rows that share an id are ordered by a hash of their text. A null or empty text has the
    end id alone (nothing, with ``end_id`` None). An empty table writes an empty manifest.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, math.ceil(size / TEXT_BYTES_PER_SHARD))
    ordered = texts.repartitionByRange(shards, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key").drop("text_key")
    encoded = ordered.mapInArrow(lambda batches: encode_batches(batches, tokenizer_path, end_id), _DATA)
    spark = docs.sparkSession
    encoded.write.options(**layout).parquet(f"{path}/data")
    counted = (
        spark.read.schema(_DATA).parquet(f"{path}/data").groupBy("shard")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    )
    # One row a shard.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted.withColumn("start", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids, a row per document of the manifest's shards.

    Filters on ``doc_id`` reach the page indexes. Null ids stay null and start first; repeated rows each have a row;
    an empty archive gives none. Without a manifest, the last file of a write, reading fails.
    """
    shards = spark.read.parquet(f"{path}/manifest").select("shard", F.col("start").alias("shard_start"))
    data = spark.read.schema(_DATA).parquet(f"{path}/data")
    return data.join(shards, "shard").select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``, the checksum of the ids as little-endian unsigned 32-bit integers."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.flatten().to_numpy().astype("<u4"), np.cumsum(ids.value_lengths().to_numpy())
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(np.concatenate(([0], ends[:-1])), ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(of_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
