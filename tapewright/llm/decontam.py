"""Benchmark decontamination: rare word n-grams seed candidate passages, Smith-Waterman alignment scores them.

Words are runs without white space of any kind (Unicode's), lower-cased, letters and digits only; a character of a
script that is written without spaces is a word of its own. Items and documents are split by one function. Test items longer than a segment are
cut into overlapping segments. The n-grams of a segment are ranked by the number of documents of the whole corpus
that hold them and the most common quarter is no seed, so that everyday phrases do not start alignments; the rank
is within the segment, so a passage that leaked into thousands of documents keeps its seeds. A segment of one or two
words is its own seed and must be found whole.

The corpus is read twice, for the document counts and for the windows around seeds. A task knows the seeds by a
bitset of fixed size only; the exact match is a join, whatever the size of the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm import chunks
from tapewright.llm.columns import id_and_text, same_row, whole_rows
from tapewright.session import arrow_rows, materialize

SEED_WORDS = 3
RARE_SHARE = 0.75
SEGMENT_WORDS = 128
SEGMENT_STEP = 64
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
# Words of a window to either side of a stretch with seeds, as a multiple of the longest segment.
SLACK = 1.25
FILTER_BITS = 22
# Two workers of an executor hold a block each beside the JVM: text in a block, windows in a batch, rows in a batch from Spark.
BLOCK_BYTES = 2_000_000
WINDOW_ROWS = 512
ARROW_ROWS = 1000

_NOT_WORD = re.compile(r"[\W_]+")
# Scripts written without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Balinese, Javanese, Cham, kana, bopomofo, Han, Yi.
_UNSPACED = (
    "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u19e0-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3021-\u3029\u3031-\u3035"
    "\u3038-\u303c\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\ua980-\ua9ff\uaa00-\uaadf\uf900-\ufaff\uff66-\uff9f"
    "\U0001aff0-\U0001b16f\U00020000-\U0003ffff"
)
_PARTS = re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+")
# Odd 64-bit multipliers.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def word_hashes(run: str) -> list[int]:
    """Hashes of the normalized words of a run without white space: one as a rule, none if nothing is left of it."""
    plain = run.lower() if run.isalnum() else _NOT_WORD.sub("", run.lower())
    parts = [plain] if plain.isascii() else _PARTS.findall(plain)
    return [xxhash.xxh64_intdigest(p) | 1 for p in parts if p]


def _runs_words(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of all runs in a row and the number of words of each; runs of ASCII alone are normalized as a column."""
    ascii_only = pc.string_is_ascii(runs)
    plain = pc.ascii_lower(runs.filter(ascii_only))
    odd = pc.invert(pc.ascii_is_alnum(plain))
    plain = pc.replace_with_mask(plain, odd, pc.replace_substring_regex(plain.filter(odd), "[^a-z0-9]+", ""))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, plain.to_numpy(zero_copy_only=False)), np.uint64, len(plain)) | np.uint64(1)
    real = pc.not_equal(plain, "").to_numpy(zero_copy_only=False)
    found = [word_hashes(r) for r in runs.filter(pc.invert(ascii_only)).to_pylist()]
    others = np.array([len(f) for f in found], dtype=np.int64)
    of_ascii = ascii_only.to_numpy(zero_copy_only=False)
    sizes = np.zeros(len(runs), dtype=np.int64)
    sizes[of_ascii], sizes[~of_ascii] = real, others
    is_ascii = np.repeat(of_ascii, sizes)
    flat = np.empty(len(is_ascii), dtype=np.uint64)
    flat[is_ascii], flat[~is_ascii] = hashes[real], np.array([h for f in found for h in f], dtype=np.uint64)
    return flat, sizes


def seed_hashes(words: np.ndarray, size: int = SEED_WORDS) -> np.ndarray:
    """Hash of the n-gram of ``size`` words that starts at each word but the last ones; ``words`` are hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, SEED_WORDS - size, dtype=np.uint64)
    for k in range(size):
        out += words[k : k + n] * _MIX[k]
    out ^= out >> np.uint64(29)
    out *= _MIX[3]
    return out ^ (out >> np.uint64(32))


def texts_words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row and the end of each text."""
    runs, codes, ends = chunks.factorize(texts, pc.utf8_split_whitespace)
    flat, sizes = _runs_words(runs)
    if sizes.max(initial=0) <= 1:
        of_run = np.zeros(len(runs), dtype=np.uint64)
        of_run[sizes == 1] = flat
        of_run = of_run[codes]
        real = of_run != 0
        return of_run[real], np.concatenate(([0], np.cumsum(real, dtype=np.int64)))[ends]
    counts = sizes[codes]
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    # The place of a word among those of its run, from where the run's words begin.
    begins = np.cumsum(sizes) - sizes
    return flat[np.repeat(begins[codes] - total[:-1], counts) + np.arange(total[-1])], total[ends]


def text_words(text: str | None) -> np.ndarray:
    return texts_words(pa.chunked_array([pa.array([text or ""])]))[0]


def segments(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, segment, words (hashes) of every item; an item without words has no segment."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["doc_id"], batch["text"]):
                words = text_words(text).view(np.int64)
                last = max(0, len(words) - SEGMENT_WORDS + SEGMENT_STEP - 1) // SEGMENT_STEP
                rows += [(item, k, words[k * SEGMENT_STEP : k * SEGMENT_STEP + SEGMENT_WORDS]) for k in range(last + 1) if len(words)]
            yield pd.DataFrame(rows, columns=["item_id", "segment", "words"])

    # An item without an id cannot be named in a result.
    items = id_and_text(benchmark, id_col, text_col).filter("doc_id is not null")
    return items.mapInPandas(cut, "item_id long, segment int, words array<long>").distinct()


def _seeds_of(cut: DataFrame) -> DataFrame:
    """seed, item_id, segment for the distinct n-grams of each segment."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [np.asarray(w, dtype=np.int64).view(np.uint64) for w in batch["words"]]
            found = [np.unique(seed_hashes(w, min(SEED_WORDS, len(w)))).view(np.int64) for w in words]
            sizes = [len(f) for f in found]
            yield pd.DataFrame(
                {
                    "seed": np.concatenate(found) if found else np.empty(0, np.int64),
                    "item_id": np.repeat(batch["item_id"].to_numpy(), sizes),
                    "segment": np.repeat(batch["segment"].to_numpy(), sizes),
                }
            )

    return cut.mapInPandas(grams, "seed long, item_id long, segment int")


def _bitset(seeds: DataFrame) -> bytes:
    """Packed bits, one per possible value of the top bits of a seed: of the same size for any benchmark."""
    top = seeds.select(F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("top")).distinct().toArrow()
    bits = np.zeros(1 << FILTER_BITS, dtype=np.uint8)
    bits[top.column("top").to_numpy()] = 1
    return np.packbits(bits).tobytes()


def _seed_sizes(cut: DataFrame) -> list[int]:
    """Numbers of words that the seeds of the segments have."""
    return sorted(r[0] for r in cut.select(F.least(F.size("words"), F.lit(SEED_WORDS))).distinct().collect())  # three at most


def _hits(batches: Iterator[pa.RecordBatch], packed: bytes, sizes: list[int]):
    """Blocks as (rows, word hashes, ends of texts, text of each hit, place of each hit, seed of each hit), by place."""
    bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
    for rows in chunks.blocks(batches, size=BLOCK_BYTES):
        hashes, ends = texts_words(rows.column("text"))
        hits = []
        for size in sizes:
            seeds = seed_hashes(hashes, size)
            places = np.flatnonzero(bits[(seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            of_text = np.searchsorted(ends, places, side="right")
            inside = places + size <= ends[of_text] if len(places) else np.empty(0, bool)
            places, of_text = places[inside], of_text[inside]
            hits.append((of_text, places, seeds[places].view(np.int64)))
        if len(hits) == 1:
            yield rows, hashes, ends, *hits[0]
        elif hits:
            of_text, places, seeds = (np.concatenate(x) for x in zip(*hits))
            order = np.argsort(places, kind="stable")
            yield rows, hashes, ends, of_text[order], places[order], seeds[order]


def document_counts(texts: DataFrame, packed: bytes, sizes: list[int]) -> DataFrame:
    """seed and the number of documents with it, for all n-grams that pass the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, of_text, _, seeds in _hits(batches, packed, sizes):
            once = np.unique(np.stack([of_text, seeds], axis=1), axis=0) if len(seeds) else np.empty((0, 2), np.int64)
            found, n = np.unique(once[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["seed", "n"])

    return texts.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def rare_seeds(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """The seeds of each segment without the most common ones."""
    own = Window.partitionBy("item_id", "segment")
    return (
        seeds.join(counts, "seed", "left")
        .withColumn("nth", F.row_number().over(own.orderBy(F.coalesce("n", F.lit(0)), "seed")))
        .withColumn("of", F.count(F.lit(1)).over(own))
        .filter(F.col("nth") <= F.ceil(F.col("of") * RARE_SHARE))
        .select("seed", "item_id", "segment")
    )


def _windows_of(batches: Iterator[pa.RecordBatch], packed: bytes, reach: int, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    for rows, hashes, ends, of_text, places, seeds in _hits(batches, packed, sizes):
        begins = np.concatenate(([0], ends[:-1]))
        tile = (places - begins[of_text]) // reach
        first = np.flatnonzero(np.concatenate(([True], (of_text[1:] != of_text[:-1]) | (tile[1:] != tile[:-1])))) if len(places) else np.empty(0, int)
        last = np.append(first[1:], len(places))
        # A few hundred windows at a time bound the size of a batch.
        for part in range(0, len(first), WINDOW_ROWS):
            f, e = first[part : part + WINDOW_ROWS], last[part : part + WINDOW_ROWS]
            texts_of, tiles = of_text[f], tile[f]
            low = np.maximum(0, (tiles - 1) * reach)
            high = np.minimum((tiles + 2) * reach, (ends - begins)[texts_of])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").combine_chunks().take(pa.array(texts_of)),
                    rows.column("text_key").combine_chunks().take(pa.array(texts_of)),
                    pa.array(low),
                    pa.array([hashes[b + x : b + y].tobytes() for b, x, y in zip(begins[texts_of], low, high)], pa.binary()),
                    pa.array([np.unique(seeds[x:y]) for x, y in zip(f, e)], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "start", "words", "seeds"],
            )


def windows(texts: DataFrame, packed: bytes, reach: int, sizes: list[int]) -> DataFrame:
    """Stretches of ``reach`` words that hold seeds, with ``reach`` words more on either side.

    doc_id, text_key, start (first word of the window), words, seeds (distinct).
    """
    return texts.mapInArrow(
        lambda batches: _windows_of(batches, packed, reach, sizes), "doc_id long, text_key long, start long, words binary, seeds array<long>"
    )


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each pair of rows and the place in the passage where it ends (exclusive).

    Rows are padded with 0, which matches nothing. The left neighbour of a cell is a running maximum, so only the
    item's words are looped over.
    """
    n, width = passages.shape
    drift = np.arange(width, dtype=np.int32) * -GAP
    above = np.zeros((n, width), dtype=np.int32)
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    every = np.arange(n)
    for k in range(items.shape[1]):
        word = items[:, k : k + 1]
        row = np.where((passages == word) & (word != 0), np.int32(MATCH), np.int32(MISMATCH))
        row[:, 1:] += above[:, :-1]
        np.maximum(row, above + GAP, out=row)
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row + drift, axis=1) - drift
        at = above.argmax(axis=1)
        top = above[every, at]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
    return best, end


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(len(r) for r in rows)), dtype=np.uint64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _score(batches: Iterator[pa.RecordBatch], min_score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            items = [np.array(x, dtype=np.int64).view(np.uint64) for x in part.column("item_words").to_pylist()]
            passages = [np.frombuffer(x, dtype=np.uint64) for x in part.column("words").to_pylist()]
            best, end = align(_padded(items), _padded(passages))
            lengths = np.array([len(x) for x in items])
            score = best / (MATCH * lengths)
            good = np.flatnonzero(score >= np.where(lengths < SEED_WORDS, 1.0, min_score))
            if not len(good):
                continue
            # The same alignment read backwards ends where it began.
            _, back = align(_padded([items[g][::-1] for g in good]), _padded([passages[g][: end[g]][::-1] for g in good]))
            start = part.column("start").to_numpy()[good]
            kept = part.take(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [kept.column("doc_id"), kept.column("text_key"), kept.column("item_id"), pa.array(score[good]), pa.array(start + end[good] - back), pa.array(start + end[good] - 1)],
                ["doc_id", "text_key", "item_id", "score", "first_word", "last_word"],
            )


def matches(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The leaks with ``text_key`` (hash of the text) beside the document's id; see ``leaks``."""
    texts = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    cut = materialize(segments(benchmark), "decontam-segments")
    longest = cut.agg(F.max(F.size("words"))).first()[0] or 1
    sizes = _seed_sizes(cut)
    seeds = materialize(_seeds_of(cut), "decontam-seeds")
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        rare = materialize(rare_seeds(seeds, document_counts(texts, _bitset(seeds), sizes)), "decontam-rare")
        found = materialize(windows(texts, _bitset(rare), int(longest * SLACK) + 1, sizes), "decontam-windows")
        place = ["doc_id", "text_key", "start"]
        pairs = (
            found.select(F.struct(*place).alias("place"), F.explode("seeds").alias("seed")).join(rare, "seed")
            .select("place", "item_id", "segment").distinct()
        )
        # Windows of repeated rows are alike; one of each is enough.
        passages = found.select(F.struct(*place).alias("place"), "words").groupBy("place").agg(F.first("words").alias("words"))
        candidates = (
            pairs.join(passages, "place").join(cut.withColumnRenamed("words", "item_words"), ["item_id", "segment"])
            .select("place.*", "item_id", "item_words", "words")
        )
        scored = candidates.mapInArrow(
            lambda batches: _score(batches, min_score), "doc_id long, text_key long, item_id long, score double, first_word long, last_word long"
        )
        scored = materialize(scored, "decontam-scored")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("back"), "last_word")).alias("best")
    return scored.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", "best.score", (-F.col("best.back")).alias("first_word"), "best.last_word"
    )


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, first_word, last_word.

    ``score`` is the alignment's share of what a perfect copy of the item (of its segment, if it has several) would
    reach, at least ``min_score``. Words are counted from 0 after dropping those without letter or digit; of equal
    scores the first place counts. An item of one or two words is found only where all of it stands. Null and
    empty texts match nothing, nor do items without words or without an id. Rows that repeat id and text give one row. A document without an id has null there. An empty
    table on either side gives no rows; further columns play no part.
    """
    return matches(docs, benchmark, min_score).drop("text_key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no test item was found; see ``leaks``.

    Null and empty texts stay. Of rows that share an id only those with a leaking text go, and rows that repeat both go
    or stay together; a null id is an id like others here. An empty table gives no rows, an empty benchmark leaves all.
    """
    found = matches(docs, benchmark, min_score).select("doc_id", "text_key").distinct().alias("leak")
    whole = whole_rows(docs, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))).alias("whole")
    return whole.join(found, same_row("whole", "leak"), "left_anti").select("row.*")
