"""Text quality by a naive Bayes support vector machine.

A text is the set of its n-grams: characters within words, with the words' edges, and words of a stretch as one of
``MARKS``, how far back the same word stood, so that repetition shows whatever is repeated. Each n-gram is an indicator, hashed
into ``BUCKETS``. The log-count ratio of an indicator tells how much likelier it is in a text of label 1; the indicators
scaled by it are the features of a linear machine with hinge loss, fitted by dual coordinate descent. Both are fitted on
a sample of bounded size. A logistic curve over the machine's values on the sample gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm import chunks
from tapewright.llm.columns import id_and_text, sample_per_label
from tapewright.session import materialize

BUCKETS = 1 << 18
LONGEST = 3  # characters of an n-gram
MARKS = 16
MARK_WORDS = 3  # marks of an n-gram of words
SMOOTHING = 1.0
COST = 1.0
PASSES = 30
# Log-count ratios and machine learn from about this many texts of each label.
TRAIN_PER_LABEL = 4_000
BLOCK_BYTES = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * _MIX
    x ^= x >> np.uint64(32)
    return ((x * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of the distinct words and the end of each word's."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    framed = "".join(f"\x01{w}\x01" for w in words.to_pylist())
    points = np.frombuffer(framed.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(sizes)), sizes)
    code, found, owner = np.zeros(len(points), np.uint64), [], []
    for n in range(1, LONGEST + 1):
        code = (code[: len(points) - n + 1] << np.uint64(21)) | points[n - 1 :]
        inside = word[: len(code)] == word[n - 1 :] if len(code) else np.empty(0, bool)
        found.append(_bucket(code[inside] * np.uint64(4) + np.uint64(n)))
        owner.append(word[: len(code)][inside])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(ends)), side="right")


def _mark_grams(codes: np.ndarray) -> np.ndarray:
    """Buckets of n-grams of marks: how many words back, up to ``MARKS``, each word of a text last stood (0: longer ago)."""
    order = np.argsort(codes, kind="stable")
    back = np.zeros(len(codes), np.int64)
    gap = np.diff(order)
    again = codes[order[1:]] == codes[order[:-1]]
    back[order[1:][again]] = gap[again]
    marks = np.where(back <= MARKS, back, 0).astype(np.uint64)
    out, code = [], np.zeros(len(marks), np.uint64)
    for n in range(1, MARK_WORDS + 1):
        code = (code[: max(0, len(marks) - n + 1)] << np.uint64(8)) | marks[n - 1 :]
        out.append(_bucket((code << np.uint64(3)) + np.uint64((1 << 62) + n)))
    return np.concatenate(out)


def indicators(texts: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Per text the different buckets of its n-grams, in no order."""
    words, codes, ends = chunks.factorize(texts)
    grams, gram_ends = _word_grams(words)
    gram_starts = np.concatenate(([0], gram_ends[:-1]))
    last = np.zeros(BUCKETS, np.int32)
    begin = 0
    for end in ends.tolist():
        own = codes[begin:end]
        begin = end
        different = np.unique(own)
        starts, sizes = gram_starts[different], (gram_ends - gram_starts)[different]
        stops = np.cumsum(sizes)
        at = np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)
        every = np.concatenate([grams[at], _mark_grams(own)])
        # The last of equal buckets stays.
        numbers = np.arange(len(every), dtype=np.int32)
        last[every] = numbers
        yield every[last[every] == numbers]


class Machine(NamedTuple):
    """Weight per bucket, bias, and slope and offset of the curve from a value to a score."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def values(self, texts: pa.ChunkedArray) -> np.ndarray:
        return np.array([float(self.weights[own].sum()) for own in indicators(texts)], dtype=np.float64) + self.bias

    def scores(self, texts: pa.ChunkedArray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.values(texts) + self.offset, -30, 30)))


def log_count_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """``counts`` has a row per label (0, 1): texts with each indicator."""
    shares = counts + smoothing
    shares = shares / shares.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights, the last one the bias, that minimize half their square plus the summed hinge losses times ``cost``.

    A row is (columns, values); each has a constant 1 as well. Texts are taken in an order drawn anew for each pass;
    passes end when no multiplier of a text could move by more than a thousandth.
    """
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    draw = np.random.default_rng(0)
    for _ in range(passes):
        most = 0.0
        for k in draw.permutation(len(rows)):
            columns, values = rows[k]
            gradient = y[k] * (w[columns] @ values + w[-1]) - 1.0
            after = min(max(alpha[k] - gradient / square[k], 0.0), cost[k])
            change = after - alpha[k]
            if change:
                w[columns] += (change * y[k]) * values
                w[-1] += change * y[k]
                alpha[k] = after
                most = max(most, abs(change) * square[k])
        if most < 1e-3:
            break
    return w


def _logistic(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve that fits best, by damped Newton steps; lightly held to zero."""
    x, weight = np.stack([value, np.ones(len(value))], axis=1), weight / weight.sum()
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + 1e-3 * np.eye(2), x.T @ (weight * (p - y)) + 1e-3 * w)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return float(w[0]), float(w[1])


def _labelled(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id and label (0 or 1) of the ids to learn from; of several labels of a document the largest counts."""
    named = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    named = named.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn)
    return named.groupBy("doc_id").agg(F.max(F.when(F.col("label") >= 1, 1).otherwise(0)).alias("label"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in chunks.blocks(batches, size=BLOCK_BYTES):
        label = rows.column("label").to_numpy()
        counts = np.zeros((2, BUCKETS), np.int64)
        for k, own in zip(label, indicators(rows.column("text"))):
            counts[k][own] += 1
        for k in (0, 1):
            held = np.flatnonzero(counts[k])
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), k, np.int32)), pa.array(held.astype(np.int32)), pa.array(counts[k][held])], ["label", "bucket", "n"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in chunks.blocks(batches, size=BLOCK_BYTES):
        found = [np.sort(own).tobytes() for own in indicators(rows.column("text"))]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), rows.column("label").combine_chunks(), pa.array(found, pa.binary())], ["doc_id", "label", "buckets"])


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_label: int = TRAIN_PER_LABEL) -> Machine | None:
    """A machine from the labelled documents for which ``learn``, a condition on doc_id, holds; None unless both labels occur.

    About ``per_label`` documents of each label take part. What is gathered is bounded: a count per label and bucket, and
    the buckets of these texts. The sample is drawn from the labels alone, so that no text but its own is moved.
    """
    marked = _labelled(labels, label, learn)
    chosen = sample_per_label(marked, "label", per_label).withColumnRenamed("doc_id", "l_id")
    texts = id_and_text(docs)
    # About 2 * per_label rows of two numbers, whatever the number of labels.
    known = materialize(texts.join(F.broadcast(chosen), texts["doc_id"] == F.col("l_id")).select("doc_id", "text", "label"), "quality-sample")
    counted = known.mapInArrow(_counted, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, BUCKETS))
    counts[counted.column("label").to_numpy(), counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    sample = known.mapInArrow(_rows, "doc_id long, label int, buckets binary").toArrow().sort_by([("doc_id", "ascending"), ("buckets", "ascending")])
    y = np.where(sample.column("label").to_numpy() == 1, 1.0, -1.0)
    if len(set(y)) < 2:
        return None
    ratios = log_count_ratios(counts)
    rows = []
    for held in sample.column("buckets"):
        columns = np.frombuffer(held.as_py(), dtype=np.int32)
        rows.append((columns, ratios[columns]))
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    w = dual_coordinate_descent(rows, y, BUCKETS, COST * 0.5 / share)
    weights = (w[:-1] * ratios).astype(np.float32)
    values = np.array([float(weights[c].sum()) + w[-1] for c, _ in rows])
    # A row of the sample stands for as many texts as its label has for each one sampled.
    every = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = np.where(y > 0, every[1] / (y > 0).sum(), every[0] / (y < 0).sum())
    return Machine(weights, float(w[-1]), *_logistic(values, (y > 0).astype(float), each))


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row of ``docs``; without a machine every score is 0.5.

    A null text counts as empty, and an empty one has no n-grams: its score is that of the machine's bias. Repeated
    rows and null ids each get their row; an empty table gives none; further columns play no part.
    """
    texts = id_and_text(docs, id_col, text_col)
    if machine is None:
        return texts.select("doc_id", F.lit(0.5).alias("score"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks.blocks(batches, size=BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(machine.scores(rows.column("text")))], ["doc_id", "score"])

    return texts.mapInArrow(of_batches, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is at least 0.5); ``held_out`` is a condition on doc_id."""
    scored = score(docs, train(docs, labels, "quality", ~held_out, per_label))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
