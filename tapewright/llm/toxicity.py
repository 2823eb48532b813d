"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums, over all character subsequences of length four, the product of their weights in
both; a subsequence weighs ``DECAY`` to the power of the stretch it spans, gaps included, so inserted and spaced
characters cost similarity without hiding a word. The two ends of a word count as characters. Nystroem features of a word are its kernel values with a set
of landmark words, whitened by the landmarks' own kernel matrix. The machine is trained on the words of labelled
sentences: words that mark toxic texts against words of clean ones, then once more with the clean words it took
for toxic. A text scores by its strongest words, calibrated on the labelled texts.

The trained machine is linear in subsequences. It is therefore kept as one weight per subsequence, which gives the
same values as kernel evaluations against every landmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import chunks
from tapewright.llm.columns import held_out, id_and_text, sample_per_label
from tapewright.session import materialize

LENGTH = 4
DECAY = 0.6
SPAN = 7  # longest stretch of a subsequence
SYMBOLS = 40
START, STOP = SYMBOLS - 2, SYMBOLS - 1
SHORTEST = 3  # letters of a word that can be toxic
LANDMARKS = 128
# Words that the landmarks of a class are picked from.
CANDIDATES = 400
# Words longer than a window are scored by overlapping windows.
WINDOW = 24
# Bounds of what the model learns from: documents of each label, words of each class.
TRAIN_PER_LABEL = 6_000
TRAIN_WORDS = 12_000
# A word marks toxic texts if it comes in this many times more contexts there, with at least this z-score, and at
# least this share of the z-score of the strongest word.
MARKING_RATIO, MARKING_Z, MARKING_SHARE = 10, 5.0, 0.15
INSERTED = "xa1"
COST = 10.0
STRONGEST = 3
EVIDENCE = 5
# What a task holds at once: bytes of text, words as symbols.
BLOCK_BYTES = 8_000_000
WORDS_AT_ONCE = 32_768
SPACED = 4  # single letters in a row that are read as one word

# Letters of a piece of a word that the machine learns from: with one inserted and both ends it fills a window.
PIECE = WINDOW - 3
# So many of the strongest words are learned from where the sample is too small for any word to stand out.
FEWEST_MARKING = 20

_NOT_LETTER = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    """Lower-cased letters and digits of a word."""
    return word.lower() if word.isalnum() else _NOT_LETTER.sub("", word.lower())


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the words as rows of symbols (0 pads), and the word of each window. Words that are too short have none."""
    pieces, owner = [], []
    for k, word in enumerate(words):
        if len(word) >= SHORTEST:
            framed = f"\x01{word}\x02"
            for start in range(0, max(1, len(framed) - WINDOW // 2), WINDOW // 2):
                pieces.append(framed[start : start + WINDOW])
                owner.append(k)
    points = np.zeros((len(pieces), WINDOW), dtype=np.int32)
    if pieces:
        sizes = np.array([len(p) for p in pieces])
        points[np.arange(WINDOW) < sizes[:, None]] = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4")
    # a-z and the two ends have symbols of their own, all other characters share the rest.
    letter = (points >= ord("a")) & (points <= ord("z"))
    symbols = np.where(letter, points - ord("a") + 1, 27 + points % (START - 27))
    for point, symbol in ((0, 0), (1, START), (2, STOP)):
        symbols[points == point] = symbol
    return symbols, np.array(owner, dtype=np.int64)


def pieces(word: str) -> list[str]:
    """The word, or overlapping pieces of a longer one that together hold all of it; the scorer's windows overlap alike."""
    if len(word) <= PIECE:
        return [word]
    return [word[start : start + PIECE] for start in range(0, len(word) - PIECE + WINDOW // 2, WINDOW // 2)]


_STEPS = [(i, j, k) for k in range(3, SPAN) for j in range(2, k) for i in range(1, j)]


def _subsequences(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """Number of rows, their subsequence codes and weight for every choice of four places.

    Rows must be sorted by length, longest first: a choice holds for the first rows.
    """
    lengths = -(symbols > 0).sum(axis=1)
    for start in range(WINDOW - LENGTH + 1):
        for i, j, k in _STEPS:
            n = int(np.searchsorted(lengths, -(start + k + 1), side="right"))
            if start + k < WINDOW and n:
                a, b, c, d = (symbols[:n, start + step] for step in (0, i, j, k))
                yield n, ((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d, DECAY ** (k + 1)


def _norms() -> np.ndarray:
    """By length of a window: the norm it would have if its subsequences were all different, 1 where it has none."""
    squares = np.zeros(WINDOW + 1)
    for length in range(LENGTH, WINDOW + 1):
        squares[length] = sum(DECAY ** (2 * (steps[-1] + 1)) for start in range(length) for steps in _STEPS if start + steps[-1] < length)
    return np.sqrt(np.where(squares > 0, squares, 1.0))


_NORM = _norms()


def _sorted_windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows longest first, the word of each and its norm."""
    symbols, owner = _symbols(words)
    lengths = (symbols > 0).sum(axis=1)
    order = np.argsort(-lengths, kind="stable")
    return symbols[order], owner[order], _NORM[lengths[order]].astype(np.float32)


def _explicit(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the subsequences of each word, normalized, and their codes: the kernel is their product.

    Words are pieces, so each fills one window at most.
    """
    symbols, owner, norm = _sorted_windows(words)
    found = list(_subsequences(symbols))
    codes = np.unique(np.concatenate([c for _, c, _ in found])) if found else np.empty(0, np.int64)
    out = np.zeros((len(words), len(codes)), dtype=np.float32)
    for n, own, weight in found:
        np.add.at(out, (owner[:n], np.searchsorted(codes, own)), np.float32(weight))
    out[owner] /= norm[:, None]
    return out, codes


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    both = _explicit(a + b)[0]
    return both[: len(a)] @ both[len(a) :].T


def _spread_out(words: list[str], most: int) -> list[str]:
    """Up to ``most`` words, each the one that those before it span worst (pivoted Cholesky of the kernel matrix)."""
    known = _explicit(words)[0]
    left, picked, rows = (known**2).sum(axis=1).astype(np.float64), [], []
    while len(picked) < most and len(left) and left.max() > 1e-3:
        at = int(left.argmax())
        row = (known @ known[at]).astype(np.float64) - sum((r * r[at] for r in rows), np.zeros(len(words)))
        rows.append(row / np.sqrt(left[at]))
        left = np.maximum(left - rows[-1] ** 2, 0)
        left[at] = 0
        picked.append(words[at])
    return picked


class Machine(NamedTuple):
    """Weight per subsequence code, bias of a word, and the calibration of a text's evidence (see ``_evidence``)."""

    weights: np.ndarray
    bias: float
    calibration: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """Decision value per plain word, at least -1: positive is toxic. Words that are too short have -1."""
        out = np.full(len(words), -1.0)
        for first in range(0, len(words), WORDS_AT_ONCE):
            symbols, owner, norm = _sorted_windows(words[first : first + WORDS_AT_ONCE])
            sums = np.zeros(len(symbols), dtype=np.float32)
            for n, codes, weight in _subsequences(symbols):
                sums[:n] += np.float32(weight) * self.weights[codes]
            np.maximum.at(out, owner + first, sums / norm + self.bias)
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(evidence @ self.calibration[:-1] + self.calibration[-1], -30, 30)))


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    loss = lambda v: 0.5 * v @ ridge @ v + (cost * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    for _ in range(50):
        gap = 1 - y * (x @ w)
        on = gap > 0
        gradient = ridge @ w - 2 * x[on].T @ (cost[on] * y[on] * gap[on])
        step = np.linalg.solve(ridge + 2 * (x[on].T * cost[on]) @ x[on], gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a lightly regularized logistic regression, the constant last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-4 * w
        w = w - np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + 1e-4 * np.eye(len(w)), gradient)
    return w


def fit_words(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """Weight per subsequence and bias. The landmarks are half toxic, half clean, unlike each other."""
    marks = [m for words in (toxic, clean) for m in _spread_out(words[:: max(1, len(words) // CANDIDATES)][:CANDIDATES], landmarks // 2)]
    known, codes = _explicit(marks)
    values, vectors = np.linalg.eigh((known @ known.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    # Kernel values with the landmarks, whitened: a matrix from subsequences to features, its last row for all others.
    to_features = np.vstack([known.T @ (vectors[:, good] / np.sqrt(values[good])), np.zeros(int(good.sum()))]).astype(np.float32)
    at = np.full(SYMBOLS**LENGTH, len(codes), dtype=np.int32)
    at[codes] = np.arange(len(codes))
    symbols, owner, norm = _sorted_windows(toxic + clean)
    features = np.zeros((len(symbols), to_features.shape[1]), dtype=np.float32)
    for n, own, weight in _subsequences(symbols):
        features[:n] += np.float32(weight) * to_features[at[own]]
    y = np.where(owner < len(toxic), 1.0, -1.0)
    cost = np.where(y > 0, COST / max(1, (y > 0).sum()), COST / max(1, (y < 0).sum())) * 100
    w = _squared_hinge(features / norm[:, None], y, cost)
    weights = np.zeros(SYMBOLS**LENGTH, dtype=np.float32)
    weights[codes] = to_features[:-1] @ w[:-1]
    return weights, float(w[-1])


def _evidence(values: np.ndarray) -> tuple[float, ...]:
    """What the values of a text's distinct words say of it.

    The strongest, the mean of the strongest few and how many are toxic; the first and the last once more, weighed
    by the length of the text, as a long one holds words like toxic ones by chance. A text without toxic words has
    no part that depends on its length.
    """
    if not len(values):
        return -1.0, -1.0, 0.0, 0.0, 0.0
    top = np.partition(values, max(0, len(values) - STRONGEST))[-STRONGEST:]
    strongest, mean = float(top.max()), float((top.sum() - (STRONGEST - len(top))) / STRONGEST)
    many, length = float(np.log1p((values > 0).sum())), float(np.log1p(len(values)))
    return strongest, mean, many, max(strongest, 0.0) * length, many * length


def _texts(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of rows with the evidence of their texts. Letters written one by one count as a word as well."""
    for rows in chunks.blocks(batches, size=BLOCK_BYTES):
        words, codes, ends = chunks.factorize(rows.column("text"))
        strings = [plain(w) for w in words.to_pylist()]
        values = machine.words(strings)
        begins = np.concatenate(([0], ends[:-1]))
        single = np.array([len(s) == 1 for s in strings], dtype=bool)[codes]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], single, [False])).astype(np.int8)))
        spelled: dict[int, list[str]] = {}
        for begin, end in zip(edges[::2], edges[1::2]):
            if end - begin >= SPACED:
                for k in range(int(np.searchsorted(ends, begin, side="right")), int(np.searchsorted(ends, end, side="left")) + 1):
                    spelled.setdefault(k, []).append("".join(strings[c] for c in codes[max(begin, begins[k]) : min(end, ends[k])]))
        out = np.empty((len(rows), EVIDENCE))
        for k, (begin, end) in enumerate(zip(begins, ends)):
            own = values[np.unique(codes[begin:end])]
            if k in spelled:
                own = np.concatenate([own, machine.words([s for s in spelled[k] if len(s) >= SPACED])])
            out[k] = _evidence(own)
        yield rows, out


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, most_words: int = TRAIN_WORDS) -> Machine | None:
    """A machine from the labelled documents outside the held-out fold; None unless both labels occur.

    About ``per_label`` documents of each label and at most ``most_words`` words of each class take part. Documents with
    a null label are not labelled; of several labels of a document the largest counts.
    """
    marked = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max(F.when(F.col("toxic") >= 1, 1).otherwise(0)).alias("toxic"))
    )
    chosen = sample_per_label(marked, "toxic", per_label).withColumnRenamed("doc_id", "l_id")
    texts = id_and_text(docs)
    # About 2 * per_label rows of two numbers, whatever the number of labels.
    sample = materialize(texts.join(F.broadcast(chosen), texts["doc_id"] == F.col("l_id")).select("doc_id", "text", "toxic"), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_n, clean_n = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic_n or not clean_n:
        return None
    vocabulary = materialize(_contexts(sample), "toxic-words")
    in_toxic, in_clean = (F.least(F.col(c) / n, F.lit(1.0)) for c, n in (("toxic", toxic_n), ("clean", clean_n)))
    share = (in_toxic * toxic_n + in_clean * clean_n) / (toxic_n + clean_n)
    z = (in_toxic - in_clean) / F.sqrt(share * (1 - share) * (1 / toxic_n + 1 / clean_n) + 1e-12)
    rated = vocabulary.withColumn("z", F.when(in_toxic >= MARKING_RATIO * in_clean, z).otherwise(0.0))
    strongest = [(r["z"], r["word"]) for r in rated.filter("z > 0").orderBy(F.desc("z"), "word").limit(most_words).select("z", "word").collect()]
    least = max(MARKING_Z, MARKING_SHARE * strongest[0][0]) if strongest else 0
    marking = [w for score, w in strongest if score >= least] or [w for _, w in strongest[:FEWEST_MARKING]]
    ordinary = rated.filter("clean > 0 and z = 0")
    frequent = [r["word"] for r in ordinary.orderBy(F.desc("clean"), "word").limit(most_words // 2).collect()]
    spread = [r["word"] for r in ordinary.orderBy(F.xxhash64("word"), "word").limit(most_words // 2).collect()]
    clean = sorted(set(frequent + spread))
    if not marking or not clean:
        return None
    marking += [w[:at] + c + w[at:] for w in marking for c, at in zip(INSERTED, (len(w) // 3, len(w) // 2, 2 * len(w) // 3))]
    machine = Machine(*fit_words(marking, clean), np.zeros(EVIDENCE + 1))
    # Clean words that the first machine takes for toxic join the second training.
    hard = ordinary.select("word").mapInArrow(lambda batches: _word_values(batches, machine), "word string, value double")
    mistaken = [r["word"] for r in hard.filter("value > -0.5").orderBy(F.desc("value"), "word").limit(most_words // 2).collect()]
    machine = Machine(*fit_words(marking, sorted(set(clean + mistaken))), np.zeros(EVIDENCE + 1))
    rows = sample.mapInArrow(lambda batches: _sample_evidence(batches, machine), "toxic int, evidence array<double>").collect()
    x, y = np.array([r["evidence"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=np.float64)
    # The sample evens the labels out; a row stands for as many documents as its label has for each one sampled.
    every = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return machine._replace(calibration=_logistic(x, y, np.where(y == 1, every[1] / toxic_n, every[0] / clean_n)))


def _contexts(sample: DataFrame) -> DataFrame:
    """word (a piece of a long one), toxic, clean: the number of different words before it in texts of either label.

    A word before is told by its last letters, which is all that tells contexts apart.

    Unlike documents, contexts do not add up over near copies of one toxic text, whose every word would stand out.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = [w for w in map(plain, text.split()) if w]
                found |= {(piece, b[-PIECE:], toxic) for w, b in zip(words, ["", *words]) if len(w) >= SHORTEST for piece in pieces(w)}
            rows = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())],
                ["word", "before", "toxic"],
            )

    # Two counts distinct, one level at a time.
    once = sample.mapInArrow(pairs, "word string, before string, toxic int").distinct()
    return once.groupBy("word").agg(F.sum(F.when(F.col("toxic") >= 1, 1).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("toxic") < 1, 1).otherwise(0)).alias("clean"))


def _word_values(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(machine.words(batch.column("word").to_pylist()))], ["word", "value"])


def _sample_evidence(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for rows, found in _texts(batches, machine):
        yield pa.RecordBatch.from_arrays([rows.column("toxic").combine_chunks(), pa.array(found.tolist(), pa.list_(pa.float64()))], ["toxic", "evidence"])


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row; without a machine every score is 0."""
    texts = id_and_text(docs, id_col, text_col)
    if machine is None:
        return texts.select("doc_id", F.lit(0.0).alias("score"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _texts(batches, machine):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(machine.probability(found))], ["doc_id", "score"])

    return texts.mapInArrow(of_batches, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if the score is at least 0.5).

    A null or empty text is scored like one without any toxic word. Repeated rows and null ids each get their row;
    an empty table gives none; further columns play no part.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
