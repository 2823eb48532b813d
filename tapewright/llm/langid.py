"""Language identification by rank-order profiles of character n-grams.

A profile is the ranked list of the most frequent n-grams of one to three characters. A document gets the
language whose profile is nearest by the out-of-place distance: the sum, over the document's own profile, of how
far apart the two ranks of an n-gram are, an n-gram missing from the language's profile counting as the furthest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.columns import held_out, id_and_text, sample_per_label

PROFILE_SIZE = 300
MAX_GRAM = 3
# Size of the sample that the profiles are learned from.
TRAIN_PER_LANGUAGE = 2_000
UNDETERMINED = "und"
# Below this score a text is further from every profile than any prose is; see ``accepted``.
MIN_SCORE = 0.05

_BITS = 21  # a code point
_EDGE = 1  # a word boundary: no letter, and not 0, which would make n-grams of different lengths alike


@functools.cache
def _letters() -> np.ndarray:
    """Per code point: the lower-cased letter, or the boundary where it is no letter."""
    out = np.full(0x110000, _EDGE, dtype=np.int64)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def profile(text: str, size: int = PROFILE_SIZE, longest: int = MAX_GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's most frequent n-grams and their counts, most frequent first, ties by code.

    Every run of other characters is one word boundary, which takes part in n-grams of two or more characters.
    """
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = _letters()[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
    padded = np.concatenate(([_EDGE], points, [_EDGE]))
    padded = padded[np.concatenate(([True], (padded[1:] != _EDGE) | (padded[:-1] != _EDGE)))]
    grams = [padded[padded != _EDGE]]
    code = padded
    for n in range(2, longest + 1):
        if len(padded) < n:
            break
        code = (code[: len(padded) - n + 1] << _BITS) | padded[n - 1 :]
        grams.append(code)
    if not len(grams[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, counts = np.unique(np.concatenate(grams), return_counts=True)
    best = np.argsort(-counts, kind="stable")[:size]
    return codes[best], counts[best]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All n-grams (no cut) of the texts of a batch, counted per language."""
    for batch in batches:
        by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            by_lang.setdefault(lang, []).append(profile(text, size=1 << 62))
        for lang, found in by_lang.items():
            codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([k for _, k in found]), minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])


def learn(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, size: int = PROFILE_SIZE) -> Profiles:
    """Ranked n-gram codes per language, from documents with a language outside the held-out fold.

    About ``per_language`` documents of a language take part (see ``sample_per_label``).
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    texts = sample_per_label(known.filter(~held_out("doc_id")), "lang", per_language).filter("text is not null")
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    grams = (
        texts.select("text", "lang").mapInArrow(_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= size)
    )
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in grams.collect():  # at most ``size`` rows a language
        profiles.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return Profiles({lang: np.array([g for _, g in sorted(rows)], dtype=np.int64) for lang, rows in profiles.items()}, size)


class Profiles:
    """Learned profiles, sorted by code for lookups."""

    def __init__(self, ranked: dict[str, np.ndarray], size: int = PROFILE_SIZE) -> None:
        self.size = size
        self.languages = sorted(ranked)
        self._orders = [np.argsort(ranked[lang]) for lang in self.languages]
        self._codes = [ranked[lang][order] for lang, order in zip(self.languages, self._orders)]

    def distances(self, doc: np.ndarray) -> list[float]:
        """Per language, from 0 (same order) to 1 (nothing in common); ``doc`` is a profile with at least one n-gram."""
        own = np.arange(len(doc))
        out = []
        for codes, ranks in zip(self._codes, self._orders):
            at = np.minimum(np.searchsorted(codes, doc), len(codes) - 1)
            apart = np.where(codes[at] == doc, np.minimum(np.abs(ranks[at] - own), self.size), self.size)
            out.append(float(apart.sum()) / (self.size * len(doc)))
        return out

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and score of a text; ties go to the first language by name."""
        codes, _ = profile(text or "", self.size)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        far = self.distances(codes)
        best = min(range(len(far)), key=far.__getitem__)
        return self.languages[best], 1.0 - far[best]


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``: one minus the distance to the nearest profile, ties by language name.

    Null texts, texts without a letter and any text when no language was learned are ``und`` with score 0.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest(text.as_py()) for text in batch.column("text")]
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), langs, scores], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(of_batches, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    ``docs`` has doc_id, text and lang; lang of the fold that is not held out is the only label seen. Repeated
    rows each get a row; a null id is held out; an empty table gives no rows; further columns play no part.
    """
    return predict(docs, learn(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, profiles: Profiles | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is in a learned language.

    Texts without a letter go, and those whose n-grams are out of place in every profile: even a single word of
    prose scores far above ``min_score``. Without a learned language nothing can be told and every row stays.
    """
    profiles = learn(docs) if profiles is None else profiles
    if not profiles.languages:
        return docs
    at = docs.columns.index("text")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest(text.as_py()) for text in batch.column(at)]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(of_batches, docs.schema)
