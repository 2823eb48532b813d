"""Shared column handling: id and text under names of the operator's own, and folds by id."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.session import materialize

FOLDS = 5


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``doc_id`` (long), ``text`` (null becomes empty) and ``keep``; others, whatever their names, stay behind."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in keep]
    )


def text_key(text: Column | str) -> Column:
    """Hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def stay(docs: DataFrame, marked: DataFrame, group: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all columns, per value of ``group`` in ``marked`` (doc_id, text_key, group).

    Smallest id, a null last, of its texts the smallest key; of rows that repeat both, the first by their JSON.
    """
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    kept = marked.groupBy(group).agg(order).select("least.doc_id", "least.text_key")
    return rows_of(docs, kept, marked, text_key(docs[text_col].cast("string")), id_col)


def whole_rows(docs: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """``row`` (all columns of ``docs``), ``doc_id`` and ``text_key``: no name of the rows can clash with another."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return docs.select(row.alias("row"), docs[id_col].cast("long").alias("doc_id"), key.alias("text_key"))


def same_row(a: str, b: str) -> Column:
    """Id and text key agree; null ids are alike."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def rows_of(docs: DataFrame, kept: DataFrame, marked: DataFrame, digest: Column, id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` per row of ``kept`` (doc_id, text_key), the first by its JSON if rows repeat both.

    ``marked`` has doc_id and text_key of every row of ``docs``, ``digest`` is the text's key there.
    """
    twice = marked.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "text_key")
    again = materialize(twice, "repeated-rows").alias("b")
    kept = materialize(kept.select("doc_id", "text_key").distinct(), "kept-rows").alias("a")
    whole = whole_rows(docs, digest, id_col).alias("whole")
    once, repeated = (kept.join(again, same_row("a", "b"), how).alias("kept") for how in ("left_anti", "left_semi"))
    first = whole.join(repeated, same_row("whole", "kept"), "left_semi").groupBy("doc_id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return whole.join(once, same_row("whole", "kept"), "left_semi").select("row.*").unionByName(first.select("row.*"))


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that no model learns from. A null id counts as empty text, whose crc32 is 0: held out."""
    name = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == 0


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other letter unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sample_per_label(docs: DataFrame, label: str, about: int) -> DataFrame:
    """About ``about`` rows of each label, all of a label with fewer; rows without a label go.

    A row is taken if the hash of its ``doc_id`` falls below the share that its label needs, so that one count per
    label is all that is gathered and no text moves. Rows that share an id are taken or left together.
    """
    name = F.col(label).cast("string")
    sizes = docs.filter(name.isNotNull()).groupBy(name.alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a label
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    taken = F.lit(False)
    for row in sizes:
        taken = taken | ((name == row["label"]) & (place < math.ceil(about / row["n"] * (1 << 40))))
    return docs.filter(taken)
