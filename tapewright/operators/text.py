"""Line, word and top-word statistics of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.words import line_count, word_count, words
from tapewright.operators.ranking import top_k
from tapewright.session import materialize


def text_stats(documents: DataFrame) -> DataFrame:
    """Lines and words per document."""
    return documents.select("doc_id", line_count(F.col("text")).alias("lines"), word_count(F.col("text")).alias("words"))


def document_words(documents: DataFrame) -> DataFrame:
    """Count and first position of each word of each document; rows that share an id are one document."""
    tokens = documents.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return tokens.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def row_top_words(documents: DataFrame, k: int) -> DataFrame:
    """The k most common words of each row, ties by first appearance, in ``top``: n, first_pos, word.

    Words are sorted and counted inside their row, so that nothing is shuffled and a task holds one row at a time.
    """
    placed = F.transform(words(F.col("text")), lambda word, pos: F.struct(word.alias("word"), pos.alias("pos")))
    word_at = lambda i: F.get(F.col("_words"), i)["word"]
    places = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1))
    starts = F.filter(places, lambda i: (i == 0) | (word_at(i) != word_at(i - 1)))
    count = lambda start, nth: F.coalesce(F.get(F.col("_starts"), nth + 1), F.size("_words")) - start
    runs = F.transform(
        F.col("_starts"),
        lambda start, nth: F.struct(
            (-count(start, nth)).alias("less"), F.get(F.col("_words"), start)["pos"].alias("first_pos"), word_at(start).alias("word")
        ),
    )
    placed_rows = documents.select("doc_id", F.sort_array(placed).alias("_words")).withColumn("_starts", starts)
    return placed_rows.select("doc_id", F.slice(F.sort_array(runs), 1, k).alias("top"))


def top_words(documents: DataFrame, k: int = 5) -> DataFrame:
    """The k most common words of each document, ties by first appearance.

    Rows that share an id are one document; only the words of those are shuffled and added up.
    """
    shared = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("doc_id")
    shared = materialize(shared, "shared-ids").alias("shared")
    rows = documents.select("doc_id", "text").alias("rows")
    once, again = (rows.join(shared, F.expr("rows.doc_id <=> shared.doc_id"), how) for how in ("left_anti", "left_semi"))
    # An inner explode would have its array, with all that it is made of, tested in a filter below.
    ranked = row_top_words(once, k).select("doc_id", F.posexplode_outer("top").alias("nth", "best")).filter("best is not null").select(
        "doc_id", "best.word", (-F.col("best.less")).cast("long").alias("n"), "best.first_pos", (F.col("nth") + 1).alias("word_rank")
    )
    order = [F.desc("n"), F.col("first_pos")]
    return ranked.unionByName(top_k(document_words(again), ["doc_id"], order, k, rank="word_rank"))


def corpus_top_words(documents: DataFrame, k: int = 5) -> DataFrame:
    """The k most common words over all documents, ties alphabetical."""
    tokens = documents.select(F.explode(words(F.col("text"))).alias("word"))
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def top_word_digest(documents: DataFrame) -> DataFrame:
    """SHA-256 of each document's most common word."""
    return top_words(documents, 1).select("doc_id", "word", F.sha2("word", 256).alias("word_sha256"))
