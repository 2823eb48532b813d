"""Tokens and lines against Python's own text functions."""

import collections
import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tapewright.operators import text

# Letters of several scripts, digits, marks, underscores and every line boundary.
ALPHABET = "aAbéÉßñжЖ中٣²½_-'’ .,\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85   ́‿🙂"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=1, max_size=60))
def test_against_python(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stats = {r.doc_id: (r.lines, r.words) for r in text.text_stats(docs).collect()}
    tops = collections.defaultdict(list)
    for r in text.top_words(docs).orderBy("doc_id", "word_rank").collect():
        tops[r.doc_id].append((r.word, r.n))
    digests = {r.doc_id: r.word_sha256 for r in text.top_word_digest(docs).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"\b\w+\b", t.lower())
        assert stats[i] == (len(t.splitlines()), len(words)), repr(t)
        want = collections.Counter(words).most_common(5)
        assert tops[i] == want, repr(t)
        assert digests.get(i) == (hashlib.sha256(want[0][0].encode()).hexdigest() if want else None)


def test_corpus_words(spark):
    docs = spark.createDataFrame([(1, "b a"), (2, "a c"), (3, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in text.corpus_top_words(docs, 2).collect()] == [("a", 2), ("b", 1)]


def test_top_words_shuffle_no_text_of_ids_that_stand_alone(spark):
    docs = spark.createDataFrame([(k, f"b a a c{k}") for k in range(50)] + [(99, None), (98, " ")], "doc_id bigint, text string")
    tops = text.top_words(docs, 2)
    assert sorted((r.doc_id, r.word, r.n, r.word_rank) for r in tops.collect()) == sorted(
        x for k in range(50) for x in ((k, "a", 2, 1), (k, "b", 1, 2))
    )
    final = tops._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "regexp_extract_all" in final
    assert "REPARTITION_BY" not in final
    assert "Exchange" not in text.row_top_words(docs, 2)._jdf.queryExecution().executedPlan().toString()


def test_rows_that_share_an_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "y"), (None, "n m"), (None, "m"), (2, "z")], "doc_id bigint, text string")
    tops = text.top_words(docs, 1)
    assert {(r.doc_id, r.word, r.n) for r in tops.collect()} == {(1, "y", 2), (None, "m", 2), (2, "z", 1)}
