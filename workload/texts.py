"""Text queries on the whole documents."""

from __future__ import annotations

from tapewright.operators import text
from workload import adapters as A
from workload.registry import query

TOKENS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
n AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS word_rank FROM n)"""
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def documents(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", "text")


@query(
    "doc_id:i lines:i words:i",
    rf"""SELECT doc_id, len(regexp_extract_all(text, '{BREAK}'))
       + CASE WHEN length(text) > 0 AND NOT regexp_matches(right(text, 1), '{BREAK}') THEN 1 ELSE 0 END AS lines,
       len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS words FROM documents""",
)
def text_stats(spark, sf_dir):
    return text.text_stats(documents(spark, sf_dir))


@query("doc_id:i word_rank:i word:s n:i", f"{TOKENS}\nSELECT * FROM r WHERE word_rank <= 5")
def word_counts_top5(spark, sf_dir):
    return text.top_words(documents(spark, sf_dir))


@query("word:s n:i", f"{TOKENS}\nSELECT word, sum(n) AS n FROM n GROUP BY word ORDER BY sum(n) DESC, word LIMIT 5")
def corpus_top_words(spark, sf_dir):
    return text.corpus_top_words(documents(spark, sf_dir))


@query("doc_id:i word:s word_sha256:s", f"{TOKENS}\nSELECT doc_id, word, sha256(word) AS word_sha256 FROM r WHERE word_rank = 1")
def top_word_sha256(spark, sf_dir):
    return text.top_word_digest(documents(spark, sf_dir))
