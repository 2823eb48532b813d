"""Named queries of this subpackage and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import bpe, decontam, exact_dedup, langid, licenses, ns_bounds, nbsvm, periodic, simhash, token_files, toxicity, url_filter, warc
from tapewright.session import arrow_rows, materialize, scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)"""


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    digests = bpe.encode_decode(docs, tokenizer_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    # Written here: the size of the batches holds while the scope lasts.
    with arrow_rows(docs.sparkSession, bpe.ARROW_ROWS):
        return materialize(digests, "bpe-digests")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.checksums(token_files.read_tokens(spark, path))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_archive(spark, path))




ORACLES["op3_warc"] = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < refers_to THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < refers_to THEN refers_to END AS refers_to
FROM (SELECT page_id, payload_bytes, payload_digest,
             CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS refers_to
      FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest FROM pages))"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; the texts of a tenth of the ids become periodic from some word on."""
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    parted = drawn.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words).alias("words"))
    planted = parted.filter("size(words) > 0").select("doc_id", "words", "g", F.size("words").alias("n"), (F.col("g") % F.size("words")).cast("int").alias("a"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    left, block = F.col("n") - F.col("a"), F.slice("words", F.col("a") + 1, F.col("period"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(left / F.col("period")).cast("int"))), 1, left)
    longer = planted.withColumn("period", period).select("doc_id", F.array_join(F.concat(F.slice("words", 1, F.col("a")), tail), " ").alias("text"))
    return parted.filter("words is null or size(words) = 0").select("doc_id", "text").unionByName(longer)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run of each document and digests of all its runs and of its collapsed text."""
    longest = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("back"), r["start"].alias("start"), r["period"].alias("period")))
    )
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(longest, F.lit(0)).alias("top"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), (-F.col("top.back")).alias("length"), F.col("top.period").alias("period"),
        F.floor(-1000 * F.col("top.back") / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@query
def op11_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ns_bounds.integer_vectors(table(spark, sf_dir, "embeddings"), DIMENSIONS)
    return ns_bounds.summary(ns_bounds.cluster_vectors(vectors, DIMENSIONS, CLUSTERS, ROUNDS, seed=2))


DIMENSIONS, CLUSTERS, ROUNDS = 64, 40, 5


def _clustering_sql() -> str:
    """The plain rounds: every distance of every round."""
    gap = f"list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({ns_bounds.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CLUSTERS}))""",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, arg_min(k, d * {CLUSTERS} + k) AS k, min(d) AS d FROM (SELECT r, k, {gap} AS d FROM kept, c{t}) GROUP BY r)")
        if t < ROUNDS:
            steps.append(
                f"""c{t + 1} AS MATERIALIZED (SELECT c{t}.k, coalesce(m.c, c{t}.c) AS c FROM c{t} LEFT JOIN (
                SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
                SELECT k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN kept USING (r), range(1, {DIMENSIONS + 1}) AS x(i) GROUP BY k, i) GROUP BY k) AS m USING (k))"""
            )
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{ROUNDS} AS a JOIN kept USING (r) JOIN c{ROUNDS} AS c ON c.k = a.k"""


ORACLES["op11_ns_bounds"] = _clustering_sql()


@query
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return nbsvm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold)
