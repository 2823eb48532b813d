import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import nbsvm, queries


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def brute_buckets(text):
    """Indicators of a text, one n-gram at a time."""
    words, out = text.split(), set()
    bucket = lambda code: int(nbsvm._bucket(np.array([code], np.uint64))[0])
    for word in words:
        framed = [ord(c) for c in f"\x01{word}\x01"]
        for n in range(1, nbsvm.LONGEST + 1):
            for at in range(len(framed) - n + 1):
                code = 0
                for point in framed[at : at + n]:
                    code = ((code << 21) | point) % (1 << 64)
                out.add(bucket((code * 4 + n) % (1 << 64)))
    marks = []
    for k, word in enumerate(words):
        back = next((b for b in range(1, nbsvm.MARKS + 1) if b <= k and words[k - b] == word), 0)
        marks.append(back)
    for n in range(1, nbsvm.MARK_WORDS + 1):
        for at in range(len(marks) - n + 1):
            code = 0
            for mark in marks[at : at + n]:
                code = (code << 8) | mark
            out.add(bucket((code << 3) + (1 << 62) + n))
    return out


def test_indicators_equal_brute_force():
    texts = ["", "  ", "one", "one one two one", "Été — 你好 ß 𝒳y", "a b c a b c a b c d", "x " * 40]
    got = list(nbsvm.indicators(pa.chunked_array([pa.array(texts, pa.string())])))
    assert [set(g.tolist()) for g in got] == [brute_buckets(t) for t in texts]
    assert all(len(g) == len(set(g.tolist())) for g in got)


def test_log_count_ratios():
    got = nbsvm.log_count_ratios(np.array([[3.0, 0.0], [0.0, 1.0]]), smoothing=1.0)
    assert got == pytest.approx([np.log((1 / 3) / (4 / 5)), np.log((2 / 3) / (1 / 5))])


def test_descent_reaches_the_optimum():
    """Gradient of the dual: no multiplier can move to gain; weights are the sum of the texts' shares."""
    draw = np.random.default_rng(1)
    rows = [(np.sort(draw.choice(30, 6, replace=False)), draw.normal(size=6)) for _ in range(80)]
    y = np.where([v.sum() + draw.normal() * 0.5 > 0 for _, v in rows], 1.0, -1.0)
    cost = np.full(80, 0.7)
    w = nbsvm.dual_coordinate_descent(rows, y, 30, cost, passes=2_000)
    margin = y * np.array([w[c] @ v + w[-1] for c, v in rows])
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - margin)).sum()
    for _ in range(200):
        other = w + draw.normal(size=31) * 0.05
        margin = y * np.array([other[c] @ v + other[-1] for c, v in rows])
        assert 0.5 * other @ other + (cost * np.maximum(0, 1 - margin)).sum() >= primal - 1e-2


def test_held_out_accuracy(spark):
    """Learned from two thirds of the labels; at least 98 % of either label of the other third are told."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = queries.QUERIES["op12_quality"](spark, folder).join(labels, "doc_id").filter("held_out").groupBy("quality", "predicted").count().collect()
    n = {(r["quality"], r["predicted"]): r["count"] for r in got}
    for label in (0, 1):
        assert n.get((label, label), 0) >= 0.98 * sum(v for (q, _), v in n.items() if q == label) > 0


def test_only_the_fold_is_learned_from(spark, docs_of, tmp_path):
    """Labels of the held-out fold say the contrary and change nothing."""
    texts = [(k, ("plain words of a text " if k % 2 else "@@ ## $$ %% ") * 5 + str(k)) for k in range(120)]
    docs = docs_of(texts, tmp_path)
    labels = docs.select("doc_id", F.when(held_out(), 1 - F.col("doc_id") % 2).otherwise(F.col("doc_id") % 2).cast("int").alias("quality"))
    got = {r["doc_id"]: r for r in nbsvm.quality(docs, labels, held_out()).collect()}
    assert all(got[k]["predicted"] == k % 2 for k, _ in texts) and {r["held_out"] for r in got.values()} == {True, False}


def test_the_sample_is_bounded(spark, docs_of, tmp_path):
    texts = [(k, ("plain words of a text " if k % 2 else "@@ ## $$ %% ") * 5 + str(k)) for k in range(400)]
    docs = docs_of(texts, tmp_path)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = {r["doc_id"]: r["predicted"] for r in nbsvm.quality(docs, labels, held_out(), per_label=20).collect()}
    assert all(got[k] == k % 2 for k, _ in texts)


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (7, 1), (7, 0), (8, 1), (9, 0), (None, 1), (10, None), (99, 1), (11, 0)], "doc_id long, quality int")
    got = nbsvm.quality(odd_docs, labels, held_out()).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 3)}) == 1


def test_without_labels_and_without_texts(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in nbsvm.quality(odd_docs, none, held_out()).collect()} == {0.5}
    assert nbsvm.quality(no_docs, none, held_out()).count() == 0
