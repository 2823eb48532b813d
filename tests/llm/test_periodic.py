import hashlib
import zlib

import numpy as np
import pytest

from odd_rows import LONG
from tapewright.llm import periodic, queries


def brute(words, min_words=periodic.MIN_WORDS, min_repeats=periodic.MIN_REPEATS):
    """All maximal stretches of every period, the smallest period of each."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - begin >= 2 * q:
                out.setdefault((begin, i + q), q)
            i += 1
    return sorted((b, e - b, q) for (b, e), q in out.items() if e - b >= max(min_words, min_repeats * q))


def as_rows(found):
    return list(zip(*(x.tolist() for x in found)))


def collapsed(words, runs):
    dropped = {k for start, length, period in runs for k in range(start + period, start + length)}
    return [w for k, w in enumerate(words) if k not in dropped]


@pytest.mark.parametrize("bounds", [(6, 4), (1, 2), (3, 3)])
def test_runs_equal_brute_force(bounds):
    draw = np.random.default_rng(7)
    for _ in range(600):
        n = int(draw.integers(0, 70))
        words = draw.integers(0, int(draw.integers(1, 4)), n)
        if n > 4 and draw.random() < 0.5:
            period, a, i = int(draw.integers(1, n // 2)), int(draw.integers(0, n)), np.arange(n)
            words = words[np.where(i >= a, a + (i - a) % period, i) % n]
        assert as_rows(periodic.find_runs(words, *bounds)) == brute(words.tolist(), *bounds)


def test_suffixes_are_in_order():
    words = np.random.default_rng(3).integers(0, 3, 200)
    order, levels = periodic.suffix_array(words)
    assert order.tolist() == sorted(range(200), key=lambda i: words[i:].tolist())
    assert levels[-1][order].tolist() == list(range(200))


def test_every_branching_square_is_found():
    words = np.random.default_rng(5).integers(0, 2, 120)
    w = words.tolist()
    order, levels = periodic.suffix_array(words)
    want = {(i, d) for d in range(1, 60) for i in range(121 - 2 * d) if w[i : i + d] == w[i + d : i + 2 * d] and w[i + d : i + d + 1] != w[i + 2 * d : i + 2 * d + 1]}
    assert set(zip(*(x.tolist() for x in periodic.branching_squares(words, order, levels)))) == want


def test_long_runs_stay_cheap():
    assert as_rows(periodic.find_runs(np.zeros(200_000, np.int64))) == [(0, 200_000, 1)]
    assert as_rows(periodic.find_runs(np.arange(200_000) % 1_000)) == [(0, 200_000, 1_000)]


def test_one_repeat_is_refused():
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(5, np.int64), 1, 1)


def test_texts_of_a_block_share_nothing(spark, docs_of, tmp_path):
    docs = docs_of([(1, "a a a"), (2, "a a a"), (3, "a a a a a a"), (4, "x y x y x y x y z"), (5, "b b b b b b c c c c c c")], tmp_path)
    got = {r["doc_id"]: r for r in periodic.periodic_runs(docs).collect()}
    assert [len(got[k]["runs"]) for k in range(1, 6)] == [0, 0, 1, 1, 2]
    assert got[3]["collapsed"] == "a" and got[4]["collapsed"] == "x y z" and got[5]["collapsed"] == "b c"
    assert got[4]["runs"][0].asDict() == {"start": 0, "length": 8, "period": 2}


def test_odd_rows(odd_docs):
    got = periodic.periodic_runs(odd_docs).collect()
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["collapsed"]) for r in got if not r["runs"]) == [
        (i, " ".join(t.split())) for i, t in texts if t != LONG
    ]
    (long,) = (r for r in got if r["runs"])
    assert [(r["start"], r["length"], r["period"]) for r in long["runs"]] == [(0, 60_000, 977)]


def test_empty_table(no_docs):
    assert periodic.periodic_runs(no_docs).count() == 0


def plant(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark):
    """Texts of up to 400 words of the smallest table; the digests are those of the contract."""
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: plant((r["text"] or "").split(), r["doc_id"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, folder).collect()}
    assert set(got) == set(texts)
    seen = 0
    for i, words in texts.items():
        if len(words) > 400:
            continue
        runs, r = brute(words), got[i]
        seen += len(runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want and r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
    assert seen > 5
