import hashlib
import random
from collections import defaultdict

from odd_rows import ODD_ROWS
from tapewright.llm import exact_dedup as X


def brute(rows):
    ids = defaultdict(list)
    for i, t in rows:
        ids[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    out = []
    for i, t in rows:
        d = hashlib.sha256((t or "").encode()).hexdigest()
        keep = max((x for x in ids[d] if x is not None), default=None)
        out.append((i, keep, len(ids[d]), i == keep, d))
    return sorted(out, key=repr)


def test_odd_rows_match_brute_force(odd_docs):
    assert sorted(map(tuple, X.exact_dedup(odd_docs).collect()), key=repr) == brute(ODD_ROWS)


def test_empty_table(no_docs):
    assert X.exact_dedup(no_docs).count() == 0
    assert X.drop_duplicates(no_docs).count() == 0


def test_hot_group(spark):
    rows = [(k, "copy" if k % 3 == 0 else f"text {k}") for k in range(3000)]
    got = X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_one_row_of_each_text_stays(odd_docs):
    got = X.drop_duplicates(odd_docs)
    assert got.columns == odd_docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len({t or "" for _, t in kept}) == len(kept) == len({t or "" for _, t in ODD_ROWS})
    assert (8, "Same text, here and there.") in kept


def digest(k):
    return hashlib.sha256(str(k).encode()).digest()


def test_filter_has_no_false_negatives_and_few_false_positives():
    f = X.CuckooFilter(5000)
    assert all(f.insert(digest(k)) for k in range(5000))
    assert all(digest(k) in f for k in range(5000))
    assert sum(digest(k) in f for k in range(5000, 25000)) < 40


def test_live_digests_against_a_counter_with_overflow_and_deletion():
    random.seed(3)
    live, want = X.LiveDigests(4), defaultdict(int)
    for _ in range(20000):
        k = random.randrange(800)
        if random.random() < 0.6:
            assert live.insert(digest(k)) == (want[k] == 0)
            want[k] += 1
        else:
            assert live.delete(digest(k)) == (want[k] == 1)
            want[k] = max(0, want[k] - 1)
    assert live.filter.rows * X.SLOTS > 64  # it was rebuilt from its keys
    assert {k for k in range(800) if live.holds(digest(k))} == {k for k, n in want.items() if n}


def test_index_build_update_probe(spark):
    texts = lambda ks: X.digests(spark.createDataFrame([(k, f"t{k}") for k in ks], "doc_id long, text string"))
    index = X.build_index(texts([*range(200), *range(50)]), 8)
    # 0-49 have two copies: one removal leaves them live.
    index = X.update_index(index, texts(range(200, 260)), texts([*range(100)]), 8)
    got = {r["text_sha256"]: r["live"] for r in X.probe_index(index, texts(range(300)), 8).collect()}
    want = {hashlib.sha256(f"t{k}".encode()).hexdigest(): k < 50 or 100 <= k < 260 for k in range(300)}
    assert got == want


def test_a_decision_binds_the_row_and_not_its_id(spark):
    rows = [(1, "a", "x"), (5, "a", "x"), (1, "b", "x"), (None, "c", "x"), (None, "a", "x"), (None, "c", "w"), (7, "d", "z"), (7, "d", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for _ in range(2):
        got = sorted(map(tuple, X.drop_duplicates(docs).collect()), key=repr)
        assert got == sorted([(5, "a", "x"), (1, "b", "x"), (None, "c", "w"), (7, "d", "y")], key=repr)
        docs = docs.orderBy("lang", "text")
