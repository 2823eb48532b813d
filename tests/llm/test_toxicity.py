import itertools
import random

import numpy as np
import pytest

from odd_rows import ODD_ROWS
from tapewright.llm import toxicity as T

DIR = "/root/testdata/sf0.1"


def brute_kernel(a, b):
    """Sum over all pairs of equal subsequences, by definition."""

    def parts(word):
        out = {}
        for at in itertools.combinations(range(len(word)), 4):
            if at[-1] - at[0] < T.SPAN:
                u = "".join(word[x] for x in at)
                out[u] = out.get(u, 0) + T.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = f"^{a}$", f"^{b}$"
    x, y = parts(a), parts(b)
    return sum(v * y.get(u, 0) for u, v in x.items()) / (T._NORM[len(a)] * T._NORM[len(b)])


def test_kernel_matches_its_definition():
    words = ["idiot", "idxiot", "banana", "abcabcabc", "xyz", "subsequence", "abcdefghijklmnopqrstuv"]
    got = T.kernel(words, words)
    want = [[brute_kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, want, rtol=1e-4)
    assert got[0, 1] > 0.3 > got[0, 2]


def test_machine_is_the_kernel_expansion():
    toxic, clean = ["idiot", "moron", "scumbag"], ["weather", "garden", "bread", "window", "river", "idea"]
    weights, bias = T.fit_words(toxic, clean)
    machine = T.Machine(weights, bias, np.zeros(T.EVIDENCE + 1))
    values = machine.words(toxic + clean + ["idxiot", "mo-ron".replace("-", ""), "ab", ""])
    assert (values[:3] > 0).all() and (values[3:9] < 0).all() and values[9] > values[3:9].max()
    assert values[11] == values[12] == -1.0


def test_long_words_are_scored_by_windows():
    weights, bias = T.fit_words(["idiot"], ["weather", "garden"])
    machine = T.Machine(weights, bias, np.zeros(T.EVIDENCE + 1))
    assert machine.words(["weather" * 40 + "idiot" * 5 + "garden" * 40])[0] > machine.words(["weather" * 80])[0]


@pytest.fixture(scope="module")
def machine(spark):
    return T.train(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = T.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    toxic, said = got["toxic"] == 1, got["predicted"] == 1
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == said).all()
    assert (toxic == said).mean() > 0.97
    assert (toxic & said).sum() / toxic.sum() > 0.85 and (toxic & said).sum() / said.sum() > 0.85


def test_gaps_inserted_and_spelled_letters(spark, machine):
    rnd = random.Random(1)
    prose = [w for r in spark.read.parquet(f"{DIR}/documents.parquet").filter("lang = 'en' and doc_id < 60").collect() for w in r["text"].split() if machine.words([T.plain(w)])[0] < -0.5]
    clean = lambda n: [rnd.choice(prose) for _ in range(n)]
    rows = []
    for k, word in enumerate(["idiot", "stupid", "worthless", "pathetic", "disgusting"]):
        for j, form in enumerate([word, word.upper() + "!", "*".join(word), f"{word[:3]}x{word[3:]}", " ".join(word)]):
            rows.append((100 * k + j, " ".join([*clean(80), form, *clean(80)])))
    rows += [(1000 + k, " ".join(clean(160))) for k in range(40)]
    got = {r["doc_id"]: r["score"] for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()}
    highest_clean = max(s for k, s in got.items() if k >= 1000)
    assert all(s > highest_clean for k, s in got.items() if k < 1000)


def test_odd_rows(spark, odd_docs, no_docs, machine):
    rows = T.score(odd_docs, machine).collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[1] == by_id[3] < 0.5
    assert T.score(no_docs, machine).count() == 0
    labels = spark.createDataFrame([(1, 1, "x"), (None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    # Without both labels nothing can be learned.
    assert {(r["score"], r["predicted"]) for r in T.toxicity(odd_docs, labels).collect()} == {(0.0, 0)}
    assert T.toxicity(no_docs, labels).count() == 0


def test_pieces_hold_the_whole_word():
    """Every stretch of letters that a window's half can hold lies in some piece: nothing after the first window is lost."""
    for n in range(1, 200):
        word = "".join(chr(0x4E00 + k) for k in range(n))
        found = T.pieces(word)
        assert all(len(p) <= T.PIECE for p in found)
        for k in range(n):
            assert any(word[k : k + 9] in p for p in found), (n, k)


def test_an_insult_late_in_a_long_run_is_learned(spark, docs_of, tmp_path):
    """The word that tells begins like others and differs only after its first 24 letters."""
    rnd = random.Random(2)
    plain = lambda n: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    begin = plain(24)
    texts = [(k, f"{plain(6)} {begin}{'zzyxqzzyx' if k % 2 else plain(9)}{plain(5)}") for k in range(400)]
    docs = docs_of(texts, tmp_path)
    labels = spark.createDataFrame([(k, k % 2) for k, _ in texts], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.toxicity(docs, labels).collect()}
    held = [k for k, _ in texts if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == k % 2 for k in held) >= 0.9 * len(held)
