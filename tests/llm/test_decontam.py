import random

import numpy as np

from odd_rows import ODD_ROWS
from tapewright.llm import decontam as D


def brute_align(item, passage):
    """Textbook Smith-Waterman with match 2, mismatch -1, gap -1."""
    above, best, end = [0] * (len(passage) + 1), 0, 0
    for x in item:
        row = [0]
        for j, y in enumerate(passage):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
            if row[-1] > best:
                best, end = row[-1], j + 1
        above = row
    return best, end


def test_alignment_matches_the_textbook():
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(120):
        item = rng.integers(1, 9, rng.integers(1, 25)).astype(np.uint64)
        passage = rng.integers(1, 9, rng.integers(1, 40)).astype(np.uint64)
        pairs.append((item, passage))
    best, _ = D.align(D._padded([a for a, _ in pairs]), D._padded([b for _, b in pairs]))
    assert best.tolist() == [brute_align(a.tolist(), b.tolist())[0] for a, b in pairs]


def vocabulary(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(n)]


def planted(spark):
    rnd, words = random.Random(7), vocabulary(400, 1)
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    items = {k: prose(rnd.randint(20, 60)) for k in range(30)}
    items[99] = prose(400)  # several segments
    docs, leaks = [], set()
    for k in range(400):
        body = prose(rnd.randint(30, 400))
        if k % 8 == 0:
            item = rnd.choice(list(items))
            copy = list(items[item])
            if k % 16 == 0:  # every seventh word another, dropped or followed by one more
                copy = [w for j, w in enumerate(copy) for w in ([w] if j % 7 else rnd.choice([["zzz"], [], [w, "yyy"]]))]
            at = rnd.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in copy]
            leaks.add((k, item))
        docs.append((k, " ".join(body)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string"), bench, docs, items, leaks


def test_copied_and_edited_items_are_found_and_clean_documents_are_not(spark):
    docs, bench, rows, items, leaks = planted(spark)
    found = D.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == leaks
    for r in found:
        if r["item_id"] != 99:
            words = D.text_words(dict(rows)[r["doc_id"]])
            want = brute_align(D.text_words(" ".join(items[r["item_id"]])).tolist(), words.tolist())
            assert r["score"] == want[0] / (2 * len(items[r["item_id"]])) and r["last_word"] == want[1] - 1
            assert words[r["first_word"]] in D.text_words(" ".join(items[r["item_id"]])).tolist()
    kept = {r["doc_id"] for r in D.drop_leaks(docs, bench).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in leaks}


def test_a_leak_copied_into_most_documents_keeps_its_seeds(spark):
    words = vocabulary(300, 2)
    rnd = random.Random(3)
    item = [rnd.choice(words) for _ in range(40)]
    docs = [(k, " ".join([rnd.choice(words) for _ in range(50)] + (item if k % 3 else []))) for k in range(900)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {k for k in range(900) if k % 3}


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "Same text, here and there."), (2, None), (3, ""), (4, "two words"), (None, "Same text, here and there."), (1, "Same text, here and there.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:3] for r in D.leaks(odd_docs, bench).collect()), key=repr)
    assert got == sorted([(7, 1, 1.0), (8, 1, 1.0), (9, 1, 1.0), (None, 1, 1.0)], key=repr)
    kept = D.drop_leaks(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    same = [t for _, t in ODD_ROWS if t and t.lower() == "same text, here and there."]
    assert kept.count() == len(ODD_ROWS) - len(same)
    assert D.leaks(no_docs, bench).count() == 0 and D.leaks(odd_docs, bench.limit(0)).count() == 0
    assert D.drop_leaks(odd_docs, bench.limit(0)).count() == len(ODD_ROWS)


def test_items_are_found_across_any_white_space_and_in_scripts_without_spaces(spark):
    phrase = "un deux trois quatre cinq six sept huit".split()
    han = "机器学习模型需要大量高质量数据才能训练"
    thai = "ประเทศไทยมีอาหารอร่อยมากมาย"
    items = {1: " ".join(phrase), 2: han, 3: thai, 4: "rareword", 5: "two words", 6: " ".join("alpha beta gamma delta epsilon".split())}
    docs = {}
    for k, gap in enumerate(["\u00a0", "\u3000", "\u2028", "\x1c", "\x1f", "\x85", " \u2009"]):
        docs[k] = ("start " + gap.join(phrase) + " end", {1})
    docs |= {
        20: ("前言。" + han + "。后记", {2}), 21: ("前言。" + han[:9] + "的" + han[9:] + "后记", {2}), 22: ("数据很多", set()), 23: (f"คำนำ{thai}จบ", {3}),
        30: ("here a Rareword, stands", {4}), 31: ("two other words and words two", set()), 32: ("at last Two, WORDS!", {5}), 33: ("rarewords", set()),
        40: ("x alpha beta gamma delta epsilon y", {6}), 41: ("", set()), 42: ("rareword two words", {4, 5}),
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = D.leaks(spark.createDataFrame([(k, t) for k, (t, _) in docs.items()], "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, i) for k, (_, want) in docs.items() for i in want}
    assert all(r["score"] == 1.0 for r in found if r["doc_id"] != 21)


def test_blocks_windows_and_batches_are_bounded(spark):
    import pyarrow as pa

    from tapewright.session import arrow_rows

    words, n = vocabulary(3000, 3), 3000
    text = " ".join(words)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([text] * n)], ["doc_id", "text_key", "text"])
    seeds = D.seed_hashes(D.text_words(text))
    bits = np.zeros(1 << D.FILTER_BITS, dtype=np.uint8)
    bits[(seeds[::100] >> np.uint64(64 - D.FILTER_BITS)).astype(np.int64)] = 1
    packed = np.packbits(bits).tobytes()
    part = batch.slice(0, 400)
    assert max(sum(map(len, b[0].column("text").to_pylist())) for b in D._hits([part], packed, [3])) < 2_100_000
    made = list(D._windows_of([part], packed, 160, [3]))
    assert sum(b.num_rows for b in made) >= 400 * 15 and max(b.num_rows for b in made) <= 512
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    with arrow_rows(spark, D.ARROW_ROWS):
        assert max(r.n for r in spark.range(5000, numPartitions=1).mapInArrow(sizes, "n long").collect()) <= 1000
    assert spark.conf.get(name) == before


def test_runs_of_ascii_are_normalized_as_a_column(monkeypatch):
    rng = random.Random(4)
    runs = ["".join(rng.choice("aZ0_-.,'\x00\x7féßİΣ日本½") for _ in range(rng.randrange(1, 8))) for _ in range(3000)] + ["---", "The", "it's"]
    want = [h for r in runs for h in D.word_hashes(r)]
    asked, one = [], D.word_hashes
    monkeypatch.setattr(D, "word_hashes", lambda run: asked.append(run) or one(run))
    assert D.text_words(" ".join(runs)).tolist() == want
    assert asked and not any(r.isascii() for r in asked)
