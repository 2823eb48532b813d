import hashlib
import random

import pytest

from odd_rows import ODD_ROWS
from tapewright.llm import bpe, queries

PATH = queries.tokenizer_path()
SIGNS = list("aAzZ éÉß Σσς İı '12½٣ 中文字 😀 ﬁ . , !?-_ \x0b\x0c\x1c\x85\t\n\r") + ["́", " ", "　", "​", "﻿"]
PIECES = SIGNS + ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "the ", "İstanbul "]


def library(rows):
    known = bpe.tokenizer(PATH)
    out = []
    for i, text in rows:
        ids = known.encode(text or "", add_special_tokens=False).ids
        out.append((i, ids, known.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=repr)


def random_rows(n):
    rnd = random.Random(8)
    return [(k if k % 17 else None, "".join(rnd.choice(PIECES) for _ in range(rnd.choice([0, 1, 2, 5, 30, 300])))) for k in range(n)]


@pytest.mark.parametrize("rows", [ODD_ROWS, random_rows(500)], ids=["odd", "random"])
def test_ids_and_decoded_texts_are_the_librarys(docs_of, tmp_path, rows):
    got = bpe.encode_decode(docs_of(rows, tmp_path), PATH).collect()
    assert sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in got), key=repr) == library(rows)


def test_blocks_of_any_size_give_the_same():
    import pyarrow as pa

    from tapewright.llm import chunks

    texts = [t for _, t in random_rows(300)]
    batches = [pa.record_batch({"text": texts[k : k + 37]}) for k in range(0, 300, 37)]
    for size in (1, 500, 10**9):
        seen = []
        for rows in chunks.blocks(iter(batches), size=size):
            words, codes, ends = chunks.factorize(rows.column("text"))
            begin = 0
            for end, text in zip(ends, rows.column("text").to_pylist()):
                seen.append((text, [words[c].as_py() for c in codes[begin:end].tolist()]))
                begin = end
        assert [s for s, _ in seen] == texts
        assert all([w.encode() for w in found] == text.encode().split() for text, found in seen)


def test_digests_of_the_query(docs_of, tmp_path):
    got = queries.bpe_digests(docs_of(ODD_ROWS, tmp_path)).collect()
    want = [
        (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        for i, ids, text in library(ODD_ROWS)
    ]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(no_docs):
    assert bpe.encode_decode(no_docs, PATH).count() == 0


def test_other_tokenizers_are_refused(odd_docs, tmp_path):
    """A cased file, and one whose tokens reach over white space: words on their own would give other ids."""
    import json

    cased = json.load(open(PATH))
    cased["normalizer"]["normalizers"].pop()
    path = str(tmp_path / "cased.json")
    json.dump(cased, open(path, "w"))
    for other in (path, queries.tokenizer_path("byte_bpe_50k.json")):
        with pytest.raises(ValueError, match="only tokenizers"):
            bpe.encode_decode(odd_docs, other)


def test_a_shard_encodes_each_word_once(monkeypatch):
    """Rows of many blocks with the same words, some rows at a time."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    seen = []
    once = bpe.encode_words
    monkeypatch.setattr(bpe, "encode_words", lambda words, path: (seen.extend(words.to_pylist()), once(words, path))[1])
    monkeypatch.setattr(bpe, "PART_BYTES", 40)
    lists = [["the", "cat", f"word{k % 7}"] for k in range(50)]
    rows = pa.record_batch(
        [pa.array([0] * 50, pa.int32()), pa.array(range(50), pa.int64()), pa.array([0] * 50, pa.int64()), pa.array([zstandard.compress(" ".join(w).encode()) for w in lists], pa.binary())],
        names=["shard", "block", "first", "words"],
    )
    out = pa.Table.from_batches(bpe._encode_shard(iter([rows.slice(0, 20), rows.slice(20)]), PATH)).to_pylist()
    assert sorted(seen) == sorted({w for words in lists for w in words}) and len(out) == 50
    for words, row in zip(lists, out):
        sizes, ids = bpe._unpack(row["sizes"], "int32"), bpe._unpack(row["ids"], "int32")
        want = [once(pa.array([w]), PATH)[1].tolist() for w in words]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()


def test_the_query_gets_small_batches(spark, monkeypatch):
    """Rows of a batch as Spark hands them to the workers; before, up to 10,000 whole texts at once."""
    import pyarrow as pa

    def counted(docs, path):
        def count(batches):
            for batch in batches:
                yield pa.record_batch({"doc_id": pa.array([batch.num_rows]), "ids": pa.array([[1]], pa.list_(pa.int32())), "decoded": pa.array([""])})

        return docs.mapInArrow(count, "doc_id long, ids array<int>, decoded string")

    monkeypatch.setattr(queries.bpe, "encode_decode", counted)
    docs = spark.range(0, 5000, 1, 2).selectExpr("id AS doc_id", "'some words' AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = [r["doc_id"] for r in queries.bpe_digests(docs).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_block_holds_four_megabytes():
    """Each block of a pass over the texts; before, twice as much beside the JVM in each worker."""
    import pyarrow as pa

    text = " ".join(f"word{k}" for k in range(1000))
    batches = [pa.record_batch({"doc_id": pa.array(range(500)), "text": pa.array([text] * 500)}) for _ in range(4)]
    sizes = [sum(len(t) for t in rows.column("text").to_pylist()) for _, rows, *_ in bpe._split(iter(batches), 16)]
    assert sum(sizes) == 2000 * len(text) and max(sizes) < 4_000_000 + len(text)
