import glob
import zlib

import numpy as np
import pyarrow.parquet as pq

from odd_rows import ODD_ROWS
from tapewright.llm import bpe, queries, token_files

PATH = queries.tokenizer_path()


def order(row):
    return (row[0] is not None, row[0] or 0)


def expected(rows):
    """Ids per document in the order of the files; texts under one id may come in any order."""
    known = bpe.tokenizer(PATH)
    return sorted(((i, [*known.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows), key=order)


def test_odd_rows_round_trip(spark, odd_docs, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd_docs, path, PATH)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=repr) == sorted(expected(ODD_ROWS), key=repr)
    assert [r["doc_id"] for r in got] == [i for i, _ in expected(ODD_ROWS)]
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.checksums(token_files.read_tokens(spark, path)).collect()}
    assert sums == {(r["doc_id"], r["start"]): zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in got}


def test_layout_of_the_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    layout = {**token_files.LAYOUT, "parquet.block.size": str(1 << 20), "parquet.page.row.count.limit": "50"}
    token_files.write_tokens(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), path, PATH, layout=layout)
    last = None
    for name in sorted(glob.glob(f"{path}/data/*.parquet")):
        meta = pq.ParquetFile(name).metadata
        ids = pq.read_table(name, columns=["doc_id"]).column("doc_id").to_pylist()
        assert ids == sorted(ids) and (last is None or ids[0] > last)
        last = ids[-1]
        for group in range(meta.num_row_groups):
            by_name = {meta.row_group(group).column(c).path_in_schema: meta.row_group(group).column(c) for c in range(meta.num_columns)}
            assert meta.row_group(group).total_byte_size < 4 << 20
            assert any("DICTIONARY" in e for e in by_name["ids.list.element"].encodings)
            for flat in ("doc_id", "offset", "n_tokens"):
                assert by_name[flat].encodings == ("DELTA_BINARY_PACKED",) and by_name[flat].has_offset_index and by_name[flat].has_column_index
    scan = token_files.read_tokens(spark, path).filter("doc_id between 100 and 120").select("doc_id", "start")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(doc_id,100)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert scan.count() == 21


def test_manifest_counts_every_shard(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), path, PATH, end_id=None)
    shards = spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()
    assert sum(r["documents"] for r in shards) == 1000
    assert [r["start"] for r in shards] == np.concatenate(([0], np.cumsum([r["tokens"] for r in shards])[:-1])).tolist()
    assert all(a["last_doc"] < b["first_doc"] for a, b in zip(shards, shards[1:]))


def test_empty_table(spark, no_docs, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(no_docs, path, PATH)
    assert token_files.read_tokens(spark, path).count() == 0
