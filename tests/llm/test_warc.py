import glob
import gzip
import hashlib
import io
import os

import pytest

from tapewright.llm import warc

BIG, SMALL = "x" * 1500, "short"
ROWS = [
    (1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, "http://a/3", BIG), (2, "http://a/2", SMALL), (4, "http://a/4", SMALL),
    (6, None, None), (7, "http://a/7 b\r\nc", ""), (None, "http://a/n", BIG), (None, None, "é" * 999), (8, "http://a/8", "é" * 999),
    (9, "http://a/9", "head\r\n\r\nbody " * 3), (9, "http://a/9", "head\r\n\r\nbody " * 3), (10, "http://a/10", "y" * 300_000), (5, "http://b/5", BIG),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], "page_id long, url string, html string, digest string, refers_to string")


def brute():
    out = []
    for page, _, html in ROWS:
        payload = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "").encode() == payload and p is not None]
        last = max(same, default=None)
        again = len(payload) >= 1000 and last is not None and page != last
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


def test_round_trip_matches_brute_force(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.resolved(warc.read_archive(spark, str(tmp_path / "a"))).collect()
    assert sorted(map(tuple, got), key=repr) == brute()


def test_payloads_and_urls_come_back(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "a"))
    got = {(r["page_id"], r["url"], bytes(r["payload"])) for r in warc.read_archive(spark, str(tmp_path / "a")).collect() if r["record_type"] == "response"}
    assert (10, "http://a/10", b"y" * 300_000) in got and (6, None, b"") in got and (7, "http://a/7%20b%0D%0Ac", b"") in got


def files(path):
    return {os.path.basename(f): open(f, "rb").read() for f in glob.glob(f"{path}/data/*.warc.gz")}


def test_same_bytes_again_rolled_by_compressed_size(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for name in "ab":
        warc.write_archive(pages, str(tmp_path / name), roll_bytes=20_000)
    first, second = files(tmp_path / "a"), files(tmp_path / "b")
    assert first == second and len(first) > 10
    manifest = spark.read.parquet(str(tmp_path / "a" / "manifest")).orderBy("shard", "name").collect()
    assert {r["name"]: (r["bytes"], r["sha256"]) for r in manifest} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in first.items()}
    assert all(a["last_page"] < b["first_page"] for a, b in zip(manifest, manifest[1:]))
    # A file is closed once it is past the limit, so it is past it by at most its last record.
    assert max(len(b) for b in first.values()) < 20_000 + max(len(gzip.compress(r["html"].encode())) for r in pages.collect()) + 1000
    assert not glob.glob(f"{tmp_path}/a/data/*.tmp")


def test_only_files_of_the_manifest_count(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "a"))
    for stray in ("_part-00000-00000.warc.gz.77.tmp", "part-99999-00000.warc.gz"):
        (tmp_path / "a" / "data" / stray).write_bytes(b"left by a lost task")
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == len(ROWS)


def test_damage_is_noticed():
    data = warc.record(1, "http://a", b"payload", None)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload\r\n", b"pAyload\r\n"))
    whole = gzip.compress(data) + gzip.compress(data)
    assert list(warc.records(io.BytesIO(whole), read_bytes=7)) == [data, data]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(whole[:-20]), read_bytes=7))


def test_empty_table(spark, pages, tmp_path):
    warc.write_archive(pages.limit(0), str(tmp_path / "a"))
    assert warc.resolved(warc.read_archive(spark, str(tmp_path / "a"))).count() == 0
