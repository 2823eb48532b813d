import re

import pytest

from tapewright.llm import url_filter as U

URLS = [
    (1, "http://WWW.Example.com/en/1?q#f"), (2, "https://a.example.com/en/"), (3, "https://example.com/de/x"), (4, "http://x.net/es/1"), (5, "http://x.net/fr/"),
    (6, "http://x.net/en/1"), (7, None), (8, ""), (9, "no scheme/here"), (10, "http://com/"), (11, "http://com"), (12, "http://notcom/"), (13, "x://a.com?u=b://c.net/es/"),
    (14, "http://h#://x/y"), (15, "http://user@Host.NET:80/es/é\nz?"), (None, "http://x.org/"), (4, "http://x.net/es/1"), (16, "http://" + "a" * 20000 + ".org/" + "b" * 20000),
    (17, "http://fakeexample.com/en/1"), (18, "http://www.example.com/en"), (19, "://"), (20, "http:///path"),
]


def brute(url):
    """Host, path, rule and its verdict, by the words of the contract."""
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*u, "clash", "clash") for u in URLS], "page_id long, url string, host string, features string")


def test_rules_match_brute_force(pages):
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages).collect()), key=repr)
    want = sorted(((i, *brute(u)) for i, u in URLS), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4] == w[4] if w[4] else g[4] in ("allow", "block") for g, w in zip(got, want))


def test_pages_of_the_tables_match_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in pages.select("page_id", "url").collect()}
    got = U.judge(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["p_block"] >= 0.5 else "allow"))


def test_model_on_urls_it_has_not_seen(spark):
    urls = [
        ("https://casino-slots-win.example.org/free", "block"), ("http://hot-porn-videos.example.net/sex", "block"), ("http://viagra-cheap.example.org/pills", "block"),
        ("https://library.college.example.org/courses", "allow"), ("https://weather.example.org/en/123", "allow"), ("https://docs.compiler.example.org/wiki/index.html", "allow"),
    ]
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.judge(df, rules=[]).collect()}
    assert [got[k] for k in range(len(urls))] == [v for _, v in urls]


def test_own_table_and_empty_table(spark, pages):
    labelled = spark.createDataFrame([("http://good.org/a", 0), ("http://bad.org/zzzz", 1), (None, 1), ("x", None)], "url string, label int")
    got = U.judge(spark.createDataFrame([(1, "http://bad.org/zzzz"), (2, "http://good.org/a")], "page_id long, url string"), labelled, rules=[])
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "allow"}
    assert U.judge(pages.limit(0)).count() == 0
