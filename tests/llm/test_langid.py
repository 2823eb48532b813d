import zlib

from odd_rows import ODD_ROWS
from tapewright.llm import langid

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 150
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_held_out_fold(spark):
    got = langid.identify(spark.read.parquet(f"{DIR}/documents.parquet")).select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_odd_rows(odd_docs):
    profiles = langid.Profiles({"en": langid.profile("some english text with the usual words of the language")[0], "aa": langid.profile("zzz qqq")[0]})
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd_docs, profiles).collect()), key=repr)
    assert len(got) == len(ODD_ROWS)
    by_id = {}
    for i, lang, score in got:
        by_id.setdefault(i, set()).add((lang, score))
    assert by_id[1] == {("und", 0.0)} and by_id[3] == {("und", 0.0)} and by_id[11] == {("und", 0.0)}
    assert all(lang == "en" for lang, _ in by_id[7] | by_id[8])


def test_without_a_learned_language(odd_docs, no_docs):
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(odd_docs).collect()} == {("und", 0.0)}
    assert langid.identify(no_docs).count() == 0
    assert langid.accepted(odd_docs).count() == odd_docs.count()


def test_rank_order_distance_by_hand():
    p = langid.Profiles({"x": langid.profile("aab")[0]})
    codes, counts = langid.profile("aab")
    # Words and their ends, here as blanks: a a b, ␣a aa ab b␣, ␣aa aab ab␣. Ties by code.
    assert codes[0] == ord("a") and counts.tolist() == [2] + [1] * 8 and codes[1:].tolist() == sorted(codes[1:].tolist())
    assert p.distances(codes) == [0.0]
    assert p.nearest("zzz")[1] == 0.0
    assert p.nearest(None) == ("und", 0.0)


def test_rejected_documents_go_and_the_others_keep_their_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    junk = spark.createDataFrame([(10**7, "$$$ ### 12 !!", "en", "s", 1), (10**7 + 1, None, None, "s", 0)], docs.schema)
    got = langid.accepted(docs.unionByName(junk))
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
