"""Landed files in, partitioned tables out."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tapewright import schemas as S
from tapewright.operators.capture import capture_contracts, capture_records, changed_days
from tapewright.operators.columns import conform, keep_listed, require
from tapewright.sources import files, readers, sinks

TICK_HEADER = "name,sequence,code,time,price,volume,turnover,ticker_direction,trade_date"


def land(path, name, header, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join([header, *rows]) + "\n")


def test_landed_ticks_match_columns_by_name(spark, tmp_path):
    d = str(tmp_path / "ticks")
    land(d, "US_TSLA260821C250000_2026-08-12.csv", TICK_HEADER, ["x,5,US.TSLA260821C250000,2026-08-12 09:30:00.125,2.5,10,2500,BUY,2026-08-12"])
    land(d, "US_NVDA260821P9500_2026-08-12.csv", TICK_HEADER, ["x,5,US.NVDA260821P9500,2026-08-12 09:31:00,n/a,1,95,SELL,2026-08-12"])
    got = {r.symbol: r for r in readers.read_landed_ticks(spark, d).collect()}
    a, b = got["TSLA"], got["NVDA"]
    assert (a.code, a.sequence, a.price, a.volume, a.ticker_direction) == ("US.TSLA260821C250000", 5, 2.5, 10.0, "BUY")
    assert a.time == "2026-08-12 09:30:00.125" and a.ts == dt.datetime(2026, 8, 12, 9, 30, 0, 125000)
    assert a.file_code == a.code and a.file_day == a.trade_date == dt.date(2026, 8, 12)
    assert b.price is None and b.turnover == 95.0


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    d = str(tmp_path / "mixed")
    land(d, "US_A260821C1_2026-08-12.csv", "code,time,price,sequence", ["c,t,1,5"])
    land(d, "US_B260821C1_2026-08-12.csv", "Sequence,name,time,code,price", ['6,"a, ""b""",t,c,2'])
    land(d, "US_C260821C1_2026-08-12.csv", "code,price", ["c,3"])
    got = sorted((r.file_code, r.code, r.time, r.price, r.sequence) for r in readers.read_landed_ticks(spark, d).collect())
    assert got == [("US.A260821C1", "c", "t", 1.0, 5), ("US.B260821C1", "c", "t", 2.0, 6)]
    assert [r.file.rsplit("/", 1)[-1] for r in readers.unreadable_files(spark, d, readers.TICK_HEADER).collect()] == ["US_C260821C1_2026-08-12.csv"]


def test_records_with_quoted_line_breaks_are_one_row(spark, tmp_path):
    d = str(tmp_path / "breaks")
    land(d, "US_A260821C1_2026-08-12.csv", "code,time,name,sequence", ['c,t,"two,\nlines ""x""\n\nmore",5', 'c,u,"one, line",6', 'c,v,plain,7'])
    land(d, "US_B260821C1_2026-08-12.csv", "sequence,name,code,time", ['8,"a, ""b""",c,w', '9,"\n\n",c,x'])
    land(d, "US_C260821C1_2026-08-12.csv", "code,time,sequence", ["c,y,10"])
    got = sorted((r.file_code, r.time, r.sequence) for r in readers.read_landed_ticks(spark, d).collect())
    assert got == [("US.A260821C1", "t", 5), ("US.A260821C1", "u", 6), ("US.A260821C1", "v", 7), ("US.B260821C1", "w", 8), ("US.B260821C1", "x", 9), ("US.C260821C1", "y", 10)]
    land(d + "/chain", "US_T_2026-08-12.csv", "option_type,code", ['"CALL,\n""x""",US.T260821C1'])
    assert readers.read_landed_chains(spark, d + "/chain").first().option_type == 'CALL,\n"x"'


def test_capture_cache_of_one_object(spark, tmp_path):
    entry = '{"overall": 97.5, "contracts": {"US.T260821C1": 99.0, "US.T260821C2": 90.5}, "below_threshold": ["US.T260821C2"], "sampled": 2, "failed_calls": 0, "fingerprint": "2:17", "checked_at": "2026-08-13T10:00:00"}'
    path = tmp_path / "capture_cache.json"
    path.write_text('{\n "2026-08-12": ' + entry + ',\n "2026-08-13": {"overall": 0, "contracts": {}, "sampled": 0}\n}')
    read = readers.read_capture_cache(spark, str(path))
    got = {str(r.day): r for r in read.collect()}
    assert set(got) == {"2026-08-12", "2026-08-13"} and got["2026-08-13"].contracts == {} and got["2026-08-13"].fingerprint is None
    assert got["2026-08-12"].checked_at == dt.datetime(2026, 8, 13, 10) and got["2026-08-12"].below_threshold == ["US.T260821C2"]
    sinks.write_capture_cache(read, str(tmp_path / "again"))
    assert sorted(map(str, readers.read_capture_cache(spark, str(tmp_path / "again")).collect())) == sorted(map(str, got.values()))


def test_files_of_one_writer_with_another_header_fail(spark, tmp_path):
    d = str(tmp_path / "mixed")
    land(d, "a.csv", "code,day,volume", ["c,2026-08-12,1"])
    land(d, "b.csv", "day,code,volume", ["2026-08-12,c,1"])
    with pytest.raises(Exception):
        readers.read_daily_volume(spark, d).collect()


def test_chain_intraday_underlying_bars_and_volume(spark, tmp_path):
    d = str(tmp_path)
    land(d + "/snap", "US_TSLA_2026-08-12.csv", "option_type,code,option_strike_price,bogus", ["CALL,US.TSLA260821C250000,250,9"])
    land(d + "/snap", "US_NVDA_2026-08-12_collector_repick.csv", "option_type,code,option_strike_price,bogus", ["PUT,US.NVDA260821P9500,9.5,9"])
    chain = {r.symbol: r for r in readers.read_landed_chains(spark, d + "/snap").collect()}
    assert chain["TSLA"].option_strike_price == 250.0 and chain["TSLA"].expiry == dt.date(2026, 8, 21) and set(chain) == {"TSLA"}
    picked = readers.read_collector_chains(spark, d + "/snap").first()
    assert (picked.symbol, picked.tag, picked.snap_date, picked.option_delta) == ("NVDA", "collector_repick", dt.date(2026, 8, 12), None)
    land(d + "/intra", "US_TSLA_2026-08-12.csv", "code,bid_vol,snap_time", ["US.TSLA260821C250000,7,2026-08-12 10:00:00"])
    assert readers.read_landed_intraday(spark, d + "/intra").first().snap_time == "2026-08-12 10:00:00"
    land(d + "/under", "US_TSLA_2026-08-12.csv", "code,last_price,poll_time", ["US.TSLA,301.5,2026-08-12T10:00:00"])
    assert readers.read_underlying(spark, d + "/under").first().last_price == 301.5
    land(d + "/bars", "US_TSLA_2026-08-12.csv", "code,time_key,close", ["US.TSLA,2026-08-12 09:31:00,300.25"])
    bar = readers.read_bars(spark, d + "/bars").first()
    assert (bar.symbol, bar.day, bar.minute, bar.close) == ("TSLA", dt.date(2026, 8, 12), dt.datetime(2026, 8, 12, 9, 31), 300.25)
    land(d + "/vol", "v.csv", "code,day,volume", ["c,2026-08-12,5"])
    assert readers.read_daily_volume(spark, d + "/vol").first().volume == 5.0


def test_pages_with_different_headers_become_one_table(spark, tmp_path):
    d = str(tmp_path)
    land(d + "/p1", "a.csv", "code,day,volume", ["c,2026-08-12,5"])
    land(d + "/p2", "b.csv", "volume,code", ["6,d"])
    got = readers.read_pages(spark, S.DAILY_VOLUME, [d + "/p1", d + "/p2"]).orderBy("code").collect()
    assert [tuple(r) for r in got] == [("c", dt.date(2026, 8, 12), 5.0), ("d", None, 6.0)]


def test_symbol_history_from_file_names(spark, tmp_path):
    d = str(tmp_path / "hist")
    land(d, "US_TSLA_stat.csv", "time,option_open_interest,put_call_volume_ratio,name", ["2026-08-12,10,N/A,x"])
    land(d, "US_TSLA_vol.csv", "time,iv,hv", ["2026-08-12,0.5,0.25"])
    from tapewright.operators.history import join_history

    r = join_history(*readers.read_symbol_history(spark, d)).first()
    assert (r.symbol, r.date, r.option_oi, r.pc_volume_ratio, r.iv) == ("TSLA", dt.date(2026, 8, 12), 10.0, None, 0.5)


def test_append_and_replace(spark, tmp_path):
    path = str(tmp_path / "tape")
    rows = spark.createDataFrame([(dt.date(2026, 8, 12), s, i) for s in "AB" for i in range(3)], "trade_date date, symbol string, x int")
    sinks.append_tape(rows, path)
    sinks.append_tape(rows, path)
    assert spark.read.parquet(path).count() == 12
    snap = str(tmp_path / "snap")
    sinks.replace_partitions(rows, snap, ["trade_date", "symbol"])
    sinks.replace_partitions(rows.filter("symbol = 'A' and x = 1"), snap, ["trade_date", "symbol"])
    assert {r.symbol: r["count"] for r in spark.read.parquet(snap).groupBy("symbol").count().collect()} == {"A": 1, "B": 3}


def test_upsert_only_touches_its_partitions(spark, tmp_path):
    path = str(tmp_path / "hist")
    a = spark.createDataFrame([("T", "d1", 1.0), ("T", "d2", 2.0), ("U", "d1", 5.0)], "symbol string, time string, x double")
    b = spark.createDataFrame([("T", "d2", 9.0), ("T", "d3", 3.0)], "symbol string, time string, x double")
    sinks.upsert(a, path, ["symbol", "time"], ["x"])
    before = {f for f in os.listdir(path + "/symbol=U")}
    sinks.upsert(b, path, ["symbol", "time"], ["x"])
    got = sorted((r.symbol, r.time, r.x) for r in spark.read.parquet(path).collect())
    assert got == [("T", "d1", 1.0), ("T", "d2", 9.0), ("T", "d3", 3.0), ("U", "d1", 5.0)]
    assert {f for f in os.listdir(path + "/symbol=U")} == before


def test_fingerprints_find_changed_days(spark, tmp_path):
    d = str(tmp_path / "ticks")
    for day in ("2026-08-11", "2026-08-12"):
        land(d, f"US_TSLA260821C250000_{day}.csv", TICK_HEADER, [])
    cached = spark.createDataFrame(files.tick_file_fingerprints(spark, d).collect())
    assert changed_days(files.tick_file_fingerprints(spark, d), cached).count() == 0
    land(d, "US_NVDA260821P9500_2026-08-12.csv", TICK_HEADER, [])
    later = time.time() + 50
    os.utime(f"{d}/US_TSLA260821C250000_2026-08-11.csv", (later, later))
    got = sorted(str(r.day) for r in changed_days(files.tick_file_fingerprints(spark, d), cached).collect())
    assert got == ["2026-08-11", "2026-08-12"]
    path = str(tmp_path / "tape")
    sinks.append_tape(spark.createDataFrame([(dt.date(2026, 8, 12), "A", 1)], "trade_date date, symbol string, x int"), path)
    assert [(str(r.day), r.files) for r in files.partition_fingerprints(spark, path).collect()] == [("2026-08-12", 1)]


def test_capture_table(spark, tmp_path):
    path = str(tmp_path / "capture")
    def record(day, ours):
        schema = "day date, code string, volume double"
        return capture_records(capture_contracts(spark.createDataFrame([(day, "a", ours)], schema), spark.createDataFrame([(day, "a", 100.0)], schema)))
    sinks.write_capture(record(dt.date(2026, 8, 11), 50.0), path)
    sinks.write_capture(record(dt.date(2026, 8, 12), 60.0), path)
    sinks.write_capture(record(dt.date(2026, 8, 11), 99.0), path)
    got = {str(r.day): (r.overall, r.contracts, r.below_threshold) for r in readers.read_capture(spark, path).collect()}
    assert got == {"2026-08-11": (99.0, {"a": 99.0}, []), "2026-08-12": (60.0, {"a": 60.0}, ["a"])}


def test_capture_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"day":"2026-08-11","overall":99.5,"contracts":{"a":99.5},"below_threshold":[],"sampled":1}\n')
    r = readers.read_capture_json(spark, str(tmp_path / "c.json")).first()
    assert r.overall == 99.5 and r.contracts == {"a": 99.5}


def test_feature_sink_is_sorted_and_guarded(spark, tmp_path):
    df = spark.createDataFrame([("2026-08-12", "B", 1), ("2026-08-11", "B", 2), ("2026-08-11", "A", 3)], "date string, symbol string, x int")
    sinks.write_features(df.repartition(3), str(tmp_path / "f"), csv=True)
    lines = []
    for name in sorted(os.listdir(tmp_path / "f")):
        if name.startswith("part"):
            lines += [x for x in (tmp_path / "f" / name).read_text().split() if not x.startswith("date")]
    assert lines == ["2026-08-11,A,3", "2026-08-11,B,2", "2026-08-12,B,1"]
    with pytest.raises(ValueError):
        sinks.write_features(df.withColumn("ret_fwd_1d", F.lit(1)), str(tmp_path / "g"))


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("apple banana apple\ncherry apple banana\ncherry date egg fig\n")
    from tapewright.operators.text import text_stats, top_words

    docs = readers.read_text(spark, str(tmp_path / "a.txt"))
    r = text_stats(docs).first()
    assert (r.lines, r.words) == (3, 10)
    assert [(w.word, w.n) for w in top_words(docs).orderBy("word_rank").collect()] == [
        ("apple", 3), ("banana", 2), ("cherry", 2), ("date", 1), ("egg", 1),
    ]


def test_column_sets(spark):
    df = spark.createDataFrame([(1, "x")], "b int, z string")
    assert keep_listed(df, ["a", "b"]).columns == ["b"]
    assert conform(df, S.TEXT).columns == ["doc_id", "text"]
    assert require(df, ["b"]) is df


def test_capture_is_one_aggregate_of_both_sides(spark):
    """No join and no sort beside it; days and contracts of one side alone, or without a key, are left out."""
    schema = "day int, code string, volume double"
    ours = spark.createDataFrame([(1, "a", 40.0), (1, "a", 50.0), (1, "b", 5.0), (None, "a", 1.0), (3, "n", None)], schema)
    truth = spark.createDataFrame([(1, "a", 100.0), (2, "a", 7.0), (1, "b", 0.0), (None, "a", 1.0), (3, "n", 2.0)], schema)
    got = capture_contracts(ours, truth)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.day, r.code, r.our_volume, r.official_volume, r.pct, r.below_threshold) for r in got.collect()) == [(1, "a", 90.0, 100.0, 90.0, 1), (3, "n", None, 2.0, None, None)]


def test_touched_rows_are_not_shuffled_by_partition(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(1000).selectExpr("id", "cast(id % 2 as int) as part").write.partitionBy("part").parquet(path)
    new = spark.range(20_000_000).selectExpr("id", "cast(1 as int) + cast(id % 1 as int) as part")
    kept = sinks._touched(spark.read.parquet(path), new, ["part"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(r.id for r in kept.collect()) == list(range(1, 1000, 2))
