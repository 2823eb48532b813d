"""Jobs from landed files to reports."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tapewright import jobs
from tapewright.plans import ingest
from tapewright.schemas import TAPE
from tapewright.sources import readers

CODE = "US.TSLA260821C250000"


def land(path, name, header, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join([header, *rows]) + "\n")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("jobs"))
    header = "code,sequence,time,price,volume,turnover,ticker_direction"
    for day in ("2026-08-12", "2026-08-13"):
        rows = [f"{CODE},{i},{day} 10:00:00,1.5,10,200000,BUY" for i in (1, 2, 2)]
        rows += [f"{CODE},3,{day} 15:30:00,1.5,10,300000,SELL", f"{CODE},4,{day} 15:30:00,1.5,10,1,SELL", f"{CODE},9,2026-08-01 10:00:00,1,1,1,BUY"]
        land(f"{d}/landing", f"{CODE.replace('.', '_')}_{day}.csv", header, rows)
    land(f"{d}/volumes", "v.csv", "code,day,volume", [f"{CODE},2026-08-12,40", f"{CODE},2026-08-13,80"])
    chain = "code,option_type,option_strike_price,option_open_interest,option_implied_volatility,option_premium,option_delta,option_expiry_date_distance,bid_price,ask_price,volume"
    land(f"{d}/chains", "US_TSLA_2026-08-12.csv", chain, [f"{CODE},CALL,250,500,0.3,2.5,0.3,14,2.4,2.6,200", f"{CODE}9,CALL,250,50,0.3,2.5,0.3,14,2.4,2.6,200"])
    land(f"{d}/bars", "US_TSLA_2026-08-12.csv", "code,time_key,close", [f"US.TSLA,2026-08-12 {h:02d}:{m:02d}:00,{300 + h + m / 60}" for h in range(10, 16) for m in range(60)])
    stat = "time,underlying_price,option_volume,call_volume,put_volume,option_open_interest,call_open_interest,put_open_interest,put_call_volume_ratio,put_call_open_interest_ratio"
    days = [str(dt.date(2026, 6, 1) + dt.timedelta(days=i)) for i in range(25)]
    land(f"{d}/hist", "US_TSLA_stat.csv", stat, [f"{t},{100 + i},{i},1,1,{50 + i},1,1,N/A,1" for i, t in enumerate(days)])
    land(f"{d}/hist", "US_TSLA_vol.csv", "time,iv,hv", [f"{t},{0.3 + i % 3 / 10},0.2" for i, t in enumerate(days)])
    return d


def run(spark, root, *arguments):
    """Run a job; its result tables by name."""
    out = f"{root}/results-{arguments[0]}-{uuid.uuid4().hex}"
    jobs.main([*arguments, "--results", out], spark)
    return {name: spark.read.parquet(f"{out}/{name}") for name in (os.listdir(out) if os.path.exists(out) else ())}


def test_collection_jobs(spark, root):
    got = run(spark, root, "ingest-ticks", f"{root}/landing", f"{root}/tape")
    assert {(str(r.session), r.fresh_rows, r.stale_rows) for r in got["sealed"].collect()} == {("2026-08-12", 5, 1), ("2026-08-13", 5, 1)}
    # Sequence numbers start anew each day, and a second run finds no changed file.
    assert "sealed" not in run(spark, root, "ingest-ticks", f"{root}/landing", f"{root}/tape")
    assert spark.read.parquet(f"{root}/tape").count() == 8
    run(spark, root, "ingest-chains", f"{root}/chains", f"{root}/snaps")
    run(spark, root, "capture", f"{root}/tape", f"{root}/volumes", f"{root}/cap", "--as-of", "2026-08-20")
    got = run(spark, root, "status", f"{root}/tape", f"{root}/cap", f"{root}/snaps", "--as-of", "2026-08-20")
    assert set(got) == {"detail", "alerts", "progress", "hours", "sizes", "symbols", "depth"}
    assert "weekday without collection" not in {r.kind for r in got["alerts"].collect()} and got["progress"].count() == 1
    got = run(spark, root, "day", f"{root}/tape", f"{root}/cap", "--on", "2026-08-12")
    summary = {r.symbol: r for r in got["summary"].collect()}
    assert summary["TOTAL"].span == "5:30:00" and summary["GOOGL"].prints == 0
    assert {r.reason for r in got["events"].collect()} == {"counted", "after 15:00"}
    bars = {r.symbol for r in run(spark, root, "missing-bars", f"{root}/tape", f"{root}/bars")["missing-bars"].filter("day = '2026-08-12'").collect()}
    assert "NVDA" in bars and "TSLA" not in bars
    assert run(spark, root, "screen", f"{root}/snaps", "--tickers", "tsla")["screen"].first().code == CODE


def test_results_are_whole_and_intermediates_are_deleted(spark, root, tmp_path):
    rows = [(f"US.S{k}", k) for k in range(450)]
    landing = str(tmp_path / "landing")
    for day in range(150):
        date = dt.date(2026, 1, 1) + dt.timedelta(days=day)
        land(landing, f"US_TSLA261231C250000_{date}.csv", "code,sequence,time,price,volume,turnover,ticker_direction", [f"US.TSLA261231C250000,1,{date} 10:00:00,1,1,1,BUY"])
    before = set(os.listdir(str(tmp_path)))
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = set(os.listdir(shared))
    run(spark, root, "ingest-ticks", landing, f"{root}/long")
    got = run(spark, root, "missing-bars", f"{root}/long", f"{root}/bars")["missing-bars"]
    assert got.count() == len(rows)  # 150 days of three symbols
    assert set(os.listdir(str(tmp_path))) == before
    # The results of the two jobs are all that stays.
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared)) - held}
    assert left <= {"ingest-ticks-results", "missing-bars-results"}


def test_changed_files_alone_are_read_and_old_partitions_are_not(spark, root, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "tape")
    header = "code,sequence,time,price,volume,turnover,ticker_direction"
    name = lambda day: f"{CODE.replace('.', '_')}_{day}.csv"
    tick = lambda day, k: f"{CODE},{k},{day} 10:00:0{k},1,1,1,BUY"
    for day in ("2026-08-10", "2026-08-11"):
        land(landing, name(day), header, [tick(day, 1), tick(day, 2)])
    assert ingest.ingest_changed(spark, landing, table).count() == 2
    land(landing, name("2026-08-11"), header, [tick("2026-08-11", k) for k in (1, 2, 3)])
    changed = [r.path for r in ingest.changed_files(spark, landing, f"{table}_files").collect()]
    assert len(changed) == 1 and changed[0].endswith(name("2026-08-11"))
    counts = ingest.ingest_changed(spark, landing, table).collect()
    assert [(str(r.session), r.fresh_rows) for r in counts] == [("2026-08-11", 3)]
    assert spark.read.parquet(table).count() == 5
    held = spark.read.schema(TAPE).parquet(table).filter(F.col("trade_date").isin([dt.date(2026, 8, 11)]))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "trade_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_batch_and_stream_give_the_same_tape(spark, root, tmp_path):
    """Repeats, stale rows, several days and files with headers of their own, over several micro-batches."""
    landing = str(tmp_path / "landing")
    for k, day in enumerate(("2026-08-10", "2026-08-11", "2026-08-12")):
        header = ["code,sequence,time,price,volume,turnover,ticker_direction", "name,time,code,trade_date,sequence,turnover,volume,price,ticker_direction"][k % 2]
        rows = [(CODE, s, f"{day} 10:00:0{s}", 1.5, 10, 100 * s, "BUY") for s in (1, 2, 2, 3)] + [(CODE, 9, "2026-08-01 10:00:00", 1, 1, 1, "BUY")]
        lines = [
            f"{c},{s},{t},{p},{v},{u},{d}" if k % 2 == 0 else f'"Call, {s}",{t},{c},{day},{s},{u},{v},{p},{d}' for c, s, t, p, v, u, d in rows
        ]
        land(landing, f"{CODE.replace('.', '_')}_{day}.csv", header, lines)
    land(landing, "broken.csv", "what,ever", ["1,2"])
    ingest.ingest_changed(spark, landing, str(tmp_path / "batch"))
    ingest.ingest_stream(spark, landing, str(tmp_path / "stream"), str(tmp_path / "cp"), max_files=1, seconds=None).awaitTermination()
    batch, stream = (sorted(map(tuple, spark.read.schema(TAPE).parquet(str(tmp_path / n)).collect())) for n in ("batch", "stream"))
    assert batch == stream and len(batch) == 9
    assert [r.file.rsplit("/", 1)[-1] for r in readers.unreadable_files(spark, landing, readers.TICK_HEADER).collect()] == ["broken.csv"]


def test_study_is_sealed_until_the_rule_is_met(spark, root):
    arguments = ["study", f"{root}/tape", f"{root}/cap", f"{root}/bars"]
    with pytest.raises(ValueError, match="sealed"):
        jobs.main([*arguments, "--as-of", "2026-08-20"], spark)
    got = run(spark, root, *arguments, "--as-of", "2026-09-23")
    decision = got["decision"].first()
    # One symbol of the protocol's three has events: whatever its excess, that is no GO.
    assert decision.events == 1 and decision.symbols == 3 and decision.decision != "GO"


def test_watch_universe_feeds_and_bars(spark, root, tmp_path):
    header = "code,option_type,option_strike_price,option_premium,volume,option_expiry_date_distance"
    row = lambda strike, volume: f"US.TSLA260821C{strike}000,CALL,{strike},2.5,{volume},14"
    chains = str(tmp_path / "chains")
    land(chains, "US_TSLA_2026-08-12_collector.csv", header, [row(k, 100 - k) for k in range(1, 21)])
    land(chains, "US_TSLA_2026-08-11_collector.csv", header, [row(900, 1)])
    land(chains, "US_TSLA_2026-08-12_collector_repick.csv", header, [row(k, 100 + k) for k in range(1, 21)])
    got = run(spark, root, "watch", chains)
    assert [r.code for r in got["watch"].orderBy("volume_rank").collect()] == [f"US.TSLA260821C{k}000" for k in range(1, 13)]
    assert {r.code for r in got["additions"].collect()} == {f"US.TSLA260821C{k}000" for k in range(13, 21)}
    daily = str(tmp_path / "daily")
    land(daily, "US_TSLA_2026-08-12.csv", header, [row(k, 1) for k in range(1, 61)])
    run(spark, root, "ingest-chains", daily, str(tmp_path / "snaps"))
    land(str(tmp_path / "quotes"), "q.csv", "code,last_price,poll_time", ["US.TSLA,5,2026-08-12T10:00:00", "US.TSLA,40.2,2026-08-12T11:00:00"])
    near = run(spark, root, "universe", str(tmp_path / "snaps"), str(tmp_path / "quotes"))["universe"]
    assert {r.code for r in near.collect()} == {f"US.TSLA260821C{k}000" for k in range(31, 51)}
    run(spark, root, "ingest-ticks", f"{root}/landing", str(tmp_path / "tape"))
    feeds = run(spark, root, "feeds", str(tmp_path / "tape"), str(tmp_path / "tape"))["feeds"]
    assert {(r.polled_prints, r.difference) for r in feeds.collect()} == {(4, 0)}
    assert run(spark, root, "bars", f"{root}/bars")["bars"].first().bars == 360


def test_feature_jobs(spark, root):
    for _ in range(2):
        jobs.main(["ingest-history", f"{root}/hist", f"{root}/history"], spark)
    got = run(spark, root, "features", f"{root}/history", f"{root}/out")
    assert "NVDA" in {r[0] for r in got["absent"].collect()}
    assert any("pc_volume_ratio" in map(str, r) for r in got["missing"].collect()) or "pc_volume_ratio" in got["missing"].columns
    features = spark.read.parquet(f"{root}/out/features")
    assert features.count() == 25 and not [c for c in features.columns if "fwd" in c]
    assert "ret_fwd_5d" in spark.read.parquet(f"{root}/out/outcomes").columns
