"""Jobs over landed folders and tables: ``python -m tapewright.jobs <job> ...``."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.functions.contract import contract_expiry, contract_right, contract_symbol
from tapewright.functions.measures import implied_sign
from tapewright.operators import capture, chain, coverage, events, flow, history, study, tape
from tapewright.operators.ranking import first_per_key
from tapewright.plans import collection, feature_table, ingest, partials, screening
from tapewright.schemas import CHAIN, FEATURE_COLUMNS, FEATURE_FLAGS
from tapewright.session import build_session, materialize, read_if_present, scratch_path, scratch_scope, sized
from tapewright.sources import compaction, files, readers, sinks
from tapewright.streaming import polls

# Options that name a folder a job reads.
INPUTS = ("landing", "table", "volumes", "captured", "chains", "bars", "quotes", "pushed")


def ingest_ticks(spark: SparkSession, landing: str, table: str) -> dict[str, DataFrame]:
    """Ticks of new and changed files, of their file's session and not in the table yet, appended to it.

    Returns rows kept and refused per session, and the files that no run could read in their present or an earlier state.
    """
    counts = ingest.ingest_changed(spark, landing, table)
    noted = read_if_present(spark, ingest.note_path(table, ingest.UNREADABLE))
    unreadable = {} if noted is None else {"unreadable": noted.select("file").distinct()}
    return unreadable if counts is None else {"sealed": counts, **unreadable}


def stream_ticks(
    spark: SparkSession, landing: str, table: str, checkpoint: str, watch_list: str | None = None, collected: str | None = None, once: bool = False
) -> None:
    """The same as a stream that flushes every minute; runs until stopped, with ``once`` until all that has landed is in.

    With ``watch_list`` only ticks of watched contracts are kept. The list starts with the collector's first picks in
    ``collected`` and takes in its re-pick some time after the first tick.
    """
    keep = None
    if watch_list is not None:
        if read_if_present(spark, watch_list) is None:
            polls.start_watch(watch(spark, collected)["watch"], watch_list)
        keep = lambda rows: polls.watched_ticks(rows, watch_list, lambda: watch(spark, collected)["additions"])
    ingest.ingest_stream(spark, landing, table, checkpoint, seconds=None if once else P.FLUSH_SECONDS, keep=keep).awaitTermination()


def compact(spark: SparkSession, table: str) -> None:
    """Small files of the tape packed into larger ones; finishes a run that broke."""
    print(f"{compaction.compact(spark, table)} files replaced")


def ingest_chains(spark: SparkSession, landing: str, table: str) -> DataFrame:
    """Landed chain snapshots; the partition of a symbol and day is replaced. Returns contracts per symbol."""
    snapshot = readers.read_landed_chains(spark, landing)
    sinks.replace_partitions(snapshot, table)
    return chain.snapshot_totals(snapshot)


def ingest_history(spark: SparkSession, landing: str, table: str) -> None:
    """Landed symbol histories, every day ever seen kept, newest values winning."""
    stat, vol = readers.read_symbol_history(spark, landing)
    for name, rows in (("stat", stat), ("vol", vol)):
        order = [c for c in rows.columns if c not in ("symbol", "time")]
        sinks.upsert(rows, f"{table}/{name}", ["symbol", "time"], order)


def build_features(spark: SparkSession, table: str, out: str, csv: bool = False) -> dict[str, DataFrame]:
    """Feature table and, apart from it, the outcome table. Returns the profile of the features."""
    stat, vol = (spark.read.parquet(f"{table}/{name}") for name in ("stat", "vol"))
    rows = materialize(history.join_history(stat, vol), "history")
    features = materialize(feature_table.feature_table(rows), "features")
    sinks.write_features(features, f"{out}/features", csv)
    feature_table.outcome_table(rows).write.mode("overwrite").parquet(f"{out}/outcomes")
    measured = [c for c in FEATURE_COLUMNS if c not in FEATURE_FLAGS]
    return {
        "range": feature_table.date_range(features),
        "splits": history.split_counts(features),
        "missing": history.missing_rates(features, measured),
        "oi": history.oi_validity(features),
        "absent": history.missing_sources(P.UNIVERSE, stat, vol),
    }


def watch(spark: SparkSession, landing: str, push: bool = False) -> dict[str, DataFrame]:
    """The contracts to watch, most liquid per ticker, from the collector's latest snapshots, and what its re-pick adds."""
    picked = readers.read_collector_chains(spark, landing)
    latest = picked.groupBy("symbol").agg(F.max("snap_date").alias("snap_date"))
    today = materialize(picked.join(latest, ["symbol", "snap_date"]), "collector-snapshots")
    n = P.WATCH_PUSH if push else P.WATCH_POLLING
    first, again = (chain.liquid_contracts(today.filter(F.col("tag") == tag), n=n) for tag in ("collector", "collector_repick"))
    return {"watch": first.select("symbol", "code", "volume_rank"), "additions": chain.watch_additions(again, first)}


def universe(spark: SparkSession, table: str, quotes: str) -> DataFrame:
    """Contracts nearest the last price of their underlying, of each ticker's latest snapshot within the days that count."""
    chains = spark.read.parquet(table)
    latest = chains.groupBy("symbol").agg(F.max("snap_date").alias("snap_date"))
    polled = readers.read_underlying(spark, quotes).withColumn("symbol", F.substring("code", 4, 32))
    spot = polled.groupBy("symbol").agg(F.max_by("last_price", "poll_time").alias("spot"))
    near = chains.join(latest, ["symbol", "snap_date"]).filter(F.col("option_expiry_date_distance") <= P.MAX_DTE)
    return chain.contract_universe(chain.nearest_strikes(near, spot))


def compare_feeds(spark: SparkSession, table: str, pushed: str) -> dict[str, DataFrame]:
    """Ticks of the polled and of the pushed tape per contract and day."""
    return {"feeds": coverage.feed_comparison(*(readers.read_tape(spark, path) for path in (table, pushed)))}


def bars(spark: SparkSession, bars: str) -> DataFrame:
    """Minute bars per symbol and day: count, first and last."""
    return coverage.bars_inventory(readers.read_bars(spark, bars))


def screen(spark: SparkSession, table: str, tickers: list[str]) -> DataFrame:
    """Top calls and puts of the tickers, each on its own latest snapshot day."""
    chains = spark.read.parquet(table)
    latest = chains.groupBy("symbol").agg(F.max("snap_date").alias("snap_date"))
    return screening.screen_tickers(chains.join(latest, ["symbol", "snap_date"]), tickers).orderBy(
        "symbol", "option_type", "screen_rank"
    )


def check_capture(spark: SparkSession, table: str, volumes: str, out: str, as_of: dt.date) -> None:
    """Measure past days that are new or whose files changed: contract rows and nested day records."""
    now = files.partition_fingerprints(spark, table).filter(F.col("day") < F.lit(as_of))
    known = read_if_present(spark, f"{out}/days")
    todo = materialize(now if known is None else capture.changed_days(now, known), "capture-todo")
    rows = readers.read_tape(spark, table).withColumn("day", F.col("trade_date"))
    rows = rows.join(todo.select("day"), "day", "left_semi")
    measured = capture.capture_contracts(rows, readers.read_daily_volume(spark, volumes))
    measured = materialize(measured, "capture-contracts")
    sample = chain.busiest_contracts(rows, ["day", "symbol"])
    records = capture.capture_records(capture.sample_contracts(measured, sample))
    sinks.replace_partitions(measured, f"{out}/contracts", ["day"])
    sinks.write_capture(records.join(todo.select("day", "fingerprint"), "day"), f"{out}/days")


def event_contracts(spark: SparkSession, captured: str) -> DataFrame:
    """Measured contracts of the event symbols: capture of other symbols decides nothing."""
    contracts = spark.read.parquet(f"{captured}/contracts")
    return contracts.filter(contract_symbol(F.col("code")).isin(P.EVENT_SYMBOLS))


def qualified_events(spark: SparkSession, table: str, captured: str) -> DataFrame:
    contracts = event_contracts(spark, captured)
    found = flow.cluster_events(readers.read_tape(spark, table), ["code", "symbol", "trade_date"])
    ours = found.filter(F.col("symbol").isin(P.EVENT_SYMBOLS)).withColumnRenamed("trade_date", "day")
    return events.qualify_events(ours, capture.capture_days(contracts), contracts)


def status(spark: SparkSession, table: str, captured: str, chains: str, as_of: dt.date) -> dict[str, DataFrame]:
    """Daily detail, alerts, progress and event distributions of the collection."""
    rows = readers.read_tape(spark, table).filter(F.col("symbol").isin(P.EVENT_SYMBOLS))
    days = materialize(capture.capture_days(event_contracts(spark, captured)), "capture-days")
    found = materialize(qualified_events(spark, table, captured), "events")
    snaps = spark.read.parquet(chains).select(F.col("snap_date").alias("day"), "symbol")
    collected = materialize(rows.select(F.col("trade_date").alias("day")).distinct(), "days")
    on_valid = events.valid_days(found, P.EXPERIMENT_START)
    counted = on_valid.filter("qualified = 1")
    size = len(P.UNIVERSE)
    return {
        "detail": collection.daily_detail(rows, found, days, snaps, P.EVENT_SYMBOLS, size).orderBy(F.desc("day")),
        "alerts": events.quality_alerts(collected, days, snaps, as_of, size).orderBy("day", "kind"),
        "progress": events.progress(found, days, as_of),
        "hours": events.hour_histogram(on_valid).orderBy("hour"),
        "sizes": events.notional_histogram(counted).orderBy("bucket_order"),
        "symbols": events.events_by(counted, ["symbol"]),
        "depth": coverage.snapshot_depth(snaps),
    }


def summary(spark: SparkSession, table: str, store: str) -> DataFrame:
    """Span, contracts, prints and events of every day and event symbol; only days whose files changed are read again."""
    ours = lambda rows: rows.filter(F.col("symbol").isin(P.EVENT_SYMBOLS))
    return partials.refreshed(spark, table, store, lambda rows: collection.day_summary(ours(rows)))


def polled(spark: SparkSession, quotes: str) -> DataFrame:
    """Last price of each underlying and how often it was polled, from polled quotes."""
    rows = readers.read_underlying(spark, quotes)
    return rows.groupBy("code").agg(F.max_by("last_price", "poll_time").alias("last_price"), F.count(F.lit(1)).alias("polls"))


def chain_pages(spark: SparkSession, pages: list[str]) -> DataFrame:
    """Chain pages that were fetched into folders of their own as one chain, a contract once where pages overlap."""
    rows = readers.read_pages(spark, CHAIN, pages)
    return chain.distinct_contracts(rows, [c for c in rows.columns if c != "code"])


def day(spark: SparkSession, table: str, captured: str, on: dt.date) -> dict[str, DataFrame]:
    """One collection day: summary per symbol and its events, largest first."""
    rows = readers.read_tape(spark, table).filter((F.col("trade_date") == F.lit(on)) & F.col("symbol").isin(P.EVENT_SYMBOLS))
    return {
        "summary": collection.full_day_summary(collection.day_summary(rows), P.EVENT_SYMBOLS),
        "events": events.events_of_day(qualified_events(spark, table, captured), on),
    }


def missing_bars(spark: SparkSession, table: str, bars: str) -> DataFrame:
    """Collection days and event symbols without minute bars."""
    days = readers.read_tape(spark, table).select(F.col("trade_date").alias("day"))
    return coverage.missing_bars(days, readers.read_bars(spark, bars)).orderBy("day", "symbol")


def run_study(
    spark: SparkSession, table: str, captured: str, bars: str, as_of: dt.date, seed: int = 0, label: str = "start"
) -> dict[str, DataFrame]:
    """The event study over contracts with more than a day left and a gap-free tape, refused until the stopping rule is met."""
    found = materialize(qualified_events(spark, table, captured), "events")
    days = capture.capture_days(event_contracts(spark, captured))
    if not events.progress(found, days, as_of).first()["stop"]:
        raise ValueError("the stopping rule is not met; outcomes stay sealed")
    counted = events.valid_days(found, P.EXPERIMENT_START).filter("qualified = 1").withColumn("trade_date", F.col("day"))
    checks = tape.gap_free(readers.read_tape(spark, table))
    counted = events.eligible_clusters(counted, contract_expiry(F.col("code")), checks).drop("trade_date")
    signed = counted.withColumn("sign", implied_sign(contract_right(F.col("code")), F.col("direction")))
    minutes = readers.read_bars(spark, bars).select("symbol", "minute", "close")
    minutes = first_per_key(minutes, ["symbol", "minute"], ["close"])  # fetched pages may overlap
    returns = study.minute_returns(study.minute_grid(minutes, day_end_minute=16 * 60 - 1, label=label))
    matched = study.matched_controls(study.event_returns(signed, returns), ["code", "time", "direction"], seed=seed)
    excess = materialize(study.event_excess(matched).drop("controls"), "excess")
    return {"symbols": study.study_by_symbol(excess), "decision": study.study_decision(excess, P.EVENT_SYMBOLS)}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tapewright")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, run, *paths: str, **options) -> None:
        sub = jobs.add_parser(name, help=run.__doc__)
        for path in paths:
            sub.add_argument(path)
        sub.add_argument("--results", help="folder for the job's result tables; a fresh one of the shared folder by default")
        for option, settings in options.items():
            sub.add_argument(f"--{option.replace('_', '-')}", **settings)
        sub.set_defaults(run=run)

    date = {"type": dt.date.fromisoformat, "required": True}
    job("ingest-ticks", ingest_ticks, "landing", "table")
    job("stream-ticks", stream_ticks, "landing", "table", "checkpoint", watch_list={}, collected={}, once={"action": "store_true"})
    job("compact", compact, "table")
    job("ingest-chains", ingest_chains, "landing", "table")
    job("ingest-history", ingest_history, "landing", "table")
    job("features", build_features, "table", "out", csv={"action": "store_true"})
    job("screen", screen, "table", tickers={"nargs": "+", "required": True})
    job("watch", watch, "landing", push={"action": "store_true"})
    job("universe", universe, "table", "quotes")
    job("feeds", compare_feeds, "table", "pushed")
    job("bars", bars, "bars")
    job("capture", check_capture, "table", "volumes", "out", as_of=date)
    job("status", status, "table", "captured", "chains", as_of=date)
    job("summary", summary, "table", "store")
    job("polled", polled, "quotes")
    job("pages", chain_pages, pages={"nargs": "+", "required": True})
    job("day", day, "table", "captured", on=date)
    job("missing-bars", missing_bars, "table", "bars")
    bar = {"choices": ["start", "end"], "default": "start"}
    job("study", run_study, "table", "captured", "bars", as_of=date, seed={"type": int, "default": 0}, label=bar)
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    options = vars(_parser().parse_args(arguments))
    run, name, results = options.pop("run"), options.pop("job"), options.pop("results")
    session = spark or build_session(f"tapewright-{name}")
    results = results or scratch_path(session, f"{name}-results")
    folders = [v for k, v in options.items() if isinstance(v, str) and k in INPUTS]
    with sized(session, files.total_bytes(session, folders)), scratch_scope(session):
        result = run(session, **options)
        frames = result if isinstance(result, dict) else {name: result} if result is not None else {}
        for title, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{results}/{title}")
            print(f"{title}: {session.read.parquet(f'{results}/{title}').count()} rows in {results}/{title}")


if __name__ == "__main__":
    main()
