"""Streams with state and timers of their own: silence alerts per key, repeats against a tape that is reloaded."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewright import params as P
from tapewright.operators.tape import SESSION_KEY
from tapewright.session import SETTINGS, ship_package

# Sequence numbers of a contract and day that share one state, so that a busy contract is spread over tasks.
BLOCK = 1 << 20

_SESSIONS = "firsts array<bigint>, lasts array<bigint>, ticks array<bigint>, late array<bigint>, newest bigint, timer bigint"
_MINUTE = 60_000_000


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def hold_state(spark: SparkSession) -> None:
    """Let streams that start from now on keep timers and values of their own, which Spark's default state store cannot.

    A checkpoint goes on with the store it began with; a store that was set on purpose stays.
    """
    if spark.conf.get(_PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, SETTINGS[_PROVIDER])


def minute_parts(stream: DataFrame, keys: Sequence[str], time: str = "ts") -> DataFrame:
    """Ticks of a key and minute added up within each task, so that a busy key is a row a minute in the shuffle.

    Columns: ``keys``, first and last (time of a tick), ticks.
    """
    by = list(keys)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            minute = batch[time].dt.floor("min").rename("_minute")
            grouped = batch.groupby([*by, minute], dropna=False)[time].agg(["min", "max", "size"]).reset_index()
            yield grouped.drop(columns="_minute").rename(columns={"min": "first", "max": "last", "size": "ticks"})

    held = stream.select(*by, time).filter(F.col(time).isNotNull())
    fields = [held.schema[k] for k in by] + [T.StructField("first", T.TimestampType()), T.StructField("last", T.TimestampType()), T.StructField("ticks", T.LongType())]
    return held.mapInPandas(add, T.StructType(fields))


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


class SilenceWatch(StatefulProcessor):
    """Sessions of ticks that are still open, with a timer at the end of the silence that closes the first of them."""

    def __init__(self, keys: Sequence[str], silence_us: int) -> None:
        self.keys, self.silence = list(keys), silence_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _SESSIONS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else ([], [], [], [], None, None)
        newest = held[4]
        sessions = [list(s) for s in zip(*held[:4])]
        seen = newest
        for part in rows:
            for first, last, ticks in zip(_micros(part["first"]).tolist(), _micros(part["last"]).tolist(), part["ticks"].tolist()):
                late = ticks if newest is not None and first // _MINUTE < newest // _MINUTE else 0
                sessions.append([first, last, ticks, late])
                seen = last if seen is None else max(seen, last)
        merged: list[list[int]] = []
        for first, last, ticks, late in sorted(sessions):
            if merged and first - merged[-1][1] < self.silence:
                before = merged[-1]
                merged[-1] = [before[0], max(before[1], last), before[2] + ticks, before[3] + late]
            else:
                merged.append([first, last, ticks, late])
        self._keep(merged, seen, held[5])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        firsts, lasts, ticks, late, newest, _ = self.open.get()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due, left = [], []
        for session in zip(firsts, lasts, ticks, late):
            (due if self._expiry(session[1]) <= now else left).append(list(session))
        self._keep(left, newest, None)
        if due:
            times = [[pd.Timestamp(us, unit="us") for us in (s[0], s[1], s[1] + self.silence)] for s in due]
            rows = [[*key, *t, s[2], s[3]] for t, s in zip(times, due)]
            yield pd.DataFrame(rows, columns=[*self.keys, "first_tick", "last_tick", "alert_time", "ticks", "late_ticks"])

    def _expiry(self, last: int) -> int:
        return -(-(last + self.silence) // 1000)

    def _keep(self, sessions: list[list[int]], newest: int, timer: int | None) -> None:
        first = min((self._expiry(s[1]) for s in sessions), default=None)
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.open.update((*([s[k] for s in sessions] for k in range(4)), newest, first))


def silence_watch(
    stream: DataFrame, keys: Sequence[str] = ("symbol",), minutes: int = P.SILENCE_MINUTES, delay: str = "10 minutes", time: str = "ts"
) -> DataFrame:
    """One row per silence of a key, once, while the key is still silent: no later tick of its own is needed.

    A timer fires when the watermark, which the ticks of all keys move, passes ``minutes`` after the last tick of the
    first open session of a key. Columns: ``keys``, first_tick, last_tick, alert_time, ticks and
    late_ticks: those of a minute before the newest one that earlier batches had seen of the key. Ticks that come more
    than ``delay`` after newer ones are dropped. Null keys are a key, null times are left out.
    """
    spark, by = stream.sparkSession, list(keys)
    ship_package(spark)
    hold_state(spark)
    parts = minute_parts(stream, by, time).withWatermark("last", delay)
    out = [parts.schema[k] for k in by] + [T.StructField(n, T.TimestampType()) for n in ("first_tick", "last_tick", "alert_time")]
    out += [T.StructField(n, T.LongType()) for n in ("ticks", "late_ticks")]
    return parts.groupBy(*by).transformWithStateInPandas(
        SilenceWatch(by, minutes * _MINUTE), T.StructType(out), outputMode="Append", timeMode="EventTime"
    )


def add_to_ranges(firsts: np.ndarray, lasts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of whole numbers with ``values`` added, and which of the values none of the ranges held, each once."""
    at = np.searchsorted(firsts, values, side="right") - 1
    known = (at >= 0) & (values <= lasts[np.maximum(at, 0)]) if len(firsts) else np.zeros(len(values), bool)
    fresh = np.zeros(len(values), bool)
    fresh[np.unique(values, return_index=True)[1]] = True
    fresh &= ~known
    added = np.unique(values[fresh])
    starts, ends = np.concatenate([firsts, added]), np.concatenate([lasts, added])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    begins = np.ones(len(starts), bool)
    begins[1:] = starts[1:] > ends[:-1] + 1
    return starts[begins], ends[np.append(begins[1:], True)] if len(starts) else ends, fresh


class SeenTicks(StatefulProcessor):
    """Sequence numbers seen of a contract, session day and block, as ranges; forgotten when the session is over."""

    def __init__(self, sequence: str) -> None:
        self.sequence = sequence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "firsts array<bigint>, lasts array<bigint>")

    def _ranges(self) -> tuple[np.ndarray, np.ndarray]:
        held = self.seen.get() if self.seen.exists() else ([], [])
        return np.array(held[0], np.int64), np.array(held[1], np.int64)

    def _keep(self, key, firsts: np.ndarray, lasts: np.ndarray) -> None:
        self.seen.update((firsts.tolist(), lasts.tolist()))
        day = key[1] if isinstance(key[1], dt.date) else pd.Timestamp(key[1]).date()
        over = dt.datetime.combine(day, dt.time(), dt.timezone.utc) + dt.timedelta(days=1)
        self.handle.registerTimer(int(over.timestamp() * 1000))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        firsts, lasts, _ = add_to_ranges(*self._ranges(), initialState[self.sequence].to_numpy(np.int64))
        self._keep(key, firsts, lasts)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The ranges are read and written once, however many parts the rows of a micro-batch come in.
        firsts, lasts = self._ranges()
        for part in rows:
            firsts, lasts, fresh = add_to_ranges(firsts, lasts, part[self.sequence].to_numpy(np.int64))
            yield part[fresh].drop(columns="_block")
        self._keep(key, firsts, lasts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])


def dedup_from_tape(stream: DataFrame, tape: DataFrame, delay: str = "1 day", keys: Sequence[str] = SESSION_KEY) -> DataFrame:
    """Ticks of the stream that neither ``tape`` nor an earlier tick of the stream has, by contract, session day and sequence.

    The state of a new checkpoint starts from ``tape``, so a lost checkpoint loses nothing and repeats nothing; a known
    checkpoint goes on with its own. Pass the sessions that may still come in. The state of a session is dropped
    ``delay`` after its day ends. Ticks without one of ``keys`` are left out.
    """
    code, day, sequence = keys
    spark = stream.sparkSession
    ship_package(spark)
    hold_state(spark)
    block = F.floor(F.col(sequence) / BLOCK).alias("_block")
    whole = F.col(code).isNotNull() & F.col(day).isNotNull() & F.col(sequence).isNotNull()
    known = tape.filter(whole).select(code, day, block, sequence).groupBy(code, day, "_block")
    rows = stream.filter(whole).withWatermark("ts", delay)
    return rows.select(*stream.columns, block).groupBy(code, day, "_block").transformWithStateInPandas(
        SeenTicks(sequence), stream.schema, outputMode="Append", timeMode="EventTime", initialState=known
    )
