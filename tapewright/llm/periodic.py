"""Periodic runs of words by an enhanced suffix array: no tree, only suffix order, common prefixes and inverse.

A run is a stretch of words with a smallest period, repeated often enough, that no neighbouring word extends. The
texts of a block are one sequence of symbols; a symbol stands for a word of one text, so nothing is shared between
texts. Each interval of the suffix array whose suffixes share ``depth`` words is split into its children. Every suffix
of all but the largest child looks up by the inverse suffix array whether its neighbours ``depth`` words on and back
lie in the same interval: if so, and if the next words differ, the pair is a branching square, the last one of a run.
As the largest child is left out, the look-ups of a text grow with its words times their logarithm.

A branching square is rotated to the left as long as the words agree, which gives the whole run. Squares whose period
is a multiple of a run's own end where the run ends and are merged into it.

All steps are arrays over a block of bounded size; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tapewright.llm import chunks
from tapewright.llm.columns import id_and_text

MIN_WORDS = 6
MIN_REPEATS = 4
BLOCK_BYTES = 2_000_000
# Documents that are put together at once.
ROWS_AT_ONCE = 1024
# Words that a rotation compares at once.
STRIDE = 32

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Runs(NamedTuple):
    """Runs in the order of start and period; ``start`` counts symbols from the begin of the sequence."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes[k]`` consecutive numbers from ``starts[k]`` on, for each k in turn."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and per k the rank of each suffix by its first 2**k symbols (alike: same rank).

    The last ranks are all different. Each has one place more than symbols, for the empty suffix. Only suffixes that
    are still tied take part in a doubling.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    held = symbols[order]
    fresh = np.concatenate(([True], held[1:] != held[:-1]))
    rank = np.full(n + 1, -1, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, width = [rank], 1
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(tied):
        suffixes = order[tied]
        keys = rank[suffixes].astype(np.int64) * (n + 2) + rank[np.minimum(suffixes + width, n)] + 1
        by_key = np.argsort(keys, kind="stable")
        suffixes, keys = suffixes[by_key], keys[by_key]
        order[tied] = suffixes
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank = rank.copy()
        rank[suffixes] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        levels.append(rank)
        tied, width = tied[~(fresh & np.append(fresh[1:], True))], width * 2
    return order, levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the different suffixes ``a[k]`` and ``b[k]`` share from their begin on."""
    shared = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared += (levels[k][a + shared] == levels[k][b + shared]) * np.int64(1 << k)
    return shared


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """Nearest place before each whose value is smaller; ``values[0]`` is smaller than all others but zeros.

    Zeros are left alone. A pointer jumps over places with values not smaller than its own, so a pointer of such a
    place may be followed at once.
    """
    to = np.arange(len(values)) - 1
    active = 1 + np.flatnonzero((values[1:] > 0) & (values[:-1] >= values[1:]))
    while len(active):
        to[active] = to[to[active]]
        active = active[values[to[active]] >= values[active]]
    return to


def branching_squares(symbols: np.ndarray, order: np.ndarray, levels: list[np.ndarray], least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of all squares whose next word breaks the period, in intervals of ``least`` suffixes or more."""
    n = len(symbols)
    # lcp[p] is shared by the suffixes at p - 1 and p; both edges are smaller than any other.
    lcp = np.full(n + 1, -1, dtype=np.int64)
    near = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    lcp[1:n] = 0
    lcp[near] = common_prefix(levels, order[near - 1], order[near])
    low = _smaller_before(lcp)[near]
    high = n - _smaller_before(lcp[::-1])[n - near] - 1
    wide = high - low + 1 >= least
    near, low, high = near[wide], low[wide], high[wide]
    if not len(near):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # The places between children of one interval have its bounds in common.
    by_interval = np.argsort(low * (n + 1) + high, kind="stable")
    near, low, high = near[by_interval], low[by_interval], high[by_interval]
    first = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    last = np.append(first[1:], True)
    interval = np.cumsum(first) - 1
    starts = np.concatenate((np.where(first, low, np.concatenate(([0], near[:-1]))), near[last]))
    sizes = np.concatenate((near, high[last] + 1)) - starts
    of = np.concatenate((interval, interval[last]))
    largest = np.zeros(interval[-1] + 1, dtype=np.int64)
    np.maximum.at(largest, of, sizes)
    big = np.flatnonzero(sizes == largest[of])
    small = np.ones(len(of), dtype=bool)
    small[big[np.unique(of[big], return_index=True)[1]]] = False
    starts, sizes, of = starts[small], sizes[small], of[small]
    low, high, depth = low[first], high[first], lcp[near[first]]
    inverse = levels[-1]
    padded = np.append(symbols, -1)
    found_at, found_depth = [], []
    # A few million look-ups at a time.
    for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(sizes) >> 21)) + 1):
        i = order[expand(starts[part], sizes[part])]
        each = np.repeat(of[part], sizes[part])
        d, lo, hi = depth[each], low[each], high[each]
        for begin in (i, i - d):
            other = begin + d if begin is i else begin
            inside = (other >= 0) & (other < n)
            place = inverse[np.where(inside, other, 0)]
            at = np.flatnonzero(inside & (place >= lo) & (place <= hi))
            at = at[padded[begin[at] + d[at]] != padded[begin[at] + 2 * d[at]]]
            found_at.append(begin[at])
            found_depth.append(d[at])
    both = np.unique(np.concatenate(found_depth) * (n + 1) + np.concatenate(found_at))
    return both % (n + 1), both // (n + 1)


def _rotate(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The start of each square after as many rotations to the left as the words allow."""
    start = start.copy()
    active, back = np.arange(len(start)), np.arange(1, STRIDE + 1)
    while len(active):
        left = start[active, None] - back
        same = (left >= 0) & (symbols[np.maximum(left, 0)] == symbols[np.maximum(left, 0) + period[active, None]])
        steps = np.where(same.all(axis=1), STRIDE, same.argmin(axis=1))
        start[active] -= steps
        active = active[steps == STRIDE]
    return start


def find_runs(symbols: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> Runs:
    """All runs of ``symbols`` (not negative) that are at least ``min_words`` and ``min_repeats`` (two or more) periods long."""
    symbols = np.asarray(symbols, dtype=np.int64)
    none = np.empty(0, np.int64)
    if min_repeats < 2:
        raise ValueError("a run repeats at least twice")
    if len(symbols) < 2:
        return Runs(none, none, none)
    order, levels = suffix_array(symbols)
    start, period = branching_squares(symbols, order, levels, min_repeats)
    end = start + 2 * period
    # Rotated as far as needed, the suffixes a period apart must agree up to the end of the square.
    need = np.maximum(min_words, min_repeats * period)
    fits = end >= need
    start, period, end, need = start[fits], period[fits], end[fits], need[fits]
    fits = common_prefix(levels, end - need, end - need + period) >= need - period
    start, period, end = start[fits], period[fits], end[fits]
    by_end = np.lexsort((period, end))
    start, period, end = start[by_end], period[by_end], end[by_end]
    out = []
    while len(start):
        first = np.concatenate(([True], end[1:] != end[:-1]))
        begin = _rotate(symbols, start[first], period[first])
        out.append((begin, end[first] - begin, period[first]))
        # Squares of the same run have a multiple of its period and lie inside.
        of = np.cumsum(first) - 1
        other = ~first & ~((period % period[first][of] == 0) & (start >= begin[of]))
        start, period, end = start[other], period[other], end[other]
    if not out:
        return Runs(none, none, none)
    begin, length, period = (np.concatenate(x) for x in zip(*out))
    by_start = np.lexsort((period, begin))
    return Runs(begin[by_start], length[by_start], period[by_start])


def repeated(runs: Runs, n: int) -> np.ndarray:
    """True for each of ``n`` words that a run holds after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, runs.start + runs.period, 1)
    np.add.at(edges, runs.start + runs.length, -1)
    return np.cumsum(edges[:-1]) > 0


def _of_block(rows: pa.Table, min_words: int, min_repeats: int) -> Iterator[pa.RecordBatch]:
    words, codes, ends = chunks.factorize(rows.column("text"))
    words = words.cast(pa.large_string())
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    own_text = np.repeat(np.arange(len(ends)), ends - begins)
    found = find_runs(own_text * (len(words) + 1) + codes, min_words, min_repeats)
    kept = np.flatnonzero(~repeated(found, len(codes)))
    run_ends = np.searchsorted(found.start, ends, side="left")
    kept_ends = np.searchsorted(kept, ends, side="left")
    inner = found.start - begins[own_text[found.start]] if len(found.start) else found.start
    for a in range(0, len(ends), ROWS_AT_ONCE):
        b = min(a + ROWS_AT_ONCE, len(ends))
        run_at, kept_at = (np.concatenate(([x[a - 1] if a else 0], x[a:b])).astype(np.int64) for x in (run_ends, kept_ends))
        fields = [pa.array(x[run_at[0] : run_at[-1]].astype(np.int64)) for x in (inner, found.length, found.period)]
        text = words.take(pa.array(codes[kept[kept_at[0] : kept_at[-1]]]))
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").slice(a, b - a).combine_chunks(),
                pa.array((ends - begins)[a:b].astype(np.int64)),
                pa.ListArray.from_arrays(pa.array((run_at - run_at[0]).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
                pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept_at - kept_at[0]), text), pa.scalar(" ", pa.large_string())).cast(pa.string()),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period) and the collapsed text.

    Words are runs without ASCII white space, numbered from 0. Runs are in the order of start and period. The collapsed
    text has the words, joined by one space, that no run holds after its first period. A null or empty text has no
    words, no runs and an empty collapsed text. Repeated rows and null ids each get their row; an empty table gives
    none; further columns play no part.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks.blocks(batches, size=BLOCK_BYTES):
            yield from _of_block(rows, min_words, min_repeats)

    return id_and_text(docs, id_col, text_col).mapInArrow(of_batches, SCHEMA)
