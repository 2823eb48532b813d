"""Centroid clustering with norm-of-sum bounds: Lloyd's rounds in exact integers that skip most distances.

A vector keeps its squared distance to its own centroid and, for each group of centroids, the distance to the nearest
other centroid of the group, each with the round it was measured in. All past centroids are kept, a small table. When
a bound is used later, it is loosened by how far a centroid has moved in total since that round, the norm of the
summed displacement, and not by the sum of its steps: a centroid that goes to and fro costs nothing.

A vector whose own bound stays below those of all groups keeps its centroid. Otherwise its own distance is measured
anew, and the groups that still fail are scanned exactly. Bounds are floating point with a margin; every decision that
a bound cannot make is made by integers, so the result is that of the plain rounds.

State is a written table per round. Sums of the clusters change by the vectors that moved, in Spark's own partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.session import delete_path, scratch_path

GROUP = 10  # centroids that share a bound
SCALE = 256
# Components are held to 28 bits, so that a squared distance fits 63 bits for up to 64 components.
LARGEST = 1 << 27
# Vectors that a task measures at once.
ROWS_AT_ONCE = 8192
# Margin of a comparison of bounds, relative: far above the rounding of a norm.
MARGIN = 1e-9

_STATE = "vec_id long, x array<int>, was int, cluster int, near long, near_round int, far array<float>, far_rounds array<int>"


class Clustering(NamedTuple):
    """``vectors``: vec_id, cluster, distance; ``centroids``: their final components."""

    vectors: DataFrame
    centroids: list[list[int]]


def integer_vectors(table: DataFrame, size: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the floor of ``SCALE`` times each component, of vectors with ``size`` finite components."""
    v = table[vector_col]
    whole = (F.size(v) == size) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    held = F.transform(v, lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST))).cast("int"))
    return table.filter(F.coalesce(whole, F.lit(False))).select(table[id_col].cast("long").alias("vec_id"), held.alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the ``k`` smallest digests of seed and id; a null id counts as empty, equal digests go by components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all centroids."""
    size = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if size < 1 << 22:  # sums of products are whole numbers below 2**53 and exact in floating point
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _moved(history: np.ndarray) -> np.ndarray:
    """By round and centroid: how far the centroid is now from where it was then."""
    return np.sqrt(((history[-1].astype(np.float64) - history.astype(np.float64)) ** 2).sum(axis=2)) * (1 + MARGIN)


def _groups(k: int) -> list[np.ndarray]:
    return np.array_split(np.arange(k), -(-k // GROUP))


def assign_first(x: np.ndarray, centroids: np.ndarray):
    """Cluster, squared distance and the bounds of the groups, all measured."""
    d = squared(x, centroids)
    cluster = d.argmin(axis=1)
    near = d[np.arange(len(x)), cluster]
    others = d.astype(np.float64)
    others[np.arange(len(x)), cluster] = np.inf
    far = np.stack([np.sqrt(others[:, g].min(axis=1)) for g in _groups(len(centroids))], axis=1)
    return cluster.astype(np.int32), near, far


def reassign(x: np.ndarray, history: np.ndarray, cluster: np.ndarray, near: np.ndarray, near_round: np.ndarray, far: np.ndarray, far_rounds: np.ndarray):
    """The same for the last centroids of ``history``, with bounds measured in earlier rounds; and the number of distances measured."""
    now, centroids, groups, moved = len(history) - 1, history[-1], _groups(history.shape[1]), _moved(history)
    cluster, near, near_round, far, far_rounds = cluster.copy(), near.copy(), near_round.copy(), far.copy(), far_rounds.copy()
    spread = np.stack([moved[:, g].max(axis=1) for g in groups], axis=1)  # round x group
    low = np.maximum(0.0, far * (1 - MARGIN) - spread[far_rounds, np.arange(len(groups))])
    high = np.sqrt(near.astype(np.float64)) * (1 + MARGIN) + moved[near_round, cluster]
    # Without a margin between the two a tie is possible, and ties go by the centroid's number.
    loose = np.flatnonzero(high * (1 + MARGIN) >= low.min(axis=1))
    if len(loose):
        diff = x[loose].astype(np.int64) - centroids[cluster[loose]]
        near[loose], near_round[loose] = (diff * diff).sum(axis=1), now
        high[loose] = np.sqrt(near[loose].astype(np.float64)) * (1 + MARGIN)
    failing = (high[:, None] * (1 + MARGIN) >= low) & np.isfinite(low)
    scanned, before = len(loose), cluster.copy()
    best, best_at = near.copy(), cluster.astype(np.int64)
    measured = {}
    for g, members in enumerate(groups):
        rows = np.flatnonzero(failing[:, g])
        if not len(rows):
            continue
        d = squared(x[rows], centroids[members])
        measured[g] = (rows, d)
        scanned += d.size
        at = d.argmin(axis=1)
        value, number = d[np.arange(len(rows)), at], members[at]
        better = (value < best[rows]) | ((value == best[rows]) & (number < best_at[rows]))
        best[rows[better]], best_at[rows[better]] = value[better], number[better]
    cluster = best_at.astype(np.int32)
    for g, (rows, d) in measured.items():
        members = groups[g]
        others = d.astype(np.float64)
        own = np.flatnonzero((cluster[rows] >= members[0]) & (cluster[rows] <= members[-1]))
        others[own, cluster[rows[own]] - members[0]] = np.inf
        far[rows, g], far_rounds[rows, g] = np.sqrt(others.min(axis=1)), now
    # The centroid that a vector left counts for its group from now on.
    left = np.flatnonzero(cluster != before)
    group_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[before[left]]
    unscanned = far_rounds[left, group_of] != now
    rows, of = left[unscanned], group_of[unscanned]
    far[rows, of] = np.minimum(low[rows, of], np.sqrt(near[rows].astype(np.float64)))
    far_rounds[rows, of] = now
    near[left], near_round[left] = best[left], now
    return cluster, near, near_round, far, far_rounds, scanned


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(dtype)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1), kind))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _state(ids, x, was, cluster, near, near_round, far, far_rounds) -> pa.RecordBatch:
    # Rounded down, a bound of fewer digits is still a bound.
    short = far.astype(np.float32)
    short = np.where(short > far, np.nextafter(short, np.float32(0)), short)
    columns = [
        ids, x, pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(near), pa.array(near_round, pa.int32()),
        _lists(short, pa.float32()), _lists(far_rounds, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, "vec_id x was cluster near near_round far far_rounds".split())


def _first_state(vectors: DataFrame, history: np.ndarray) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            x = _matrix(part.column("x"), history.shape[2], np.int64)
            cluster, near, far = assign_first(x, history[0])
            zero = np.zeros(len(x), np.int32)
            yield _state(part.column("vec_id"), part.column("x"), zero - 1, cluster, near, zero, far, np.zeros(far.shape, np.int32))

    return vectors.mapInArrow(measure, _STATE)


def _next_state(state: DataFrame, history: np.ndarray) -> DataFrame:
    groups = len(_groups(history.shape[1]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            x = _matrix(part.column("x"), history.shape[2], np.int64)
            was, near, near_round = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "near", "near_round"))
            far, far_rounds = _matrix(part.column("far"), groups, np.float64), _matrix(part.column("far_rounds"), groups, np.int32)
            cluster, near, near_round, far, far_rounds, _ = reassign(x, history, was, near, near_round, far, far_rounds)
            yield _state(part.column("vec_id"), part.column("x"), was, cluster, near, near_round, far, far_rounds)

    return state.mapInArrow(measure, _STATE)


def _changes(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By cluster: how its number of vectors and its sums change by the vectors that moved.

    A task sums over all its rows first, so that a value per task, cluster and component is shuffled and one per
    cluster and component gathered.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)
        for part in _parts(batches):
            x = np.column_stack([np.ones(part.num_rows, np.int64), _matrix(part.column("x"), size, np.int64)])
            was, now = (part.column(c).to_numpy() for c in ("was", "cluster"))
            np.add.at(total, now, x)
            np.subtract.at(total, was[was >= 0], x[was >= 0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["place", "value"])

    moved = state.filter("was <> cluster").select("x", "was", "cluster")
    summed = moved.mapInArrow(add, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(k * (size + 1), np.int64)
    total[summed.column("place").to_numpy()] = summed.column("value").to_numpy()
    return total.reshape(k, size + 1)[:, 0], total.reshape(k, size + 1)[:, 1:]


def cluster_vectors(vectors: DataFrame, size: int, k: int, rounds: int, seed: int = 0) -> Clustering:
    """``rounds`` of assignment and update from ``first_centroids``, then a last assignment.

    ``vectors`` is a table of vec_id and x (``size`` integers). A vector goes to the nearest centroid, of equal ones to
    the first; a centroid becomes the floor of its vectors' mean, or stays if it has none. Fewer vectors than ``k`` are
    each a centroid. Repeated rows and null ids each get their row; an empty table gives none and no centroids.
    """
    start = first_centroids(vectors, k, seed)
    if not len(start):
        return Clustering(vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [])
    spark, history = vectors.sparkSession, start[None]
    counts, sums = np.zeros(len(start), np.int64), np.zeros(start.shape, np.int64)
    state, path = _written(_first_state(vectors, history))
    for _ in range(rounds):
        more, change = _changes(state, len(start), size)
        counts, sums = counts + more, sums + change
        means = sums // np.maximum(counts, 1)[:, None]
        history = np.concatenate([history, np.where(counts[:, None] > 0, means, history[-1])[None]])
        before = path
        state, path = _written(_next_state(state, history))
        delete_path(spark, before)
    return Clustering(_distances(state, history[-1]), history[-1].tolist())


def _written(state: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(state.sparkSession, "clustering-round")
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path), path


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            diff = _matrix(part.column("x"), centroids.shape[1], np.int64) - centroids[part.column("cluster").to_numpy()]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("cluster"), pa.array((diff * diff).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return state.select("vec_id", "cluster", "x").mapInArrow(measure, "vec_id long, cluster int, distance long")


def summary(found: Clustering) -> DataFrame:
    """The vectors with the summed distance of their cluster and of all, and a digest of their centroid.

    A sum beyond 63 bits is null.
    """
    vectors = found.vectors
    sums = vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # a row per centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    by_cluster = {r["cluster"]: int(r["inertia"]) for r in sums}
    whole = [v if v < 1 << 63 else None for v in (*by_cluster.values(), sum(by_cluster.values()))]
    rows = [(c, value, whole[-1], digests[c]) for c, value in zip(by_cluster, whole)]
    table = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return vectors.join(table, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
