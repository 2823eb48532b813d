import hashlib

import numpy as np
import pytest

from tapewright.llm import ns_bounds


def plain_rounds(x, start, rounds):
    """Lloyd's rounds with Python's integers."""
    centroids = [list(map(int, c)) for c in start]
    for t in range(rounds + 1):
        d = [[sum((int(a) - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x]
        cluster = [row.index(min(row)) for row in d]
        if t < rounds:
            for k in range(len(centroids)):
                own = [x[i] for i, c in enumerate(cluster) if c == k]
                if own:
                    centroids[k] = [int(sum(int(v) for v in col)) // len(own) for col in zip(*own)]
    return cluster, [min(row) for row in d], centroids


@pytest.mark.parametrize("seed,scale", [(0, 40), (1, 3), (2, 1 << 24)])
def test_bounds_never_change_the_result(seed, scale):
    """Centroids wander at will; the bounds are kept over many rounds. Small scales give many ties."""
    draw = np.random.default_rng(seed)
    x = draw.integers(-scale, scale, (400, 6))
    history = draw.integers(-scale, scale, (1, 23, 6))
    cluster, near, far = ns_bounds.assign_first(x, history[0])
    near_round, far_rounds = np.zeros(len(x), np.int32), np.zeros(far.shape, np.int32)
    for t in range(12):
        step = draw.integers(-scale // 8 - 1, scale // 8 + 2, (23, 6)) * (draw.random((23, 1)) < 0.4)
        history = np.concatenate([history, (history[-1] + step)[None]])
        cluster, near, near_round, far, far_rounds, _ = ns_bounds.reassign(x, history, cluster, near, near_round, far, far_rounds)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in history[-1]] for v in x], dtype=object)
        assert cluster.tolist() == [list(row).index(min(row)) for row in exact], t
        for g, members in enumerate(ns_bounds._groups(23)):
            then = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, history[r, c])) ** 0.5 for c in members] for v, r in zip(x, far_rounds[:, g])]
            # A bound holds for its own round unless it was loosened when a centroid was left.
            assert all(f <= max(others, default=np.inf) + 1e-6 for f, others in zip(far[:, g], then) if np.isfinite(f))


def test_a_centroid_that_returns_costs_nothing():
    """Out and back again: the summed steps are long, the total displacement is zero."""
    draw = np.random.default_rng(4)
    middles = draw.integers(-10_000, 10_000, (20, 8))
    x = np.concatenate([m + draw.integers(-50, 50, (30, 8)) for m in middles])
    history = np.stack([middles, middles + 3_000, middles])
    cluster, near, far = ns_bounds.assign_first(x, history[0])
    zero = np.zeros(len(x), np.int32)
    *_, scanned = ns_bounds.reassign(x, history, cluster, near, zero, far, np.zeros(far.shape, np.int32))
    assert scanned == 0
    *_, scanned = ns_bounds.reassign(x, history[:2], cluster, near, zero, far, np.zeros(far.shape, np.int32))
    assert scanned > 0


def test_clustered_vectors_skip_most_distances():
    draw = np.random.default_rng(5)
    middles = draw.integers(-5_000, 5_000, (40, 16))
    x = np.concatenate([m + draw.integers(-200, 200, (50, 16)) for m in middles])
    history = middles[None]
    cluster, near, far = ns_bounds.assign_first(x, history[0])
    near_round, far_rounds, total = np.zeros(len(x), np.int32), np.zeros(far.shape, np.int32), 0
    for _ in range(5):
        means = np.array([x[cluster == k].sum(axis=0) // max(1, (cluster == k).sum()) for k in range(40)])
        history = np.concatenate([history, means[None]])
        cluster, near, near_round, far, far_rounds, scanned = ns_bounds.reassign(x, history, cluster, near, near_round, far, far_rounds)
        total += scanned
    assert total < 0.1 * 5 * len(x) * 40


def test_rounds_equal_plain_ones(spark, tmp_path):
    draw = np.random.default_rng(6)
    rows = [(int(i), [float(v) for v in draw.normal(size=4)], "clash") for i in range(300)]
    path = str(tmp_path / "vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string").write.parquet(path)
    vectors = ns_bounds.integer_vectors(spark.read.parquet(path), 4)
    found = ns_bounds.cluster_vectors(vectors, 4, k=13, rounds=4, seed=2)
    x = {r["vec_id"]: r["x"] for r in vectors.collect()}
    assert all(x[i] == [int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for i, v, _ in rows)
    first = sorted(x, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:13]
    cluster, distance, centroids = plain_rounds(list(x.values()), [x[i] for i in first], 4)
    got = {r["vec_id"]: r for r in ns_bounds.summary(found).collect()}
    assert [(got[i]["cluster"], got[i]["distance"]) for i in x] == list(zip(cluster, distance)) and found.centroids == centroids
    for i in x:
        k = got[i]["cluster"]
        assert got[i]["cluster_inertia"] == sum(d for c, d in zip(cluster, distance) if c == k) and got[i]["inertia"] == sum(distance)
        assert got[i]["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()


def test_odd_vectors(spark, tmp_path):
    """Null, short and non-finite vectors go; null and repeated ids, repeated and huge vectors stay."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [0.5, -0.001]), (2, [3e38, -3e38]), (3, None), (4, [1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0])]
    path = str(tmp_path / "vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(path)
    vectors = ns_bounds.integer_vectors(spark.read.parquet(path), 2)
    assert sorted((r["vec_id"] or 0, r["x"]) for r in vectors.collect()) == [
        (0, [128, -1]), (1, [0, 0]), (1, [0, 0]), (2, [ns_bounds.LARGEST, -ns_bounds.LARGEST])
    ]
    got = ns_bounds.summary(ns_bounds.cluster_vectors(vectors, 2, k=40, rounds=3, seed=2)).collect()
    assert len(got) == 4 and {r["inertia"] for r in got} == {0}


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = ns_bounds.cluster_vectors(ns_bounds.integer_vectors(empty, 64), 64, 40, 5)
    assert ns_bounds.summary(found).count() == 0 and found.centroids == []
