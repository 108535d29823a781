"""Centroid clusters and whitened embeddings against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from curbside.llm import centroids, whitening

KIND = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("cluster", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("v", T.IntegerType()),
])


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], KIND).repartition(partitions)


def plain_clusters(rows, k, rounds):
    """By trying every centroid, in Python integers."""
    kept = []
    for i, v in rows:
        if v is None or len(v) != 64 or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(64 * x) for x in v]
        if all(abs(x) < centroids.LIMIT for x in whole):
            kept.append((i, whole))
    names = sorted((hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    now = [v for _, v in names[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(now)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                now[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = Counter()
    for d, n in found:
        inertia[n] += d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, n, d, inertia[n], sum(inertia.values()), hashes[n]) for (i, _), (d, n) in zip(kept, found)]


def vectors(rng, n, spread=1.0):
    """Clumps with repeats, small grids for ties, and rows that take no part."""
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            rows.append((i, rng.choice(rows)[1]))
        elif kind < 0.5:
            rows.append((i, [rng.choice([0.0, 1 / 64]) if j < 3 else 0.0 for j in range(64)]))
        else:
            centre = rng.randrange(5)
            rows.append((i, [rng.gauss(centre * (j % 3), spread) for j in range(64)]))
    return rows


ODD = [
    (900, None), (901, [0.5] * 63), (902, [0.5] * 63 + [None]), (903, [0.5] * 63 + [math.inf]), (904, [math.nan] + [0.5] * 63),
    (905, []), (906, [1e9] + [0.0] * 63), (None, [0.25] * 64), (907, [2.0] * 64), (907, [2.0] * 64), (907, [-2.0] * 64),
]


@pytest.mark.parametrize("seed,k", [(1, 16), (2, 5), (3, 1)])
def test_clusters_like_brute_force(spark, seed, k):
    rows = vectors(random.Random(seed), 150) + ODD
    out = centroids.clusters(table(spark, rows, 7), k)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, out.collect())) == Counter(plain_clusters(rows, k, centroids.ROUNDS))


def test_clusters_with_few_rows_or_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [1.5] * 64)]
    assert sorted(map(tuple, centroids.clusters(table(spark, rows)).collect())) == sorted(plain_clusters(rows, 16, 3))
    assert centroids.clusters(table(spark, [])).count() == 0
    assert centroids.clusters(table(spark, ODD[:6])).dtypes == centroids.clusters(table(spark, rows)).dtypes


def test_tree_finds_the_nearest_and_prunes():
    rng = np.random.default_rng(4)
    clumps = rng.integers(-2000, 2000, (40, 64)).repeat(5, axis=0) + rng.integers(-40, 40, (200, 64))
    points = np.concatenate([clumps, clumps[:20]])
    asked = np.concatenate([clumps + rng.integers(-60, 60, clumps.shape), points])
    every = centroids.squared(asked[:, None, :], points[None, :, :])
    number, best, measured = centroids.nearest(asked, points, centroids.build_tree(points))
    assert np.array_equal(best, every.min(axis=1)) and np.array_equal(number, every.argmin(axis=1))
    assert measured < every.size / 3


def test_tree_of_equal_distances():
    grid = np.zeros((27, 64), np.int64)
    grid[:, :3] = np.array([(a, b, c) for a in (0, 2, 4) for b in (0, 2, 4) for c in (0, 2, 4)])
    asked = np.zeros((125, 64), np.int64)
    asked[:, :3] = np.array([(a, b, c) for a in range(5) for b in range(5) for c in range(5)])
    every = centroids.squared(asked[:, None, :], grid[None, :, :])
    for order in (np.arange(27), np.random.default_rng(1).permutation(27)):
        number, best, _ = centroids.nearest(asked, grid[order], centroids.build_tree(grid[order]))
        assert np.array_equal(number, every[:, order].argmin(axis=1)) and np.array_equal(best, every.min(axis=1))


# --- whitening --------------------------------------------------------------


def plain_whitening(rows, components=8, weights="counts"):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max(len(v) for _, v in kept)
    whole = [[math.floor(1024 * x) + 100_000 for x in v] + [100_000] * (size - len(v)) for _, v in kept]
    fit = whole if weights == "counts" else [list(x) for x in sorted(set(map(tuple, whole)))]
    n = len(fit)
    sums = [sum(x) for x in zip(*fit)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in whole]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in whole]) @ axes / np.sqrt(values)
    return n, [i for i, _ in kept], deviation, y, values / np.trace(covariance)


def check_whitening(out, rows, components=8, weights="counts"):
    n, ids, deviation, y, explained = plain_whitening(rows, components, weights)
    got = {}
    for r in out.collect():
        assert r["n"] == n and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-8
        got.setdefault((r["vec_id"], r["deviation"]), Counter())[r["component"]] += 1
    assert sum(sum(c.values()) for c in got.values()) == len(ids) * y.shape[1]
    assert {k: set(c) for k, c in got.items()} == {(i, d): set(range(1, y.shape[1] + 1)) for i, d in zip(ids, deviation)}
    for c in range(y.shape[1]):
        own = {(r["vec_id"], r["deviation"]): r["whitened"] for r in out.where(f"component = {c + 1}").collect()}
        mine = np.array([own[i, d] for i, d in zip(ids, deviation)])
        sign = 1 if abs(mine - y[:, c]).max() < abs(mine + y[:, c]).max() else -1
        assert np.allclose(mine, sign * y[:, c], atol=1e-8)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_like_brute_force(spark, weights):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + 3 / (1 + j)) for j in range(12)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(None, rows[3][1]), (5, rows[5][1])]
    odd = [(900, None), (901, [None] * 12), (902, [math.nan] + [0.0] * 11), (903, [math.inf] * 12)]
    out = whitening.whitened(table(spark, rows + odd, 5), weights=weights)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(out, rows, weights=weights)


def test_whitening_of_few_and_uneven_dimensions(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 4)][: 2 + i % 2]) for i in range(40)]
    check_whitening(whitening.whitened(table(spark, rows)), rows, components=3)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])], [(1, []), (2, [])], ODD[:1]):
        out = whitening.whitened(table(spark, rows))
        assert out.count() == 0 and out.columns[0] == "vec_id" and dict(out.dtypes)["deviation"] == "bigint"


def test_components_without_variance_are_left_out(spark):
    rng = random.Random(7)
    rows = [(i, [a := rng.gauss(0, 1), a, 3.0, rng.gauss(0, 1)]) for i in range(50)]
    out = whitening.whitened(table(spark, rows))
    assert {r["component"] for r in out.collect()} == {1, 2}
    check_whitening(out, rows, components=2)


def test_deviations_beyond_a_long_are_null():
    matrix = np.array([[2**40, 0], [3, 5]], dtype=np.int64)
    n, sums = 3, [6, 9]
    assert whitening.deviations(matrix, n, sums) == [None, (9 - 6) ** 2 + (15 - 9) ** 2]
    near = np.array([[2**20, -(2**20)]], dtype=np.int64)
    assert whitening.deviations(near, 1000, [7, 8]) == [(1000 * 2**20 - 7) ** 2 + (1000 * 2**20 + 8) ** 2]
