"""Clustering against plain Python in whole numbers, and the geometry of the bounds against points of the sphere."""

import hashlib
import math
import random

import numpy as np
import pytest

from basketlens.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k, rounds, components, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    code = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda x: (code(x[0]), x[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        of = [c for c, _ in assign()]
        for c in range(len(centroids)):
            members = [v for (_, v), x in zip(kept, of) if x == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    return sorted((str(i), c, d) for (i, _), (c, d) in zip(kept, assign())), centroids


def blobs(rng, n, components, spread, centres=12):
    at = [[rng.uniform(-1, 1) for _ in range(components)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(at)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.3, 2.0])
def test_clusters_against_brute_force(spark, spread):
    rng = random.Random(int(spread * 100))
    rows = blobs(rng, 400, 5, spread)
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]  # a third are copies
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(6)
    found, centroids, shares = clustering.cluster_vectors(df, clusters=10, rounds=6, components=5)
    expected, means = brute(rows, 10, 6, 5)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == expected
    assert centroids.tolist() == means
    if spread < 0.1:  # settled clusters are mostly not compared again
        assert min(shares[1:]) < 0.2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, -inf]),
        (9, [-0.001, 0.001]), (9, [-0.001, 0.001]), (9, [5.0, 5.0]), (None, [3.0, 3.0]), (10, [1e6, -1e6]), (11, [3e9, 1.0]), (12, [1e300, -1e300]),
    ]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    found, _, _ = clustering.cluster_vectors(df, clusters=4, rounds=3, components=2)
    expected, _ = brute([(i, v) for i, v in rows if v != [1e300, -1e300]] + [(12, [clustering.FARTHEST / 256, -clustering.FARTHEST / 256])], 4, 3, 2)
    expected = sorted((i, c, min(d, clustering.LONGEST)) for i, c, d in expected)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == expected


def test_fewer_vectors_than_clusters_and_none(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], 0) for i in range(3)], SCHEMA)
    found, centroids, _ = clustering.cluster_vectors(df, components=2)
    assert len(centroids) == 3 and sorted(r.distance for r in found.collect()) == [0, 0, 0]
    assert clustering.cluster_vectors(df.limit(0), components=2)[0].collect() == []
    clash = df.selectExpr("*", "1 as v", "2 as x", "3 as cluster", "4 as distance", "5 as lower")
    assert sorted(clustering.cluster_vectors(clash, components=2)[0].collect()) == sorted(found.collect())


def test_moved_centroids_come_nearer_by_no_more_than_said():
    rng = np.random.default_rng(4)
    tighter = 0
    for _ in range(300):
        dims = int(rng.integers(2, 9))
        centre, a = rng.normal(size=dims) * 3, rng.normal(size=(4, dims)) * 3
        b = a + rng.normal(size=(4, dims)) * rng.choice([0.01, 0.5, 3])
        radius = float(rng.choice([0.0, 0.1, 1.0, 4.0]))
        x = rng.normal(size=(2000, dims))
        x = centre + x / np.linalg.norm(x, axis=1)[:, None] * radius * rng.choice([1.0, 0.7], size=2000)[:, None]
        said, drift = clustering.nearer_at_most(centre, radius, a, b), np.linalg.norm(b - a, axis=1)
        for j in range(4):
            real = (np.linalg.norm(x - a[j], axis=1) - np.linalg.norm(x - b[j], axis=1)).max()
            assert real <= said[j] + 1e-12 and said[j] <= drift[j] + 1e-9
            tighter += said[j] < 0.9 * drift[j]
    assert tighter > 500
