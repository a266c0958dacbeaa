"""Batched K-means and the linear silhouette against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import clusters, kmeans


def blobs(rows, size, centres, spread, seed):
    rng = np.random.default_rng(seed)
    at = rng.uniform(-3, 3, (centres, size))
    of = rng.integers(centres, size=rows)
    return at[of] + rng.normal(0, spread, (rows, size)), of


def frame_of(spark, x, labels=None, partitions=5):
    rows = [(i, v.tolist(), int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "customer_id long, features array<double>, label int").repartition(partitions)


def lloyd(x, centres, rounds):
    for _ in range(rounds):
        of = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([x[of == k].mean(0) if (of == k).any() else c for k, c in enumerate(centres)])
    return centres, ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_models_move_together_as_each_alone(spark):
    x, _ = blobs(600, 3, 4, 0.7, 1)
    points = kmeans.pack_points(frame_of(spark, x), "customer_id", "features")
    starts = [(k, s, x[10 * s : 10 * s + k].copy()) for k in (2, 4) for s in range(3)]
    fits = kmeans.fit_models(points, starts, rounds=6, tolerance=0.0)
    for fit, (k, s, c) in zip(fits, starts, strict=True):
        centres, cost = lloyd(x, c, fit.rounds)
        assert (fit.k, fit.start) == (k, s)
        assert np.allclose(fit.centres, centres, atol=1e-5) and fit.cost == pytest.approx(cost, rel=1e-6)


def test_points_of_one_partition_are_scanned_by_several_tasks(spark):
    df = spark.range(60_000, numPartitions=1).selectExpr("id", "array(id / 7D, id % 11D) as v")
    points = kmeans.pack_points(df, "id", "v")
    assert points.rdd.getNumPartitions() >= 8
    assert points.agg(F.sum("rows")).first()[0] == 60_000


def test_one_scan_for_models_of_many_sizes(spark):
    x, _ = blobs(1500, 3, 4, 0.7, 6)
    models = [x[:k].copy() for k in (1, 5, 2, 5, 3)]
    models[3][4] = models[3][1]  # equal centres: the first one has the points
    rows = kmeans.model_sums(kmeans.pack_points(frame_of(spark, x), "customer_id", "features"), models).collect()
    got = {(r.model, r.centre): (r.n, r.cost, *r[4:]) for r in rows}
    for m, centres in enumerate(models):
        squared = ((x[:, None] - centres) ** 2).sum(2)
        of = squared.argmin(1)
        assert not (m == 3 and (of == 4).any())
        for k in np.unique(of).tolist():
            n, cost, *sums = got.pop((m, k))
            assert n == (of == k).sum() and sums == np.rint(x[of == k] * kmeans.UNIT).sum(0).tolist()
            assert cost == pytest.approx(squared[of == k, k].sum() * kmeans.UNIT, abs=2 * n)
    assert not got


def test_result_does_not_depend_on_partitions(spark):
    x, _ = blobs(500, 4, 3, 1.0, 2)
    found = []
    for partitions in (1, 7):
        best, fits = kmeans.best_fits(kmeans.pack_points(frame_of(spark, x, partitions=partitions), "customer_id", "features"), [2, 3], 4, seed=5)
        assert len(fits) == 8
        found.append([(f.k, f.start, f.cost, f.centres.tolist()) for f in best])
    assert found[0] == found[1]


def test_twenty_starts_find_the_blobs_and_mini_batches_come_near(spark):
    x, of = blobs(900, 5, 6, 0.3, 3)
    points = kmeans.pack_points(frame_of(spark, x), "customer_id", "features")
    (best,), fits = kmeans.best_fits(points, [6], kmeans_starts := 20, seed=1)
    real = sum(((x[of == k] - x[of == k].mean(0)) ** 2).sum() for k in range(6))
    assert len(fits) == kmeans_starts and best.cost == min(f.cost for f in fits) <= real * 1.0001
    (quick,), _ = kmeans.best_fits(points, [6], 20, seed=1, batches=6)
    assert best.cost * 0.9999 <= quick.cost <= best.cost * 1.1


def test_empty_clusters_keep_their_centre(spark):
    points = kmeans.pack_points(frame_of(spark, np.array([[0.0], [1.0], [2.0]])), "customer_id", "features")
    (fit,) = kmeans.fit_models(points, [(2, 0, np.array([[1.0], [50.0]]))])
    assert fit.centres.tolist() == [[1.0], [50.0]] and fit.cost == 2.0


def plain_silhouette(x, of):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    values = []
    for i, c in enumerate(of):
        own = (of == c).sum() - 1
        a = d[i][of == c].sum() / max(own, 1)
        b = min(d[i][of == k].mean() for k in set(of) - {c})
        values.append((b - a) / max(a, b) if own and max(a, b) else 0.0)
    return float(np.mean(values))


@pytest.mark.parametrize(("rows", "spread", "cells", "most"), [(300, 0.4, 16, 0.03), (300, 2.0, 8, 0.08), (3000, 1.0, 256, 0.03)])
def test_silhouette_lies_within_its_bounds(spark, rows, spread, cells, most):
    x, of = blobs(rows, 4, 4, spread, rows)
    of[0] = 9  # alone in its cluster
    points = kmeans.pack_points(frame_of(spark, x, of), "customer_id", "features", "label")
    (found,) = kmeans.silhouette_bounds(points, ["label"], 4, cells).collect()
    exact = plain_silhouette(x, of)
    assert found.lower <= exact <= found.upper and (found.clusters, found.points) == (5, rows)
    assert abs(found.silhouette - exact) < most / 2 and found.upper - found.lower < 4 * most
    assert found.silhouette == pytest.approx(exact, abs=most / 2)


def test_silhouette_in_linear_time_at_twenty_times_the_rows(spark):
    """The same clouds with twenty times the points: the same cells, so each point is compared with as much as before."""
    figures = []
    for rows in (400, 8000):
        x, of = blobs(rows, 3, 3, 0.8, 11)
        points = kmeans.pack_points(frame_of(spark, x, of), "customer_id", "features", "label")
        found = kmeans._cells(points, "label", 64, 3)
        assert all(len(w) <= 64 for _, w, _, _ in found) and sum(w.sum() for _, w, _, _ in found) == rows
        (row,) = kmeans.silhouette_bounds(points, ["label"], 3, 64).collect()
        figures.append(row.silhouette)
    assert figures[0] == pytest.approx(figures[1], abs=0.03)


def test_one_cluster_and_no_points(spark):
    x, _ = blobs(20, 2, 1, 1.0, 4)
    df = frame_of(spark, x)
    (row,) = kmeans.silhouette_bounds(kmeans.pack_points(df, "customer_id", "features", "label"), ["label"], 2).collect()
    assert (row.clusters, row.silhouette) == (1, -1.0)
    assert kmeans.silhouette_bounds(kmeans.pack_points(df.limit(0), "customer_id", "features", "label"), ["label"], 2).collect() == []


def test_choice_and_axes(spark):
    x, of = blobs(600, 4, 3, 0.2, 8)
    df = frame_of(spark, x)
    choice = clusters.choose_k(df, candidates=[2, 3, 4], starts=4)
    assert choice.k == 3 and len(choice.centres) == 3
    cluster, squared = kmeans.nearest_centre(F.col("features"), choice.centres)
    got = {r.customer_id: (r.c, r.d) for r in df.select("customer_id", cluster.alias("c"), squared.alias("d")).collect()}
    distances = ((x[:, None] - choice.centres) ** 2).sum(2)
    assert all(got[i][0] == distances[i].argmin() and got[i][1] == pytest.approx(distances[i].min()) for i in range(len(x)))
    matrix = clusters.matrix_of(clusters.covariance(df, "features", 4), 4)
    assert np.allclose(matrix, np.cov(x.T, bias=True))
    axes = clusters.principal_axes(matrix)
    spread = np.var((x - x.mean(0)) @ axes, axis=0)
    assert np.allclose(spread, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2])
    assert all(abs(c[1] - 1) < 1e-9 and c[2] < 1e-9 and c[3] < 1e-9 for c in clusters.axis_checks(matrix, axes))
    assert all(a[np.abs(a).argmax()] > 0 for a in axes.T)


def test_exact_silhouette_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "_BLOCK", 8)
    rng = np.random.default_rng(5)
    x, of, many = rng.normal(size=(150, 4)), rng.integers(0, 4, 150), np.arange(150) // 2
    df = spark.createDataFrame([(i, v.tolist(), int(c), int(m)) for i, (v, c, m) in enumerate(zip(x, of, many))], "id long, v array<double>, few int, many int")
    found = {r.labelling: r for r in clusters.silhouette_exact(df, "id", "v", ["few", "many"]).collect()}
    assert [found[0].clusters, found[1].clusters, found[0].points, found[1].points] == [4, 75, 150, 150]
    assert found[0].silhouette == pytest.approx(plain_silhouette(x, of)) and found[1].silhouette == pytest.approx(plain_silhouette(x, many))


def test_exact_silhouette_sends_points_to_a_fixed_number_of_blocks(spark):
    """Twenty times the points are sent as often each; blocks grow until they hold 65536 points."""
    blocks = [spark.range(1).select(clusters._blocks_of(F.lit(n))).first()[0] for n in (0, 500, 2000, 20000, 400000, 1048576, 2000000)]
    assert blocks == [1, 1, 2, 16, 16, 16, 31]
