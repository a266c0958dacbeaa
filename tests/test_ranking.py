"""Quantile scores, medians and samples against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from basketlens.operators.ranking import exact_median, quantile_scores, stable_sample


def brute_scores(rows, descending=False, bins=5):
    """rows: (id, value) without nulls."""
    ordered = sorted(rows, key=lambda r: (-r[1] if descending else r[1], r[0]))
    n = len(rows)
    q = min(bins, n)
    if n == 1:
        return {ordered[0][0]: 1}
    return {key: max(1, math.ceil(i * q / (n - 1))) for i, (key, _) in enumerate(ordered)}


def scores(frame, rows, descending=False, buckets=8):
    df = frame(rows, "id long, v double")
    result = quantile_scores(df, {"s": ("v", descending)}, id_col="id", buckets=buckets)
    return {r["id"]: r["s"] for r in result.collect()}


@pytest.mark.parametrize("n, expected", [(1, [1]), (2, [1, 2]), (4, [1, 2, 3, 4]), (7, [1, 1, 2, 3, 4, 5, 5])])
def test_small_sizes(frame, n, expected):
    found = scores(frame, [(i, float(i)) for i in range(n)])
    assert [found[i] for i in range(n)] == expected


@pytest.mark.parametrize("descending", [False, True])
def test_ties_follow_the_id(frame, descending):
    rows = [(i, 1.0) for i in range(10)]
    random.Random(1).shuffle(rows)
    found = scores(frame, rows, descending)
    assert [found[i] for i in range(10)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("seed", [3, 4])
def test_heavy_ties_and_zeros(frame, descending, seed):
    """A third of the rows share one value, another third are zeros of both signs."""
    rng = random.Random(seed)
    rows = [(i, 7.0) for i in range(400)] + [(i, rng.choice([0.0, -0.0])) for i in range(400, 800)]
    rows += [(i, rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 9))])) for i in range(800, 1203)]
    rng.shuffle(rows)
    assert scores(frame, rows, descending) == brute_scores(rows, descending)


def test_partitioning_does_not_matter(spark, frame):
    rng = random.Random(5)
    rows = [(i, float(rng.randint(0, 30))) for i in range(500)]
    expected = brute_scores(rows)
    for partitions in ("1", "4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rng.shuffle(rows)
        assert scores(frame, rows) == expected
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_nulls_count_as_the_median(frame):
    rows = [(i, float(i) if i % 3 else None) for i in range(30)]
    median = statistics.median(v for _, v in rows if v is not None)
    filled = [(i, median if v is None else v) for i, v in rows]
    assert scores(frame, rows) == brute_scores(filled)
    assert scores(frame, [(1, None), (2, None)]) == {1: 1, 2: 2}


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 1.0], [4.0] * 9 + [1.0] * 3, [2.0, None, 8.0]])
def test_exact_median(frame, values):
    df = frame(list(enumerate(values)), "id long, v double")
    known = [v for v in values if v is not None]
    assert exact_median(df, "id", "v", 8).first()["median"] == statistics.median(known)


def test_scores_grow_with_rank_and_fill_evenly(frame):
    rows = [(i, random.Random(i).random()) for i in range(503)]
    found = scores(frame, rows)
    ordered = [found[i] for i, _ in sorted(rows, key=lambda r: r[1])]
    assert ordered == sorted(ordered)
    sizes = [ordered.count(s) for s in range(1, 6)]
    assert max(sizes) - min(sizes) <= 1


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(20000).withColumn("x", F.col("id") * 2)

    def key(i):
        return (i * 1103515245 + 42) % (1 << 32), i

    for n in (1, 300, 3000, 20000, 50000):
        found = {r["id"] for r in stable_sample(df.repartition(7), "id", n).collect()}
        assert found == set(sorted(range(20000), key=key)[:n])
