"""K-means with many starts in one scan per round, and a Euclidean silhouette in linear time.

*Batched rounds.*  A model is a set of centres; for each k there are many, one per start.  A round reads the points once and
moves all models on: every task adds up, per model and centre, how many points are nearest and the sum of their coordinates, and
these sums merge over tasks into one row per centre.  Coordinates are added as whole multiples of 2**-24, so the result
does not depend on how the points are split.  A model that has settled is left out of later rounds.

*Mini batches.*  The same tasks also take a share of the points, chosen by the hash of their id, and every centre steps towards the mean
of its part of the batch by a rate that falls with the points it has seen.

*Silhouette.*  The mean distance from a point x to a set of points with mean m and mean square deviation v lies between |x - m| and
sqrt(|x - m|**2 + v).  Each cluster is cut into cells, whose weights, means and deviations are all that a point is
compared with; the sums of both bounds over the cells enclose its mean distance to each cluster, and so its silhouette.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.plans.stage import write_stage

# Tasks get these functions by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = float(1 << 24)
ROWS_AT_ONCE = 4096
TILE = 512  # points whose distances to all centres stay in a core's cache
SEEDING_ROWS = 4000
MOST_ROUNDS = 40
TOLERANCE = 1e-4


# --- points ------------------------------------------------------------------


def pack_points(df: DataFrame, id_col: str, vector_col: str, *labels: str) -> DataFrame:
    """The stored points as blocks: ids, coordinates and labels of some thousand rows in one.

    The blocks are dealt over files for all cores, since a scan of a file is one task, and a stage before may have left few of them.
    """
    columns = ["id", "v", *labels]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
                rows = [values.astype("<f8").tobytes()] + [batch.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in ("id", *labels)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), *(pa.array([x], pa.binary()) for x in rows)], names=["rows", "v", "id", *labels])

    flat = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *[F.col(c).cast("long").alias(c) for c in labels])
    schema = ", ".join(["rows long", "v binary", "id binary", *[f"`{c}` binary" for c in labels]])
    files = 2 * df.sparkSession.sparkContext.defaultParallelism
    return write_stage(flat.select(*columns).mapInArrow(pack, schema).repartition(files), "points")


def _blocks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(coordinates, then each other column) of every block."""
    for batch in batches:
        for r in batch.to_pylist():
            yield (np.frombuffer(r["v"], "<f8").reshape(r["rows"], -1), *(np.frombuffer(r[c], "<i8") for c in columns))


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0.0)


# --- rounds of many models ---------------------------------------------------


@dataclass
class Sums:
    """Per model, what one scan has added up: members and coordinate sums of each centre, and the cost."""

    n: list[np.ndarray]
    total: list[np.ndarray]
    cost: np.ndarray


def _stacked(models: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(models), np.cumsum([0, *(len(m) for m in models)])


def _in_batch(ids: np.ndarray, part: tuple[int, int] | None) -> np.ndarray | slice:
    """Which points belong to part i of n, by a hash of their ids."""
    if part is None:
        return slice(None)
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(33)) % np.uint64(part[1]) == np.uint64(part[0])


def model_sums(points: DataFrame, models: list[np.ndarray], part: tuple[int, int] | None = None) -> DataFrame:
    """(model, centre, n, cost, s0, s1, ...): for every centre of every model, its members in the points, in one scan.

    ``cost`` and the sums are whole multiples of 2**-24.  The rows are as many as there are centres.
    """
    centres, first = _stacked(models)
    size = centres.shape[1]
    sums = [f"s{i}" for i in range(size)]

    counts = np.diff(first)
    # the centres of all models of one size together: the first ones of each, then the second ones, ...
    places = [first[:-1][counts == k] + np.arange(k)[:, None] for k in np.unique(counts)]
    order = np.concatenate([p.ravel() for p in places])
    twice, own = -2 * centres[order], (centres[order] ** 2).sum(1)[:, None]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, total = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), np.zeros((len(centres), size), np.int64)
        held = np.empty((len(centres), TILE))
        for x_all, ids in _blocks(batches, "id"):
            x_all = x_all[_in_batch(ids, part)]
            for at in range(0, len(x_all), TILE):
                x = x_all[at : at + TILE]
                distances = twice @ x.T
                distances += (x * x).sum(1)
                distances += own
                np.maximum(distances, 0.0, out=distances)
                member, begin = held[:, : len(x)], 0
                for k, m in (p.shape for p in places):
                    here = slice(begin, begin + k * m)
                    of, chosen = distances[here].reshape(k, m, -1), member[here].reshape(k, m, -1)
                    least = of.min(axis=0)
                    free, units = np.ones(least.shape, bool), np.rint(least * UNIT)
                    for j in range(k):  # of equally near centres the first one
                        nearest = (of[j] == least) & free
                        free &= ~nearest
                        chosen[j] = nearest
                        cost[order[begin + j * m : begin + (j + 1) * m]] += (chosen[j] * units).sum(1).astype(np.int64)
                    begin += k * m
                n[order] += member.sum(1).astype(np.int64)
                total[order] += (member @ np.rint(x * UNIT)).astype(np.int64)  # whole numbers below 2**53
        some = np.flatnonzero(n)
        columns = [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(cost[some]), *(pa.array(total[some, i]) for i in range(size))]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "n", "cost", *sums])

    parts = points.mapInArrow(add, "at int, n long, cost long, " + ", ".join(f"{s} long" for s in sums))
    merged = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *sums)])
    of = np.repeat(np.arange(len(models)), np.diff(first))
    model, centre = (F.get(F.lit(list(map(int, v))), "at") for v in (of, np.arange(len(centres)) - first[of]))
    return merged.select(model.alias("model"), centre.alias("centre"), "n", "cost", *sums)


def _scan(points: DataFrame, models: list[np.ndarray], part: tuple[int, int] | None = None) -> Sums:
    out = Sums([np.zeros(len(m), np.int64) for m in models], [np.zeros(m.shape) for m in models], np.zeros(len(models)))
    for r in model_sums(points, models, part).collect():  # a row per centre
        out.n[r.model][r.centre] = r.n
        out.total[r.model][r.centre] = np.array(r[4:], np.float64) / UNIT
        out.cost[r.model] += r.cost / UNIT
    return out


def seeding_sample(points: DataFrame, rows: int = SEEDING_ROWS) -> np.ndarray:
    """At most ``rows`` points, those with the least hashed ids: only the starts are drawn from them."""

    def code(ids: np.ndarray) -> np.ndarray:
        h = (ids.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, vectors = np.zeros(0, np.int64), None
        for x, ids in _blocks(batches, "id"):
            codes = np.concatenate([codes, code(ids)])
            vectors = x if vectors is None else np.concatenate([vectors, x])
            keep = np.argsort(codes, kind="stable")[:rows]
            codes, vectors = codes[keep], vectors[keep]
        if vectors is not None:
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["code", "v"])

    found = points.mapInArrow(least, "code long, v binary").orderBy("code", "v").limit(rows).collect()
    return np.array([np.frombuffer(r.v, "<f8") for r in found])


def spread_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centres drawn by squared distance to those before; of a few draws the one that lowers the cost most."""
    centres = [sample[rng.integers(len(sample))]]
    nearest = _squared(sample, centres[0][None])[:, 0]
    tries = 2 + int(np.log(k))
    while len(centres) < k:
        total = nearest.sum()
        drawn = rng.choice(len(sample), tries, p=nearest / total) if total > 0 else rng.integers(len(sample), size=tries)
        lowered = np.minimum(nearest[:, None], _squared(sample, sample[drawn]))
        best = lowered.sum(0).argmin()
        centres.append(sample[drawn[best]])
        nearest = lowered[:, best]
    return np.array(centres)


@dataclass
class Fit:
    k: int
    start: int
    centres: np.ndarray
    cost: float
    rounds: int


def fit_models(
    points: DataFrame, starts: list[tuple[int, int, np.ndarray]], rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE, batches: int | None = None, passes: int = 2
) -> list[Fit]:
    """Move models (k, start, centres) on together, one scan a round, until each has settled.

    A model has settled when the squared shift of its centres is at most ``tolerance`` times the mean variance of a coordinate.  Empty
    centres stay where they are.  With ``batches``, rounds over hashed parts of the points come first: ``passes`` times over all of them, a
    centre steps by the share of the points it has seen that came with the batch, and a single full round gives the cost.
    """
    models = [c.copy() for _, _, c in starts]
    k_of, start_of = [k for k, _, _ in starts], [s for _, s, _ in starts]
    if batches:
        seen = [np.zeros(len(m)) for m in models]
        for step in range(passes * batches):
            found = _scan(points, models, (step % batches, batches))
            for m, (n, total) in enumerate(zip(found.n, found.total)):
                seen[m] += n
                here = n > 0
                rate = (n[here] / seen[m][here])[:, None]
                models[m][here] += rate * (total[here] / n[here][:, None] - models[m][here])
        found = _scan(points, models)
        return [Fit(k, s, c, cost, passes * batches + 1) for k, s, c, cost in zip(k_of, start_of, models, found.cost)]
    whole = _scan(points, [models[0][:1]])
    mean = whole.total[0][0] / max(1, whole.n[0][0])
    spread = _scan(points, [mean[None]]).cost[0] / max(1, whole.n[0][0]) / len(mean)
    active, done = list(range(len(models))), [0] * len(models)
    costs = np.zeros(len(models))
    for round_ in range(rounds):
        found = _scan(points, [models[m] for m in active])
        still = []
        for m, n, total, cost in zip(active, found.n, found.total, found.cost):
            moved = models[m].copy()
            moved[n > 0] = total[n > 0] / n[n > 0][:, None]
            shift = ((moved - models[m]) ** 2).sum()
            models[m], done[m], costs[m] = moved, round_ + 1, cost
            if shift > tolerance * spread:
                still.append(m)
        active = still
        if not active:
            break
    costs = _scan(points, models).cost  # with the centres as they are now
    return [Fit(k, s, c, float(cost), r) for k, s, c, cost, r in zip(k_of, start_of, models, costs, done)]


def best_fits(points: DataFrame, counts: list[int], starts: int, seed: int, **options) -> tuple[list[Fit], list[Fit]]:
    """The cheapest fit for each number of clusters (ties: the first start), and all fits."""
    sample = seeding_sample(points)
    drawn = [(k, s, spread_centres(sample, k, np.random.default_rng([seed, k, s]))) for k in counts for s in range(starts)]
    fits = fit_models(points, drawn, **options)
    return [min((f for f in fits if f.k == k), key=lambda f: (f.cost, f.start)) for k in counts], fits


def nearest_centre(vector: Column, centres: np.ndarray) -> tuple[Column, Column]:
    """Number of the nearest centre (the smaller of equal ones) and the squared distance to it, as DataFrame expressions."""
    distances = F.array(*[sum(((F.get(vector, F.lit(i)) - float(x)) ** 2 for i, x in enumerate(c)), F.lit(0.0)) for c in centres])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int"), F.array_min(distances)


# --- silhouette from cells ---------------------------------------------------

CELLS = 256


def _cells(points: DataFrame, label: str, cells: int, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each cluster of a labelling, found from the points: its label, and the weights, means and mean square deviations of its cells.

    Cells are the points nearest to one of at most ``cells`` members of the cluster, those with the least hashed ids.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for x, ids, of in _blocks(batches, "id", label):
            codes = ((ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(1)).astype(np.int64)
            for c in np.unique(of).tolist():
                h, v = codes[of == c], x[of == c]
                if c in held:
                    h, v = np.concatenate([held[c][0], h]), np.concatenate([held[c][1], v])
                keep = np.argsort(h, kind="stable")[:cells]
                held[c] = h[keep], v[keep]
        rows = [(c, h, v.tobytes()) for c, (hs, vs) in held.items() for h, v in zip(hs.tolist(), vs)]
        if rows:
            cs, hs, vs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(hs, pa.int64()), pa.array(vs, pa.binary())], names=["c", "h", "v"])

    turn = F.row_number().over(Window.partitionBy("c").orderBy("h", "v"))
    found = points.mapInArrow(least, "c long, h long, v binary").withColumn("turn", turn).where(F.col("turn") <= cells).orderBy("c", "turn").collect()
    if not found:
        return []
    labels = sorted({r.c for r in found})
    seeds = [np.array([np.frombuffer(r.v, "<f8") for r in found if r.c == c]) for c in labels]
    centres, first = _stacked(seeds)
    names = [f"s{i}" for i in range(size)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, q, total = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros((len(centres), size))
        for x, of in _blocks(batches, label):
            for m, c in enumerate(labels):
                v = x[of == c]
                if len(v):
                    at = first[m] + _squared(v, seeds[m]).argmin(axis=1)
                    n += np.bincount(at, minlength=len(centres))
                    q += np.bincount(at, weights=((v - centres[at]) ** 2).sum(1), minlength=len(centres))
                    np.add.at(total, at, v - centres[at])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(q[some]), *(pa.array(total[some, i]) for i in range(size))], names=["at", "n", "q", *names])

    sums = points.mapInArrow(add, "at int, n double, q double, " + ", ".join(f"{s} double" for s in names)).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "q", *names)])
    rows = {r.at: r for r in sums.collect()}  # at most ``cells`` per cluster
    out = []
    for m, c in enumerate(labels):
        at = [i for i in range(first[m], first[m + 1]) if i in rows]
        n = np.array([rows[i].n for i in at])
        off = np.array([rows[i][3:] for i in at]) / n[:, None]  # the cell's mean, seen from its seed
        deviation = np.maximum(np.array([rows[i].q for i in at]) / n - (off * off).sum(1), 0.0)
        out.append((np.int64(c), n, centres[at] + off, deviation))
    return out


def silhouette_bounds(points: DataFrame, labels: list[str], size: int, cells: int = CELLS) -> DataFrame:
    """Mean Euclidean silhouette of each labelling of packed points: (labelling, clusters, points, lower, silhouette, upper).

    The exact figure lies between ``lower`` and ``upper``, and ``silhouette`` between them is the estimate; more cells bring them nearer.
    The cost is linear in the points.  Conventions are those of the exact form: a labelling with one cluster has -1, a
    point alone in its cluster counts 0.
    """
    parts = None
    for number, label in enumerate(labels):
        found = _cells(points, label, cells, size)
        rows = points.mapInArrow(_enclosed(found, label), "n long, lower double, middle double, upper double")
        one = F.lit(len(found) <= 1)
        mean = lambda c, one=one: F.when(one, -1.0).otherwise(F.sum(c) / F.sum("n")).alias({"middle": "silhouette"}.get(c, c))
        row = rows.agg(F.sum("n").alias("points"), mean("lower"), mean("middle"), mean("upper"))
        row = row.select(F.lit(number).alias("labelling"), F.lit(len(found)).cast("long").alias("clusters"), "points", "lower", "silhouette", "upper").where("points > 0")
        parts = row if parts is None else parts.union(row)
    return parts


def _enclosed(clusters: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], label: str):
    """Sums over a task's points of the silhouette's lower bound, estimate and upper bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(3)
        for x_all, of_all in _blocks(batches, label):
            for at in range(0, len(x_all), 512):
                x, of = x_all[at : at + 512], of_all[at : at + 512]
                n += len(x)
                low, mid, high = (np.zeros((len(x), len(clusters))) for _ in range(3))
                sizes = np.array([w.sum() for _, w, _, _ in clusters])
                own = np.array([of == c for c, *_ in clusters]).T
                for j, (_, weight, mean, deviation) in enumerate(clusters):
                    d2 = _squared(x, mean)
                    least, most = np.sqrt(d2), np.sqrt(d2 + deviation)
                    # a mean of square roots is nearer to the upper end, by the share of the deviation along the way
                    along = 1 / x.shape[1]
                    likely = np.sqrt(d2 + deviation * (1 - along * d2 / np.maximum(d2 + deviation, 1e-300)))
                    low[:, j], mid[:, j], high[:, j] = least @ weight, likely @ weight, most @ weight
                others = np.where(own.any(1), sizes @ own.T - 1, 0)
                alone = others < 1
                a = [np.where(alone, 0, (d * own).sum(1) / np.maximum(others, 1)) for d in (low, mid, high)]
                b = [np.where(own, np.inf, d / sizes).min(1) for d in (low, mid, high)] if len(clusters) > 1 else [np.zeros(len(x))] * 3

                def value(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                    widest = np.maximum(a, b)
                    return np.where(alone | (widest == 0), 0.0, (b - a) / np.where(widest == 0, 1, widest))

                sums += [value(a[2], b[0]).sum(), value(a[1], b[1]).sum(), value(a[0], b[2]).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([float(s)]) for s in sums)], names=["n", "lower", "middle", "upper"])

    return run
