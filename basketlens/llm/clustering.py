"""Lloyd's clustering of whole-number vectors with lower bounds that are loosened by planar geometry.

Vectors are integers, so centroids, sums and squared distances are exact and every run gives the same clusters.

An *anchor* is a stored table of the vectors, each with its nearest centroid at that time and a lower bound of the distance to all
other centroids (that of the second nearest).  All members of a cluster lie in a sphere around its centroid, whose radius
is the largest of their distances.  In a later round the other centroids have moved from ``a`` to ``b``, and a member may have come
nearer to one of them by at most the full drift ``|a - b|``.  Mostly it is much less.  In the plane through ``a``, ``b`` and the
sphere's centre, ``|x - a| - |x - b|`` is constant on a hyperbola with these foci, which lies within the cone of its asymptotes:
seen from the middle of ``a`` and ``b``, a point at an angle ``w`` off the way of the move has come nearer by at most ``|a - b| cos w``.
The sphere is seen under a known angle, so its least ``w`` is known too; and no point that is ``s`` ahead of the
middle comes nearer by more than ``2 s``.  The largest of these values over all moved centroids is what the cluster's lower
bounds are loosened by.  A vector whose distance to its own moved centroid stays below its loosened bound keeps it; the others are
ambiguous and compared with all centroids.

A round reads the anchor and sends only counts and sums per task and cluster.  When more than half of the vectors were
ambiguous, the next round writes a new anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.shared import ship, store

CLUSTERS = 40
ROUNDS = 5
SEED = 2
COMPONENTS = 64
SCALE = 256
# Up to this size of components all sums of products are below 2**53, so doubles hold them exactly.
EXACT = 1 << 22
# Components are cut off here; a vector that reaches it is farther from anything than a long can say.
FARTHEST = 1 << 61
LONGEST = (1 << 63) - 1
ROWS_AT_ONCE = 4096
AMBIGUOUS_SHARE = 0.5

VECTORS = "vec_id long, v binary"
ANCHOR = "vec_id long, v binary, cluster int, lower double"
TALLY = "cluster int, n long, radius double, ambiguous long, sums array<decimal(38,0)>"
ASSIGNED = "vec_id long, cluster int, distance long"


# ---------------------------------------------------------------- vectors


def _packed(v: np.ndarray) -> bytes:
    """Components as 32-bit integers where they fit, else as 64-bit ones."""
    small = np.abs(v).max(initial=0) < 1 << 31
    return v.astype("<i4" if small else "<i8").tobytes()


def _unpacked(column: pa.Array, components: int) -> np.ndarray:
    held = column.to_pylist()
    if held and all(len(x) == 4 * components for x in held):
        return np.frombuffer(b"".join(held), "<i4").reshape(-1, components).astype(np.int64)
    return np.array([np.frombuffer(x, "<i4" if len(x) == 4 * components else "<i8") for x in held], np.int64).reshape(-1, components)


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -float(FARTHEST), float(FARTHEST)).astype(np.int64)


def _scaler(components: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, components)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([_packed(v) for v in scaled(x, scale)], pa.binary())], names=["vec_id", "v"])

    return run


def complete_vectors(table: DataFrame, id_col: str, vector_col: str, components: int) -> DataFrame:
    """vec_id and the vector ``x`` of the rows whose vector is complete and finite."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fit = (F.size(x) == components) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return table.where(fit).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int, components: int, scale: int) -> np.ndarray:
    """The vectors with the smallest hashed ids; those without an id come last, equal hashes by the vector."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(code.alias("code"), "x").orderBy(F.col("code").asc_nulls_last(), "x").limit(clusters).collect()
    return scaled(np.array([r.x for r in rows], np.float64).reshape(-1, components), scale)


# ---------------------------------------------------------------- distances and bounds


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid, as doubles, or Python integers where doubles can't hold them."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    x, c = v.astype(object), centroids.astype(object)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1) if len(x) else np.zeros((0, len(c)))


def own_squared(v: np.ndarray, centroids: np.ndarray, of: np.ndarray) -> np.ndarray:
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        d = (v - centroids[of]).astype(np.float64)
        return np.einsum("ij,ij->i", d, d)
    return ((v.astype(object) - centroids[of].astype(object)) ** 2).sum(1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equal ones), its squared distance, and the distance to the next one."""
    d = squared(v, centroids)
    here = np.arange(len(v))
    of = d.argmin(axis=1) if len(v) else np.zeros(0, np.int64)
    own = d[here, of]
    rest = d.astype(np.float64)
    rest[here, of] = np.inf
    return of, own, np.sqrt(rest.min(axis=1, initial=np.inf))


def nearer_at_most(centre: np.ndarray, radius: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each move from a[j] to b[j], how much nearer it comes, at most, to any point of the sphere."""
    move = b - a
    drift = np.sqrt((move * move).sum(1))
    out = np.zeros(len(a))
    j = np.flatnonzero(drift)
    if not len(j):
        return out
    d, way = drift[j], move[j] / drift[j][:, None]
    off = centre - (a[j] + move[j] / 2)  # from the middle of the move
    far = np.sqrt((off * off).sum(1))
    ahead = (off * way).sum(1)
    radius = radius * (1 + 1e-7) + 1e-9 * (far + d)  # more than all rounding
    inside = radius >= far
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip(ahead / far, -1, 1)) - np.arcsin(np.clip(radius / far, 0, 1))
    by_angle = np.where(inside | (angle <= 0), d, d * np.cos(np.clip(angle, 0, np.pi)))
    out[j] = np.minimum(np.maximum(0, np.minimum(by_angle, 2 * (ahead + radius))) * (1 + 1e-9) + 1e-9 * d, d)
    return out


def loosening(radii: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each cluster of the anchor: what its members' lower bounds lose when the centroids move from ``a`` to ``b``."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    out = np.zeros(len(a))
    for i in range(len(a)):
        others = np.arange(len(a)) != i
        out[i] = nearer_at_most(a[i], radii[i], a[others], b[others]).max(initial=0)
    return out


@dataclass(frozen=True)
class Round:
    """What a task needs to assign vectors: centroids, and what the bounds of the anchor's clusters lose."""

    centroids: np.ndarray
    loosened: np.ndarray

    def assign(self, v: np.ndarray, cluster: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, squared distance, and whether all centroids had to be compared."""
        of, own = cluster.copy(), own_squared(v, self.centroids, cluster)
        bound = lower - self.loosened[cluster]
        ambiguous = np.sqrt(own.astype(np.float64)) * (1 + 1e-9) + 1e-9 >= bound
        at = np.flatnonzero(ambiguous)
        if len(at):
            found, distance, _ = nearest(v[at], self.centroids)
            of[at] = found
            own[at] = distance
        return of, own, ambiguous


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _anchor(centroids: np.ndarray, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            of, _, lower = nearest(_unpacked(batch.column("v"), components), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(of.astype(np.int32)), pa.array(lower)], names=["vec_id", "v", "cluster", "lower"])

    return run


def _state(batch: pa.RecordBatch, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpacked(batch.column("v"), components), batch.column("cluster").to_numpy().astype(np.int64), batch.column("lower").to_numpy()


def _tally(now: Round, components: int):
    """Per task and cluster: members, their farthest distance, how many were ambiguous, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now.centroids)
        n, radius, ambiguous = np.zeros(k, np.int64), np.zeros(k), np.zeros(k, np.int64)
        sums = np.zeros((k, components), object)
        for batch in _pieces(batches):
            v, cluster, lower = _state(batch, components)
            of, own, scanned = now.assign(v, cluster, lower)
            n += np.bincount(of, minlength=k)
            ambiguous += np.bincount(of[scanned], minlength=k)
            np.maximum.at(radius, of, np.sqrt(own.astype(np.float64)))
            order = np.argsort(of, kind="stable")
            present, starts = np.unique(of[order], return_index=True)
            whole = v if np.abs(v).max(initial=0) < 1 << 48 else v.astype(object)
            sums[present] += np.add.reduceat(whole[order], starts, axis=0).astype(object)
        some = np.flatnonzero(n)
        total = pa.array([[Decimal(int(x)) for x in sums[i]] for i in some], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(radius[some]), pa.array(ambiguous[some]), total], names=["cluster", "n", "radius", "ambiguous", "sums"])

    return run


def _decide(now: Round, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            of, own, _ = now.assign(*_state(batch, components))
            distance = [min(int(x), LONGEST) for x in own] if own.dtype == object else own.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(of.astype(np.int32)), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


# ---------------------------------------------------------------- rounds


@dataclass
class Tally:
    n: np.ndarray
    radius: np.ndarray
    share: float  # of ambiguous vectors
    moved: np.ndarray  # centroids of the next round


def _tallied(state: DataFrame, now: Round, components: int) -> Tally:
    """One pass over the anchor; a row per cluster comes to the driver."""
    parts = state.mapInArrow(_tally(now, components), TALLY)
    total = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("ambiguous").alias("ambiguous"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(components)]
    )
    k = len(now.centroids)
    n, radius, moved, ambiguous = np.zeros(k, np.int64), np.zeros(k), now.centroids.copy(), 0
    for r in total.collect():
        n[r.cluster], radius[r.cluster] = r.n, r.radius
        ambiguous += r.ambiguous
        moved[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(components)]
    return Tally(n, radius, ambiguous / max(1, n.sum()), moved)


def cluster_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(vec_id, cluster, distance) of every complete vector, the final centroids, and the share of ambiguous vectors by round.

    A vector counts if it has exactly ``components`` components, none null, NaN or infinite; a component x becomes
    floor(scale * x), cut off at +-2**61.  A squared distance that a long can't hold is the largest long.  Rows with the same id are
    separate vectors, rows without one are clustered and start a centroid only where too few have one.  With fewer
    vectors than ``clusters`` each starts a centroid; equal ones leave the later of them empty.  No rows give no
    rows.  Other columns are not read.
    """
    ship(table.sparkSession)
    complete = complete_vectors(table, id_col, vector_col, components)
    centroids = first_centroids(complete, clusters, seed, components, scale)
    vectors = complete.mapInArrow(_scaler(components, scale), VECTORS)
    if not len(centroids):
        return vectors.selectExpr("vec_id", "0 as cluster", "0L as distance"), centroids, []
    state, shares, anchored = vectors, [], None
    radii = np.zeros(len(centroids))
    for _ in range(rounds):
        if anchored is None or shares[-1] > AMBIGUOUS_SHARE:
            state = store(state.select("vec_id", "v").mapInArrow(_anchor(centroids, components), ANCHOR), "anchor")
            anchored = centroids
            found = _tallied(state, Round(centroids, np.zeros(len(centroids))), components)
            radii = found.radius
            shares.append(0.0)  # compared with all, for the anchor
        else:
            found = _tallied(state, Round(centroids, loosening(radii, anchored, centroids)), components)
            shares.append(found.share)
        centroids = found.moved
    last = Round(centroids, loosening(radii, anchored, centroids))
    return state.mapInArrow(_decide(last, components), ASSIGNED), centroids, shares


def query(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    assigned, centroids, _ = cluster_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    rows = store(assigned, "assigned")
    whole = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    names = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, parts string")
    # one row per cluster
    totals = rows.groupBy("cluster").agg(whole("distance").alias("cluster_inertia")).join(F.broadcast(names), "cluster")
    totals = totals.select("cluster", "cluster_inertia", F.sha2(F.col("parts").cast("binary"), 256).alias("centroid_sha256"))
    overall = rows.agg(whole("distance").alias("inertia"))
    return rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", overall.scalar().alias("inertia"), "centroid_sha256")


def _sql() -> str:
    each = range(COMPONENTS)
    steps = [
        f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {COMPONENTS}),
c0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id), v) - 1 as cluster, v as c from v order by sha256('{SEED}:' || vec_id), v limit {CLUSTERS})"""
    ]
    far = " + ".join(f"(v[{i + 1}] - c[{i + 1}]) * (v[{i + 1}] - c[{i + 1}])" for i in each)
    floor = lambda s, n: f"(({s} - (({s} % {n}) + {n}) % {n}) // {n})"
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} as materialized (select r, arg_min(cluster, (d, cluster)) as cluster, min(d) as d from (select r, cluster, {far} as d from v, c{k}) group by r)")
        if k < ROUNDS:
            means = ", ".join(floor(f"sum(v[{i + 1}])", "count(*)") + "::bigint" for i in each)
            steps.append(
                f"""m{k} as (select cluster, [{means}] as c from a{k} join v using (r) group by cluster),
c{k + 1} as materialized (select c{k}.cluster, coalesce(m{k}.c, c{k}.c) as c from c{k} left join m{k} using (cluster))"""
            )
    return f"""
with {", ".join(steps)}
select vec_id, cluster::int as cluster, d::bigint as distance, (sum(d) over (partition by cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from a{ROUNDS} join v using (r) join c{ROUNDS} using (cluster)
"""


SQL = _sql()
