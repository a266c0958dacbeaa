"""Customer clustering: features, choice of k, silhouette, PCA, personas."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.operators import kmeans
from basketlens.operators.ranking import exact_median, stable_sample
from basketlens.plans.stage import write_stage

# --- features ---------------------------------------------------------------


def cluster_features(profile: DataFrame) -> DataFrame:
    """customer_id and the 17 features in fixed order, without nulls.

    A rating of 0 means "no review" and becomes the mean of the others; a missing
    age becomes the exact median.  ``profile`` should be a stored table.
    """
    c = F.col
    rated = F.when(c("avg_rating") > 0, c("avg_rating"))
    mean_rating = profile.agg(F.coalesce(F.avg(rated), F.lit(0.0)).alias("m")).scalar()
    median_age = exact_median(profile, "customer_id", "age").scalar()
    derived = {
        "session_count_log": F.log1p("session_count"),
        "events_log": F.log1p("total_events"),
        "orders_log": F.log1p("order_count"),
        "revenue_log": F.log1p("revenue"),
        "avg_rating": F.coalesce(rated, mean_rating),
        "age": F.coalesce(c("age"), median_age),
    }
    features = [derived.get(name, c(name)).cast("double") for name in K.CLUSTER_FEATURES]
    return profile.select(
        "customer_id", *[F.coalesce(f, F.lit(0.0)).alias(n) for f, n in zip(features, K.CLUSTER_FEATURES)]
    )


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population standard deviation 1; a constant column becomes 0."""
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
        ).alias("m")
    ).scalar()
    others = [F.col(c) for c in df.columns if c not in columns]
    held = df.withColumn("__m", moments)

    def scaled(c: str) -> Column:
        std = F.col("__m")[f"{c}_std"]
        return ((F.col(c) - F.col("__m")[f"{c}_mean"]) / F.when(std == 0, 1.0).otherwise(std)).alias(c)

    return held.select(*others, *[scaled(c) for c in columns])


def standardise_vectors(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """Column-wise standardisation of an array column of known length."""
    names = [f"d{i}" for i in range(size)]
    flat = df.select(id_col, *[F.col(vector_col)[i].cast("double").alias(n) for i, n in enumerate(names)])
    return standardise(flat, names).select(id_col, F.array(*names).alias(vector_col))


# --- silhouette -------------------------------------------------------------

_BLOCK, _TILE = 1024, 512
# Blocks are larger, not more, up to _LARGEST points: what is sent grows with the points times the blocks.
_BLOCKS, _LARGEST = 16, 65536


def _blocks_of(n: Column) -> Column:
    """Into how many blocks n points are cut: at most ``_BLOCKS`` until a block holds ``_LARGEST``."""
    few = F.least(F.ceil(n / _BLOCK), F.lit(_BLOCKS))
    return F.greatest(few, F.ceil(n / _LARGEST), F.lit(1)).cast("int")


def _distance_sums():
    # built here, so that it travels to the executors by value: they need no copy of this package
    columns = ["labelling", "id", "own", "cluster", "total", "size"]
    tile = _TILE

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Distance sums from each point of two blocks to each cluster of the other, for every labelling; within a block, if both are one."""
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        same = left["i"].iloc[0] == right["j"].iloc[0]
        a, b = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        of_a, of_b = np.stack(left["labels"].to_numpy()), np.stack(right["labels"].to_numpy())
        ids_a, ids_b = left["id"].to_numpy(), right["id"].to_numpy()
        wide_a, wide_b, turned = (a * a).sum(1), (b * b).sum(1), np.ascontiguousarray(b.T)
        found_a = [np.unique(of_a[:, k], return_inverse=True) for k in range(of_a.shape[1])]
        found_b = [np.unique(of_b[:, k], return_inverse=True) for k in range(of_b.shape[1])]
        order = [np.argsort(index, kind="stable") for _, index in found_b]
        first = [np.searchsorted(index[o], np.arange(len(c))) for o, (c, index) in zip(order, found_b)]
        to_b = [np.zeros((len(a), len(c))) for c, _ in found_b]
        to_a = [np.zeros((len(c), len(b))) for c, _ in found_a]
        for at in range(0, len(a), tile):
            here = slice(at, at + tile)
            distance = a[here] @ turned
            distance *= -2
            distance += wide_a[here, None]
            distance += wide_b
            np.sqrt(np.maximum(distance, 0.0, out=distance), out=distance)
            if same:
                distance[ids_a[here, None] == ids_b] = 0.0
            for k, (o, start) in enumerate(zip(order, first)):
                # with many clusters, sums of runs; with few, a product
                if len(start) > 64:
                    to_b[k][here] = np.add.reduceat(distance[:, o], start, axis=1)
                else:
                    to_b[k][here] = distance @ np.eye(len(start))[found_b[k][1]]
                if not same:
                    clusters, index = found_a[k][0], found_a[k][1][here]
                    some = np.unique(index)
                    to_a[k][some] += (index == some[:, None]).astype(float) @ distance
        parts = []

        def add(labelling, ids, own, clusters, index, total):
            size = np.bincount(index, minlength=len(clusters))
            of = {"id": np.repeat(ids, len(clusters)), "own": np.repeat(own, len(clusters)), "cluster": np.tile(clusters, len(ids))}
            parts.append(pd.DataFrame({"labelling": labelling, **of, "total": total.ravel(), "size": np.tile(size, len(ids))}))

        for k in range(of_a.shape[1]):
            add(k, ids_a, of_a[:, k], *found_b[k], to_b[k])
            if not same:
                add(k, ids_b, of_b[:, k], *found_a[k], to_a[k].T)
        return pd.concat(parts)[columns]

    return sums


def silhouette_exact(df: DataFrame, id_col: str, vector_col: str, label_cols: list[str]) -> DataFrame:
    """Mean Euclidean silhouette per labelling: (labelling, clusters, points, silhouette).

    The cost is quadratic in the rows; :func:`silhouette_squared` is linear.  Points are cut into
    blocks; one task adds up the distances between two blocks, once for both, and returns one row
    per point and cluster, never a row per pair.  A labelling with one cluster has
    silhouette -1, a point alone in its cluster counts 0.
    """
    n = df.agg(F.count("*").alias("n")).scalar()
    labels = F.array(*[F.col(c).cast("int") for c in label_cols])
    points = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vec"),
        labels.alias("labels"),
        _blocks_of(n).alias("blocks"),
    ).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = points.select("id", "vec", "labels", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = points.select("id", "vec", "labels", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    sums = (
        left.groupBy("i", "j")
        .cogroup(right.groupBy("i", "j"))
        .applyInPandas(_distance_sums(), "labelling int, id long, own int, cluster int, total double, size long")
    )
    mean_to = (
        sums.groupBy("labelling", "id", "own", "cluster")
        .agg(F.sum("total").alias("total"), F.sum("size").alias("size"))
    )
    is_own = F.col("cluster") == F.col("own")
    per_point = mean_to.groupBy("labelling", "id").agg(
        F.max(F.when(is_own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~is_own, F.col("total") / F.col("size"))).alias("b"),
        F.count("*").alias("clusters"),
    )
    widest = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | (widest == 0), 0.0).otherwise((F.col("b") - F.col("a")) / widest)
    return per_point.groupBy("labelling").agg(
        F.max("clusters").alias("clusters"),
        F.count("*").alias("points"),
        F.when(F.max("clusters") > 1, F.avg(value)).otherwise(-1.0).alias("silhouette"),
    )


def silhouette_squared(df: DataFrame, vector_col: str, label_cols: list[str]) -> DataFrame:
    """Mean silhouette by squared Euclidean distance per labelling: (labelling, clusters, points, silhouette).

    The mean squared distance from a point to a cluster follows from the cluster's size, vector sum and sum of
    squares, so the cost is linear in the rows; what each row is compared with is one entry per cluster.  The same
    conventions hold as for :func:`silhouette_exact`.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    labels = F.posexplode(F.array(*[F.col(c).cast("int") for c in label_cols])).alias("labelling", "own")
    points = df.select(v.alias("v"), labels).withColumn("q", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    parts = points.select("labelling", "own", "q", F.posexplode("v").alias("d", "x"))
    sums = parts.groupBy("labelling", "own", "d").agg(
        F.sum("x").alias("s"), F.sum(F.when(F.col("d") == 0, F.col("q"))).alias("q"), F.sum(F.when(F.col("d") == 0, 1)).alias("n")
    )
    clusters = sums.groupBy("labelling", "own").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")
    )
    per_labelling = clusters.groupBy("labelling").agg(F.collect_list(F.struct("own", "s", "q", "n")).alias("clusters"))

    def total(c: Column) -> Column:
        dot = F.aggregate(F.zip_with(F.col("v"), c["s"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return c["n"] * F.col("q") - 2 * dot + c["q"]

    own = F.filter("clusters", lambda c: c["own"] == F.col("own"))
    own_total = F.get(F.transform(own, lambda c: F.when(c["n"] > 1, F.greatest(total(c), F.lit(0.0)) / (c["n"] - 1))), F.lit(0))
    others = F.transform(F.filter("clusters", lambda c: c["own"] != F.col("own")), lambda c: F.greatest(total(c), F.lit(0.0)) / c["n"])
    per_point = points.join(per_labelling, "labelling").select(
        "labelling", F.size("clusters").alias("clusters"), own_total.alias("a"), F.array_min(others).alias("b")
    )
    widest = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | (widest == 0), 0.0).otherwise((F.col("b") - F.col("a")) / widest)
    return per_point.groupBy("labelling").agg(
        F.max("clusters").alias("clusters"),
        F.count("*").alias("points"),
        F.when(F.max("clusters") > 1, F.avg(value)).otherwise(-1.0).alias("silhouette"),
    )


# --- k-means ----------------------------------------------------------------

STARTS = 20


@dataclass(frozen=True)
class Choice:
    k: int
    scores: DataFrame
    centres: np.ndarray


def choose_k(
    scaled: DataFrame,
    *,
    id_col: str = "customer_id",
    candidates: list[int] | None = None,
    starts: int = STARTS,
    seed: int = K.SEED,
    measure: str = "silhouette",
    **options,
) -> Choice:
    """Number of clusters with the best silhouette, fitted and scored on all rows, and the centres fitted for it.

    ``scaled`` is (id, array<double> features), stored.  Every number of clusters is fitted from ``starts`` starts, all of them together in one
    scan a round, and the cheapest fit of each is scored.  ``scores`` has a row per candidate with its cost, the Euclidean ``silhouette``
    between its bounds, and that of squared distances (``silhouette_squared``); the first strictly best one by ``measure`` is chosen.
    ``options`` go to :func:`kmeans.fit_models`, such as ``batches`` for mini batches.
    """
    candidates = candidates or K.CLUSTER_COUNTS
    size = len(scaled.select("features").first()[0])
    best, _ = kmeans.best_fits(kmeans.pack_points(scaled, id_col, "features"), candidates, starts, seed, **options)
    names = [f"k{fit.k}" for fit in best]
    labelled = scaled.select(id_col, "features", *[kmeans.nearest_centre(F.col("features"), fit.centres)[0].alias(n) for n, fit in zip(names, best)])
    packed = kmeans.pack_points(labelled, id_col, "features", *names)
    squared = silhouette_squared(labelled, "features", names).select("labelling", F.col("silhouette").alias("silhouette_squared"))
    fits = scaled.sparkSession.createDataFrame([(i, fit.k, fit.cost) for i, fit in enumerate(best)], "labelling int, k int, cost double")
    scores = kmeans.silhouette_bounds(packed, names, size).join(squared, "labelling").join(fits, "labelling")
    stored = write_stage(scores.select("k", "cost", "silhouette", "lower", "upper", "silhouette_squared"), "cluster-scores")
    chosen = stored.orderBy(F.desc(measure), "k").first()["k"]  # one row per candidate
    return Choice(chosen, stored.withColumn("chosen", F.col("k") == chosen), best[candidates.index(chosen)].centres)


def covariance(df: DataFrame, vector_col: str, size: int) -> DataFrame:
    """(i, j, value) with i <= j: the covariance of each two coordinates over the population, in one scan."""
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    x = [F.get(F.col(vector_col), F.lit(i)).cast("double") for i in range(size)]
    held = df.agg(F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("c"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    return held.select(F.explode(F.arrays_zip(places.alias("at"), F.col("c").alias("value"))).alias("e")).select("e.at.i", "e.at.j", "e.value")


def matrix_of(found: DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for r in found.collect():  # one row per two coordinates
        out[r.i, r.j] = out[r.j, r.i] = r.value
    return out


def principal_axes(matrix: np.ndarray, components: int = 2) -> np.ndarray:
    """The axes along which a covariance matrix spreads most, with a fixed sign: the largest loading of each is positive."""
    axes = np.linalg.eigh(matrix)[1][:, ::-1][:, :components]
    strongest = np.abs(axes).argmax(axis=0)
    return axes * np.sign(axes[strongest, range(components)])


def axis_checks(matrix: np.ndarray, axes: np.ndarray) -> list[tuple[int, float, float, float]]:
    """(axis, length, product with the other axes, largest deviation of the matrix times the axis from a multiple of it)."""
    out = []
    for k, a in enumerate(axes.T):
        others = [abs(float(a @ b)) for j, b in enumerate(axes.T) if j != k]
        out.append((k, float(np.linalg.norm(a)), max(others, default=0.0), float(np.abs(matrix @ a - (a @ matrix @ a) * a).max())))
    return out


def _oriented_pca(scaled: DataFrame, components: int = 2) -> np.ndarray:
    size = len(scaled.select("features").first()[0])
    return principal_axes(matrix_of(covariance(scaled, "features", size), size), components)


def project(df: DataFrame, vector_col: str, axes: np.ndarray, names: list[str]) -> DataFrame:
    """Coordinates along the given axes; the vectors are centred already."""

    def along(axis: np.ndarray) -> Column:
        terms = [F.col(vector_col)[i] * float(w) for i, w in enumerate(axis)]
        return sum(terms, F.lit(0.0))

    return df.select("*", *[along(axes[:, i]).alias(n) for i, n in enumerate(names)])


def pca_coordinates(scaled: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """First two principal coordinates of stored, standardised vectors."""
    return project(scaled, "features", _oriented_pca(scaled), ["cluster_x", "cluster_y"]).select(id_col, "cluster_x", "cluster_y")


@dataclass(frozen=True)
class Clustered:
    profile: DataFrame
    choice: Choice


def assign_clusters(profile: DataFrame, *, starts: int = STARTS, seed: int = K.SEED, **options) -> Clustered:
    """Add cluster_id, cluster_x, cluster_y to a stored profile."""
    features = standardise(cluster_features(profile), K.CLUSTER_FEATURES)
    vectors = features.select("customer_id", F.array(*K.CLUSTER_FEATURES).alias("features"))
    stored = write_stage(vectors, "cluster-features")
    choice = choose_k(stored, starts=starts, seed=seed, **options)
    placed = project(stored, "features", _oriented_pca(stored), ["cluster_x", "cluster_y"])
    cluster, _ = kmeans.nearest_centre(F.col("features"), choice.centres)
    columns = placed.select("customer_id", cluster.alias("cluster_id"), "cluster_x", "cluster_y")
    return Clustered(profile.join(columns, "customer_id", "left"), choice)


# --- personas ---------------------------------------------------------------


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Size and means per cluster (a handful of rows); exact, so that equal clusters compare equal."""
    means = {
        "avg_age": "age",
        "sessions": "session_count",
        "orders": "order_count",
        "revenue": "revenue",
        "aov": "avg_order_value",
        "conversion": "session_to_order_rate",
        "avg_discount": "avg_discount_pct",
        "avg_rating": "avg_rating",
        "recency": "recency_days",
    }
    return clustered.groupBy("cluster_id").agg(
        F.count("customer_id").alias("users"), *[S.fraction_mean(F.col(col)).alias(out) for out, col in means.items()]
    )


_THRESHOLDS = ["revenue", "orders", "sessions", "recency", "avg_discount", "conversion"]


def persona_thresholds(summary: DataFrame) -> DataFrame:
    """Upper quartiles over the clusters, and the plain mean of their conversions."""
    return summary.agg(
        *[F.percentile(c, F.lit(0.75)).alias(c) for c in _THRESHOLDS], S.fraction_mean(F.col("conversion")).alias("mean_conversion")
    )


def persona_names(summary: DataFrame) -> DataFrame:
    """Name each cluster by the first rule it meets, best revenue first.

    A name already taken by a better cluster gets the cluster number appended.
    """
    every = W.partitionBy()  # one row per cluster
    total = F.sum(F.col("conversion").cast("decimal(28,12)")).over(every).cast("double")
    held = summary.withColumns(
        {f"__{c}": F.percentile(c, F.lit(0.75)).over(every) for c in _THRESHOLDS} | {"__mean": total / F.count("conversion").over(every)}
    )

    def top(c: str) -> Column:
        return F.col(c) >= F.col(f"__{c}")

    label = S.first_match(
        [
            ((F.col("revenue") <= 0) & (F.col("orders") <= 0), K.PERSONAS["never"]),
            (top("revenue") & top("orders"), K.PERSONAS["value"]),
            (
                top("sessions") & (F.col("conversion") < F.col("__mean")),
                K.PERSONAS["browsing"],
            ),
            (top("avg_discount"), K.PERSONAS["discounts"]),
            (top("recency"), K.PERSONAS["dormant"]),
            (top("conversion"), K.PERSONAS["intent"]),
        ],
        K.PERSONAS["other"],
    )
    turn = F.row_number().over(W.partitionBy("label").orderBy(F.desc("revenue"), F.desc("orders"), "cluster_id"))
    numbered = F.concat("label", F.lit(" "), (F.col("cluster_id") + 1).cast("string"))
    return (
        held.withColumn("label", label)
        .withColumn("turn", turn)
        .withColumn("cluster_name", F.when(F.col("turn") == 1, F.col("label")).otherwise(numbered))
        .drop(*[f"__{c}" for c in _THRESHOLDS], "__mean", "label", "turn")
    )


def add_personas(clustered: DataFrame, named: DataFrame) -> DataFrame:
    """Attach cluster_name to every customer (one row per cluster)."""
    return clustered.join(named.select("cluster_id", "cluster_name"), "cluster_id", "left")


def _dominant(clustered: DataFrame, column: str) -> DataFrame:
    counts = clustered.dropna(subset=[column]).groupBy("cluster_name", column).agg(F.count("*").alias("users"))
    first = F.min_by(F.struct(column, "users"), F.struct(-F.col("users"), F.col(column)))
    return counts.groupBy("cluster_name").agg(first.alias("top"))


def persona_top_region(clustered: DataFrame) -> DataFrame:
    """Most common region per persona and its share of the persona's customers."""
    totals = clustered.groupBy("cluster_name").agg(F.count("*").alias("total"))
    return (
        _dominant(clustered, "region")
        .join(totals, "cluster_name")
        .select(
            "cluster_name",
            F.col("top.region").alias("top_region"),
            F.col("top.users").alias("users"),
            (F.col("top.users") / F.col("total")).alias("share"),
        )
    )


def persona_top_source(clustered: DataFrame) -> DataFrame:
    return _dominant(clustered, "dominant_source").select(
        "cluster_name", F.col("top.dominant_source").alias("top_source"), F.col("top.users").alias("users")
    )


def persona_figures(clustered: DataFrame) -> DataFrame:
    """Means per persona with its dominant region and source, best revenue first."""
    means = clustered.groupBy("cluster_name").agg(
        F.count("customer_id").alias("users"),
        *[
            S.fraction_mean(F.col(column)).alias(name)
            for name, column in {
                "revenue": "revenue",
                "orders": "order_count",
                "sessions": "session_count",
                "conversion": "session_to_order_rate",
                "avg_age": "age",
                "avg_rating": "avg_rating",
            }.items()
        ],
    )
    region = persona_top_region(clustered).select("cluster_name", "top_region", F.col("share").alias("top_region_share"))
    source = persona_top_source(clustered).select("cluster_name", "top_source")
    return (
        means.join(region, "cluster_name", "left")
        .join(source, "cluster_name", "left")
        .orderBy(F.desc("revenue"), "cluster_name")
    )


def persona_cards(figures: DataFrame) -> DataFrame:
    """The figures as printed."""
    c = F.col
    return figures.select(
        "cluster_name",
        S.number_text("users").alias("users"),
        S.currency_text("revenue").alias("revenue"),
        S.fixed_text("orders", 2).alias("orders"),
        S.fixed_text("sessions", 2).alias("sessions"),
        S.percent_text("conversion").alias("conversion"),
        F.coalesce(F.when(c("avg_age").isNotNull(), S.fixed_text("avg_age", 1)), F.lit("-")).alias("avg_age"),
        S.fixed_text("avg_rating", 2).alias("avg_rating"),
        "top_region",
        S.percent_text("top_region_share", 0).alias("top_region_pct"),
        "top_source",
    )


_HEAT_METRICS = ["sessions", "orders", "revenue", "aov", "conversion", "avg_discount", "avg_rating", "recency", "avg_age"]


def cluster_zscores(named: DataFrame) -> DataFrame:
    """Each metric relative to the mean over clusters, in population deviations."""
    return standardise(named.select("cluster_name", *_HEAT_METRICS), _HEAT_METRICS)


def marker_size(revenue: Column) -> Column:
    """A marker's size: by revenue, within fixed limits."""
    return F.least(F.greatest(revenue + 20, F.lit(20.0)), F.lit(600.0))


def cluster_scatter(clustered: DataFrame, n: int = K.SCATTER_SAMPLE, seed: int = K.SEED) -> DataFrame:
    """A fixed sample of customers in the plane, with a clipped marker size."""
    sample = stable_sample(clustered.select("customer_id", "cluster_x", "cluster_y", "cluster_name", "revenue"), "customer_id", n, seed)
    return sample.select("customer_id", "cluster_x", "cluster_y", "cluster_name", marker_size(F.col("revenue")).alias("marker_size"))
