"""Exact order statistics, quantile scores and deterministic samples.

Nothing here sorts a whole table.  Rows are mapped to narrow ordered buckets,
the buckets are counted with map-side combination, and only the few buckets that
hold a wanted rank are sorted.  Bucket limits come from an approximate quantile
sketch and become literals, so a recomputed task always sees the same buckets;
the sketch decides only how even the buckets are, never the result.

A value that fills a bucket on its own (most customers have one order) is split
further by id range, so a tie of any size spreads over many buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketlens.functions import constants as K

DEFAULT_BUCKETS = 256
_INF = float("inf")


def _limits(df: DataFrame, columns: list[str], buckets: int) -> list[list[float]]:
    shares = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(columns, shares, 1 / (2 * buckets))
    # an empty column gives no limits; one dummy limit keeps the bucketing valid
    return [sorted(set(limits)) or [0.0] for limits in found]


def ranked_rows(
    df: DataFrame,
    id_col: str,
    values: dict[str, Column],
    wanted: Callable[[Column], list[Column]],
    buckets: int = DEFAULT_BUCKETS,
) -> DataFrame:
    """Rows at given ranks, exactly: (metric, k, value, id).

    ``values`` maps a metric to an ascending sort key of type double.  Rows are ranked by
    (key, id) from 1, null keys left out.  ``wanted(n)`` lists the ranks to
    return for a metric with n keys; ``k`` is the position in that list, from 1.
    ``df`` is read three times, so it should be a stored table.  Ids are unique
    integers.
    """
    metrics = list(values)
    keyed = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(id_col).cast("double").alias("__id"),
        *[key.alias(f"__{m}") for m, key in values.items()],
    )
    columns = ["__id"] + [f"__{m}" for m in metrics]
    limits = _limits(keyed, columns, buckets)
    bucketizer = Bucketizer(
        splitsArray=[[-_INF, *ls, _INF] for ls in limits],
        inputCols=columns,
        outputCols=[f"{c}_slot" for c in columns],
        handleInvalid="keep",
    )

    def entry(metric: str, metric_limits: list[float]) -> Column:
        value, slot = F.col(f"__{metric}"), F.col(f"__{metric}_slot").cast("int")
        # one parsed text: a few hundred literal columns would take longer to build than to run
        edges = F.expr(f"array(cast(null as double), {', '.join(f'{x!r}D' for x in metric_limits)})")
        edge = F.try_element_at(edges, slot + 1)
        tied = F.coalesce(value == edge, F.lit(False))
        part = F.when(tied, F.col("__id_slot").cast("int")).otherwise(-1)
        return F.struct(
            F.lit(metric).alias("metric"),
            F.struct(slot.alias("slot"), (~tied).alias("above"), part.alias("part")).alias("bucket"),
            value.alias("value"),
            F.col("id"),
        )

    entries = F.array(*[entry(m, ls) for m, ls in zip(metrics, limits[1:])])
    rows = bucketizer.transform(keyed).select("id", F.explode(entries).alias("e")).select("e.*")
    rows = rows.filter(F.col("value").isNotNull())

    # a bounded table: at most `buckets` squared rows per metric, usually a few hundred
    counts = rows.groupBy("metric", "bucket").agg(F.count("*").alias("size"))
    running = W.partitionBy("metric").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = F.posexplode(F.array(*wanted(F.col("n")))).alias("pos", "rank")
    targets = (
        counts.withColumn("upto", F.sum("size").over(running))
        .withColumn("n", F.sum("size").over(W.partitionBy("metric")))
        .select("metric", "bucket", "size", "upto", ranks)
        .filter((F.col("rank") > F.col("upto") - F.col("size")) & (F.col("rank") <= F.col("upto")))
        .groupBy("metric", "bucket")
        .agg(
            F.collect_list(
                F.struct((F.col("pos") + 1).alias("k"), (F.col("rank") - F.col("upto") + F.col("size")).alias("at"))
            ).alias("marks")
        )
    )
    # at most one row per metric and wanted rank
    inside = rows.join(F.broadcast(targets), ["metric", "bucket"])
    place = F.row_number().over(W.partitionBy("metric", "bucket").orderBy("value", "id"))
    return (
        inside.withColumn("place", place)
        .select("metric", "value", "id", "place", F.explode("marks").alias("mark"))
        .filter("place = mark.at")
        .select("metric", F.col("mark.k").alias("k"), "value", "id")
    )


def exact_median(df: DataFrame, id_col: str, column: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """One row, one column ``median``: the exact median, null for no values."""

    def middle(n: Column) -> list[Column]:
        return [F.ceil(n / 2), F.floor(n / 2) + 1]

    found = ranked_rows(df, id_col, {column: F.col(column).cast("double")}, middle, buckets)
    return found.agg(F.avg("value").alias("median"))


def quantile_scores(
    df: DataFrame,
    scores: dict[str, tuple[str, bool]],
    *,
    id_col: str,
    bins: int = 5,
    buckets: int = DEFAULT_BUCKETS,
) -> DataFrame:
    """Add equal-frequency scores 1..bins, one per entry of ``scores``.

    ``scores`` maps the new column to (value column, descending).  Rows are
    ordered by value, ties by id ascending in both directions; with q =
    min(bins, n) rank r gets max(1, ceil((r - 1) * q / (n - 1))).  Null values
    count as the exact median, or as 0 without any value.

    A score changes only at q - 1 ranks, so it is enough to find the rows at those
    ranks and compare every row with them: ``df`` itself is not shuffled.
    """
    columns = sorted({column for column, _ in scores.values()})
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    keys: dict[str, Column] = {}
    for name, (column, descending) in scores.items():
        value = F.col(column).cast("double")
        if nulls[column]:
            median = exact_median(df, id_col, column, buckets).first()["median"]
            value = F.coalesce(value, F.lit(median or 0.0))
        # adding to 0.0 turns a negative zero, which would order below zero, into zero
        keys[name] = F.lit(0.0) - value if descending else F.lit(0.0) + value

    def last_ranks(n: Column) -> list[Column]:
        q = F.least(F.lit(bins), n)
        return [
            F.when(F.lit(k) < q, F.floor(F.lit(k) * (n - 1) / q).cast("long") + 1) for k in range(1, bins)
        ]

    found = ranked_rows(df, id_col, keys, last_ranks, buckets)
    cuts = found.agg(
        *[
            F.max(F.when((F.col("metric") == name) & (F.col("k") == k), F.struct("value", "id"))).alias(f"{name}_{k}")
            for name in scores
            for k in range(1, bins)
        ]
    )
    cut = cuts.select(F.struct(*cuts.columns).alias("c")).scalar()
    row_id = F.col(id_col).cast("long")

    def score(name: str) -> Column:
        key = keys[name]

        def beyond(k: int) -> Column:
            at = F.col("__cut")[f"{name}_{k}"]
            later = (key > at["value"]) | ((key == at["value"]) & (row_id > at["id"]))
            return F.when(later, 1).otherwise(0)

        return reduce(lambda a, b: a + b, [beyond(k) for k in range(1, bins)], F.lit(1))

    return df.withColumn("__cut", cut).select(*df.columns, *[score(n).cast("int").alias(n) for n in scores])


_HASH_MOD = 1 << 32
_HASH_SLOTS = 4096


def _order_key(id_col: str, seed: int) -> Column:
    return (F.pmod(F.col(id_col).cast("long"), F.lit(_HASH_MOD)) * 1103515245 + seed) % _HASH_MOD


def stable_sample(df: DataFrame, id_col: str, n: int, seed: int = K.SEED) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones every time: lowest id hash, then id.

    A histogram of the hash gives the slot in which the n-th row lies; rows above
    that slot never reach the final sort.
    """
    keyed = df.withColumn("__key", _order_key(id_col, seed))
    width = _HASH_MOD // _HASH_SLOTS
    slots = (
        df.select(F.floor(_order_key(id_col, seed) / width).alias("slot"))
        .groupBy("slot")
        .agg(F.count("*").alias("size"))
        .withColumn("upto", F.sum("size").over(W.orderBy("slot")))
    )
    last_slot = slots.filter(F.col("upto") >= n).agg(F.min("slot").alias("slot")).scalar()
    reachable = keyed.filter(F.col("__key") < (F.coalesce(last_slot, F.lit(_HASH_SLOTS)) + 1) * width)
    return reachable.orderBy("__key", id_col).limit(n).drop("__key")
