"""Spending potential: what a customer's past says about the value tier of a later window."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.operators import customers, segments
from basketlens.operators.ranking import stable_sample
from basketlens.plans.stage import write_stage
from basketlens.sources.tables import RetailTables

TIERS = [name for _, name in K.LTV_TIERS] + [K.LTV_LOWEST_TIER]
NUMBERS = ["session_count", "page_to_cart_rate", "avg_order_value", "avg_discount_pct", "active_days", "recency_days", "marketing_opt_in"]
SCORES = ["r_score", "f_score", "m_score"]


def _parts(tables: RetailTables) -> dict[str, DataFrame]:
    return {name: getattr(tables, name) for name in ("customers", "sessions", "events", "orders", "order_items", "products", "reviews")}


def before(tables: RetailTables, cut: dt.datetime) -> RetailTables:
    """The tables as they were at ``cut``."""
    at = F.lit(cut).cast("timestamp_ntz")
    known = RetailTables(**_parts(tables), countries=getattr(tables, "countries", None), first_names=getattr(tables, "first_names", None))
    return replace(
        known,
        sessions=tables.sessions.filter(F.col("start_time") < at),
        events=tables.events.filter(F.col("timestamp") < at),
        orders=tables.orders.filter(F.col("order_time") < at),
        reviews=tables.reviews.filter(F.col("review_time") < at),
    )


def later_value(tables: RetailTables, cut: dt.datetime, days: int) -> DataFrame:
    """The label: customer_id, and orders, revenue, value score and tier of the ``days`` from ``cut`` on.

    The score is that of the value tiers, with recency counted at the end of the window; the potential is high when the
    tier is one of the upper two.  Customers without an order there are Bronze.
    """
    begin = F.lit(cut).cast("timestamp_ntz")
    end = F.lit(cut + dt.timedelta(days=days)).cast("timestamp_ntz")
    window = tables.orders.filter((F.col("order_time") >= begin) & (F.col("order_time") < end))
    spent = window.groupBy("customer_id").agg(
        F.count("*").alias("later_orders"), F.sum("total_usd").cast("double").alias("later_revenue"), F.max("order_time").alias("last_order")
    )
    c = F.col
    filled = tables.customers.select("customer_id").join(spent, "customer_id", "left").fillna(0, subset=["later_orders", "later_revenue"])
    recency = F.coalesce(S.elapsed_days(end, c("last_order")), F.lit(days))
    scored = filled.withColumn("later_score", F.when(c("later_orders") > 0, S.ltv_score(c("later_revenue"), c("later_orders"), recency)).otherwise(0))
    tier = scored.withColumn("later_tier", S.ltv_tier(c("later_score"))).drop("last_order")
    return tier.withColumn("high_potential", c("later_tier").isin(K.HIGH_POTENTIAL_TIERS))


def past_features(tables: RetailTables, cut: dt.datetime) -> DataFrame:
    """customer_id and the features known at ``cut``: scores, lifecycle stage and seven figures of the profile."""
    profile = customers.customer_profile(before(tables, cut), recency_from="orders", as_of=cut)
    columns = ["customer_id", "order_count", "revenue", *NUMBERS]
    stored = write_stage(profile.select(*columns), "potential-profile")
    return segments.add_lifecycle(segments.rfm_scores(stored)).select("customer_id", *SCORES, "lifecycle_stage", *NUMBERS)


def _vectors(features: DataFrame, extra: list[str]) -> DataFrame:
    """One array of numbers: figures, scores, and an indicator per lifecycle stage (and per other given value)."""
    stages = [F.when(F.col("lifecycle_stage") == s, 1.0).otherwise(0.0) for s in K.CRM_RULES]
    figures = [F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in [*NUMBERS, *extra]]
    scores = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in SCORES]
    return features.withColumn("features", array_to_vector(F.array(*figures, *scores, *stages)))


def spending_potential(
    past: DataFrame, label: DataFrame, now: DataFrame, *, training_rows: int = 200_000, extra: list[str] | None = None, seed: int = K.SEED
) -> DataFrame:
    """customer_id, high_potential, predicted_ltv_tier, potential_score (0 to 100) for every row of ``now``.

    A multinomial logistic model of the later tier is fitted on at most ``training_rows`` customers, chosen by a hash
    of the id, from ``past`` features and ``label``.  The score is the probability of the upper tiers in per cent, and the potential
    is high from 50 on.  ``extra`` names further numeric features, such as persona indicators.
    """
    known = past.join(label.select("customer_id", "later_tier"), "customer_id")
    number = S.first_match([(F.col("later_tier") == t, float(i)) for i, t in enumerate(TIERS)], None)
    rows = stable_sample(known, "customer_id", training_rows, seed)
    train = write_stage(rows.select("*", number.alias("label")), "potential-training")
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=0.001).fit(_vectors(train, extra or []))
    scored = model.transform(_vectors(now, extra or [])).withColumn("p", vector_to_array("probability"))
    # tiers that the training rows lack have no probability
    high = sum((F.coalesce(F.get("p", F.lit(TIERS.index(t))), F.lit(0.0)) for t in K.HIGH_POTENTIAL_TIERS), F.lit(0.0))
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("prediction").cast("int") + 1)
    return scored.select("customer_id", tier.alias("predicted_ltv_tier"), (100 * high).alias("potential_score"), (high >= 0.5).alias("high_potential"))


def _cuts(values: DataFrame, column: str, parts: int):
    """Limits that cut a column into about equal parts, as a scalar array."""
    shares = F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)])
    return values.agg(F.percentile_approx(column, shares, F.lit(10_000)).alias("q")).scalar()


def ranking_auc(df: DataFrame, score: str, label: str, parts: int = 100) -> DataFrame:
    """(positives, negatives, auc): how often a positive row has a higher score than a negative one; ties count half.

    Rows are counted per score, scores are cut into ranges, and positions add up range by range, so no row
    of the table is sorted in one task.  ``label`` is a boolean; rows without score or label do not count.
    """
    c = F.col
    counts = df.where(c(score).isNotNull() & c(label).isNotNull()).groupBy(c(score).cast("double").alias("s"))
    counts = counts.agg(F.sum(c(label).cast("long")).alias("p"), F.sum((~c(label)).cast("long")).alias("n"))
    held = counts.withColumn("q", _cuts(counts, "s", parts)).withColumn("part", F.size(F.filter("q", lambda x: x < c("s"))))
    within = W.partitionBy("part").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    inner = held.select("part", "p", "n", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("below"))
    # pairs within a part, and what every part adds for the parts above it: at most ``parts`` rows
    sums = inner.groupBy("part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(c("p") * (2 * c("below") + c("n")).cast("decimal(38,0)")).alias("pairs"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = sums.withColumn("before", before).agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"), F.sum(c("pairs") + 2 * c("before").cast("decimal(38,0)") * c("p")).alias("pairs")
    )
    return total.select("positives", "negatives", S.ratio(c("pairs").cast("double"), 2 * c("positives").cast("double") * c("negatives")).alias("auc"))


def calibration(df: DataFrame, score: str, label: str, parts: int = 10) -> DataFrame:
    """(part, rows, mean_score, rate): for parts of the scores, what was predicted and the share that came true."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).alias("y"))
    held = known.withColumn("q", _cuts(known, "s", parts)).withColumn("part", F.size(F.filter("q", lambda x: x < F.col("s"))))
    return held.groupBy("part").agg(F.count("*").alias("rows"), S.fraction_mean(F.col("s")).alias("mean_score"), F.avg(F.col("y").cast("double")).alias("rate"))


def potential_quality(predictions: DataFrame, label: DataFrame) -> DataFrame:
    """Predictions of an earlier cut against what happened after it: the figures of :func:`ranking_auc`, and the mean squared error."""
    met = predictions.select("customer_id", (F.col("potential_score") / 100).alias("p")).join(label.select("customer_id", F.col("high_potential").alias("y")), "customer_id")
    error = met.agg(F.avg((F.col("p") - F.col("y").cast("double")) ** 2).alias("e")).scalar()
    return ranking_auc(met, "p", "y").withColumn("squared_error", error)
