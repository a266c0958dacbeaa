"""RFM scores and segments, lifecycle stages, value tiers, actions, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.operators.ranking import quantile_scores


def rfm_scores(profile: DataFrame) -> DataFrame:
    """Add r_score, f_score, m_score (1..5) and the three-digit rfm_score."""
    scored = quantile_scores(
        profile,
        {
            "r_score": ("recency_days", True),
            "f_score": ("order_count", False),
            "m_score": ("revenue", False),
        },
        id_col="customer_id",
    )
    return scored.withColumn("rfm_score", F.concat("r_score", "f_score", "m_score"))


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    recent, lapsed = r >= 4, r <= 2
    rare, small = f <= 2, m <= 2
    return S.first_match(
        [
            (recent & (f >= 4) & (m >= 4), "Champions"),
            (recent & (f >= 3), "Loyal Customers"),
            (lapsed & (f >= 4), "At-Risk High Value"),
            (lapsed & rare & small, "Lost Low Value"),
            (rare & small, "Price / Casual Shoppers"),
        ],
        K.RFM_DEFAULT,
    )


def add_rfm(profile: DataFrame) -> DataFrame:
    """Scores plus rfm_segment.  ``profile`` should be a stored table."""
    segment = rfm_segment(F.col("r_score"), F.col("f_score"), F.col("m_score"))
    return rfm_scores(profile).withColumn("rfm_segment", segment)


def rfm_summary(segmented: DataFrame) -> DataFrame:
    return (
        segmented.groupBy("rfm_segment")
        .agg(
            F.count("customer_id").alias("customers"),
            S.money_sum(F.col("revenue")).alias("revenue"),
            F.avg("order_count").alias("avg_orders"),
            F.avg("recency_days").alias("avg_recency"),
        )
        .orderBy(F.desc("revenue"), "rfm_segment")
    )


def lifecycle_stage(order_count: Column, session_count: Column, recency_days: Column) -> Column:
    """The rules leave gaps on purpose: one order 46 to 60 days ago is "Unclassified"."""
    never, bought = order_count == 0, order_count >= 1
    return S.first_match(
        [
            (never & (recency_days <= 30), "New Visitor"),
            (never & (session_count > 0), "Browsing Prospect"),
            ((order_count == 1) & (recency_days <= 45), "New Buyer"),
            ((order_count >= 2) & (recency_days <= 60), "Active Repeat Buyer"),
            (bought & (recency_days > 60) & (recency_days <= 120), "Cooling Down"),
            (bought & (recency_days > 120), "Dormant Customer"),
        ],
        K.LIFECYCLE_DEFAULT,
    )


def add_lifecycle(profile: DataFrame) -> DataFrame:
    stage = lifecycle_stage(F.col("order_count"), F.col("session_count"), F.col("recency_days"))
    return profile.withColumn("lifecycle_stage", stage)


def lifecycle_summary(staged: DataFrame) -> DataFrame:
    return (
        staged.groupBy("lifecycle_stage")
        .agg(F.count("customer_id").alias("customers"), S.money_sum(F.col("revenue")).alias("revenue"))
        .orderBy(F.desc("customers"), "lifecycle_stage")
    )


def add_ltv(profile: DataFrame) -> DataFrame:
    score = S.ltv_score(F.col("revenue"), F.col("order_count"), F.col("recency_days"))
    return profile.withColumn("ltv_score", score).withColumn("ltv_tier", S.ltv_tier(F.col("ltv_score")))


def add_crm(profile: DataFrame) -> DataFrame:
    return profile.withColumn("crm_recommendation", S.crm_action(F.col("lifecycle_stage"), F.col("rfm_segment")))


def customer_lookup(profile: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """The 23-field customer card for one or many ids; unknown ids give no row.

    ``ids`` is a short list (a pushed-down filter) or a table with customer_id.
    """
    if isinstance(ids, DataFrame):
        chosen = profile.join(ids.select("customer_id").distinct(), "customer_id", "left_semi")
    else:
        chosen = profile.filter(F.col("customer_id").isin(ids))
    if "cluster_name" not in profile.columns:
        chosen = chosen.withColumn("cluster_name", F.lit("-"))
    return add_crm(add_ltv(chosen)).select(
        "customer_id",
        "name",
        F.col("country_name").alias("country"),
        "region",
        "age",
        "age_band",
        "gender_inferred",
        F.col("marketing_opt_in").cast("boolean").alias("marketing_opt_in"),
        "session_count",
        "order_count",
        "revenue",
        "avg_order_value",
        "avg_discount_pct",
        "recency_days",
        "active_days",
        "page_to_cart_rate",
        "avg_rating",
        "rfm_segment",
        "lifecycle_stage",
        "cluster_name",
        "ltv_tier",
        "ltv_score",
        "crm_recommendation",
    )
