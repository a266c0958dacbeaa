"""Who stays, goes and comes back, by bit operations on bitmaps of customers.

Spark's bitmaps hold 32768 ids each.  A month's customers are a row per bitmap, built without a distinct, and months meet bitmap by
bitmap, so what is compared is an eighth of a byte per customer, spread over as many rows as there are bitmaps.  Ids that are
dense fill the bitmaps; sparse ones only make them less full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import scalars as S
from basketlens.sources.tables import RetailTables


def bitmaps(df: DataFrame, *keys: str, id_col: str = "customer_id") -> DataFrame:
    """(keys, bucket, bits): the ids of each key; rows without an id are left out."""
    held = df.where(F.col(id_col).isNotNull())
    return held.groupBy(*keys, F.bitmap_bucket_number(F.col(id_col).cast("long")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(id_col).cast("long"))).alias("bits"))


def in_both(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, both): how many ids of each key are in both frames of bitmaps."""
    met = left.select(*keys, "bucket", "bits").union(right.select(*keys, "bucket", "bits"))
    shared = met.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return shared.where("n = 2").groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("both"))


def customer_flow(orders: DataFrame) -> DataFrame:
    """Per month with orders: active customers, kept from the month before, lost since then, new ones, and returned ones."""
    active = orders.select("customer_id", S.period_start(F.col("order_time")).alias("month")).dropna()
    now = bitmaps(active, "month")
    before = now.withColumn("month", F.col("month") + F.expr("interval 1 month"))
    count = lambda df, name: df.groupBy("month").agg(F.sum(F.bitmap_count("bits")).alias(name))
    new = active.groupBy("customer_id").agg(F.min("month").alias("month")).groupBy("month").agg(F.count("*").alias("new"))
    joined = count(now, "active").join(count(before, "previous"), "month", "left").join(in_both(now, before, "month").withColumnRenamed("both", "kept"), "month", "left").join(new, "month", "left")
    filled = joined.fillna(0)
    return filled.select("month", "active", "kept", (F.col("previous") - F.col("kept")).alias("lost"), "new", (F.col("active") - F.col("kept") - F.col("new")).alias("returned"))


def retention_by_bitmaps(tables: RetailTables, *, cohort: str = "signup_date", periods: int = 12) -> DataFrame:
    """The same rows as :func:`retention.retention` by months of orders, without a row per customer and month after the bitmaps.

    A cohort's bitmap meets those of the ``periods`` months from its start on.
    """
    orders = tables.orders.select("customer_id", S.period_start(F.col("order_time")).alias("month")).dropna()
    starts = tables.customers.select("customer_id", S.period_start(F.col(cohort)).alias("cohort")).dropna()
    sizes = starts.groupBy("cohort").agg(F.count("*").alias("cohort_size"))
    members = bitmaps(starts, "cohort")
    later = members.select("cohort", F.explode(F.sequence(F.lit(0), F.lit(periods))).alias("period"), "bucket", "bits")
    later = later.withColumn("month", F.col("cohort") + F.make_ym_interval(F.lit(0), F.col("period")))
    months = bitmaps(orders, "month").withColumnRenamed("bits", "seen")
    met = later.join(months, ["month", "bucket"]).select("cohort", "period", "bucket", F.explode(F.array("bits", "seen")).alias("b"))
    both = met.groupBy("cohort", "period", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("b")).alias("n"))
    cells = both.groupBy("cohort", "period").agg(F.sum("n").alias("active_users")).where("active_users > 0")
    return cells.join(sizes, "cohort").withColumn("retention", F.col("active_users") / F.col("cohort_size"))
