"""Product and category figures.

Order lines and reviews are combined per product before they meet the product
table, so a best-seller that holds a third of all lines is one row by then.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.sources.tables import RetailTables


def order_lines(tables: RetailTables) -> DataFrame:
    """Every order line with its category, margin and month; unknown keys give nulls."""
    products = tables.products.select("product_id", "category", "margin_usd")
    orders = tables.orders.select("order_id", S.period_start(F.col("order_time")).alias("month"))
    return (
        tables.order_items.select("order_id", "product_id", "quantity", "line_total_usd")
        .join(products, "product_id", "left")
        .join(orders, "order_id", "left")
        .withColumn("gross_margin", F.col("margin_usd") * F.col("quantity"))
    )


def product_sales(order_items: DataFrame) -> DataFrame:
    return (
        order_items.dropna(subset=["product_id"])
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units"), F.sum("line_total_usd").alias("revenue"))
    )


def product_ratings(reviews: DataFrame, counted: str = "review_id") -> DataFrame:
    """Mean rating per product; ``counted`` says what a review is counted by."""
    return (
        reviews.dropna(subset=["product_id"])
        .groupBy("product_id")
        .agg(S.mean_of(F.col("rating")).alias("avg_rating"), F.count(counted).alias("review_count"))
    )


def category_performance(tables: RetailTables) -> DataFrame:
    """Per category: revenue, units, margin, sold products, rating.

    ``avg_rating`` is the plain mean of product means.  Every category of the
    product table appears, also one without sales.
    """
    products = tables.products.dropna(subset=["category"]).select("product_id", "category", "margin_usd")
    sold = product_sales(tables.order_items).withColumn("sold", F.lit(1))
    joined = products.join(sold, "product_id", "left").join(product_ratings(tables.reviews), "product_id", "left")
    return (
        joined.groupBy("category")
        .agg(
            F.sum("revenue").cast("double").alias("revenue"),
            F.sum("units").alias("units"),
            F.sum(F.col("margin_usd") * F.col("units")).cast("double").alias("gross_margin"),
            F.count("sold").alias("products"),
            F.avg("avg_rating").alias("avg_rating"),
            F.sum("review_count").alias("review_count"),
        )
        .fillna(0)
        .orderBy("category")
    )


def category_monthly(tables: RetailTables) -> DataFrame:
    """Revenue, units and margin for every month with an order line and every category.

    Lines are combined per product and month before the product table is joined.
    The grid gives every category the months found, which the calendar bounds, and
    then looks the totals up; lines of unknown products keep their month in the grid.
    """
    months = tables.orders.select("order_id", S.period_start(F.col("order_time")).alias("month"))
    per_product = (
        tables.order_items.join(months.filter(F.col("month").isNotNull()), "order_id")
        .groupBy("month", "product_id")
        .agg(F.sum("line_total_usd").alias("revenue"), F.sum("quantity").alias("units"))
    )
    products = tables.products.select("product_id", "category", "margin_usd")
    totals = (
        per_product.join(products, "product_id", "left")
        .groupBy("month", "category")
        .agg(
            F.sum("revenue").cast("double").alias("revenue"),
            F.sum("units").alias("units"),
            F.sum(F.col("margin_usd") * F.col("units")).cast("double").alias("gross_margin"),
        )
    )
    found = per_product.agg(F.array_sort(F.collect_set("month")).alias("m")).scalar()
    categories = tables.products.select("category").dropna().distinct()
    grid = categories.withColumn("month", F.explode(found))
    return grid.join(totals, ["month", "category"], "left").fillna(0).orderBy("month", "category")


def top_products(tables: RetailTables, n: int = 12) -> DataFrame:
    """Best products by revenue, then units, with their ratings."""
    named = tables.products.select("product_id", "name", "category").dropna()
    best = (
        product_sales(tables.order_items)
        .join(named, "product_id")
        .orderBy(F.desc("revenue"), F.desc("units"), "product_id")
        .limit(n)
    )
    # n rows: only the reviews of these products are aggregated
    wanted = tables.reviews.join(F.broadcast(best.select("product_id")), "product_id", "left_semi")
    return (
        best.join(product_ratings(wanted), "product_id", "left")
        .fillna(0, subset=["avg_rating", "review_count"])
        .select(
            "product_id",
            "name",
            "category",
            F.col("revenue").cast("double").alias("revenue"),
            "units",
            "avg_rating",
            "review_count",
        )
        .orderBy(F.desc("revenue"), F.desc("units"), "product_id")
    )


def product_master(tables: RetailTables) -> DataFrame:
    """Every product with sales and ratings; missing numbers are 0."""
    sales = product_sales(tables.order_items).select(
        "product_id",
        F.col("units").alias("total_qty"),
        F.col("revenue").cast("double").alias("total_revenue"),
    )
    return (
        tables.products.join(sales, "product_id", "left")
        .join(product_ratings(tables.reviews, counted="rating"), "product_id", "left")
        .fillna(0)
    )


def top_by_units(master: DataFrame, n: int = 10) -> DataFrame:
    return (
        master.select("product_id", "name", "category", "total_qty")
        .orderBy(F.desc("total_qty"), "product_id")
        .limit(n)
    )


def top_rated(master: DataFrame, *, min_reviews: int = 5, n: int = 10) -> DataFrame:
    return (
        master.filter(F.col("review_count") >= min_reviews)
        .select("product_id", "name", "category", "avg_rating", "review_count")
        .orderBy(F.desc("avg_rating"), "product_id")
        .limit(n)
    )


def lowest_rated(master: DataFrame, category: str, n: int = 3) -> DataFrame:
    """The n worst-rated reviewed products of a category."""
    return (
        master.filter((F.col("category") == category) & (F.col("review_count") > 0))
        .select("product_id", "name", "category", "avg_rating", "review_count")
        .orderBy("avg_rating", "product_id")
        .limit(n)
    )


def units_by_name(tables: RetailTables, *, with_category: bool = True) -> DataFrame:
    """Units per product name (and category): products that share a name are merged."""
    keys = ["name", "category"] if with_category else ["name"]
    named = tables.products.select("product_id", *keys).dropna()
    return (
        product_sales(tables.order_items).join(named, "product_id").groupBy(*keys).agg(F.sum("units").alias("units"))
    )


def top_names(tables: RetailTables, *, with_category: bool = True, n: int = 10) -> DataFrame:
    ranked = units_by_name(tables, with_category=with_category)
    keys = [c for c in ranked.columns if c != "units"]
    return ranked.orderBy(F.desc("units"), *keys).limit(n)


def sales_rank(tables: RetailTables, *, days: int | None = None, as_of: dt.datetime | None = None, n: int = 10) -> DataFrame:
    """Best-selling products of the last ``days`` days before ``as_of`` (default: the last order)."""
    lines = tables.order_items
    if days is not None:
        if as_of is None:
            end = tables.orders.agg(F.max("order_time").alias("t")).scalar()
        else:
            end = F.lit(as_of).cast("timestamp_ntz")
        recent = tables.orders.filter(F.col("order_time") > end - F.make_dt_interval(F.lit(days)))
        lines = lines.join(recent.select("order_id"), "order_id", "left_semi")
    named = tables.products.select("product_id", "name", "category")
    best = product_sales(lines).orderBy(F.desc("units"), "product_id").limit(n)
    return best.join(named, "product_id", "left").select("product_id", "name", "category", "units").orderBy(
        F.desc("units"), "product_id"
    )


def sentiment_by_category(tables: RetailTables, labelled: DataFrame) -> DataFrame:
    """Share of each sentiment label per category, in percent.

    ``labelled`` holds product_id and sentiment per review; reviews of unknown
    products are dropped.
    """
    per_product = labelled.groupBy("product_id").agg(
        *[F.count(F.when(F.col("sentiment") == s, 1)).alias(s) for s in K.SENTIMENTS]
    )
    category = tables.products.select("product_id", "category").dropna()
    counts = per_product.join(category, "product_id").groupBy("category").agg(*[F.sum(s).alias(s) for s in K.SENTIMENTS])
    total = sum((F.col(s) for s in K.SENTIMENTS), F.lit(0))
    return counts.select("category", *[(F.col(s) / total * 100).alias(s) for s in K.SENTIMENTS]).orderBy("category")
