"""Figures by month and by country, and the demographic cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.operators.customers import geo_lookup
from basketlens.sources.literals import ordered_domain
from basketlens.sources.tables import RetailTables


def monthly_overview(tables: RetailTables, *, exact_users: bool = True) -> DataFrame:
    """Sessions, users, orders, revenue and ratings per month.

    Months with a session or an order; a month with only reviews is left out.  The
    rolling mean covers three rows, not three calendar months.  ``exact_users=False``
    trades the distinct counts' extra exchange for a sketch.
    """
    distinct = F.countDistinct if exact_users else F.approx_count_distinct

    def by_month(df: DataFrame, ts: str, *measures) -> DataFrame:
        dated = df.withColumn("month", S.period_start(F.col(ts)))
        return dated.filter(F.col("month").isNotNull()).groupBy("month").agg(*measures)

    sessions = by_month(
        tables.sessions,
        "start_time",
        F.count("session_id").alias("sessions"),
        distinct("customer_id").alias("active_users"),
    )
    orders = by_month(
        tables.orders,
        "order_time",
        F.count("order_id").alias("orders"),
        F.sum("total_usd").cast("double").alias("revenue"),
        S.mean_of(F.col("total_usd")).alias("aov"),
        distinct("customer_id").alias("buyers"),
    )
    ratings = by_month(
        tables.reviews,
        "review_time",
        S.mean_of(F.col("rating")).alias("avg_rating"),
        F.count("review_id").alias("review_count"),
    )
    monthly = sessions.join(orders, "month", "full").join(ratings, "month", "left").fillna(0)
    # one row per calendar month, so the unpartitioned window stays small
    last_three = W.orderBy("month").rowsBetween(-2, W.currentRow)
    return monthly.withColumns(
        {
            "session_to_order": S.ratio(F.col("orders"), F.col("sessions")),
            "revenue_rolling_3m": F.avg("revenue").over(last_three),
        }
    ).orderBy("month")


def monthly_revenue(orders: DataFrame) -> DataFrame:
    dated = orders.withColumn("month", S.period_start(F.col("order_time")))
    return (
        dated.filter(F.col("month").isNotNull())
        .groupBy("month")
        .agg(F.sum("total_usd").cast("double").alias("revenue"))
    )


def recent_revenue(orders: DataFrame, months: int = 3) -> DataFrame:
    """Revenue of the last ``months`` calendar months up to the latest order, and the change from the month before it.

    A month without orders has no row; the change of the first row, or after a gap, is null.
    """
    monthly = monthly_revenue(orders)
    last = monthly.agg(F.max("month").alias("m")).scalar()
    before = F.lag(F.struct("month", "revenue")).over(W.orderBy("month"))  # one row per month
    recent = monthly.filter(F.col("month") > F.add_months(last, -months - 1).cast("timestamp_ntz")).withColumn("before", before)
    follows = F.col("before.month") == F.add_months("month", -1).cast("timestamp_ntz")
    change = F.when(follows & (F.col("before.revenue") > 0), F.col("revenue") / F.col("before.revenue") - 1)
    shown = recent.withColumn("change", change).filter(F.col("month") > F.add_months(last, -months).cast("timestamp_ntz"))
    return shown.select("month", "revenue", "change").orderBy("month")


def peak_month(orders: DataFrame) -> DataFrame:
    """The month with the highest revenue (the earlier one on a tie) and its label."""
    return (
        monthly_revenue(orders)
        .orderBy(F.desc("revenue"), "month")
        .limit(1)
        .withColumn("label", S.month_text(F.col("month"), long=True))
    )


def geography(tables: RetailTables) -> DataFrame:
    """Sessions, users, orders and revenue per country."""
    sessions = (
        tables.sessions.dropna(subset=["country"])
        .groupBy("country")
        .agg(F.count("session_id").alias("sessions"), F.countDistinct("customer_id").alias("active_users"))
    )
    orders = (
        tables.orders.dropna(subset=["country"])
        .groupBy("country")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum("total_usd").cast("double").alias("revenue"),
            S.mean_of(F.col("total_usd")).alias("aov"),
        )
    )
    merged = sessions.join(orders, "country", "full").fillna(0)
    placed = geo_lookup(merged, "country", tables.countries)
    return placed.withColumn("conversion", S.ratio(F.col("orders"), F.col("sessions"))).orderBy("country")


def highest_aov_country(geo: DataFrame) -> DataFrame:
    """The country with the highest average order value."""
    return geo.select("country", "country_name", "aov").orderBy(F.desc("aov"), "country").limit(1)


def new_user_conversion(tables: RetailTables) -> DataFrame:
    """Per signup month: new customers, those who ordered in that month, and their share."""
    signups = tables.customers.select("customer_id", S.period_start(F.col("signup_date")).alias("month")).dropna()
    bought = tables.orders.select("customer_id", S.period_start(F.col("order_time")).alias("month")).dropna().distinct()
    return (
        signups.join(bought.withColumn("bought", F.lit(1)), ["customer_id", "month"], "left")
        .groupBy("month")
        .agg(F.count("*").alias("new_users"), F.count("bought").alias("buyers"))
        .withColumn("conversion", S.ratio(F.col("buyers"), F.col("new_users")))
        .orderBy("month")
    )


def demographics(profile: DataFrame) -> DataFrame:
    """Customers per region, gender and age band; empty cells are absent."""
    cell = ["region", "gender_inferred", "age_band"]
    return profile.fillna(K.UNKNOWN, subset=cell).groupBy(*cell).agg(F.count("*").alias("users"))


def age_pyramid(profile: DataFrame) -> DataFrame:
    """Customers per age band and gender; ``plot_users`` is negative for men."""
    cells = (
        profile.dropna(subset=["age_band", "gender_inferred"])
        .groupBy("age_band", "gender_inferred")
        .agg(F.count("*").alias("users"))
    )
    signed = F.when(F.col("gender_inferred") == "Male", -F.col("users")).otherwise(F.col("users"))
    bands = ordered_domain(profile.sparkSession, "age_band", K.AGE_LABELS + [K.UNKNOWN])
    return (
        cells.withColumn("plot_users", signed)
        .join(F.broadcast(bands), "age_band")
        .select("position", "age_band", "gender_inferred", "users", "plot_users")
        .orderBy("position", "gender_inferred")
    )


def customer_cube(profile: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Counts of several figures from one scan: (figure, first, second, users) for each figure's one or two columns.

    Grouping sets make a row per figure in the scan itself, so the profile is read once however many figures there are.  Rows
    where a figure's column is null do not count in it.
    """
    names = sorted({c for cs in columns.values() for c in cs})
    sets = [[F.col(c) for c in cs] for cs in columns.values()]
    # a column's bit in the id of the set is 0 where it belongs to the set; the first column has the highest bit
    number = {figure: sum((c not in cs) << (len(names) - 1 - i) for i, c in enumerate(names)) for figure, cs in columns.items()}
    cells = profile.select(*names).groupingSets(sets, *[F.col(c) for c in names]).agg(F.grouping_id().alias("set"), F.count("*").alias("users"))
    rows = []
    for figure, cs in columns.items():
        here = (F.col("set") == number[figure]) & F.col(cs[0]).isNotNull() & (F.col(cs[1]).isNotNull() if len(cs) > 1 else F.lit(True))
        value = F.struct(F.lit(figure).alias("figure"), F.col(cs[0]).cast("string").alias("first"), (F.col(cs[1]).cast("string") if len(cs) > 1 else F.lit(None).cast("string")).alias("second"))
        rows.append(F.when(here, value))
    return cells.select(F.coalesce(*rows).alias("r"), "users").where("r is not null").select("r.*", "users")
