"""Cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import scalars as S
from basketlens.sources.tables import RetailTables


def retention(
    tables: RetailTables,
    *,
    activity: str = "sessions",
    cohort: str = "signup_date",
    grain: str = "month",
    periods: int = 12,
) -> DataFrame:
    """Share of each cohort active n periods after its start, in long form.

    ``activity`` is "sessions" or "orders".  ``cohort`` is a timestamp column of
    customers, or "first_activity".  A customer counts once per period.  The
    denominator is the whole cohort; cohorts nobody of which was active within 0..periods
    do not appear.
    """
    if activity not in ("sessions", "orders"):
        raise ValueError(f"unsupported activity: {activity}")
    source, ts = (tables.sessions, "start_time") if activity == "sessions" else (tables.orders, "order_time")

    # one row per customer and period before any join: bounded per customer
    active = (
        source.select("customer_id", S.period_start(F.col(ts), grain).alias("active_period"))
        .dropna()
        .distinct()
    )
    if cohort == "first_activity":
        starts = active.groupBy("customer_id").agg(F.min("active_period").alias("cohort"))
    else:
        starts = tables.customers.select("customer_id", S.period_start(F.col(cohort), grain).alias("cohort"))
    starts = starts.filter(F.col("cohort").isNotNull())

    number = S.periods_between(F.col("cohort"), F.col("active_period"), grain)
    cells = (
        active.join(starts, "customer_id")
        .withColumn("period", number)
        .filter(F.col("period").between(0, periods))
        .groupBy("cohort", "period")
        .agg(F.count("*").alias("active_users"))
    )
    sizes = starts.groupBy("cohort").agg(F.count("*").alias("cohort_size"))
    return cells.join(sizes, "cohort").withColumn("retention", F.col("active_users") / F.col("cohort_size"))


def retention_wide(long_form: DataFrame, periods: int = 12, prefix: str = "m") -> DataFrame:
    """One row per cohort, one column per period; null where nobody was active."""
    numbers = list(range(periods + 1))
    pivoted = long_form.groupBy("cohort").pivot("period", numbers).agg(F.max("retention"))
    return pivoted.select(
        F.col("cohort"), *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in numbers]
    ).orderBy("cohort")


def retention_matrix(long_form: DataFrame) -> DataFrame:
    """One record per cohort: its date, the periods present in the whole matrix, the values."""
    months = long_form.agg(F.array_sort(F.collect_set("period")).alias("p")).scalar()
    by_period = F.map_from_entries(F.collect_list(F.struct("period", "retention")))
    rows = long_form.groupBy("cohort").agg(by_period.alias("cells")).withColumn("months", months)
    return rows.select(
        F.date_format("cohort", "yyyy-MM-dd").alias("cohort"),
        "months",
        F.transform("months", lambda m: F.try_element_at(F.col("cells"), m)).alias("values"),
    ).orderBy("cohort")


def retention_text(long_form: DataFrame, periods: int = 12) -> DataFrame:
    """The matrix as printed: "yyyy-MM" rows, percentages, blanks for empty cells."""
    wide = retention_wide(long_form, periods)
    cells = [S.percent_text(c, 1, missing="").alias(c) for c in wide.columns if c != "cohort"]
    return wide.select(S.month_text(F.col("cohort")).alias("cohort"), *cells)
