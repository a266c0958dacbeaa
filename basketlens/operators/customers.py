"""Customer-grain summaries and the wide customer profile.

Every side of a join onto customers is aggregated to one row per customer
first, so no join sees a hot key: the large tables are combined map-side before
their exchange.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.sources.literals import country_table
from basketlens.sources.tables import RetailTables


def value_profile(df: DataFrame, group_col: str, value_col: str, dominant: str, diversity: str) -> DataFrame:
    """Most frequent non-null value per group (ties: the smaller value) and the number of values.

    Rows are counted per group and value first, so a busy group is a handful of rows
    when it is gathered.
    """
    counted = df.dropna(subset=[group_col, value_col]).groupBy(group_col, value_col).agg(F.count("*").alias("n"))
    best = F.min_by(F.col(value_col), F.struct(-F.col("n"), F.col(value_col)))
    return counted.groupBy(group_col).agg(best.alias(dominant), F.count("*").alias(diversity))


def dominant_value(df: DataFrame, group_col: str, value_col: str, name: str) -> DataFrame:
    return value_profile(df, group_col, value_col, name, "values").drop("values")


def _session_span(sessions: DataFrame) -> DataFrame:
    """Count and span, one row per customer."""
    return (
        sessions.dropna(subset=["customer_id"])
        .groupBy("customer_id")
        .agg(
            F.count("session_id").alias("session_count"),
            F.min("start_time").alias("first_session"),
            F.max("start_time").alias("last_session"),
        )
    )


def _session_parts(sessions: DataFrame) -> DataFrame:
    """Count, span, and most frequent source and device with the number of each, from one pass over the sessions.

    Sessions are combined per customer, source and device; both columns are then counted as entries of one list, so a
    busy customer is a handful of rows from the first exchange on.
    """
    combined = (
        sessions.dropna(subset=["customer_id"])
        .groupBy("customer_id", "source", "device")
        .agg(
            F.count("session_id").alias("sessions"),
            F.count("*").alias("rows"),
            F.min("start_time").alias("first"),
            F.max("start_time").alias("last"),
        )
    )
    # sources carry the count and span as well; every session has one entry of each kind, null ones included
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")) for kind in ("source", "device")]))
    counted = (
        combined.select("customer_id", "sessions", "rows", "first", "last", kinds.alias("e"))
        .groupBy("customer_id", "e.kind", "e.value")
        .agg(F.sum("sessions").alias("sessions"), F.sum("rows").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    )

    def most(kind: str) -> Column:
        known = (F.col("kind") == kind) & F.col("value").isNotNull()
        return F.min_by(F.when(known, F.col("value")), F.when(known, F.struct(-F.col("n"), F.col("value"))))

    def number(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, F.col("value")))

    return counted.groupBy("customer_id").agg(
        F.sum(F.when(F.col("kind") == "source", F.col("sessions"))).alias("session_count"),
        F.min("first").alias("first_session"),
        F.max("last").alias("last_session"),
        most("source").alias("dominant_source"),
        number("source").alias("source_diversity"),
        most("device").alias("dominant_device"),
        number("device").alias("device_diversity"),
    )


def session_summary(sessions: DataFrame) -> DataFrame:
    return _session_parts(sessions).drop("dominant_source", "dominant_device")


def events_per_session(events: DataFrame) -> DataFrame:
    """One row per session: event counts by type, and additive parts of the volume figures."""
    return events.groupBy("session_id").agg(
        F.count("event_id").alias("events"),
        F.count("event_type").alias("typed_events"),
        *[
            F.count(F.when(F.col("event_type") == stage, F.col("event_id"))).alias(column)
            for stage, column in K.STAGE_COUNT_COLUMNS.items()
        ],
        F.sum("qty").alias("qty"),
        F.sum("cart_size").alias("cart_sum"),
        F.count("cart_size").alias("cart_count"),
    )


def _events_per_customer(tables: RetailTables, *measures: Column) -> DataFrame:
    """Aggregate the per-session table by customer; sessions nobody owns are dropped."""
    owners = tables.sessions.select("session_id", "customer_id").dropna()
    return (
        events_per_session(tables.events)
        .join(owners, "session_id")
        .groupBy("customer_id")
        .agg(*measures)
    )


def _event_count_measures() -> list[Column]:
    return [F.sum(c).alias(c) for c in K.STAGE_COUNT_COLUMNS.values()]


def _event_volume_measures() -> list[Column]:
    return [
        F.sum("events").alias("total_events"),
        F.coalesce(F.sum("qty"), F.lit(0)).alias("total_qty"),
        (F.sum("cart_sum").cast("double") / F.nullif(F.sum("cart_count"), F.lit(0))).alias("mean_cart_size"),
    ]


def event_type_counts(tables: RetailTables) -> DataFrame:
    """Page views, cart additions, checkouts and purchases per customer."""
    typed = F.sum("typed_events").alias("typed_events")
    counts = _events_per_customer(tables, *_event_count_measures(), typed)
    return counts.filter("typed_events > 0").drop("typed_events")


def event_volume(tables: RetailTables) -> DataFrame:
    """All events of any type per customer."""
    return _events_per_customer(tables, *_event_volume_measures())


def event_user(tables: RetailTables) -> DataFrame:
    """Every event with its customer; null where the session is unknown."""
    owners = tables.sessions.select("session_id", "customer_id")
    return tables.events.join(owners, "session_id", "left")


def event_summary(tables: RetailTables) -> DataFrame:
    """Both event summaries from one pass over events."""
    typed = F.sum("typed_events").alias("typed_events")
    both = _events_per_customer(tables, *_event_count_measures(), *_event_volume_measures(), typed)
    return both.filter("typed_events > 0").drop("typed_events")


def order_summary(orders: DataFrame) -> DataFrame:
    """Orders, money and first and last order per customer.

    Subtotal and discount figures appear when ``orders`` has those columns.
    """
    measures = {
        "order_count": F.count("order_id"),
        "revenue": F.sum("total_usd").cast("double"),
        "avg_order_value": S.mean_of(F.col("total_usd")),
        "first_order": F.min("order_time"),
        "last_order": F.max("order_time"),
    }
    if "subtotal_usd" in orders.columns:
        measures["subtotal"] = F.sum("subtotal_usd").cast("double")
    if "discount_pct" in orders.columns:
        measures["avg_discount_pct"] = S.fraction_mean(F.col("discount_pct"))
    buyers = orders.dropna(subset=["customer_id"]).groupBy("customer_id")
    return buyers.agg(*[m.alias(name) for name, m in measures.items()])


def review_summary(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Reviews and mean rating per ordering customer."""
    per_order = (
        reviews.dropna(subset=["order_id"])
        .groupBy("order_id")
        .agg(
            F.count("review_id").alias("n"),
            F.sum("rating").alias("rating_sum"),
            F.count("rating").alias("rating_count"),
        )
    )
    buyers = orders.select("order_id", "customer_id").dropna()
    return (
        per_order.join(buyers, "order_id")
        .groupBy("customer_id")
        .agg(
            F.sum("n").alias("review_count"),
            (F.sum("rating_sum").cast("double") / F.nullif(F.sum("rating_count"), F.lit(0))).alias("avg_rating"),
        )
    )


def reference_time(tables: RetailTables) -> DataFrame:
    """One row: the latest event, order or session start."""

    def latest(df: DataFrame, column: str) -> DataFrame:
        return df.agg(F.max(column).alias("t"))

    moments = latest(tables.events, "timestamp").union(latest(tables.orders, "order_time"))
    moments = moments.union(latest(tables.sessions, "start_time"))
    return moments.agg(F.max("t").alias("reference_time"))


def geo_lookup(df: DataFrame, country_col: str = "country", countries: DataFrame | None = None) -> DataFrame:
    """Add country_name (default: the code) and region (default "Other")."""
    if countries is None:
        dim = F.broadcast(country_table(df.sparkSession))
    else:
        dim = countries  # size unknown here: the planner decides from its statistics
    dim = dim.select(
        F.col("country").alias("__code"),
        F.col("country_name").alias("__name"),
        F.col("region").alias("__region"),
    )
    joined = df.join(dim, F.col(country_col) == F.col("__code"), "left")
    return joined.select(
        *df.columns,
        F.coalesce("__name", F.col(country_col)).alias("country_name"),
        F.coalesce("__region", F.lit(K.DEFAULT_REGION)).alias("region"),
    )


def infer_gender(
    df: DataFrame, name_col: str = "name", first_names: DataFrame | None = None, out: str = "gender_inferred"
) -> DataFrame:
    """Gender from the title, else from a (name, is_male, is_female) table, else "Unknown"."""
    title = S.gender_from_title(F.col(name_col))
    if first_names is None:
        return df.withColumn(out, F.coalesce(title, F.lit(K.UNKNOWN)))
    known = first_names.select(
        F.lower("name").alias("__first"), F.col("is_male").alias("__male"), F.col("is_female").alias("__female")
    )
    # a titled name needs no lookup
    key = F.when(title.isNull(), F.nullif(F.lower(S.first_name(F.col(name_col))), F.lit("")))
    by_name = S.first_match(
        [
            (F.col("__male") & F.col("__female"), "Ambiguous"),
            (F.col("__male"), "Male"),
            (F.col("__female"), "Female"),
        ],
        K.UNKNOWN,
    )
    joined = df.withColumn("__key", key).join(known, F.col("__key") == F.col("__first"), "left")
    return joined.select(*df.columns, F.coalesce(title, by_name).alias(out))


def _moment(tables: RetailTables, as_of: dt.datetime | Column | None, recency_from: str) -> Column:
    if recency_from not in ("sessions", "orders"):
        raise ValueError(f"unsupported recency_from: {recency_from}")
    return reference_time(tables).scalar() if as_of is None else F.lit(as_of).cast("timestamp_ntz")


def segment_inputs(
    tables: RetailTables,
    *,
    as_of: dt.datetime | Column | None = None,
    recency_from: str = "sessions",
    lifecycle: bool = True,
) -> DataFrame:
    """The few profile columns that segments are made of, without the rest of the profile.

    customer_id, order_count, revenue and recency_days; with ``lifecycle`` also
    session_count and region.  Events and reviews are not read for them, and
    sessions only where a column needs them.
    """
    now = _moment(tables, as_of, recency_from)
    base = tables.customers.select("customer_id", "country", "signup_date")
    columns = ["customer_id", "order_count", "revenue", "recency_days"]
    if lifecycle:
        base = geo_lookup(base, "country", tables.countries)
        columns += ["session_count", "region"]
    orders = order_summary(tables.orders).select("customer_id", "order_count", "revenue", "last_order")
    base = base.join(orders, "customer_id", "left")
    if lifecycle or recency_from == "sessions":
        base = base.join(_session_span(tables.sessions), "customer_id", "left")
    filled = base.fillna(0, subset=[c for c in ("order_count", "revenue", "session_count") if c in base.columns])
    last_seen = F.coalesce("last_session" if recency_from == "sessions" else "last_order", "signup_date")
    recency = S.not_negative(S.elapsed_days(F.col("__now"), last_seen))
    return filled.withColumn("__now", now).withColumn("recency_days", recency).select(*columns)


_ZERO_FILLED = [
    "session_count",
    "source_diversity",
    "device_diversity",
    "page_views",
    "add_to_cart_events",
    "checkout_events",
    "purchase_events",
    "total_events",
    "total_qty",
    "order_count",
    "revenue",
    "subtotal",
    "avg_order_value",
    "avg_discount_pct",
    "review_count",
    "avg_rating",
    "mean_cart_size",
]


def customer_profile(
    tables: RetailTables,
    *,
    as_of: dt.datetime | Column | None = None,
    recency_from: str = "sessions",
) -> DataFrame:
    """One wide row per customer.

    ``recency_from`` is "sessions" (days since the last session) or "orders"
    (days since the last order); both fall back to the signup date.  ``as_of`` (a
    moment or a scalar column) replaces the latest moment found in the data.
    """
    now = _moment(tables, as_of, recency_from)
    people = geo_lookup(tables.customers, "country", tables.countries)
    people = infer_gender(people, "name", tables.first_names)
    sides = [
        _session_parts(tables.sessions),
        event_summary(tables),
        order_summary(tables.orders),
        review_summary(tables.reviews, tables.orders),
    ]
    profile = people
    for side in sides:
        profile = profile.join(side, "customer_id", "left")
    profile = profile.fillna(0, subset=_ZERO_FILLED).fillna(
        K.NO_SESSION, subset=["dominant_source", "dominant_device"]
    )

    c = F.col
    # one column, so that the moment is found once
    profile = profile.withColumn("__now", now)
    last_seen = c("last_session") if recency_from == "sessions" else c("last_order")
    active = S.elapsed_days(F.coalesce("last_session", "signup_date"), F.coalesce("first_session", "signup_date"))
    recency = S.elapsed_days(c("__now"), F.coalesce(last_seen, c("signup_date")))
    return profile.withColumns(
        {
            "age_band": S.age_band(c("age")),
            "active_days": S.not_negative(active + 1),
            "recency_days": S.not_negative(recency),
            "session_to_order_rate": S.ratio(c("order_count"), c("session_count")),
            "page_to_cart_rate": S.ratio(c("add_to_cart_events"), c("page_views")),
            "cart_to_checkout_rate": S.ratio(c("checkout_events"), c("add_to_cart_events")),
            "checkout_to_purchase_rate": S.ratio(c("purchase_events"), c("checkout_events")),
            "review_rate": S.ratio(c("review_count"), c("order_count")),
            "revenue_per_session": S.ratio(c("revenue"), c("session_count")),
            "marketing_opt_in": c("marketing_opt_in").cast("int"),
        }
    ).drop("__now")
