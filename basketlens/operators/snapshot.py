"""Headline figures, the long business snapshot, and the canned answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.operators import funnel, products, trends
from basketlens.sources.tables import RetailTables


def _one(df: DataFrame, **measures: Column) -> Column:
    """Aggregates of one table as a scalar struct: one scan, one row."""
    return df.agg(F.struct(*[m.alias(name) for name, m in measures.items()]).alias("s")).scalar()


def _mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count)


def kpis(tables: RetailTables) -> DataFrame:
    """One row with the headline figures.

    ``conversion_rate`` is purchase sessions over page-view sessions.
    """
    flags = funnel.session_flags(tables)
    c = _one(
        tables.customers,
        n=F.count("*"),
        countries=F.countDistinct("country"),
        first_signup=F.min("signup_date"),
    )
    s = _one(tables.sessions, n=F.count("*"), users=F.countDistinct("customer_id"))
    o = _one(
        tables.orders,
        n=F.count("*"),
        revenue=F.sum("total_usd").cast("double"),
        priced=F.count("total_usd"),
        last=F.max("order_time"),
    )
    r = _one(
        tables.reviews,
        n=F.count("*"),
        rating_sum=F.sum("rating").cast("double"),
        rated=F.count("rating"),
        last=F.max("review_time"),
    )
    f = _one(flags, **{stage: F.sum(stage) for stage in K.FUNNEL_STAGES})
    e = _one(tables.events, last=F.max("timestamp"))
    row = tables.spark.range(1).select(
        c.alias("c"), s.alias("s"), o.alias("o"), r.alias("r"), f.alias("f"), e.alias("e")
    )
    return row.select(
        F.col("c.n").alias("customers"),
        F.col("c.countries").alias("countries"),
        F.col("s.n").alias("sessions"),
        F.col("s.users").alias("active_users"),
        F.col("o.n").alias("orders"),
        F.coalesce("o.revenue", F.lit(0.0)).alias("revenue"),
        _mean(F.col("o.revenue"), F.col("o.priced")).alias("aov"),
        F.col("f.purchase").alias("purchase_sessions"),
        S.ratio(F.col("f.purchase"), F.col("f.page_view")).alias("conversion_rate"),
        S.ratio(F.col("f.add_to_cart"), F.col("f.page_view")).alias("add_to_cart_rate"),
        _mean(F.col("r.rating_sum"), F.col("r.rated")).alias("avg_rating"),
        F.col("r.n").alias("review_count"),
        F.col("c.first_signup").alias("date_from"),
        F.greatest("e.last", "o.last", "r.last").alias("date_to"),
    )


def kpi_cards(figures: DataFrame) -> DataFrame:
    """The headline figures as printed: label, value, detail."""
    n, usd, pct = S.number_text, S.currency_text, S.percent_text
    c = F.col
    cards = [
        ("Customers", n("customers"), F.concat(c("countries").cast("string"), F.lit(" countries"))),
        ("Sessions", n("sessions"), F.concat(n("active_users"), F.lit(" active users"))),
        ("Orders", n("orders"), F.concat(n("purchase_sessions"), F.lit(" purchase sessions"))),
        ("Revenue", usd("revenue"), F.concat(F.lit("AOV "), usd("aov"))),
        (
            "Session Conversion",
            pct("conversion_rate"),
            F.concat(F.lit("Add-to-cart rate "), pct("add_to_cart_rate")),
        ),
        ("Average Rating", S.fixed_text("avg_rating", 2), F.concat(n("review_count"), F.lit(" reviews"))),
    ]
    rows = [F.struct(F.lit(a).alias("label"), b.alias("value"), d.alias("detail")) for a, b, d in cards]
    return figures.select(F.posexplode(F.array(*rows)).alias("position", "card")).select("position", "card.*")


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Frequency of each non-null value, most frequent first: rank, key, value."""
    counts = df.dropna(subset=[column]).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("value"))
    return ranked(counts, n)


def ranked(counts: DataFrame, n: int | None = None) -> DataFrame:
    """Number the rows of a small (key, value) table by value descending, then key."""
    if n is not None:
        counts = counts.orderBy(F.desc("value"), "key").limit(n)
    place = F.row_number().over(W.orderBy(F.desc("value"), "key"))
    return counts.select(place.alias("rank"), "key", F.col("value").cast("double").alias("value"))


def headline(tables: RetailTables) -> DataFrame:
    """The headline figures in long form.

    ``conversion`` is orders over sessions, unlike in ``kpis``.  Orders without a total and reviews without a
    rating do not count in the means.
    """
    c = _one(tables.customers, n=F.count("*"), countries=F.countDistinct("country"))
    s = _one(tables.sessions, n=F.count("*"))
    o = _one(tables.orders, n=F.count("*"), priced=F.count("total_usd"), revenue=F.coalesce(F.sum("total_usd"), F.lit(0)).cast("double"))
    r = _one(tables.reviews, n=F.count("*"), rated=F.count("rating"), total=F.sum("rating").cast("double"))
    row = tables.spark.range(1).select(c.alias("c"), s.alias("s"), o.alias("o"), r.alias("r"))
    figures = {
        "customers": F.col("c.n"),
        "countries": F.col("c.countries"),
        "sessions": F.col("s.n"),
        "orders": F.col("o.n"),
        "revenue": F.col("o.revenue"),
        "aov": S.ratio(F.col("o.revenue"), F.col("o.priced")),
        "conversion": S.ratio(F.col("o.n"), F.col("s.n")),
        "avg_rating": S.ratio(F.col("r.total"), F.col("r.rated")),
        "reviews": F.col("r.n"),
    }
    rows = [F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in figures.items()]
    listed = row.select(F.posexplode(F.array(*rows)).alias("position", "row"))
    return listed.select((F.col("position") + 1).alias("rank"), "row.key", "row.value")


def business_snapshot(tables: RetailTables, profile: DataFrame) -> DataFrame:
    """All figures a business question can draw on: section, rank, key, value.

    ``profile`` holds the segment columns; persona counts appear when it has
    cluster_name.  Every part is a small aggregate.
    """
    peak = trends.peak_month(tables.orders).select(
        F.lit(1).alias("rank"), F.col("label").alias("key"), F.col("revenue").alias("value")
    )
    # units per (name, category) serve both the top products and the category totals
    named = products.units_by_name(tables)
    by_name = named.select(F.concat("name", F.lit(" ["), "category", F.lit("]")).alias("key"), F.col("units").alias("value"))
    sold = products.product_sales(tables.order_items)
    by_category = (
        sold.join(tables.products.select("product_id", "category").dropna(), "product_id")
        .groupBy(F.col("category").alias("key"))
        .agg(F.sum("units").alias("value"))
    )
    parts = {
        "headline": headline(tables),
        "peak_month": peak,
        "lifecycle": value_counts(profile, "lifecycle_stage"),
        "rfm": value_counts(profile, "rfm_segment"),
        "region": value_counts(profile, "region"),
        "country": value_counts(tables.customers, "country", 10),
        "product": ranked(by_name, 10),
        "category": ranked(by_category),
    }
    if "cluster_name" in profile.columns:
        parts["persona"] = value_counts(profile, "cluster_name")
    frames = [
        df.select(
            F.lit(section).alias("section"),
            F.col("rank").cast("int").alias("rank"),
            "key",
            F.col("value").cast("double").alias("value"),
        )
        for section, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def _headline_lines(snapshot: DataFrame) -> DataFrame:
    """The headline figures and the peak month as printed, in one row of lines."""
    number, usd, pct = S.number_text, S.currency_text, S.percent_text
    keys = ["customers", "countries", "sessions", "orders", "revenue", "aov", "conversion", "avg_rating", "reviews"]

    def figure(section: str, key: str | None, column: str) -> Column:
        hit = F.col("section") == section
        return F.max(F.when(hit if key is None else hit & (F.col("key") == key), F.col(column)))

    facts = snapshot.agg(
        *[F.coalesce(figure("headline", k, "value"), F.lit(0.0)).alias(k) for k in keys],
        figure("peak_month", None, "key").alias("peak"),
        figure("peak_month", None, "value").alias("peak_revenue"),
    )
    lines = [
        F.concat(F.lit("Customers: "), number("customers"), F.lit(" across "), F.col("countries").cast("long").cast("string"), F.lit(" countries")),
        F.concat(F.lit("Sessions: "), number("sessions"), F.lit(" | Orders: "), number("orders")),
        F.concat(F.lit("Total revenue: "), usd("revenue")),
        F.concat(F.lit("Average order value: "), usd("aov")),
        F.concat(F.lit("Session→order conversion: "), pct("conversion")),
        F.concat(F.lit("Average review rating: "), S.fixed_text("avg_rating", 2), F.lit("/5 across "), number("reviews"), F.lit(" reviews")),
        F.concat(F.lit("Peak revenue month: "), "peak", F.lit(" ("), usd("peak_revenue"), F.lit(")")),
    ]
    listed = facts.select(F.posexplode(F.array(*lines)).alias("position", "line")).where("line is not null")
    return listed.select(F.lit(0).alias("section_order"), (F.col("position") + 1).alias("rank"), F.lit(K.SNAPSHOT_TITLE).alias("title"), "line")


def snapshot_lines(snapshot: DataFrame) -> DataFrame:
    """The snapshot as printed lines: section order, rank, title, line."""
    sections = K.SNAPSHOT_SECTIONS
    order = S.first_match([(F.col("section") == s, i) for i, (s, _, _) in enumerate(sections, 1)], None)
    title = S.first_match([(F.col("section") == s, t) for s, t, _ in sections], None)
    unit = S.first_match([(F.col("section") == s, u) for s, _, u in sections], "")
    text = F.concat(F.lit("- "), "key", F.lit(": "), S.number_text("value"), unit)
    listed = snapshot.select(order.alias("section_order"), "rank", title.alias("title"), text.alias("line")).filter(F.col("section_order").isNotNull())
    return _headline_lines(snapshot).unionByName(listed).orderBy("section_order", "rank")


def answers(snapshot: DataFrame, top_five: DataFrame) -> DataFrame:
    """One answer text per intent, from the snapshot table and the top products by name.

    ``top_five`` is (rank, key, value).
    """
    number, usd, pct = S.number_text, S.currency_text, S.percent_text

    def figure(section: str, key: str) -> Column:
        hit = (F.col("section") == section) & (F.col("key") == key)
        return F.coalesce(F.max(F.when(hit, F.col("value"))), F.lit(0.0))

    def bullets(line: Column, section: str | None) -> Column:
        wanted = F.lit(True) if section is None else F.col("section") == section
        entry = F.when(wanted, F.struct("rank", line.alias("line")))
        return F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"]))

    segment_line = F.concat(F.lit("- "), "key", F.lit(": "), number("value"))
    product_line = F.concat(F.lit("- "), "key", F.lit(": "), number("value"), F.lit(" units"))
    keys = ["customers", "countries", "sessions", "orders", "revenue", "aov", "conversion", "avg_rating", "reviews"]
    facts = snapshot.agg(
        *[figure("headline", k).alias(k) for k in keys],
        F.max(F.when(F.col("section") == "peak_month", F.col("key"))).alias("peak"),
        figure("lifecycle", "Dormant Customer").alias("dormant"),
        figure("lifecycle", "Cooling Down").alias("cooling"),
        bullets(segment_line, "rfm").alias("segments"),
    )
    top = top_five.agg(bullets(product_line, None).alias("t")).scalar()
    c = F.col

    def pair(a: str, x: Column, b: str, y: Column) -> Column:
        return F.concat(F.lit(f"**{a}:** "), x, F.lit(f"  \n**{b}:** "), y)

    texts = {
        "revenue": pair("Total revenue", usd("revenue"), "Peak month", c("peak")),
        "orders": pair("Total orders", number("orders"), "Average order value", usd("aov")),
        "customers": pair(
            "Total customers", number("customers"), "Countries", c("countries").cast("long").cast("string")
        ),
        "churn": pair("Dormant customers", number("dormant"), "Cooling down", number("cooling")),
        "rfm": F.concat(F.lit("**RFM Segments:**\n"), c("segments")),
        "rating": pair(
            "Average rating",
            F.concat(S.fixed_text("avg_rating", 2), F.lit(" / 5")),
            "Total reviews",
            number("reviews"),
        ),
        "conversion": F.concat(
            pair("Session-to-order conversion", pct("conversion"), "Sessions", number("sessions")),
            F.lit(" | **Orders:** "),
            number("orders"),
        ),
        "products": F.concat(F.lit("**Top 5 products by units sold:**\n"), c("top")),
        "help": F.lit(K.HELP_TEXT),
    }
    rows = [F.struct(F.lit(k).alias("intent"), v.alias("answer")) for k, v in texts.items()]
    return facts.withColumn("top", top).select(F.inline(F.array(*rows)))
