"""Adapter from the star-schema test tables to the retail data model.

Ids, names, times, amounts, quantities and texts are real columns.  Device,
source, age, margin, rating and the like do not exist there and are fixed
formulas of real columns; they carry no business meaning.

A session ends after a gap of more than twelve hours.  All events of one user in
one half day are less than twelve hours apart, hence always in one session.  So
events are first combined to one row per user and half day, and the ordered
window runs over those rows: at most two per day, however many events one user
has.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketlens.functions.scalars import first_match
from basketlens.plans.session import tune
from basketlens.plans.stage import write_stage

_MONEY = "decimal(18,2)"
_EVENT_NAMES = [("view", "page_view"), ("click", "add_to_cart"), ("signup", "checkout")]
_SOURCES = ["organic", "direct", "paid", "social", "email"]

# Extras that cost a join or an aggregation; a query asks for what it reads.
SIGNUP, DISCOUNTS, COUNTRY = "signup", "discounts", "country"
EVERYTHING = (SIGNUP, DISCOUNTS, COUNTRY)
# For queries that read sessions several times: their cut is stored once.
STORED = "stored"
# Orders in one task's hash table, about: 64 MB at most.
TABLE_ORDERS = 500_000


class StarSchema:
    """The seven tables as attributes, like ``RetailTables``, each built when first read."""

    def __init__(self, spark: SparkSession, folder: str, needs: tuple[str, ...] = EVERYTHING):
        self.spark = tune(spark)
        self.folder = folder
        self.needs = needs
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def _nations(self) -> DataFrame:
        """country, country_name, region: one row per nation."""
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(
                F.col("n_nationkey"),
                F.col("n_name").alias("country"),
                F.col("n_name").alias("country_name"),
                F.col("r_name").alias("region"),
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        base = self.raw("customer").join(
            self._nations.select("n_nationkey", "country"),
            F.col("c_nationkey") == F.col("n_nationkey"),
            "left",
        )
        columns = [
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.col("country"),
            (10 + (F.col("c_custkey") * 37) % 70).cast("double").alias("age"),
            (F.col("c_acctbal") > 5000).alias("marketing_opt_in"),
            F.col("c_mktsegment").alias("market_segment"),
        ]
        if SIGNUP in self.needs:
            first_order = self.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("signup_date"))
            base = base.join(first_order, F.col("o_custkey") == F.col("c_custkey"), "left")
            columns.append(F.col("signup_date"))
        return base.select(*columns)

    @cached_property
    def _half_days(self) -> DataFrame:
        """user, day, half -> session_id and the figures a session needs."""
        per_half_day = (
            self._events
            .groupBy("user_id", "day", "half")
            .agg(
                F.min("ts").alias("first_ts"),
                F.max("ts").alias("last_ts"),
                F.min("event_id").alias("first_id"),
                F.min_by("k", "event_id").alias("first_k"),
            )
        )
        in_order = W.partitionBy("user_id").orderBy("day", "half")
        gap = F.col("first_ts") - F.lag("last_ts").over(in_order)
        opens = F.when(gap <= F.expr("interval '12' hour"), 0).otherwise(1)
        visit = F.sum("opens").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
        cut = (
            per_half_day.withColumn("opens", opens)
            .withColumn("visit", visit)
            .withColumn("session_id", F.min("first_id").over(W.partitionBy("user_id", "visit")))
            .drop("opens", "visit", "last_ts")
        )
        return write_stage(cut, "half-days") if STORED in self.needs else cut

    @cached_property
    def _events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id",
            "user_id",
            "ts",
            "event_type",
            "value",
            F.col("ts").cast("date").alias("day"),
            (F.hour("ts") >= 12).alias("half"),
            F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("k"),
        )

    @cached_property
    def events(self) -> DataFrame:
        kind = F.coalesce(first_match([(F.col("event_type") == a, b) for a, b in _EVENT_NAMES], None), "event_type")
        return (
            self._events
            .join(self._half_days.select("user_id", "day", "half", "session_id"), ["user_id", "day", "half"])
            .select(
                "event_id",
                "session_id",
                F.col("ts").alias("timestamp"),
                kind.alias("event_type"),
                F.when(F.col("event_type") == "click", 1 + F.col("k") % 5).alias("qty"),
                (F.col("k") % 10).alias("cart_size"),
                F.col("value").alias("amount_usd"),
            )
        )

    @cached_property
    def sessions(self) -> DataFrame:
        k = F.col("k")
        sixth = F.floor(k / 3) % 6
        device = F.when(k % 3 == 0, "desktop").when(k % 3 == 1, "mobile").otherwise("tablet")
        source = first_match([(sixth == i, s) for i, s in enumerate(_SOURCES)], "referral")
        visits = (
            self._half_days
            .groupBy("user_id", "session_id")
            .agg(F.min("first_ts").alias("start_time"), F.min_by("first_k", "first_id").alias("k"))
            .select(
                "session_id",
                F.col("user_id").alias("customer_id"),
                "start_time",
                device.alias("device"),
                source.alias("source"),
            )
        )
        return self._with_country(visits)

    def _with_country(self, facts: DataFrame) -> DataFrame:
        if COUNTRY not in self.needs:
            return facts
        home = self.customers.select("customer_id", "country")
        return facts.join(home, "customer_id", "left")

    @cached_property
    def orders(self) -> DataFrame:
        total: Column = F.col("o_totalprice").cast(_MONEY)
        base = self.raw("orders")
        columns = [
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_time"),
            F.col("o_orderpriority").alias("payment_method"),
            total.alias("total_usd"),
        ]
        if DISCOUNTS in self.needs:
            lines = (
                self.raw("lineitem")
                .groupBy("l_orderkey")
                .agg(
                    (F.sum(F.col("l_discount").cast(_MONEY)).cast("double") / F.count("*")).alias("discount_pct"),
                    F.sum(F.col("l_extendedprice").cast(_MONEY)).cast(_MONEY).alias("subtotal_usd"),
                )
            )
            base = base.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
            columns += [F.col("discount_pct"), F.col("subtotal_usd")]
        return self._with_country(base.select(*columns))

    @cached_property
    def order_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast(_MONEY).alias("line_total_usd"),
        )

    @cached_property
    def products(self) -> DataFrame:
        price = F.col("p_retailprice").cast(_MONEY)
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("category"),
            F.col("p_name").alias("name"),
            price.alias("price_usd"),
            (price * F.lit("0.25").cast("decimal(4,2)")).cast(_MONEY).alias("margin_usd"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        parts = self.raw("part").agg(F.count("*").alias("n")).scalar()
        orders = self.raw("orders").agg(F.count("*").alias("n")).scalar()
        docs = self.raw("documents").select(
            F.col("doc_id").alias("review_id"),
            ((F.col("doc_id") * 13) % orders).alias("order_id"),
            ((F.col("doc_id") * 7) % parts).alias("product_id"),
            (1 + F.col("n_chars") % 5).cast("int").alias("rating"),
            F.col("text").alias("review_text"),
            (F.col("doc_id") % 45).cast("int").alias("days_later"),
        )
        placed = self.raw("orders").select(F.col("o_orderkey").alias("order_id"), "o_orderdate")
        later = F.make_dt_interval(F.col("days_later"))
        # a hash table can't spill, and partitions merged by their bytes hold ten million orders where no text is
        # read: many orders are dealt to a fixed number of tasks, which is not merged
        tables = -(-self.raw("orders").count() // TABLE_ORDERS)
        if tables > 1:
            tasks = max(tables, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            docs, placed = docs.repartition(tasks, "order_id"), placed.repartition(tasks, "order_id")
        # texts pass by a table of their orders, unsorted: a sort would hold the texts of a partition in memory
        return docs.join(placed.hint("shuffle_hash"), "order_id").select(
            "review_id",
            "order_id",
            "product_id",
            "rating",
            "review_text",
            (F.col("o_orderdate") + later).alias("review_time"),
        )

    @cached_property
    def countries(self) -> DataFrame:
        return self._nations.select("country", "country_name", "region")

    # no test table has person names
    first_names = None
