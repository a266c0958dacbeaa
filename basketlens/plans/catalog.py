"""Registered queries: every operator over the whole test tables.

Each function takes (spark, folder) and returns one frame.  Doubles are rounded
to six digits here, never inside an operator.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.operators import clusters, customers, flows, funnel, kmeans, potential, products, ranking, retention, segments, snapshot, texts, trends, valence
from basketlens.plans import states
from basketlens.plans.stage import shared_folder, write_stage
from basketlens.sources.files import json_safe
from basketlens.sources.literals import constant_table
from basketlens.sources.star_schema import COUNTRY, DISCOUNTS, EVERYTHING, SIGNUP, STORED, StarSchema
from basketlens.sources.tables import RetailTables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Short lists of function words: the test texts are invented, so the usual
# sentiment words and stopwords do not occur in them.
TEST_LEXICON = [("the", 0.3), ("and", -0.2), ("of", 1.1), ("der", -0.6), ("und", 0.9), ("la", 0.7), ("que", -1.4), ("el", 0.4)]
TEST_NEGATIONS = ["in", "un"]
TEST_BOOSTERS = {"is": 0.293, "die": 0.293, "on": -0.293}
TEST_POSITIVE = ["the", "and", "der", "que"]
TEST_NEGATIVE = ["ing", "ion", "und", "el"]
TEST_STOPWORDS = ["the", "and", "is", "la", "le", "un", "und", "die", "el", "que"]
TEST_INTENTS = [
    ("revenue", ["erth", "sales"]),
    ("orders", ["ouen", "purchase"]),
    ("customers", ["heon", "user"]),
    ("churn", ["stre", "lost"]),
    ("rfm", ["ungs", "segment"]),
    ("rating", ["ente", "review"]),
    ("conversion", ["cart", "ción"]),
    ("products", ["ing", "top"]),
]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NAME_TITLES = [("ECONOMY", "Mr. "), ("SMALL", "MRS. "), ("MEDIUM", "Miss "), ("PROMO", "Dr. "), ("LARGE", "Ms. ")]
NAME_LIST = [("small", True, False), ("red", False, True), ("blue", True, True), ("hot", True, False), ("cold", False, True)]


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles; decimals leave as doubles.

    The nudge makes exact ties go up on every engine, whether it rounds the binary
    or the decimal form.
    """

    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        return F.round(c + 1e-10, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c

    return df.select(*[column(f) for f in df.schema.fields])


def query(name: str, *needs: str):
    """Register ``f(tables, star)`` under ``name``; ``needs`` lists the costly extras it reads."""

    def register(f: Callable[[RetailTables, StarSchema], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            star = StarSchema(spark, folder, needs)
            return tidy(f(star, star))

        run.__name__ = name
        run.__doc__ = f.__doc__
        REGISTRY[name] = run
        return f

    return register


# --- sources ----------------------------------------------------------------


@query("load_customers", *EVERYTHING)
def _(t, star):
    return t.customers


@query("load_sessions", COUNTRY)
def _(t, star):
    return t.sessions


@query("load_events")
def _(t, star):
    return t.events


@query("load_orders", COUNTRY, DISCOUNTS)
def _(t, star):
    return t.orders


@query("load_order_items")
def _(t, star):
    return t.order_items


@query("load_products")
def _(t, star):
    return t.products


@query("load_reviews")
def _(t, star):
    return t.reviews


@query("json_safe")
def _(t, star):
    v, kind = F.col("value"), F.col("event_type")
    odd = (
        F.when(kind == "error", F.lit(float("nan")))
        .when(kind == "signup", F.lit(float("inf")))
        .when(kind == "view", F.lit(float("-inf")))
        .otherwise(v)
    )
    return json_safe(star.raw("events").select("event_id", odd.alias("value")))


# --- customers --------------------------------------------------------------


def last_order_time(t: RetailTables):
    return t.orders.agg(F.max("order_time").alias("t")).scalar()


def order_profile(t: RetailTables) -> DataFrame:
    """Profile whose recency counts from the last order: events and orders do not overlap in time here."""
    return customers.customer_profile(t, recency_from="orders", as_of=last_order_time(t))


def stored_profile(t: RetailTables) -> DataFrame:
    return write_stage(order_profile(t), "profile")


def slim_profile(t: RetailTables, lifecycle: bool = False) -> DataFrame:
    """What RFM scores and value tiers need, or with ``lifecycle`` all segments."""
    return customers.segment_inputs(t, recency_from="orders", as_of=last_order_time(t), lifecycle=lifecycle)


def rfm_inputs(t: RetailTables) -> DataFrame:
    return write_stage(slim_profile(t), "rfm-inputs")


@query("session_summary")
def _(t, star):
    return customers.session_summary(t.sessions)


@query("dominant_value")
def _(t, star):
    source = customers.dominant_value(t.sessions, "customer_id", "source", "dominant_source")
    device = customers.dominant_value(t.sessions, "customer_id", "device", "dominant_device")
    return source.join(device, "customer_id", "full")


@query("event_type_counts")
def _(t, star):
    return customers.event_type_counts(t)


@query("event_volume")
def _(t, star):
    return customers.event_volume(t)


@query("event_user")
def _(t, star):
    return customers.event_user(t).select("event_id", "session_id", "customer_id", "event_type")


@query("order_summary", DISCOUNTS)
def _(t, star):
    return customers.order_summary(t.orders)


@query("review_summary")
def _(t, star):
    return customers.review_summary(t.reviews, t.orders)


@query("reference_time")
def _(t, star):
    return customers.reference_time(t)


@query("customer_profile", SIGNUP, DISCOUNTS, STORED)
def _(t, star):
    return customers.customer_profile(t).drop("market_segment")


@query("customer_rates", SIGNUP, DISCOUNTS, STORED)
def _(t, star):
    return customers.customer_profile(t).select(
        "customer_id",
        "session_to_order_rate",
        "page_to_cart_rate",
        "cart_to_checkout_rate",
        "checkout_to_purchase_rate",
        "review_rate",
        "revenue_per_session",
    )


@query("geo_lookup")
def _(t, star):
    docs = star.raw("documents").select("doc_id", F.upper("lang").alias("country"))
    return customers.geo_lookup(docs)


@query("gender_inference")
def _(t, star):
    title = S.first_match([(F.col("p_type") == kind, text) for kind, text in NAME_TITLES], "")
    people = star.raw("part").select("p_partkey", F.concat(title, F.initcap("p_name")).alias("name"))
    known = constant_table(star.spark, NAME_LIST, ["name", "is_male", "is_female"])
    return customers.infer_gender(people, "name", known).withColumn("first_name", S.first_name(F.col("name")))


@query("text_formats", DISCOUNTS)
def _(t, star):
    return t.orders.select(
        "order_id",
        S.number_text("total_usd").alias("number"),
        S.currency_text("total_usd").alias("currency"),
        S.percent_text("discount_pct").alias("percent"),
        S.month_text(F.col("order_time")).alias("month"),
        S.month_text(F.col("order_time"), long=True).alias("month_long"),
    )


@query("stable_sample")
def _(t, star):
    return ranking.stable_sample(t.orders.select("order_id", "customer_id", "total_usd"), "order_id", K.SCATTER_SAMPLE)


# --- segments ---------------------------------------------------------------


@query("rfm_scores", SIGNUP)
def _(t, star):
    return segments.rfm_scores(rfm_inputs(t)).select("customer_id", "r_score", "f_score", "m_score", "rfm_score")


@query("rfm_segments", SIGNUP)
def _(t, star):
    return segments.add_rfm(rfm_inputs(t)).select("customer_id", "rfm_score", "rfm_segment")


@query("rfm_summary", SIGNUP)
def _(t, star):
    return segments.rfm_summary(segments.add_rfm(rfm_inputs(t)))


@query("lifecycle_stage", SIGNUP)
def _(t, star):
    staged = segments.add_lifecycle(slim_profile(t, lifecycle=True))
    return staged.select("customer_id", "order_count", "session_count", "recency_days", "lifecycle_stage")


@query("lifecycle_summary", SIGNUP)
def _(t, star):
    return segments.lifecycle_summary(segments.add_lifecycle(slim_profile(t, lifecycle=True)))


@query("ltv_tier", SIGNUP)
def _(t, star):
    return segments.add_ltv(slim_profile(t)).select("customer_id", "ltv_score", "ltv_tier")


def segment_labels(t: RetailTables) -> DataFrame:
    inputs = write_stage(slim_profile(t, lifecycle=True), "segment-inputs")
    return segments.add_lifecycle(segments.add_rfm(inputs))


def segmented_profile(t: RetailTables) -> DataFrame:
    return segments.add_lifecycle(segments.add_rfm(stored_profile(t)))


@query("crm_actions", SIGNUP)
def _(t, star):
    full = segments.add_crm(segment_labels(t))
    return full.select("customer_id", "rfm_segment", "lifecycle_stage", "crm_recommendation")


@query("customer_lookup", SIGNUP, DISCOUNTS)
def _(t, star):
    """Cards of all customers that have a session."""
    return segments.customer_lookup(segmented_profile(t), t.sessions.select("customer_id"))


# --- funnel, trends, retention ------------------------------------------------


@query("session_funnel_flags")
def _(t, star):
    return funnel.session_flags(t)


@query("funnel_overall")
def _(t, star):
    return funnel.funnel_overall(funnel.session_flags(t))


@query("funnel_step_rates")
def _(t, star):
    return funnel.funnel_step_rates(funnel.session_flags(t))


@query("funnel_by_device")
def _(t, star):
    return funnel.funnel_by_device(funnel.session_flags(t))


@query("funnel_by_source")
def _(t, star):
    return funnel.funnel_by_source(funnel.session_flags(t))


@query("monthly_overview")
def _(t, star):
    return trends.monthly_overview(t)


@query("recent_revenue")
def _(t, star):
    return trends.recent_revenue(t.orders)


@query("peak_month")
def _(t, star):
    return trends.peak_month(t.orders)


@query("geography", COUNTRY)
def _(t, star):
    return trends.geography(t)


@query("highest_aov_country", COUNTRY)
def _(t, star):
    return trends.highest_aov_country(trends.geography(t))


@query("new_user_conversion", SIGNUP)
def _(t, star):
    return trends.new_user_conversion(t)


def person_profile(t: RetailTables) -> DataFrame:
    """The customer columns the demographic cells read; no fact table needed."""
    people = customers.infer_gender(customers.geo_lookup(t.customers, "country", t.countries), "name", t.first_names)
    return people.withColumn("age_band", S.age_band(F.col("age")))


@query("demographics")
def _(t, star):
    return trends.demographics(person_profile(t))


CUBE = {"region": ["region"], "pyramid": ["age_band", "gender_inferred"], "market segment": ["market_segment"], "country": ["country_name"], "region and age": ["region", "age_band"]}


@query("customer_cube")
def _(t, star):
    """Five figures of the customers from one scan."""
    return trends.customer_cube(person_profile(t), CUBE)


@query("age_pyramid")
def _(t, star):
    return trends.age_pyramid(person_profile(t))


def session_weeks(t: RetailTables) -> DataFrame:
    """Weekly, from the first session: all sessions lie years after the signups here."""
    return retention.retention(t, activity="sessions", cohort="first_activity", grain="week")


@query("retention_sessions")
def _(t, star):
    return session_weeks(t)


@query("retention_sessions_wide")
def _(t, star):
    return retention.retention_wide(session_weeks(t))


@query("retention_orders", SIGNUP)
def _(t, star):
    return retention.retention(t, activity="orders")


@query("retention_bitmaps", SIGNUP)
def _(t, star):
    return flows.retention_by_bitmaps(t)


@query("customer_flow")
def _(t, star):
    return flows.customer_flow(t.orders)


@query("retention_orders_wide", SIGNUP)
def _(t, star):
    return retention.retention_wide(retention.retention(t, activity="orders"))


@query("retention_text", SIGNUP)
def _(t, star):
    return retention.retention_text(retention.retention(t, activity="orders"))


@query("retention_matrix_export", SIGNUP)
def _(t, star):
    matrix = retention.retention_matrix(retention.retention(t, activity="orders"))
    number = F.expr(f"transform(values, v -> coalesce({S.fixed_sql('v', 3)}, 'null'))")
    return matrix.select(
        "cohort",
        F.array_join("months", ",").alias("months"),
        F.array_join(number, ",").alias("values"),
    )


# --- products ---------------------------------------------------------------


@query("order_lines")
def _(t, star):
    return products.order_lines(t)


@query("category_performance")
def _(t, star):
    return products.category_performance(t)


@query("category_monthly")
def _(t, star):
    return products.category_monthly(t)


@query("product_ratings")
def _(t, star):
    return products.product_ratings(t.reviews)


@query("product_master")
def _(t, star):
    return products.product_master(t)


@query("top_products")
def _(t, star):
    return products.top_products(t)


@query("top_by_units")
def _(t, star):
    return products.top_by_units(products.product_master(t))


@query("top_rated")
def _(t, star):
    """At most one review per product exists here, so one review is enough."""
    return products.top_rated(products.product_master(t), min_reviews=1)


@query("lowest_rated")
def _(t, star):
    return products.lowest_rated(products.product_master(t), "ECONOMY")


@query("top_names")
def _(t, star):
    return products.top_names(t)


@query("top_five_names")
def _(t, star):
    return products.top_names(t, with_category=False, n=5)


@query("sales_rank_7_days")
def _(t, star):
    return products.sales_rank(t, days=7)


@query("sales_rank_30_days")
def _(t, star):
    return products.sales_rank(t, days=30)


@query("sales_rank_all")
def _(t, star):
    return products.sales_rank(t)


# --- results kept up to date ----------------------------------------------------


@query("quarterly_states", COUNTRY)
def _(t, star):
    """Quarters from stored states per month, the last year of them refreshed once more; buyers against the exact number."""
    path = f"{shared_folder(star.spark)}/basketlens/order-states-{uuid.uuid4().hex}"
    states.refresh_order_states(t.orders, path)
    last = t.orders.agg(F.max("order_time").alias("t")).first()["t"]
    if last is not None:
        states.refresh_order_states(t.orders, path, last.date().replace(month=1, day=1), last.date())
    quarter = F.date_trunc("quarter", F.col("month")).cast("date").alias("quarter")
    found = states.merged(states.read_order_states(star.spark, path), quarter)
    exact = t.orders.groupBy(F.date_trunc("quarter", F.col("order_time")).cast("date").alias("quarter")).agg(F.countDistinct("customer_id").alias("exact"))
    near = F.abs(F.col("buyers") - F.col("exact")) <= 0.1 * F.col("exact") + 1
    return found.join(exact, "quarter").select("quarter", "orders", "revenue", near.alias("buyers_near"))


@query("bucketed_activity", COUNTRY)
def _(t, star):
    """Facts stored in buckets, then joined without an exchange."""
    parts = int(star.spark.conf.get("spark.sql.shuffle.partitions"))
    stored = [states.bucketed(df, name, parts) for name, df in (("customers", t.customers.select("customer_id")), ("sessions", t.sessions), ("orders", t.orders))]
    return states.customer_activity(*stored)


# --- texts ------------------------------------------------------------------


def sample_sentiment(t: RetailTables, star: StarSchema) -> DataFrame:
    lexicon = constant_table(star.spark, TEST_LEXICON, ["token", "valence"])
    return texts.review_sentiment(t.reviews, lexicon, negations=TEST_NEGATIONS, boosters=TEST_BOOSTERS)


@query("review_sentiment")
def _(t, star):
    return tidy(sample_sentiment(t, star), 4)


TEST_RULES = valence.Rules(
    TEST_NEGATIONS,
    TEST_BOOSTERS,
    capitals=0.733,
    intensified=("un", ("le", "die"), 1.5),
    affirmed=("in", ("is",)),
    least=("les", ("un",)),
    contrast=("die", "is"),
    exclamation=(0.292, 4),
    question=(0.18, 0.96),
)
TEST_IDIOMS = [("of the", 2.5), ("the and", -1.0), ("der und", 1.2), ("la que el", 0.6), ("is the of", -2.0)]


@query("valence_sentiment")
def _(t, star):
    """All valence rules."""
    lexicon, idioms = constant_table(star.spark, TEST_LEXICON, ["token", "valence"]), constant_table(star.spark, TEST_IDIOMS, ["phrase", "valence"])
    return tidy(valence.valence_scores(t.reviews, lexicon, TEST_RULES, idioms), 4)


@query("labelled_reviews")
def _(t, star):
    return tidy(texts.with_sentiment(t.reviews.drop("review_text"), sample_sentiment(t, star)), 4)


@query("sentiment_by_category")
def _(t, star):
    return products.sentiment_by_category(t, sample_sentiment(t, star))


@query("wordlist_sentiment")
def _(t, star):
    labelled = texts.wordlist_sentiment(t.reviews, positive=TEST_POSITIVE, negative=TEST_NEGATIVE)
    return labelled.select("review_id", "score", "sentiment")


@query("category_keywords")
def _(t, star):
    stopwords = constant_table(star.spark, [(w,) for w in TEST_STOPWORDS], ["token"])
    return texts.category_keywords(t.reviews, t.products, stopwords)


@query("category_phrases")
def _(t, star):
    stopwords = constant_table(star.spark, [(w,) for w in TEST_STOPWORDS], ["token"])
    return tidy(texts.category_phrases(t.reviews, t.products, stopwords), 3)


@query("question_intents")
def _(t, star):
    routed = texts.route_questions(star.raw("conversations"), "text", TEST_INTENTS)
    return routed.select("conv_id", "turn", "intent")


def canned_answers(t: RetailTables) -> DataFrame:
    figures = snapshot.business_snapshot(t, write_stage(segment_labels(t), "segment-labels"))
    top = products.top_names(t, with_category=False, n=5).select(
        F.col("name").alias("key"), F.col("units").alias("value")
    )
    return snapshot.answers(figures, snapshot.ranked(top))


@query("question_answers", SIGNUP, STORED)
def _(t, star):
    answered = texts.answer_questions(star.raw("conversations"), "text", canned_answers(t), TEST_INTENTS)
    return answered.select("conv_id", "turn", "intent", "answer")


# --- headline figures ---------------------------------------------------------


@query("kpis", SIGNUP, STORED)
def _(t, star):
    return snapshot.kpis(t)


@query("kpi_cards", SIGNUP, STORED)
def _(t, star):
    return snapshot.kpi_cards(snapshot.kpis(t))


@query("business_snapshot", SIGNUP, STORED)
def _(t, star):
    return snapshot.business_snapshot(t, write_stage(segment_labels(t), "segment-labels"))


@query("snapshot_lines", SIGNUP, STORED)
def _(t, star):
    return snapshot.snapshot_lines(snapshot.business_snapshot(t, write_stage(segment_labels(t), "segment-labels")))


# --- spending potential -----------------------------------------------------

CUT, LATER_DAYS = dt.datetime(2000, 8, 1), 365


@query("later_value")
def _(t, star):
    return potential.later_value(t, CUT, LATER_DAYS)


@query("ranking_auc")
def _(t, star):
    """How well the revenue before the cut ranks customers by whether they buy in the year after it."""
    earlier = potential.before(t, CUT).orders.groupBy("customer_id").agg(F.sum("total_usd").cast("double").alias("spent"))
    later = potential.later_value(t, CUT, LATER_DAYS).select("customer_id", (F.col("later_orders") > 0).alias("bought"))
    return potential.ranking_auc(later.join(earlier, "customer_id", "left").fillna(0.0, subset=["spent"]), "spent", "bought")


@query("spending_potential", SIGNUP, DISCOUNTS)
def _(t, star):
    """Learned at a cut a year before the last orders, applied to what is known today."""
    label = potential.later_value(t, CUT, LATER_DAYS)
    today = CUT + dt.timedelta(days=LATER_DAYS)
    return potential.spending_potential(potential.past_features(t, CUT), label, potential.past_features(t, today))


# --- clusters ---------------------------------------------------------------


def given_clusters(t: RetailTables) -> DataFrame:
    """Profile with the market segment as the given cluster."""
    cluster = S.first_match([(F.col("market_segment") == s, i) for i, s in enumerate(SEGMENTS)], None)
    return order_profile(t).withColumn("cluster_id", cluster)


def given_personas(t: RetailTables) -> DataFrame:
    stored = write_stage(given_clusters(t), "given-clusters")
    return clusters.add_personas(stored, clusters.persona_names(clusters.cluster_summary(stored)))


@query("cluster_features", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.cluster_features(stored_profile(t))


@query("standardised_features", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.standardise(clusters.cluster_features(stored_profile(t)), K.CLUSTER_FEATURES)


@query("standardised_embeddings")
def _(t, star):
    scaled = clusters.standardise_vectors(star.raw("embeddings"), "vec_id", "embedding", 64)
    return scaled.select("vec_id", F.posexplode("embedding").alias("dimension", "z"))


@query("silhouette_exact")
def _(t, star):
    return clusters.silhouette_exact(star.raw("embeddings"), "vec_id", "embedding", ["label"])


@query("silhouette_squared")
def _(t, star):
    return clusters.silhouette_squared(star.raw("embeddings"), "embedding", ["label"])


@query("silhouette_enclosed")
def _(t, star):
    """The linear silhouette's bounds against the exact figure."""
    vectors = star.raw("embeddings")
    exact = clusters.silhouette_exact(vectors, "vec_id", "embedding", ["label"]).select("silhouette").scalar()
    near = kmeans.silhouette_bounds(kmeans.pack_points(vectors, "vec_id", "embedding", "label"), ["label"], 64, cells=8)
    within = exact.between(F.col("lower") - 1e-9, F.col("upper") + 1e-9)
    return near.select("labelling", "clusters", "points", within.alias("encloses"))


def first_vectors(vectors: DataFrame, n: int) -> np.ndarray:
    """The vectors of the ``n`` smallest ids, as given centres."""
    return np.array([r.embedding for r in vectors.orderBy("vec_id").limit(n).collect()], float)


@query("lloyd_step")
def _(t, star):
    """One scan for two models with given centres: members, cost and mean of the first coordinate of each centre."""
    vectors = star.raw("embeddings").select("vec_id", "embedding")
    models = [first_vectors(vectors, n) for n in (4, 7)]
    moved = kmeans.model_sums(kmeans.pack_points(vectors, "vec_id", "embedding"), models)
    return moved.select("model", "centre", "n", F.round(F.col("cost") / kmeans.UNIT, 3).alias("cost"), F.round(F.col("s0") / F.col("n") / kmeans.UNIT, 5).alias("x0"))


@query("nearest_centres")
def _(t, star):
    vectors = star.raw("embeddings")
    cluster, squared = kmeans.nearest_centre(F.col("embedding"), first_vectors(vectors, 7))
    return vectors.select("vec_id", cluster.alias("cluster_id"), squared.alias("squared_distance"))


@query("feature_covariance", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.covariance(scaled_vectors(t), "features", len(K.CLUSTER_FEATURES))


@query("axis_checks", SIGNUP, DISCOUNTS)
def _(t, star):
    """Length, products and deviation of the two principal axes of the features."""
    matrix = clusters.matrix_of(clusters.covariance(scaled_vectors(t), "features", len(K.CLUSTER_FEATURES)), len(K.CLUSTER_FEATURES))
    return star.spark.createDataFrame(clusters.axis_checks(matrix, clusters.principal_axes(matrix)), "axis int, length double, product double, deviation double")


@query("marker_sizes", SIGNUP, DISCOUNTS)
def _(t, star):
    return stored_profile(t).select("customer_id", clusters.marker_size(F.col("revenue")).alias("marker_size"))


@query("cluster_summary", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.cluster_summary(given_clusters(t))


@query("persona_thresholds", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.persona_thresholds(clusters.cluster_summary(given_clusters(t)))


@query("persona_names", SIGNUP, DISCOUNTS)
def _(t, star):
    named = clusters.persona_names(clusters.cluster_summary(given_clusters(t)))
    return named.select("cluster_id", "users", "cluster_name")


@query("cluster_zscores", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.cluster_zscores(clusters.persona_names(clusters.cluster_summary(given_clusters(t))))


@query("persona_top_region", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.persona_top_region(given_personas(t))


@query("persona_figures", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.persona_figures(given_personas(t))


@query("persona_cards", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.persona_cards(clusters.persona_figures(given_personas(t)))


# fitted results: no SQL equivalent


def scaled_vectors(t: RetailTables) -> DataFrame:
    scaled = clusters.standardise(clusters.cluster_features(stored_profile(t)), K.CLUSTER_FEATURES)
    return write_stage(scaled.select("customer_id", F.array(*K.CLUSTER_FEATURES).alias("features")), "scaled")


@query("kmeans_select", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.choose_k(scaled_vectors(t)).scores


@query("customer_clusters", SIGNUP, DISCOUNTS)
def _(t, star):
    clustered = clusters.assign_clusters(stored_profile(t)).profile
    named = clusters.persona_names(clusters.cluster_summary(clustered))
    full = clusters.add_personas(clustered, named)
    return full.select("customer_id", "cluster_id", "cluster_name", "cluster_x", "cluster_y")


@query("cluster_scatter", SIGNUP, DISCOUNTS)
def _(t, star):
    clustered = clusters.assign_clusters(stored_profile(t)).profile
    named = clusters.persona_names(clusters.cluster_summary(clustered))
    return clusters.cluster_scatter(clusters.add_personas(clustered, named))


@query("cluster_pca", SIGNUP, DISCOUNTS)
def _(t, star):
    return clusters.pca_coordinates(scaled_vectors(t))
