"""Hand-made tables, one case per rule the larger test data cannot reach."""

import datetime as dt
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketlens.operators import clusters, customers, flows, funnel, potential, products, retention, segments, snapshot, texts, trends


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_dominant_value_ties_and_nulls(frame):
    data = [(1, "b"), (1, "a"), (1, "c"), (1, "c"), (1, "a"), (2, None), (3, "z"), (None, "z")]
    found = customers.dominant_value(frame(data, "g int, v string"), "g", "v", "top")
    assert sorted(rows(found, "g", "top")) == [(1, "a"), (3, "z")]


@pytest.fixture(scope="module")
def shop(make_tables):
    day = "2024-01-{:02d} 00:00:00".format
    return make_tables(
        customers=[
            dict(customer_id=1, name="Mr. Kim X", country="DE", age=24.0, signup_date="2023-12-01", marketing_opt_in=True),
            dict(customer_id=2, name="Alice Y", country="XX", age=None, signup_date="2024-01-05", marketing_opt_in=False),
            dict(customer_id=3, name="Bob Z", country=None, age=80.0, signup_date="2024-03-01", marketing_opt_in=False),
        ],
        sessions=[
            dict(session_id=10, customer_id=1, start_time="2024-01-01 23:00:00", device="mobile", source="paid"),
            dict(session_id=11, customer_id=1, start_time="2024-01-03 01:00:00", device="tv", source=None),
            dict(session_id=12, customer_id=2, start_time=day(9), device=None, source=None),
        ],
        events=[
            dict(event_id=1, session_id=10, timestamp="2024-01-01 23:00:00", event_type="page_view", cart_size=2),
            dict(event_id=2, session_id=10, timestamp="2024-01-01 23:01:00", event_type="purchase", qty=3),
            dict(event_id=3, session_id=10, timestamp="2024-01-01 23:02:00", event_type="error"),
            dict(event_id=4, session_id=99, timestamp="2024-02-01 00:00:00", event_type="checkout"),
            dict(event_id=5, session_id=10, timestamp="2024-01-01 23:03:00", event_type="purchase", cart_size=5),
        ],
        orders=[
            dict(order_id=100, customer_id=1, order_time="2024-01-02 00:00:00", total_usd=10, subtotal_usd=12, discount_pct=0.1, country="DE"),
            dict(order_id=101, customer_id=1, order_time="2024-03-10 00:00:00", total_usd=30, subtotal_usd=30, country="DE"),
            dict(order_id=102, customer_id=2, order_time="2024-06-10 00:00:00", total_usd=5, subtotal_usd=5, country="XX"),
        ],
        order_items=[
            dict(order_id=100, product_id=1, quantity=2, line_total_usd=8),
            dict(order_id=100, product_id=2, quantity=1, line_total_usd=2),
            dict(order_id=101, product_id=1, quantity=5, line_total_usd=30),
            dict(order_id=102, product_id=77, quantity=1, line_total_usd=5),
        ],
        products=[
            dict(product_id=1, category="toys", name="ball", margin_usd=1, price_usd=4, cost_usd=3),
            dict(product_id=2, category="toys", name="ball", margin_usd=2, price_usd=2, cost_usd=0),
            dict(product_id=3, category="food", name="tea", margin_usd=1, price_usd=1, cost_usd=0),
        ],
        reviews=[
            dict(review_id=1, order_id=100, product_id=1, rating=5, review_text="great", review_time="2024-01-05 00:00:00"),
            dict(review_id=2, order_id=100, product_id=1, rating=5, review_text="great but broken", review_time="2024-01-06 00:00:00"),
            dict(review_id=3, order_id=101, product_id=1, rating=5, review_text="valueless", review_time="2024-09-06 00:00:00"),
            dict(review_id=4, order_id=101, product_id=2, rating=1, review_text=None, review_time="2024-03-20 00:00:00"),
            dict(review_id=5, order_id=555, product_id=88, rating=4, review_text="bad", review_time="2024-03-21 00:00:00"),
        ],
    )


def test_profile(shop):
    profile = customers.customer_profile(shop)
    found = {r["customer_id"]: r for r in profile.collect()}
    kim, alice, bob = found[1], found[2], found[3]
    assert (kim["session_count"], kim["source_diversity"], kim["device_diversity"]) == (2, 1, 2)
    assert (kim["page_views"], kim["purchase_events"], kim["checkout_events"]) == (1, 2, 0)
    assert (kim["total_events"], kim["total_qty"], kim["mean_cart_size"]) == (4, 3, 3.5)
    # 26 hours between the sessions: one day and the first day
    assert kim["active_days"] == 2
    # the latest moment is the order of 10 June; sessions count, not orders
    assert kim["recency_days"] == (dt.datetime(2024, 6, 10) - dt.datetime(2024, 1, 3, 1)).days
    assert (kim["revenue"], kim["avg_order_value"], kim["avg_discount_pct"]) == (40.0, 20.0, 0.1)
    assert (kim["review_count"], kim["avg_rating"], kim["review_rate"]) == (4, 4.0, 2.0)
    assert (kim["gender_inferred"], kim["age_band"], kim["region"]) == ("Male", "18-24", "Europe")
    assert (alice["dominant_source"], alice["dominant_device"]) == ("No Session", "No Session")
    assert (alice["country_name"], alice["region"], alice["age_band"]) == ("XX", "Other", "Unknown")
    assert (bob["session_count"], bob["order_count"], bob["active_days"]) == (0, 0, 1)
    assert (bob["region"], bob["age_band"], bob["session_to_order_rate"]) == ("Other", "Unknown", 0.0)


def test_recency_from_orders_and_as_of(shop):
    profile = customers.customer_profile(shop, as_of=dt.datetime(2024, 3, 5), recency_from="orders")
    assert sorted(rows(profile, "customer_id", "recency_days")) == [(1, 0), (2, 0), (3, 4)]
    with pytest.raises(ValueError):
        customers.customer_profile(shop, recency_from="clicks")


def test_gender(frame):
    names = ["Mr. Kim X", "Miss Bob", "Dr. Alice X", "Alice X", "Sam Y", "李", "", "MRS. X", None, "Bob"]
    known = frame([("alice", False, True), ("bob", True, False), ("sam", True, True)], "name string, is_male boolean, is_female boolean")
    df = frame(list(enumerate(names)), "i int, name string")
    found = dict(rows(customers.infer_gender(df, "name", known), "i", "gender_inferred"))
    assert [found[i] for i in range(len(names))] == [
        "Male", "Female", "Female", "Female", "Ambiguous", "Unknown", "Unknown", "Female", "Unknown", "Male",
    ]
    titled = dict(rows(customers.infer_gender(df, "name"), "i", "gender_inferred"))
    assert (titled[0], titled[3]) == ("Male", "Unknown")


def test_funnel(shop):
    flags = funnel.session_flags(shop)
    assert rows(funnel.funnel_overall(flags), "stage", "sessions") == [
        ("page_view", 1), ("add_to_cart", 0), ("checkout", 0), ("purchase", 1),
    ]
    assert rows(funnel.funnel_by_device(flags), "device", "page_view", "purchase") == [
        ("desktop", None, None), ("mobile", 1.0, 1.0), ("tablet", None, None),
    ]
    assert [r[0] for r in rows(funnel.funnel_step_rates(flags), "of_previous")] == [None, 0.0, 0.0, 0.0]


def test_monthly_keeps_rows_not_calendar_months(shop):
    found = rows(trends.monthly_overview(shop), "month", "orders", "sessions", "revenue_rolling_3m", "review_count", "session_to_order")
    months = [r[0].month for r in found]
    assert months == [1, 3, 6]  # September has only a review
    assert [r[3] for r in found] == [10.0, 20.0, 15.0]
    assert [r[4] for r in found] == [2, 2, 0]
    assert found[0][5] == pytest.approx(1 / 3)
    assert rows(trends.peak_month(shop.orders), "label") == [("March 2024",)]


def test_geography(shop):
    found = {r["country"]: r for r in trends.geography(shop).collect()}
    assert (found["DE"]["orders"], found["DE"]["aov"], found["DE"]["country_name"], found["DE"]["sessions"]) == (2, 20.0, "Germany", 0)
    assert found["XX"]["region"] == "Other"


def test_categories(shop):
    perf = {r["category"]: r for r in products.category_performance(shop).collect()}
    assert perf["toys"]["avg_rating"] == 3.0  # mean of 5 and 1, not of the four reviews
    assert (perf["toys"]["revenue"], perf["toys"]["units"], perf["toys"]["gross_margin"], perf["toys"]["products"]) == (40.0, 8, 9.0, 2)
    assert (perf["food"]["revenue"], perf["food"]["products"], perf["food"]["avg_rating"]) == (0.0, 0, 0.0)
    grid = rows(products.category_monthly(shop), "month", "category", "revenue", "units")
    # June has only a line of an unknown product
    assert [(m.month, c, r, u) for m, c, r, u in grid] == [
        (1, "food", 0.0, 0), (1, "toys", 10.0, 3), (3, "food", 0.0, 0), (3, "toys", 30.0, 5), (6, "food", 0.0, 0), (6, "toys", 0.0, 0),
    ]


def test_product_lists(shop):
    master = products.product_master(shop)
    assert sorted(rows(master, "product_id", "total_qty", "review_count")) == [(1, 7, 3), (2, 1, 1), (3, 0, 0)]
    assert rows(products.top_products(shop), "product_id", "revenue", "avg_rating") == [(1, 38.0, 5.0), (2, 2.0, 1.0)]
    assert rows(products.top_names(shop), "name", "units") == [("ball", 8)]
    assert rows(products.lowest_rated(master, "toys", 1), "product_id") == [(2,)]
    assert rows(products.sales_rank(shop, days=30), "product_id", "name", "units") == [(77, None, 1)]


def test_top_rated_needs_five_reviews(frame):
    schema = "product_id int, name string, category string, avg_rating double, review_count long"
    master = frame([(1, "a", "c", 5.0, 4), (2, "b", "c", 4.0, 5), (3, "d", "c", 4.5, 6)], schema)
    assert rows(products.top_rated(master), "product_id") == [(3,), (2,)]


def test_wordlist_sentiment(shop):
    found = dict(rows(texts.wordlist_sentiment(shop.reviews), "review_id", "sentiment"))
    assert found == {1: "Positive", 2: "Neutral", 3: "Positive", 4: "Neutral", 5: "Negative"}
    labelled = texts.wordlist_sentiment(shop.reviews)
    shares = rows(products.sentiment_by_category(shop, labelled), "category", "Positive", "Neutral", "Negative")
    assert shares == [("toys", 50.0, 50.0, 0.0)]


def test_sentiment_cutoffs(frame):
    df = frame([(0.05,), (-0.05,), (0.049,), (0.0,)], "c double").coalesce(1)
    assert [r[0] for r in rows(df, texts.sentiment_label(F.col("c")))] == ["Positive", "Negative", "Neutral", "Neutral"]


def test_valence_looks_back_three_words(frame):
    lexicon = frame([("good", 2.0), ("bad", -2.0)], "token string, valence double")
    data = [
        (1, "good"),
        (2, "not good"),
        (3, "very good!"),
        (4, "not a very good"),
        (5, "not one two three good"),
        (6, "very bad"),
        (7, None),
        (8, "good, good"),
        (9, "nothing here"),
    ]
    reviews = frame(data, "review_id int, review_text string")
    found = {r["review_id"]: r for r in texts.review_sentiment(reviews, lexicon, keep=()).collect()}

    def compound(s):
        return round(s / (s * s + 15) ** 0.5, 4)

    sums = {1: 2.0, 2: -1.48, 3: 2.293, 4: -2.293 * 0.74, 5: 2.0, 6: -2.293, 7: 0.0, 8: 4.0, 9: 0.0}
    assert {k: v["compound"] for k, v in found.items()} == {k: compound(s) for k, s in sums.items()}
    assert [found[i]["sentiment"] for i in (1, 2, 7)] == ["Positive", "Negative", "Neutral"]


def test_keywords(frame):
    products_ = frame([(1, "c"), (2, "d")], "product_id int, category string")
    stop = frame([("the",)], "token string")
    reviews = frame(
        [(1, "The ring and the rings, the cat's glass 42 x"), (1, "rings glasses"), (2, "rings 7th"), (9, "lost")],
        "product_id int, review_text string",
    )
    found = rows(texts.category_keywords(reviews, products_, stop), "category", "rank", "token", "n", "weight")
    assert [r for r in found if r[0] == "c"][0] == ("c", 1, "ring", 3, 1.0)
    assert {(r[0], r[2], r[3]) for r in found} == {
        ("c", "ring", 3), ("c", "and", 1), ("c", "cat", 1), ("c", "glass", 1), ("c", "glasses", 1), ("d", "rings", 1), ("d", "7th", 1),
    }


def test_phrases_take_the_counts_of_their_words(frame):
    products_ = frame([(1, "c")], "product_id int, category string")
    stop = frame([("the",)], "token string")
    data = [(1, "battery life")] * 20 + [(1, f"word{chr(97 + i)} other{chr(97 + i)}") for i in range(12)]
    data += [(1, "life")] * 2 + [(1, "battery the 42 life")]
    reviews = frame(data, "product_id int, review_text string")
    phrases = texts.category_phrases(reviews, products_, stop)
    ((token, n, score),) = rows(phrases, "token", "n", "score")

    def fit(k, n, p):
        return k * math.log(max(p, 1e-10)) + (n - k) * math.log(max(1 - p, 1e-10))

    both, first, second, total = 20, 21, 23, 20 * 2 + 24 + 2 + 2
    apart = fit(both, first, second / total) + fit(second - both, total - first, second / total)
    together = fit(both, first, both / first) + fit(second - both, total - first, (second - both) / (total - first))
    assert (token, n) == ("battery life", 20) and score == pytest.approx(-2 * (apart - together)) and score > 30
    found = dict(rows(texts.category_keywords(reviews, products_, stop, phrases=phrases), "token", "n"))
    assert (found["battery life"], found["battery"], found["life"], found["worda"]) == (20, 1, 3, 1)


def test_words_and_pairs_are_counted_in_one_pass(frame):
    data = [(1, "ox's's cart ox's's cart the cart 42 end"), (2, "ox cart"), (1, None), (1, ""), (3, "ox cart"), (1, "ox"), (9, "ox cart"), (1, "7a's's ab 77's's ab")]
    products_ = frame([(1, "c"), (2, "c"), (2, "e"), (3, None)], "product_id int, category string")
    stop = frame([("the",), ("ab",)], "token string")
    followers = texts._followers(frame(data, "product_id int, review_text string"), products_, stop, "review_text")
    counted = texts._counted_pairs(followers, stop)
    found = Counter(map(tuple, counted.collect()))
    # "ox's" counts for itself, but its pairs are those of "ox"
    words = [("c", "ox's", None, 2, 2), ("c", "cart", None, 4, 4), ("c", "end", None, 1, 1), ("c", "ox", None, 2, 2), ("c", "7a's", None, 1, 1), ("c", "77's", None, 1, 1)]
    pairs = [("c", "ox", "cart", 3, 2), ("c", "cart", "ox", 1, 4), ("c", "cart", "end", 1, 4), ("e", "ox", "cart", 1, 1)]
    assert found == Counter(words + [("e", "ox", None, 1, 1), ("e", "cart", None, 1, 1)] + pairs)
    # the texts pass once, to the words' homes
    final = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow") == 1 and len(re.findall(r"ReusedExchange [^\n]*REPARTITION_BY_COL", final)) == 1


@pytest.mark.parametrize("most", [1, 3, 100])
def test_words_and_followers_are_packed_in_pieces(most):
    category, words = ["c", "d", "c", "c", "c"], [["a", "b", "a", "b"], ["a"], None, [], ["b", "a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(category), pa.array(words, pa.list_(pa.string()))], ["category", "w"])
    alone, pairs = Counter(), Counter()
    for piece in texts._pack_followers(most)(iter([batch.slice(0, 4), batch.slice(4), batch.slice(2, 2)])):
        for row in piece.to_pylist():
            n, *nexts = row["entries"].split(" ")
            alone[row["category"], row["word"]] += int(n.removeprefix("="))
            for x in nexts:
                pairs[row["category"], row["word"], x.split("=")[0]] += int((x.split("=") + ["1"])[1])
    assert alone == {("c", "a"): 3, ("c", "b"): 3, ("d", "a"): 1} and pairs == {("c", "a", "b"): 2, ("c", "b", "a"): 2}


def test_pairs_are_not_gathered_by_category(spark, frame):
    """The totals of the few categories come to the pairs, however many pairs there are."""
    reviews = frame([(1, "battery life")] * 20, "product_id int, review_text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the tables here are small
    try:
        found = texts.category_phrases(reviews, frame([(1, "c")], "product_id int, category string"), frame([("the",)], "token string"))
        text = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # only the sums of words are
    gathered = r"Exchange hashpartitioning\(category#\d+, \d+\)"
    assert len(re.findall(gathered, text)) == len(re.findall(gathered + r"[^\n]*\n[^\n]*HashAggregate", text)) == 1


def test_new_user_conversion(shop):
    found = rows(trends.new_user_conversion(shop), "month", "new_users", "buyers", "conversion")
    assert [(m.month, n, b, c) for m, n, b, c in found] == [(12, 1, 0, 0.0), (1, 1, 0, 0.0), (3, 1, 0, 0.0)]


def test_question_routing(frame):
    questions = [
        ("Which customers buy most?", "orders"),
        ("reorder", "orders"),
        ("hello", "help"),
        ("Total SALES of champions", "revenue"),
        ("how many shoppers", "customers"),
        ("churn", "churn"),
        ("rfm", "rfm"),
        ("feedback", "rating"),
        ("cart", "conversion"),
        ("best", "products"),
        (None, "help"),
    ]
    df = frame([(q,) for q, _ in questions], "q string").coalesce(1)
    assert [r[0] for r in rows(texts.route_questions(df, "q"), "intent")] == [i for _, i in questions]


def test_retention_window(make_tables):
    tables = make_tables(
        customers=[
            dict(customer_id=1, signup_date="2023-01-31 10:00:00"),
            dict(customer_id=2, signup_date="2023-01-02"),
            dict(customer_id=3, signup_date="2023-05-02"),
        ],
        orders=[
            dict(order_id=i, customer_id=c, order_time=t)
            for i, (c, t) in enumerate(
                [
                    (1, "2022-12-31 23:00:00"),
                    (1, "2023-01-31 11:00:00"),
                    (1, "2023-02-01"),
                    (1, "2023-02-20"),
                    (2, "2024-01-31 23:59:59"),
                    (2, "2024-02-01"),
                    (3, "2023-04-30"),
                ]
            )
        ],
    )
    long_form = retention.retention(tables, activity="orders")
    assert sorted(rows(long_form, "period", "active_users", "cohort_size", "retention")) == [(0, 1, 2, 0.5), (1, 1, 2, 0.5), (12, 1, 2, 0.5)]
    wide = retention.retention_wide(long_form).collect()
    assert len(wide) == 1 and wide[0]["m12"] == 0.5 and wide[0]["m2"] is None
    matrix = retention.retention_matrix(long_form).first()
    assert (matrix["cohort"], matrix["months"], matrix["values"]) == ("2023-01-01", [0, 1, 12], [0.5, 0.5, 0.5])
    assert retention.retention_text(long_form).first()[:4] == ("2023-01", "50.0%", "50.0%", "")


def test_kpis_and_snapshot(shop):
    row = snapshot.kpis(shop).first()
    assert (row["customers"], row["countries"], row["sessions"], row["active_users"], row["orders"]) == (3, 2, 3, 2, 3)
    assert (row["revenue"], row["aov"], row["conversion_rate"], row["add_to_cart_rate"], row["avg_rating"]) == (45.0, 15.0, 1.0, 0.0, 4.0)
    assert row["date_to"] == dt.datetime(2024, 9, 6)
    staged = segments.add_lifecycle(customers.customer_profile(shop)).withColumn("rfm_segment", F.lit("Champions"))
    facts = snapshot.business_snapshot(shop, staged)
    table = {(r["section"], r["key"]): r["value"] for r in facts.collect()}
    assert table[("headline", "conversion")] == 1.0
    assert table[("peak_month", "March 2024")] == 30.0
    assert table[("product", "ball [toys]")] == 8.0
    assert table[("category", "toys")] == 8.0
    top = snapshot.ranked(products.top_names(shop, with_category=False, n=5).selectExpr("name as key", "units as value"))
    texts_ = dict(rows(snapshot.answers(facts, top), "intent", "answer"))
    assert texts_["revenue"] == "**Total revenue:** $45  \n**Peak month:** March 2024"
    assert texts_["orders"] == "**Total orders:** 3  \n**Average order value:** $15"
    assert texts_["rfm"] == "**RFM Segments:**\n- Champions: 3"
    assert texts_["products"] == "**Top 5 products by units sold:**\n- ball: 8 units"
    assert texts_["conversion"].endswith("100.0%  \n**Sessions:** 3 | **Orders:** 3")
    lines = rows(snapshot.snapshot_lines(facts), "title", "line")
    assert ("CATEGORIES (by units)", "- toys: 8 units") in lines
    assert ("BUSINESS SNAPSHOT", "Sessions: 3 | Orders: 3") in lines
    assert ("BUSINESS SNAPSHOT", "Peak revenue month: March 2024 ($30)") in lines


def test_means_leave_out_missing_totals_and_ratings(make_tables):
    tables = make_tables(
        customers=[{"customer_id": 1, "country": "US"}],
        orders=[
            {"order_id": 1, "customer_id": 1, "order_time": "2024-01-01", "total_usd": 10},
            {"order_id": 2, "customer_id": 1, "order_time": "2024-02-01"},
            {"order_id": 3, "customer_id": 1, "order_time": "2024-04-01", "total_usd": 30},
        ],
        reviews=[{"review_id": 1, "order_id": 1, "rating": 5}, {"review_id": 2, "order_id": 1}, {"review_id": 3, "order_id": 3, "rating": 2}],
    )
    row = snapshot.kpis(tables).first()
    assert (row["orders"], row["aov"], row["avg_rating"], row["review_count"]) == (3, 20.0, 3.5, 3)
    facts = {r["key"]: r["value"] for r in snapshot.headline(tables).collect()}
    assert (facts["orders"], facts["aov"], facts["avg_rating"], facts["reviews"]) == (3, 20.0, 3.5, 3)


def test_recent_revenue(frame):
    orders = frame(
        [(dt.datetime(2024, m, 3), v) for m, v in ((1, 10.0), (2, 20.0), (3, 30.0), (5, 60.0), (5, 6.0))], "order_time timestamp_ntz, total_usd double"
    )
    found = [(r["month"].month, r["revenue"], r["change"]) for r in trends.recent_revenue(orders, 4).collect()]
    assert found == [(2, 20.0, 1.0), (3, 30.0, 0.5), (5, 66.0, None)]


def test_later_value_and_potential(make_tables, frame):
    cut = dt.datetime(2024, 1, 1)
    spend = {1: [("2024-01-05", 600)] * 8 + [("2024-06-28", 1)], 2: [("2023-12-31", 900), ("2024-07-01", 900)], 3: [("2024-06-20", 100)]}
    tables = make_tables(
        customers=[{"customer_id": i} for i in (1, 2, 3)],
        orders=[{"order_id": 10 * c + i, "customer_id": c, "order_time": t, "total_usd": v} for c, o in spend.items() for i, (t, v) in enumerate(o)],
    )
    found = {r["customer_id"]: (r["later_orders"], r["later_score"], r["later_tier"], r["high_potential"]) for r in potential.later_value(tables, cut, 182).collect()}
    assert found == {1: (9, 100, "Platinum", True), 2: (0, 0, "Bronze", False), 3: (1, 50, "Silver", False)}
    rows_ = [(i, 1 + i % 5, 1, 1, "Active Repeat Buyer", i % 3, 0.1, 50.0 + 200 * (i % 2), 0.0, 5, 10, 1) for i in range(200)]
    schema = (
        "customer_id int, r_score int, f_score int, m_score int, lifecycle_stage string, session_count int, page_to_cart_rate double, "
        "avg_order_value double, avg_discount_pct double, active_days int, recency_days int, marketing_opt_in int"
    )
    past = frame(rows_, schema)
    label = past.selectExpr("customer_id", "if(customer_id % 2 = 1, 'Gold', 'Bronze') as later_tier")
    out = potential.spending_potential(past, label, past).collect()
    assert all((r["predicted_ltv_tier"] == "Gold") == (r["customer_id"] % 2 == 1) == r["high_potential"] for r in out)
    assert all(0 <= r["potential_score"] <= 100 for r in out)


SUMMARY = "cluster_id int, users long, avg_age double, sessions double, orders double, revenue double, aov double, conversion double, avg_discount double, avg_rating double, recency double"


def summary_row(cluster, **values):
    names = [c.split()[0] for c in SUMMARY.split(", ")][2:]
    return (cluster, 10, *[float(values.get(n, 0)) for n in names])


def test_persona_names(frame):
    data = [
        summary_row(0),
        summary_row(1, revenue=90, orders=9, conversion=0.5),
        summary_row(2, revenue=50, orders=5, conversion=0.4, sessions=1),
        summary_row(3, revenue=40, orders=4, conversion=0.4, sessions=1),
        summary_row(4, revenue=30, orders=3, conversion=0.1, sessions=9, recency=1),
        summary_row(5, revenue=20, orders=2, conversion=0.3, avg_discount=0.5),
    ]
    found = dict(rows(clusters.persona_names(frame(data, SUMMARY)), "cluster_id", "cluster_name"))
    assert found[0] == "Never Purchased"
    assert found[1] == "High-Value Repeat Buyers"
    assert found[4] == "Heavy Browsers, Low Conversion"


def test_repeated_persona_gets_its_number(frame):
    data = [
        summary_row(0, revenue=90, orders=1, conversion=0.9, sessions=9, recency=9, avg_discount=9),
        summary_row(1, revenue=10, orders=9, conversion=0.9, sessions=9, recency=9, avg_discount=9),
        summary_row(2, revenue=60, orders=2, conversion=0.2, sessions=1, recency=1, avg_discount=1),
        summary_row(3, revenue=50, orders=3, conversion=0.2, sessions=1, recency=1, avg_discount=1),
        summary_row(4, revenue=40, orders=4, conversion=0.2, sessions=1, recency=1, avg_discount=1),
    ]
    found = dict(rows(clusters.persona_names(frame(data, SUMMARY)), "cluster_id", "cluster_name"))
    assert [found[i] for i in (2, 3, 4)] == ["Steady Mainstream", "Steady Mainstream 4", "Steady Mainstream 5"]
    assert [found[i] for i in (0, 1)] == ["Promotion Sensitive", "Promotion Sensitive 2"]


def test_silhouette_edge_cases(frame):
    data = [(1, [0.0, 0.0], 0, 0), (2, [0.0, 1.0], 0, 0), (3, [9.0, 9.0], 1, 0)]
    df = frame(data, "id int, v array<double>, two int, one int")
    found = {r["labelling"]: r["silhouette"] for r in clusters.silhouette_exact(df, "id", "v", ["two", "one"]).collect()}
    b1, b2 = (81 + 81) ** 0.5, (81 + 64) ** 0.5
    assert found[0] == pytest.approx(((b1 - 1) / b1 + (b2 - 1) / b2 + 0) / 3)
    assert found[1] == -1.0


def test_standardise_constant_column(frame):
    df = frame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0)], "id int, a double, b double")
    found = rows(clusters.standardise(df, ["a", "b"]).orderBy("id"), "a", "b")
    std = (14 / 9) ** 0.5
    assert [r[0] for r in found] == pytest.approx([(x - 7 / 3) / std for x in (1, 2, 4)])
    assert [r[1] for r in found] == [0.0, 0.0, 0.0]


def test_lookup(shop, frame):
    profile = segments.add_lifecycle(customers.customer_profile(shop)).withColumn("rfm_segment", F.lit("Champions"))
    card = segments.customer_lookup(profile, [1, 404]).collect()
    assert len(card) == 1 and len(card[0]) == 23
    assert (card[0]["name"], card[0]["country"], card[0]["marketing_opt_in"], card[0]["cluster_name"]) == ("Mr. Kim X", "Germany", True, "-")
    batch = segments.customer_lookup(profile, frame([(2,), (2,), (404,)], "customer_id int"))
    assert rows(batch, "customer_id") == [(2,)]


def test_squared_silhouette_against_pairs(frame):
    points = [(i, [float(i % 7), float(i * i % 11)], i % 3, 0) for i in range(40)] + [(99, [50.0, 50.0], 9, 0)]
    df = frame(points, "id long, v array<double>, three int, one int")
    found = {r["labelling"]: r for r in clusters.silhouette_squared(df, "v", ["three", "one"]).collect()}

    def squared(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    values = []
    for i, v, own, _ in points:
        to = {c: [squared(v, w) for j, w, d, _ in points if d == c and j != i] for c in {p[2] for p in points}}
        a, b = to.pop(own), min(sum(x) / len(x) for x in to.values() if x)
        mean = sum(a) / len(a) if a else None
        values.append(0.0 if mean is None else (b - mean) / max(a and mean, b))
    assert found[0]["clusters"] == 4 and found[0]["points"] == 41
    assert abs(found[0]["silhouette"] - sum(values) / len(values)) < 1e-9
    assert found[1]["silhouette"] == -1


def test_persona_names_do_not_depend_on_the_partitions(frame):
    rows = [(i, i % 5, 30 + i % 3, i % 4, i % 6, (i % 6) * 0.1, 0.1 * (i % 5), 0.3, 0.07 * (i % 7), 4.0, i % 30) for i in range(400)]
    df = frame(
        rows,
        "customer_id int, cluster_id int, age int, session_count int, order_count int, revenue double, avg_order_value double, "
        "session_to_order_rate double, avg_discount_pct double, avg_rating double, recency_days int",
    )
    seen = {tuple(sorted(map(tuple, clusters.persona_names(clusters.cluster_summary(df.repartition(n))).collect()))) for n in (1, 3, 7, 16)}
    assert len(seen) == 1


def test_customer_flow(frame):
    months = {1: [1, 2, 3], 2: [2, 3, 4], 4: [1, 2], 5: [1, 2, 5]}
    data = [(c, dt.datetime(2024, m, 5)) for m, cs in months.items() for c in cs for _ in range(2)] + [(None, dt.datetime(2024, 1, 1)), (70_000, None)]
    found = flows.customer_flow(frame(data, "customer_id int, order_time timestamp_ntz"))
    got = {r.month.month: (r.active, r.kept, r.lost, r.new, r.returned) for r in found.collect()}
    assert got == {1: (3, 0, 0, 3, 0), 2: (3, 2, 1, 1, 0), 4: (2, 0, 0, 0, 2), 5: (3, 2, 0, 1, 0)}


def test_bitmaps_hold_any_id(frame):
    ids = [0, 1, -1, 32_768, -32_768, 2**40, 7, 7]
    df = frame([(i,) for i in ids] + [(None,)], "customer_id long").withColumn("k", F.lit("a"))
    both = flows.in_both(flows.bitmaps(df, "k"), flows.bitmaps(df.where("customer_id > 0"), "k"), "k").collect()
    assert [r.both for r in both] == [4]


def test_ranking_auc_and_calibration(frame):
    rng = random.Random(3)
    for rows in ([(float(rng.randrange(9)), rng.random() < 0.4) for _ in range(300)], [(rng.random(), rng.random() < 0.1) for _ in range(200)], [(1.0, True)], []):
        df = frame([*rows, (None, True), (0.5, None)], "s double, y boolean")
        (r,) = potential.ranking_auc(df, "s", "y", parts=7).collect()
        up, down = [s for s, y in rows if y], [s for s, y in rows if not y]
        wins = sum((a > b) + 0.5 * (a == b) for a in up for b in down)
        assert (r.positives, r.negatives) == (len(up), len(down))
        assert r.auc == pytest.approx(wins / (len(up) * len(down)) if up and down else 0.0)
    df = frame([(i / 100, i % 100 < 30) for i in range(1000)], "s double, y boolean")
    parts = potential.calibration(df, "s", "y", parts=5).collect()
    assert len(parts) == 5 and sum(p.rows for p in parts) == 1000 and all(p.rate == pytest.approx(0.3, abs=0.02) for p in parts)
