"""Physical plans: what must not appear in them."""

import datetime as dt
import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from support import SMALL

from basketlens.operators import customers, ranking
from basketlens.plans import catalog, states
from basketlens.plans.catalog import REGISTRY
from basketlens.sources import star_schema
from basketlens.sources.star_schema import COUNTRY

FITTED = {"kmeans_select", "customer_clusters", "cluster_scatter", "cluster_pca", "spending_potential"}


def plan(df, mode="simple"):
    jvm = df.sparkSession._jvm
    parsed = jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(parsed)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - FITTED))
def test_no_cross_join_and_no_row_udf(spark, name):
    text = plan(REGISTRY[name](spark, SMALL))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", text)


def test_profile_scans_only_needed_columns(spark):
    star = catalog.StarSchema(spark, SMALL, ())
    text = plan(customers.order_summary(star.orders))
    (schema,) = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert "o_totalprice" in schema and "o_orderstatus" not in schema and "o_orderpriority" not in schema


def test_scores_do_not_shuffle_the_scored_table(spark, frame):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as double) as v", "'payload' as payload")
    scored = ranking.quantile_scores(df, {"s": ("v", False)}, id_col="id", buckets=8)
    text = plan(scored)
    # the branch that carries the payload has no exchange: everything else is in the subquery
    main = text.split("Subquery")[0]
    assert "payload" in main and "Exchange" not in main


def test_sessions_are_cut_on_combined_rows(spark):
    """The window over a user's history reads one row per half day, not one per event."""
    star = catalog.StarSchema(spark, SMALL, ())
    text = plan(star.sessions)
    first_window = text.index("Window")
    assert "HashAggregate(keys=[user_id" in text[first_window:]


def test_texts_pass_by_their_orders_without_a_sort(spark):
    """A sorted join holds the texts of a whole partition in one task's memory."""
    text = plan(REGISTRY["labelled_reviews"](spark, SMALL))
    assert "ShuffledHashJoin" in text and "SortMergeJoin [order_id" not in text and "BroadcastHashJoin [order_id" not in text


def test_hash_tables_of_orders_stay_small(spark, frame, tmp_path, monkeypatch):
    """Partitions merged by their bytes hold ten million orders where no text is read, and a hash table can't spill."""
    days = [(k, dt.datetime(2020, 1, 1 + k % 28)) for k in range(1000)] + [(13, dt.datetime(2021, 1, 1)), (None, dt.datetime(2021, 1, 2))]
    orders = frame(days, "o_orderkey long, o_orderdate timestamp_ntz")
    docs = [(k, f"text {k}", k) for k in range(60)] + [(5, "again", 1)] + [(None, "lost", 2)] * 3
    tables = {"orders": orders, "documents": frame(docs, "doc_id long, text string, n_chars long"), "part": frame([(k,) for k in range(9)], "p_partkey long")}
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")

    def reviews():
        return star_schema.StarSchema(spark, str(tmp_path), ()).reviews

    def found():
        return sorted(map(tuple, reviews().collect()))

    few = found()
    monkeypatch.setattr(star_schema, "TABLE_ORDERS", 50)
    # 1002 orders in tables of about 50, with and without the texts; a missing order is dropped before
    for df in (reviews(), reviews().drop("review_text")):
        text = plan(df)
        assert len(re.findall(r"hashpartitioning\(order_id#\d+L, 21\), REPARTITION_BY_NUM", text)) == 2
        assert re.search(r"ShuffledHashJoin \[order_id", text) and "ENSURE_REQUIREMENTS" not in text.split("Subquer")[0]
        assert len(re.findall(r"Filter isnotnull\(\(?\(?doc_id|Filter .*isnotnull\(doc_id", text)) == 1
    assert found() == few and len(few) == 60 + 1 + 1
    assert sum(r[0] == 5 for r in few) == 2 and sum(r[0] == 1 for r in few) == 2 and all(r[0] is not None for r in few)


@pytest.mark.parametrize("name", ["category_keywords", "category_phrases"])
def test_words_are_counted_per_category(spark, name):
    """Counts per product hold nearly every word of every text; the plan has the stored counts of words only where it reads them."""
    text = plan(REGISTRY[name](spark, SMALL))
    assert "HashAggregate(keys=[category" in text and "HashAggregate(keys=[product_id" not in text


@pytest.mark.parametrize("name", ["category_keywords", "category_phrases", "review_sentiment", "valence_sentiment"])
def test_words_are_taken_once(spark, name):
    """No filter on the size of the exploded words, which would take them a second time in the scan."""
    assert not re.search(r"Filter [^\n]*(arrays_zip|regexp_extract_all|split)\(", plan(REGISTRY[name](spark, SMALL)))


def test_keyword_limit_is_pushed_below_the_exchange(spark):
    text = plan(REGISTRY["category_keywords"](spark, SMALL))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(catalog.StarSchema(spark, SMALL, ()).order_items.filter("order_id = 5").select("order_id", "quantity"))
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,5)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_bucketed_facts_meet_without_an_exchange(spark, folder):
    star = catalog.StarSchema(spark, folder, (COUNTRY,))
    stored = [states.bucketed(df, "test", 4) for df in (star.customers.select("customer_id"), star.sessions, star.orders)]
    found = states.customer_activity(*stored)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the test tables are small
    try:
        text = plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in text and text.count("Bucketed: true") == 3 and "SortMergeJoin" in text
    plain = states.customer_activity(star.customers, star.sessions, star.orders)
    assert sorted(found.collect()) == sorted(plain.collect())


def test_a_refresh_reads_its_months_only(spark, folder, tmp_path):
    star = catalog.StarSchema(spark, folder, (COUNTRY,))
    orders = star.orders.where("order_time >= '1995-01-01' and order_time < '1995-06-01'")
    path, whole = f"{tmp_path}/states", f"{tmp_path}/whole"
    states.refresh_order_states(orders.where("order_time < '1995-05-01'"), path)
    states.refresh_order_states(orders, path, dt.date(1995, 5, 1), dt.date(1995, 5, 31))
    states.refresh_order_states(orders, whole)

    def rows(at):
        return sorted(map(tuple, states.merged(states.read_order_states(spark, at), "month").collect()))

    assert rows(path) == rows(whole) and len(rows(path)) == 5
    # the months' limits reach the scan of the orders, and a read of one month opens its partition alone
    text = plan(states.order_states(star.orders, dt.date(1995, 5, 1), dt.date(1995, 5, 31)), "formatted")
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(o_orderdate,1995-05-01", text)
    one = states.read_order_states(spark, path).where("month = date'1995-05-01'")
    assert re.search(r"PartitionFilters: \[isnotnull\(month", plan(one)) and len(one.select("month").distinct().collect()) == 1
    # a month that lost its orders is overwritten too
    states.refresh_order_states(orders.where("order_time < '1995-05-01'"), path, dt.date(1995, 5, 1), dt.date(1995, 5, 31))
    assert [r[1] for r in rows(path)][-1] == 0


def test_sketches_of_any_period_come_near_the_exact_number(spark, folder, tmp_path):
    star = catalog.StarSchema(spark, folder, (COUNTRY,))
    states.refresh_order_states(star.orders, f"{tmp_path}/s")
    stored = states.read_order_states(spark, f"{tmp_path}/s")
    orders = star.orders.selectExpr("*", "year(order_time) as y")
    for key, column in (("country", "country"), ("y", "year(month)")):
        exact = {r[0]: r[1] for r in orders.groupBy(key).agg(F.countDistinct("customer_id")).collect()}
        near = {r[0]: r.buyers for r in states.merged(stored, F.expr(column).alias(key)).collect()}
        assert exact.keys() == near.keys() and all(abs(near[k] - n) <= 0.06 * n + 1 for k, n in exact.items())


def test_a_look_up_reads_one_row_group(spark, tmp_path):
    path = f"{tmp_path}/profile"
    states.write_for_lookup(spark.range(0, 40_000, 2).selectExpr("id as customer_id", "id * 2 as v"), path, "customer_id", 8)
    groups = []
    for name in sorted(os.listdir(path)):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(f"{path}/{name}").metadata
            for g in range(meta.num_row_groups):
                column = meta.row_group(g).column(0)
                groups.append((column.statistics.min, column.statistics.max))
    assert len(groups) == 8 and sum(low <= 12_346 <= high for low, high in groups) == 1
    found = spark.read.parquet(path).where("customer_id = 12346")
    assert "EqualTo(customer_id,12346)" in plan(found) and found.collect()[0].v == 24_692


def test_a_cube_scans_the_profile_once(spark, folder):
    text = plan(REGISTRY["customer_cube"](spark, folder))
    assert text.count("customer.parquet") == 1 and text.count("Expand") == 1


@pytest.mark.parametrize("name", ["customer_profile", "kpis"])
def test_sessions_are_cut_once(spark, folder, name):
    text = plan(REGISTRY[name](spark, folder))
    assert len(re.findall(r"FileScan parquet[^\n]*events\.parquet", text)) <= 2
    assert "Window" not in text.split("Subquery")[0] or "half-days" in text
