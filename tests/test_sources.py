"""CSV and Parquet table sets, JSON records, stored stages, publishing."""

import datetime as dt
import json

import pytest

from basketlens.plans.publish import build_outputs, publish_outputs
from basketlens.plans.stage import shared_folder, write_stage
from basketlens.sources.files import json_safe, load_tables, write_records
from basketlens.sources.tables import SCHEMAS

HEADERS = {name: ",".join(schema.names) for name, schema in SCHEMAS.items()}


def write_csv(folder, **lines):
    for name, header in HEADERS.items():
        (folder / f"{name}.csv").write_text("\n".join([header, *lines.get(name, [])]) + "\n")


def test_csv_types(spark, tmp_path):
    write_csv(
        tmp_path,
        customers=["1,Ann,a@x,DE,,2024-01-02,True", "2,Bob,b@x,,33.5,2024-01-02 10:30:00,False"],
        events=["5,7,2024-01-02 10:30:00,page_view,,2.0,3,,,"],
        reviews=['9,1,2,5,"two\nlines, ""quoted""",2024-01-02'],
    )
    t = load_tables(spark, str(tmp_path), line_breaks_in_texts=True)
    ann, bob = t.customers.orderBy("customer_id").collect()
    assert (ann["age"], ann["marketing_opt_in"], ann["signup_date"]) == (None, True, dt.datetime(2024, 1, 2))
    assert (bob["country"], bob["age"], bob["signup_date"]) == (None, 33.5, dt.datetime(2024, 1, 2, 10, 30))
    assert t.events.select("product_id", "qty", "cart_size").first()[:] == (None, 2, 3)
    assert t.reviews.first()["review_text"] == 'two\nlines, "quoted"'
    assert t.orders.count() == 0


def test_line_breaks_must_be_asked_for(spark, tmp_path):
    write_csv(tmp_path, reviews=['9,1,2,5,"two\nlines",2024-01-02'])
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        load_tables(spark, str(tmp_path)).reviews.collect()


def test_all_missing_files_are_named(spark, tmp_path):
    write_csv(tmp_path)
    (tmp_path / "orders.csv").unlink()
    (tmp_path / "products.csv").unlink()
    with pytest.raises(FileNotFoundError, match="orders.csv, products.csv"):
        load_tables(spark, str(tmp_path))


def test_bad_value_fails_the_read(spark, tmp_path):
    write_csv(tmp_path, order_items=["1,2,x,3,4"])
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        load_tables(spark, str(tmp_path)).order_items.collect()


def test_parquet_table_set(spark, tmp_path, make_tables):
    tables = make_tables(products=[dict(product_id=1, category="c", name="n", price_usd=2)])
    for name in SCHEMAS:
        getattr(tables, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    loaded = load_tables(spark, str(tmp_path), "parquet")
    assert loaded.products.first()["name"] == "n"


def test_json_records(spark, frame, tmp_path):
    df = frame([(1, float("nan")), (2, float("-inf")), (3, 0.5)], "id int, v double").coalesce(1)
    assert [r["v"] for r in json_safe(df).orderBy("id").collect()] == [None, None, 0.5]
    write_records(df, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"id": 1, "v": None}, {"id": 2, "v": None}, {"id": 3, "v": 0.5}]


def test_stage_goes_to_the_shared_folder(spark, frame):
    stored = write_stage(frame([(1, "a")], "i int, s string"), "test")
    assert [tuple(r) for r in stored.collect()] == [(1, "a")]
    assert shared_folder(spark) in stored.inputFiles()[0]


def test_publish(spark, make_tables, tmp_path):
    people = range(1, 61)
    tables = make_tables(
        customers=[
            dict(customer_id=i, name=f"Ms. N{i}", country=["DE", "US"][i % 2], age=20.0 + i % 50, signup_date="2024-01-01", marketing_opt_in=i % 3 == 0)
            for i in people
        ],
        sessions=[
            dict(session_id=100 * i + j, customer_id=i, start_time=f"2024-0{1 + j}-05 10:00:00", device="mobile", source="paid", country="DE")
            for i in people
            for j in range(i % 4)
        ],
        events=[
            dict(event_id=100 * i + j, session_id=100 * i + j, timestamp=f"2024-0{1 + j}-05 10:00:00", event_type="page_view")
            for i in people
            for j in range(i % 4)
        ],
        orders=[
            dict(order_id=100 * i + j, customer_id=i, order_time=f"2024-0{1 + j}-07 10:00:00", total_usd=i * (j + 1), subtotal_usd=i, discount_pct=0.1 * (i % 3), country="DE")
            for i in people
            for j in range(i % 3)
        ],
        order_items=[dict(order_id=100 * i, product_id=i % 5, quantity=1, line_total_usd=i) for i in people if i % 3],
        products=[dict(product_id=i, category=f"c{i % 2}", name=f"p{i}", margin_usd=1, price_usd=2, cost_usd=1) for i in range(6)],
        reviews=[
            dict(review_id=i, order_id=100 * i, product_id=i % 5, rating=1 + i % 5, review_text="great value", review_time="2024-02-01")
            for i in people
        ],
    )
    stopwords = spark.createDataFrame([("the",)], "token string")
    outputs = build_outputs(tables, stopwords=stopwords, starts=1)
    paths = publish_outputs(outputs, str(tmp_path))
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    assert read["profile"].count() == 60
    assert read["rfm_summary"].agg({"customers": "sum"}).first()[0] == 60
    assert read["cluster_summary"].agg({"users": "sum"}).first()[0] == 60
    scores = read["cluster_scores"].collect()
    assert sorted(r["k"] for r in scores) == [3, 4, 5, 6] and sum(r["chosen"] for r in scores) == 1
    assert read["persona_cards"].count() == read["cluster_summary"].count()
    assert read["answers"].count() == 9
    assert {r["token"] for r in read["category_keywords"].collect()} == {"great value"}
    assert {r["sentiment"] for r in read["review_sentiment"].collect()} == {"Positive"}
    corr = read["profile"].selectExpr("corr(cluster_x, cluster_y)", "var_pop(cluster_x) >= var_pop(cluster_y)").first()
    assert abs(corr[0]) < 1e-6 and corr[1]
