"""Column expressions against values worked out by hand."""

import datetime as dt

import pytest
from support import moment
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.operators.segments import lifecycle_stage, rfm_segment


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


@pytest.mark.parametrize(
    "later, earlier, days",
    [
        ("2024-01-02 01:00:00", "2024-01-01 23:00:00", 0),
        ("2024-01-02 23:00:00", "2024-01-01 23:00:00", 1),
        ("2024-01-01 00:00:00", "2024-01-01 05:00:00", -1),
        ("2024-03-01 12:00:00", "2024-02-28 12:00:01", 1),
    ],
)
def test_elapsed_days_floors(frame, later, earlier, days):
    df = frame([(moment(later), moment(earlier))], "b timestamp_ntz, a timestamp_ntz")
    assert column(df, S.elapsed_days(F.col("b"), F.col("a"))) == [days]


def test_age_bands_are_right_closed(frame):
    ages = [17.0, 17.5, 24.0, 24.5, 75.0, 76.0, None]
    df = frame([(a,) for a in ages], "age double")
    assert column(df, S.age_band(F.col("age"))) == [
        "Unknown", "18-24", "18-24", "25-34", "65-75", "Unknown", "Unknown",
    ]


def test_lifecycle_rules_and_gaps(frame):
    cases = [
        (0, 0, 30, "New Visitor"),
        (0, 1, 31, "Browsing Prospect"),
        (0, 0, 31, "Unclassified"),
        (1, 1, 45, "New Buyer"),
        (1, 1, 46, "Unclassified"),
        (1, 1, 60, "Unclassified"),
        (1, 1, 61, "Cooling Down"),
        (2, 1, 60, "Active Repeat Buyer"),
        (2, 1, 120, "Cooling Down"),
        (2, 1, 121, "Dormant Customer"),
        (0, 0, None, "Unclassified"),
    ]
    df = frame([c[:3] for c in cases], "o int, s int, r int").coalesce(1)
    assert column(df, lifecycle_stage(F.col("o"), F.col("s"), F.col("r"))) == [c[3] for c in cases]


def test_rfm_rules(frame):
    cases = {
        "444": "Champions",
        "431": "Loyal Customers",
        "241": "At-Risk High Value",
        "222": "Lost Low Value",
        "322": "Price / Casual Shoppers",
        "333": "Potential Loyalists",
        "443": "Loyal Customers",
    }
    df = frame([tuple(map(int, k)) for k in cases], "r int, f int, m int").coalesce(1)
    assert column(df, rfm_segment(F.col("r"), F.col("f"), F.col("m"))) == list(cases.values())


def test_ltv(frame):
    cases = [
        (500.0, 8, 30, 100, "Platinum"),
        (499.99, 7, 60, 70, "Gold"),
        (200.0, 1, 61, 44, "Silver"),
        (80.0, 1, 180, 24, "Bronze"),
        (0.0, 0, 181, 0, "Bronze"),
        (0.01, 2, 121, 20, "Bronze"),
        (0.0, 0, None, 0, "Bronze"),
    ]
    df = frame([c[:3] for c in cases], "m double, o int, r int").coalesce(1)
    score = S.ltv_score(F.col("m"), F.col("o"), F.col("r"))
    assert [tuple(r) for r in df.select(score, S.ltv_tier(score)).collect()] == [c[3:] for c in cases]


def test_crm_priority(frame):
    df = frame(
        [("Dormant Customer", "Champions"), ("New Buyer", "Loyal Customers"), ("Unclassified", "Potential Loyalists")],
        "l string, s string",
    ).coalesce(1)
    assert column(df, S.crm_action(F.col("l"), F.col("s"))) == [
        K.CRM_RULES["Champions"], K.CRM_RULES["New Buyer"], K.CRM_DEFAULT,
    ]


def test_first_names(frame):
    names = ["Mr. Kim X", "Dr.Alice Y", "Anne-Marie O'Neil", "  Bob", "李", "", None, "A"]
    df = frame([(n,) for n in names], "n string").coalesce(1)
    assert column(df, S.first_name(F.col("n"))) == ["Kim", "Alice", "Anne-Marie", "Bob", "", "", "", ""]


def test_period_numbers(frame):
    df = frame([(moment("2023-11-30 10:00:00"), moment("2024-02-01 00:00:00"))], "a timestamp_ntz, b timestamp_ntz")
    months = S.periods_between(S.period_start(F.col("a")), S.period_start(F.col("b")))
    weeks = S.periods_between(S.period_start(F.col("a"), "week"), S.period_start(F.col("b"), "week"), "week")
    assert df.select(months, weeks, S.period_start(F.col("a"))).first()[:] == (3, 9, dt.datetime(2023, 11, 1))


def python_compact(x, prefix="", grouping=False):
    if x is None or x != x:
        return "-"
    if abs(x) >= 1_000_000:
        return f"{prefix}{x / 1_000_000:.2f}M"
    if abs(x) >= 1_000:
        return f"{prefix}{x / 1_000:.1f}K"
    return f"{prefix}{x:,.0f}" if grouping else f"{prefix}{x:.0f}"


def test_number_texts(frame):
    values = [None, float("nan"), 0.0, 999.4, 999.5, 0.5, 1.5, 2.5, 1500.0, -1500.0, 2_500_000.0, 1150.0, 1250.0, 405850.0, 405950.0]
    df = frame([(v,) for v in values], "v double").coalesce(1)
    assert column(df, S.number_text("v")) == [python_compact(v) for v in values]
    assert column(df, S.currency_text("v")) == [python_compact(v, "$", True) for v in values]


@settings(max_examples=4, deadline=None, phases=[Phase.generate])
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_subnormal=False), min_size=20, max_size=60))
def test_texts_equal_python_formatting(frame, values):
    values = [v + 0.0 for v in values]  # no negative zero
    # quarters and eighths are exact ties
    values = values + [i / 8 for i in range(-40, 40)] + [i * 50.0 for i in range(100)] + [i / 100 for i in range(60)]
    df = frame([(v,) for v in values], "v double").coalesce(1)
    for digits in range(4):
        printed = column(df, S.fixed_text("v", digits))
        assert printed == [f"{v:.{digits}f}" for v in values]
    assert column(df, S.percent_text("v")) == [f"{v * 100:.1f}%" for v in values]


def test_ratio_is_zero_without_denominator(frame):
    df = frame([(1, 0), (1, None), (None, 2), (1, 4)], "a int, b int").coalesce(1)
    assert column(df, S.ratio(F.col("a"), F.col("b"))) == [0.0, 0.0, None, 0.25]


def test_finite_or_null(frame):
    df = frame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "v double").coalesce(1)
    assert column(df, S.finite_or_null(F.col("v"))) == [None, None, None, 1.5, None]
