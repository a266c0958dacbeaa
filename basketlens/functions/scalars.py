"""Column expressions shared by the operators.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation.  Timestamps are ``timestamp_ntz`` and the expressions never
go through the session time zone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketlens.functions import constants as K


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; 0 where the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def first_match(rules: Iterable[tuple[Column, object]], default: object) -> Column:
    """Value of the first rule whose condition holds."""
    case = F
    for condition, value in rules:
        case = case.when(condition, F.lit(value))
    return case.otherwise(F.lit(default))


def fraction_mean(col: Column) -> Column:
    """Mean of small fractions held as double, the same in whatever order they are added."""
    return F.sum(col.cast("decimal(28,12)")).cast("double") / F.count(col)


def mean_of(col: Column) -> Column:
    """Exact mean of an integer or decimal column: sum and count kept apart."""
    return F.sum(col).cast("double") / F.count(col)


def money_sum(col: Column) -> Column:
    """Sum of amounts held as double, free of rounding drift."""
    return F.sum(col.cast("decimal(18,2)")).cast("double")


def period_start(ts: Column, grain: str = "month") -> Column:
    """First instant of the month, quarter, year or (Monday) week."""
    return F.trunc(ts.cast("date"), grain).cast("timestamp_ntz")


def periods_between(start: Column, end: Column, grain: str = "month") -> Column:
    """Whole periods between two period starts."""
    if grain == "month":
        return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))
    if grain == "week":
        return F.floor(F.datediff(end, start) / 7).cast("int")
    raise ValueError(f"unsupported grain: {grain}")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days between two timestamps, rounded towards minus infinity."""

    def time_of_day(ts: Column) -> Column:
        return ts - ts.cast("date").cast("timestamp_ntz")

    borrowed = F.when(time_of_day(later) < time_of_day(earlier), 1).otherwise(0)
    return F.datediff(later, earlier) - borrowed


def not_negative(value: Column) -> Column:
    """Negative values become 0; null stays null."""
    return F.when(value < 0, 0).otherwise(value)


def age_band(age: Column, edges=K.AGE_EDGES, labels=K.AGE_LABELS) -> Column:
    """Right-closed bands; null or outside becomes "Unknown"."""
    bands = [((age > lo) & (age <= hi), label) for lo, hi, label in zip(edges, edges[1:], labels)]
    return first_match(bands, K.UNKNOWN)


def first_name(name: Column) -> Column:
    """First name after an optional title; "" where there is none."""
    return F.coalesce(F.regexp_extract(F.trim(name), K.FIRST_NAME_PATTERN, 1), F.lit(""))


def gender_from_title(name: Column) -> Column:
    """Gender implied by a title at the start of the name, else null."""
    lowered = F.lower(F.trim(name))
    return first_match([(lowered.startswith(f"{t} "), g) for t, g in K.TITLE_GENDER], None)


def ltv_score(revenue: Column, order_count: Column, recency_days: Column) -> Column:
    money = first_match(
        [(revenue >= at, pts) for at, pts in K.LTV_REVENUE_AT_LEAST]
        + [(revenue > 0, K.LTV_REVENUE_ANY)],
        0,
    )
    frequency = first_match(
        [(order_count >= at, pts) for at, pts in K.LTV_ORDERS_AT_LEAST]
        + [(order_count == 1, K.LTV_ORDERS_ONE)],
        0,
    )
    freshness = first_match([(recency_days <= at, pts) for at, pts in K.LTV_RECENCY_AT_MOST], 0)
    return F.least(money + frequency + freshness, F.lit(K.LTV_MAX))


def ltv_tier(score: Column) -> Column:
    return first_match([(score >= at, tier) for at, tier in K.LTV_TIERS], K.LTV_LOWEST_TIER)


def crm_action(lifecycle_stage: Column, rfm_segment: Column) -> Column:
    """Recommended action; three RFM segments override the lifecycle stage."""
    by_segment = [(rfm_segment == s, K.CRM_RULES[s]) for s in K.CRM_RFM_FIRST]
    by_stage = [(lifecycle_stage == s, text) for s, text in K.CRM_RULES.items()]
    return first_match(by_segment + by_stage, K.CRM_DEFAULT)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


# --- text rendering ---------------------------------------------------------
# Numbers are printed as Python prints them: the exact binary value is rounded
# half-even.  The JVM formatter rounds the shortest decimal form half-up, which
# differs in the last digit now and then.
#
# These functions take a SQL expression, not a column: the rounding reads its
# input many times and is much smaller as one parsed text.  A one-element array
# and a lambda bind a value that is read more than once.

_BITS = 52


def _bind(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _scaled_units(size: str, digits: int) -> str:
    """size * 10^digits for size >= 0, rounded half-even from the exact binary value."""
    power, one = 10**digits, 1 << _BITS
    units = f"(cast(floor({size}) as bigint) * {power} + w.q)"
    # b: the fraction times 2^52, which is exact; its own fraction part r is not empty for
    # sizes below 1.  w.d: 2 * power * b plus one half, w.q: the whole units in it
    tie = f"(w.d = shiftleft(w.q, {_BITS + 1}) and w.exact)"
    rounded = f"{units} - if({tie} and {units} % 2 = 1, 1, 0)"
    doubled = f"(cast(floor(b) as bigint) * {2 * power} + {one} + cast(floor(r) as bigint))"
    parts = f"named_struct('d', {doubled}, 'q', shiftright({doubled}, {_BITS + 1}), 'exact', r = floor(r))"
    fraction = f"(({size}) - floor({size})) * {float(one)!r}D"
    rest = _bind(f"(b - floor(b)) * {2 * power}D", "r", parts)
    return _bind(_bind(fraction, "b", rest), "w", rounded)


def fixed_sql(value: str, digits: int, grouping: bool = False) -> str:
    """SQL text of a number with 0 to 3 decimals; null stays null."""
    if not 0 <= digits <= 3:
        raise ValueError("digits must be 0 to 3")
    if digits:
        power = 10**digits
        printed = f"concat(u div {power}, '.', lpad(cast(u % {power} as string), {digits}, '0'))"
    else:
        printed = "format_number(u, 0)" if grouping else "cast(u as string)"
    text = f"concat(if(x < 0, '-', ''), {_bind(_scaled_units('abs(x)', digits), 'u', printed)})"
    return _bind(f"cast({value} as double)", "x", text)


def _compact_sql(value: str, prefix: str, grouping: bool) -> str:
    text = (
        "case when v is null or isnan(v) then '-' "
        f"when abs(v) >= 1000000 then concat('{prefix}', {fixed_sql('v / 1000000', 2)}, 'M') "
        f"when abs(v) >= 1000 then concat('{prefix}', {fixed_sql('v / 1000', 1)}, 'K') "
        f"else concat('{prefix}', {fixed_sql('v', 0, grouping)}) end"
    )
    return _bind(f"cast({value} as double)", "v", text)


def fixed_text(value: str, digits: int) -> Column:
    return F.expr(fixed_sql(value, digits))


def number_text(value: str) -> Column:
    """Compact number: 999, 1.5K, 2.50M; "-" for null."""
    return F.expr(_compact_sql(value, "", False))


def currency_text(value: str) -> Column:
    return F.expr(_compact_sql(value, "$", True))


def percent_text(value: str, digits: int = 1, missing: str = "-") -> Column:
    """A share as a percentage, e.g. 0.1234 -> "12.3%"."""
    text = f"if(v is null or isnan(v), '{missing}', concat({fixed_sql('v * 100', digits)}, '%'))"
    return F.expr(_bind(f"cast({value} as double)", "v", text))


def month_text(ts: Column, long: bool = False) -> Column:
    return F.date_format(ts, "MMMM yyyy" if long else "yyyy-MM")


def finite_or_null(value: Column) -> Column:
    """NaN and infinities as null."""
    number = value.cast("double")
    infinite = F.abs(number) == F.lit(float("inf"))
    return F.when(F.isnan(number) | infinite, None).otherwise(value)
