"""One DuckDB statement per registered query that SQL can express."""

from __future__ import annotations

from oracle.views import VIEWS, with_views

_TIDY: dict[str, str] = {}


_DIGITS = ", 6)"


def _nudged(sql: str) -> str:
    """Add 1e-10 inside every round(x, 6): exact ties then go up on every engine."""
    done, rest = "", sql
    while (at := rest.find("round(")) >= 0:
        depth, end = 1, at + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        inner = rest[at + len("round(") : end]
        if inner.endswith(_DIGITS):
            inner = f"({inner[: -len(_DIGITS)]}) + 1e-10{_DIGITS}"
        done, rest = done + rest[:at] + "round(" + inner, rest[end:]
    return done + rest


def statements() -> dict[str, str]:
    return {name: with_views(_nudged(sql.strip())) for name, sql in _TIDY.items()}


def _r(columns: str, digits: int = 6) -> str:
    """"a b c=expr" -> rounded select items."""
    items = []
    for item in columns.split():
        name, _, expr = item.partition("=")
        items.append(f"round({expr or name}, {digits}) as {name}")
    return ", ".join(items)


Q = _TIDY

# --- sources --------------------------------------------------------------------
Q["load_customers"] = "select customer_id, name, country, age, marketing_opt_in, market_segment, signup_date from x_customers"
Q["load_sessions"] = "select * from x_sessions"
Q["load_events"] = f"select event_id, session_id, event_time as timestamp, event_type, qty, cart_size, {_r('amount_usd')} from x_events"
Q["load_orders"] = f"""select order_id, customer_id, order_time, payment_method, cast(total_usd as double) as total_usd, {_r('discount_pct')},
 cast(subtotal_usd as double) as subtotal_usd, country from x_orders"""
Q["load_order_items"] = "select order_id, product_id, quantity, cast(line_total_usd as double) as line_total_usd from x_order_items"
Q["load_products"] = "select product_id, category, name, cast(price_usd as double) as price_usd, cast(margin_usd as double) as margin_usd from x_products"
Q["load_reviews"] = "select * from x_reviews"
Q["json_safe"] = "select event_id, case when event_type in ('error', 'signup', 'view') then null else round(value, 6) end as value from events"

# --- customers ------------------------------------------------------------------
Q["session_summary"] = "select * from session_summary"
Q["dominant_value"] = "select * from dominant"
Q["event_type_counts"] = "select * from event_counts"
Q["event_volume"] = f"select customer_id, total_events, total_qty, {_r('mean_cart_size')} from event_volume"
Q["event_user"] = "select event_id, session_id, customer_id, event_type from event_user"
Q["order_summary"] = f"select customer_id, order_count, first_order, last_order, {_r('revenue subtotal avg_order_value avg_discount_pct')} from order_summary"
Q["review_summary"] = f"select customer_id, review_count, {_r('avg_rating')} from review_summary"
Q["reference_time"] = """select greatest((select max(event_time) from x_events), (select max(order_time) from x_orders),
 (select max(start_time) from x_sessions)) as reference_time"""
_RATES = "session_to_order_rate page_to_cart_rate cart_to_checkout_rate checkout_to_purchase_rate review_rate revenue_per_session"
Q["customer_profile"] = f"""select customer_id, name, country, country_name, region, age, signup_date, marketing_opt_in, gender_inferred, age_band,
 session_count, first_session, last_session, source_diversity, device_diversity, dominant_source, dominant_device, page_views, add_to_cart_events,
 checkout_events, purchase_events, total_events, total_qty, order_count, first_order, last_order, review_count, active_days, recency_days,
 {_r('mean_cart_size revenue subtotal avg_order_value avg_discount_pct avg_rating ' + _RATES)} from profile_s"""
Q["customer_rates"] = f"select customer_id, {_r(_RATES)} from profile_s"
Q["geo_lookup"] = """select doc_id, upper(lang) as country,
 case upper(lang) when 'DE' then 'Germany' when 'ES' then 'Spain' when 'FR' then 'France' else upper(lang) end as country_name,
 case when upper(lang) in ('DE', 'ES', 'FR') then 'Europe' else 'Other' end as region from documents"""
Q["gender_inference"] = """select p_partkey, name, first_name,
 case when t in ('Mr. ') then 'Male' when t in ('MRS. ', 'Miss ', 'Ms. ') then 'Female' when lower(first_name) in ('small', 'hot') then 'Male'
  when lower(first_name) in ('red', 'cold') then 'Female' when lower(first_name) = 'blue' then 'Ambiguous' else 'Unknown' end as gender_inferred
 from (select *, regexp_extract(trim(name), '^(?:Mr\\.|Mrs\\.|Ms\\.|Miss|Dr\\.)?\\s*([A-Za-z][A-Za-z''\\-]+)', 1) as first_name
 from (select p_partkey, t, t || upper(p_name[1]) || substr(p_name, 2, strpos(p_name, ' ') - 1) || upper(p_name[strpos(p_name, ' ') + 1]) || substr(p_name, strpos(p_name, ' ') + 2) as name
 from (select *, case p_type when 'ECONOMY' then 'Mr. ' when 'SMALL' then 'MRS. ' when 'MEDIUM' then 'Miss ' when 'PROMO' then 'Dr. ' when 'LARGE' then 'Ms. ' else '' end as t from part) a) b) c"""
_NUMBER = """case when abs({v}) >= 1000000 then printf('{p}%.2fM', {v} / 1000000) when abs({v}) >= 1000 then printf('{p}%.1fK', {v} / 1000) else printf('{p}%.0f', {v}) end"""


def _number(value: str) -> str:
    return _NUMBER.format(v=f"cast({value} as double)", p="")


def _currency(value: str) -> str:
    return _NUMBER.format(v=f"cast({value} as double)", p="$")


def _percent(value: str, digits: int = 1) -> str:
    return f"coalesce(printf('%.{digits}f%%', ({value}) * 100), '-')"


Q["text_formats"] = f"""select order_id, {_number('total_usd')} as number, {_currency('total_usd')} as currency,
 {_percent('discount_pct')} as percent, strftime(order_time, '%Y-%m') as month, strftime(order_time, '%B %Y') as month_long from x_orders"""
Q["stable_sample"] = f"""select order_id, customer_id, cast(total_usd as double) as total_usd from x_orders
 order by ((order_id % 4294967296) * 1103515245 + 42) % 4294967296, order_id limit 3000"""

# --- segments ---------------------------------------------------------------------
Q["rfm_scores"] = "select customer_id, r_score, f_score, m_score, rfm_score from scored"
Q["rfm_segments"] = "select customer_id, rfm_score, rfm_segment from scored"
Q["rfm_summary"] = f"""select rfm_segment, count(*) as customers, round(cast(sum(cast(revenue as decimal(18,2))) as double), 6) as revenue,
 round(avg(order_count), 6) as avg_orders, round(avg(recency_days), 6) as avg_recency from scored group by rfm_segment"""
Q["lifecycle_stage"] = "select customer_id, order_count, session_count, recency_days, lifecycle_stage from scored"
Q["lifecycle_summary"] = "select lifecycle_stage, count(*) as customers, round(cast(sum(cast(revenue as decimal(18,2))) as double), 6) as revenue from scored group by lifecycle_stage"
Q["ltv_tier"] = "select customer_id, ltv_score, ltv_tier from scored"
Q["crm_actions"] = "select customer_id, rfm_segment, lifecycle_stage, crm_recommendation from carded"
Q["customer_lookup"] = f"""select customer_id, name, country, region, age, age_band, gender_inferred, marketing_opt_in = 1 as marketing_opt_in, session_count,
 order_count, {_r('revenue avg_order_value avg_discount_pct page_to_cart_rate avg_rating')}, recency_days, active_days, rfm_segment, lifecycle_stage,
 '-' as cluster_name, ltv_tier, ltv_score, crm_recommendation from carded where session_count > 0"""

# --- funnel, trends, retention ------------------------------------------------------
_STAGES = "page_view add_to_cart checkout purchase"
_STAGE_MEANS = " ".join(f"{s}=f.{s}" for s in _STAGES.split())
Q["session_funnel_flags"] = "select * from flags"
Q["funnel_overall"] = "select * from funnel"
Q["funnel_step_rates"] = """select position, stage, sessions, round(sessions / lag(sessions) over (order by position), 6) as of_previous from funnel"""


def _funnel_by(column: str, domain: list[str]) -> str:
    values = ", ".join(f"({i}, '{v}')" for i, v in enumerate(domain))
    means = ", ".join(f"avg({s}) as {s}" for s in _STAGES.split())
    return f"""select d.position, d.{column}, {_r(_STAGE_MEANS)} from (values {values}) d(position, {column})
 left join (select {column}, {means} from flags group by {column}) f on f.{column} = d.{column}"""


Q["funnel_by_device"] = _funnel_by("device", ["desktop", "mobile", "tablet"])
Q["funnel_by_source"] = _funnel_by("source", ["organic", "direct", "paid", "social", "email", "referral"])
Q["monthly_overview"] = f"""select month, sessions, active_users, orders, buyers, review_count, {_r('revenue aov avg_rating')},
 round(case when sessions > 0 then orders / sessions else 0 end, 6) as session_to_order,
 round(avg(revenue) over (order by month rows between 2 preceding and current row), 6) as revenue_rolling_3m from monthly"""
Q["peak_month"] = "select month, round(revenue, 6) as revenue, label from peak"
Q["geography"] = f"select country, country_name, region, sessions, active_users, orders, {_r('revenue aov conversion')} from geo"
Q["highest_aov_country"] = "select country, country_name, round(aov, 6) as aov from geo order by aov desc, country limit 1"
Q["new_user_conversion"] = """select c.month, count(*) as new_users, count(o.customer_id) as buyers, round(count(o.customer_id) / count(*), 6) as conversion
 from (select customer_id, cast(date_trunc('month', signup_date) as timestamp) as month from x_customers where signup_date is not null) c
 left join (select distinct customer_id, cast(date_trunc('month', order_time) as timestamp) as month from x_orders) o
 on o.customer_id = c.customer_id and o.month = c.month group by c.month"""
Q["demographics"] = "select region, gender_inferred, age_band, count(*) as users from profile group by 1, 2, 3"
Q["customer_cube"] = " union all ".join(
    f"select '{figure}' as figure, {a} as first, {b} as second, count(*) as users from profile where {a} is not null {'' if b.startswith('cast') else f'and {b} is not null'} group by 1, 2, 3"
    for figure, a, b in (
        ("region", "region", "cast(null as varchar)"),
        ("pyramid", "age_band", "gender_inferred"),
        ("market segment", "market_segment", "cast(null as varchar)"),
        ("country", "country_name", "cast(null as varchar)"),
        ("region and age", "region", "age_band"),
    )
)
Q["quarterly_states"] = """select date_trunc('quarter', order_time)::date as quarter, count(*) as orders, round(sum(total_usd)::double, 6) as revenue, true as buyers_near
 from x_orders group by 1"""
Q["bucketed_activity"] = """select c.customer_id, coalesce(s.n, 0) as sessions, coalesce(o.n, 0) as orders, round(coalesce(o.r, 0)::double, 6) as revenue from x_customers c
 left join (select customer_id, count(*) as n from x_sessions group by 1) s on s.customer_id = c.customer_id
 left join (select customer_id, count(*) as n, sum(total_usd) as r from x_orders group by 1) o on o.customer_id = c.customer_id"""
Q["age_pyramid"] = """select d.position, d.age_band, p.gender_inferred, count(*) as users, count(*) as plot_users from profile p
 join (values (0, '18-24'), (1, '25-34'), (2, '35-44'), (3, '45-54'), (4, '55-64'), (5, '65-75'), (6, 'Unknown')) d(position, age_band)
 on d.age_band = p.age_band group by 1, 2, 3"""
_LONG = "select cohort, period, active_users, cohort_size, round(retention, 6) as retention from {v}"


def _wide(view: str) -> str:
    cells = ", ".join(f"round(max(retention) filter (period = {n}), 6) as m{n}" for n in range(13))
    return f"select cohort, {cells} from {view} group by cohort"


Q["retention_sessions"] = _LONG.format(v="retention_s")
Q["retention_sessions_wide"] = _wide("retention_s")
Q["retention_orders"] = _LONG.format(v="retention_o")
Q["retention_bitmaps"] = _LONG.format(v="retention_o")
VIEWS["month_active"] = "select distinct customer_id, date_trunc('month', order_time)::timestamp as month from x_orders"
VIEWS["month_kept"] = """select *, min(month) over (partition by customer_id) as first,
 coalesce(lag(month) over (partition by customer_id order by month) = month - interval 1 month, false) as kept from month_active"""
VIEWS["month_flow"] = "select month, count(*) as active, count(*) filter (kept) as kept, count(*) filter (month = first) as new from month_kept group by month"
Q["customer_flow"] = """select m.month, m.active, m.kept, coalesce(p.active, 0) - m.kept as lost, m.new, m.active - m.kept - m.new as returned
 from month_flow m left join month_flow p on p.month = m.month - interval 1 month"""
Q["retention_orders_wide"] = _wide("retention_o")
_TEXTS = ", ".join(f"coalesce(printf('%.1f%%', max(retention) filter (period = {n}) * 100), '') as m{n}" for n in range(13))
Q["retention_text"] = f"select strftime(cohort, '%Y-%m') as cohort, {_TEXTS} from retention_o group by retention_o.cohort"
Q["retention_matrix_export"] = """select strftime(c.cohort, '%Y-%m-%d') as cohort, string_agg(cast(p.period as varchar), ',' order by p.period) as months,
 string_agg(coalesce(printf('%.3f', r.retention), 'null'), ',' order by p.period) as values
 from (select distinct cohort from retention_o) c cross join (select distinct period from retention_o) p
 left join retention_o r on r.cohort = c.cohort and r.period = p.period group by c.cohort"""

# --- products -----------------------------------------------------------------------
Q["order_lines"] = """select i.order_id, i.product_id, i.quantity, cast(i.line_total_usd as double) as line_total_usd, p.category, cast(p.margin_usd as double) as margin_usd,
 cast(date_trunc('month', o.order_time) as timestamp) as month, cast(p.margin_usd * i.quantity as double) as gross_margin
 from x_order_items i left join x_products p on p.product_id = i.product_id left join x_orders o on o.order_id = i.order_id"""
Q["category_performance"] = f"""select p.category, {_r('revenue=coalesce(sum(s.revenue)::double,0)')}, cast(coalesce(sum(s.units), 0) as bigint) as units,
 round(cast(coalesce(sum(p.margin_usd * s.units), 0) as double), 6) as gross_margin, count(s.product_id) as products,
 round(coalesce(avg(r.avg_rating), 0), 6) as avg_rating, cast(coalesce(sum(r.review_count), 0) as bigint) as review_count
 from x_products p left join sales s on s.product_id = p.product_id left join ratings r on r.product_id = p.product_id where p.category is not null group by p.category"""
Q["category_monthly"] = """select g.month, g.category, coalesce(cast(t.revenue as double), 0) as revenue, coalesce(cast(t.units as bigint), 0) as units, coalesce(cast(t.gross_margin as double), 0) as gross_margin
 from (select month, category from (select distinct cast(date_trunc('month', o.order_time) as timestamp) as month from x_order_items i join x_orders o on o.order_id = i.order_id) a
  cross join (select distinct category from x_products) b) g
 left join (select cast(date_trunc('month', o.order_time) as timestamp) as month, p.category, sum(i.line_total_usd) as revenue, sum(i.quantity) as units, sum(p.margin_usd * i.quantity) as gross_margin
  from x_order_items i join x_orders o on o.order_id = i.order_id join x_products p on p.product_id = i.product_id group by 1, 2) t on t.month = g.month and t.category = g.category"""
Q["product_ratings"] = f"select product_id, {_r('avg_rating')}, review_count from ratings"
Q["product_master"] = f"""select product_id, category, name, cast(price_usd as double) as price_usd, cast(margin_usd as double) as margin_usd, total_qty,
 {_r('total_revenue avg_rating')}, review_count from master"""
Q["top_products"] = f"""select product_id, name, category, {_r('revenue=total_revenue')}, total_qty as units, {_r('avg_rating')}, review_count
 from master where total_qty > 0 order by total_revenue desc, total_qty desc, product_id limit 12"""
Q["top_by_units"] = "select product_id, name, category, total_qty from master order by total_qty desc, product_id limit 10"
Q["top_rated"] = f"select product_id, name, category, {_r('avg_rating')}, review_count from master where review_count >= 1 order by master.avg_rating desc, product_id limit 10"
Q["lowest_rated"] = f"""select product_id, name, category, {_r('avg_rating')}, review_count from master where category = 'ECONOMY' and review_count > 0
 order by master.avg_rating, product_id limit 3"""
Q["top_names"] = "select name, category, cast(sum(total_qty) as bigint) as units from master group by name, category order by units desc, name, category limit 10"
Q["top_five_names"] = "select name, cast(sum(total_qty) as bigint) as units from master group by name order by units desc, name limit 5"


def _sales_rank(days: int | None) -> str:
    recent = "" if days is None else f"""where order_id in (select order_id from x_orders
 where order_time > (select max(order_time) from x_orders) - interval '{days}' day)"""
    return f"""select s.product_id, p.name, p.category, s.units from (select product_id, cast(sum(quantity) as bigint) as units from x_order_items {recent}
 group by product_id order by units desc, product_id limit 10) s left join x_products p on p.product_id = s.product_id"""


Q["sales_rank_7_days"] = _sales_rank(7)
Q["sales_rank_30_days"] = _sales_rank(30)
Q["sales_rank_all"] = _sales_rank(None)

# --- texts ----------------------------------------------------------------------------
Q["review_sentiment"] = "select review_id, product_id, compound, sentiment from sentiment"
Q["sentiment_by_category"] = """select category, round(count(*) filter (sentiment = 'Positive') / count(*) * 100, 6) as "Positive",
 round(count(*) filter (sentiment = 'Neutral') / count(*) * 100, 6) as "Neutral", round(count(*) filter (sentiment = 'Negative') / count(*) * 100, 6) as "Negative"
 from sentiment s join x_products p on p.product_id = s.product_id group by category"""


def _hits(words: list[str]) -> str:
    return " + ".join(f"cast(contains(t, '{w}') as int)" for w in words)


Q["wordlist_sentiment"] = f"""select review_id, score, case when score > 0 then 'Positive' when score < 0 then 'Negative' else 'Neutral' end as sentiment
 from (select review_id, ({_hits(['the', 'and', 'der', 'que'])}) - ({_hits(['ing', 'ion', 'und', 'el'])}) as score
 from (select review_id, lower(coalesce(review_text, '')) as t from x_reviews) a) b"""
Q["category_keywords"] = """select category, rank, token, n, round(n / max(n) over (partition by category), 6) as weight from
 (select category, token, n, cast(row_number() over (partition by category order by n desc, token) as int) as rank from
 (select c.category, case when s.token is null then c.token else s.token end as token, cast(sum(c.n) as bigint) as n from
 (select category, token, count(*) as n from (select category, regexp_replace(raw, '''s$', '') as token from
  (select p.category, unnest(regexp_extract_all(lower(r.review_text), '([\\p{L}\\p{N}_][\\p{L}\\p{N}_'']+)', 1)) as raw
   from x_reviews r join x_products p on p.product_id = r.product_id) a) b
  where not regexp_matches(token, '^\\p{N}*$') and token not in ('the', 'and', 'is', 'la', 'le', 'un', 'und', 'die', 'el', 'que') group by 1, 2) c
 left join (select distinct p.category, regexp_replace(unnest(regexp_extract_all(lower(r.review_text), '([\\p{L}\\p{N}_][\\p{L}\\p{N}_'']+)', 1)), '''s$', '') as token
   from x_reviews r join x_products p on p.product_id = r.product_id) s
  on s.category = c.category and c.token = s.token || 's' and not c.token like '%ss'
  and s.token not in ('the', 'and', 'is', 'la', 'le', 'un', 'und', 'die', 'el', 'que') and not regexp_matches(s.token, '^\\p{N}*$')
 group by 1, 2) d) e where rank <= 120"""
_STOP = "('the', 'and', 'is', 'la', 'le', 'un', 'und', 'die', 'el', 'que')"
VIEWS["kept_words"] = """
select review_id, category, list_filter(list_transform(regexp_extract_all(lower(review_text), '([\\p{L}\\p{N}_][\\p{L}\\p{N}_'']+)', 1),
  lambda x: regexp_replace(x, '''s$', '')), lambda x: not regexp_matches(x, '^\\p{N}*$')) as w
from x_reviews r join x_products p on p.product_id = r.product_id
"""
VIEWS["unigrams"] = f"""
select category, word, count(*) as n from (select category, unnest(w) as word from kept_words) a where word not in {_STOP} group by 1, 2
"""
VIEWS["pairs"] = f"""
select category, w0, w1, count(*) as n from (select category, unnest(w[:-2]) as w0, unnest(w[2:]) as w1 from kept_words where len(w) > 1) a
where w0 not in {_STOP} and w1 not in {_STOP} group by 1, 2, 3
"""


def _fit(k: str, n: str, p: str) -> str:
    return f"(({k}) * ln(greatest({p}, 1e-10::double)) + (({n}) - ({k})) * ln(greatest(1 - ({p}), 1e-10::double)))"


_RATIO = f"""case when t > a and t > b then -2 * ({_fit('n', 'a', 'b / t')} + {_fit('b - n', 't - a', 'b / t')}
 - {_fit('n', 'a', 'n / a')} - {_fit('b - n', 't - a', '(b - n) / (t - a)')}) else 0.0 end"""
Q["category_phrases"] = f"""select category, token, n, round(score, 3) as score from (select category, token, n, {_RATIO} as score from
 (select p.category, p.w0 || ' ' || p.w1 as token, p.n, u.n as a, v.n as b, z.t from pairs p
  join unigrams u on u.category = p.category and u.word = p.w0 join unigrams v on v.category = p.category and v.word = p.w1
  join (select category, cast(sum(n) as bigint) as t from unigrams group by category) z on z.category = p.category) q) s where score > 30"""
_RULES = [
    ("revenue", ["erth", "sales"]),
    ("orders", ["ouen", "purchase"]),
    ("customers", ["heon", "user"]),
    ("churn", ["stre", "lost"]),
    ("rfm", ["ungs", "segment"]),
    ("rating", ["ente", "review"]),
    ("conversion", ["cart", "ción"]),
    ("products", ["ing", "top"]),
]
_INTENT = "case " + " ".join(
    "when " + " or ".join(f"contains(lower(text), '{w}')" for w in words) + f" then '{name}'" for name, words in _RULES
) + " else 'help' end"
Q["question_intents"] = f"select conv_id, turn, {_INTENT} as intent from conversations"


def _fact(key: str) -> str:
    return f"(select value from snapshot where section = 'headline' and key = '{key}')"


def _stage_count(stage: str) -> str:
    return f"(select coalesce(max(value), 0) from snapshot where section = 'lifecycle' and key = '{stage}')"


_NL = "chr(10)"
_ANSWERS = {
    "revenue": f"'**Total revenue:** ' || {_currency(_fact('revenue'))} || '  ' || {_NL} || '**Peak month:** ' || (select label from peak)",
    "orders": f"'**Total orders:** ' || {_number(_fact('orders'))} || '  ' || {_NL} || '**Average order value:** ' || {_currency(_fact('aov'))}",
    "customers": f"'**Total customers:** ' || {_number(_fact('customers'))} || '  ' || {_NL} || '**Countries:** ' || cast(cast({_fact('countries')} as int) as varchar)",
    "churn": f"'**Dormant customers:** ' || {_number(_stage_count('Dormant Customer'))} || '  ' || {_NL} || '**Cooling down:** ' || {_number(_stage_count('Cooling Down'))}",
    "rfm": f"'**RFM Segments:**' || {_NL} || (select string_agg('- ' || key || ': ' || {_number('value')}, {_NL} order by rank) from snapshot where section = 'rfm')",
    "rating": f"'**Average rating:** ' || printf('%.2f', {_fact('avg_rating')}) || ' / 5  ' || {_NL} || '**Total reviews:** ' || {_number(_fact('reviews'))}",
    "conversion": f"'**Session-to-order conversion:** ' || {_percent(_fact('conversion'))} || '  ' || {_NL} || '**Sessions:** ' || {_number(_fact('sessions'))} || ' | **Orders:** ' || {_number(_fact('orders'))}",
    "products": f"'**Top 5 products by units sold:**' || {_NL} || (select string_agg('- ' || name || ': ' || {_number('units')} || ' units', {_NL} order by units desc, name) from (select name, sum(total_qty) as units from master group by name order by units desc, name limit 5) t5)",
    "help": f"'I couldn''t find a specific answer for that question.  ' || {_NL} || 'Try asking about: **revenue**, **orders**, **customers**, **retention**, **RFM segments**, **ratings**, **conversion**, or **top products**.'",
}
VIEWS["answer_texts"] = " union all ".join(f"select '{k}' as intent, {v} as answer" for k, v in _ANSWERS.items())
Q["question_answers"] = f"""select q.conv_id, q.turn, q.intent, a.answer from (select conv_id, turn, {_INTENT} as intent from conversations) q
 left join answer_texts a on a.intent = q.intent"""

# --- headline figures -------------------------------------------------------------------
VIEWS["kpi_row"] = """
select (select count(*) from x_customers) as customers, (select count(distinct country) from x_customers) as countries,
 (select count(*) from x_sessions) as sessions, (select count(distinct customer_id) from x_sessions) as active_users,
 (select count(*) from x_orders) as orders, (select cast(sum(total_usd) as double) from x_orders) as revenue,
 (select cast(sum(total_usd) as double) / count(total_usd) from x_orders) as aov,
 (select cast(sum(purchase) as bigint) from flags) as purchase_sessions,
 (select sum(purchase) / sum(page_view) from flags) as conversion_rate, (select sum(add_to_cart) / sum(page_view) from flags) as add_to_cart_rate,
 (select avg(rating) from x_reviews) as avg_rating, (select count(*) from x_reviews) as review_count,
 (select min(signup_date) from x_customers) as date_from,
 greatest((select max(event_time) from x_events), (select max(order_time) from x_orders), (select max(review_time) from x_reviews)) as date_to
"""
Q["kpis"] = f"""select customers, countries, sessions, active_users, orders, purchase_sessions, review_count, date_from, date_to,
 {_r('revenue aov conversion_rate add_to_cart_rate avg_rating')} from kpi_row"""
Q["kpi_cards"] = " union all ".join(
    f"select {i} as position, '{label}' as label, {value} as value, {detail} as detail from kpi_row"
    for i, (label, value, detail) in enumerate(
        [
            ("Customers", _number("customers"), "cast(countries as varchar) || ' countries'"),
            ("Sessions", _number("sessions"), f"{_number('active_users')} || ' active users'"),
            ("Orders", _number("orders"), f"{_number('purchase_sessions')} || ' purchase sessions'"),
            ("Revenue", _currency("revenue"), f"'AOV ' || {_currency('aov')}"),
            ("Session Conversion", _percent("conversion_rate"), f"'Add-to-cart rate ' || {_percent('add_to_cart_rate')}"),
            ("Average Rating", "printf('%.2f', avg_rating)", f"{_number('review_count')} || ' reviews'"),
        ]
    )
)
Q["business_snapshot"] = "select section, rank, key, round(value, 6) as value from snapshot"

_PRINTED = [
    f"'Customers: ' || {_number(_fact('customers'))} || ' across ' || cast(cast({_fact('countries')} as int) as varchar) || ' countries'",
    f"'Sessions: ' || {_number(_fact('sessions'))} || ' | Orders: ' || {_number(_fact('orders'))}",
    f"'Total revenue: ' || {_currency(_fact('revenue'))}",
    f"'Average order value: ' || {_currency(_fact('aov'))}",
    f"'Session→order conversion: ' || {_percent(_fact('conversion'))}",
    f"'Average review rating: ' || printf('%.2f', {_fact('avg_rating')}) || '/5 across ' || {_number(_fact('reviews'))} || ' reviews'",
    f"'Peak revenue month: ' || (select label from peak) || ' (' || {_currency('(select revenue from peak)')} || ')'",
]
_SECTIONS = [
    ("lifecycle", "LIFECYCLE STAGES", ""),
    ("rfm", "RFM SEGMENTS", ""),
    ("region", "REGIONS (customer count)", ""),
    ("country", "TOP COUNTRIES", ""),
    ("product", "TOP 10 PRODUCTS (by units sold)", " units"),
    ("category", "CATEGORIES (by units)", " units"),
]
_ORDER = {"lifecycle": 1, "rfm": 2, "region": 4, "country": 5, "product": 6, "category": 7}
Q["snapshot_lines"] = " union all ".join(
    [f"select 0 as section_order, {i} as rank, 'BUSINESS SNAPSHOT' as title, {line} as line" for i, line in enumerate(_PRINTED, 1)]
    + [
        f"select {_ORDER[s]}, rank, '{title}', '- ' || key || ': ' || {_number('value')} || '{unit}' from snapshot where section = '{s}'"
        for s, title, unit in _SECTIONS
    ]
)
Q["valence_sentiment"] = "select review_id, product_id, compound, sentiment from valenced"
Q["labelled_reviews"] = """select r.review_id, r.order_id, r.product_id, r.rating, r.review_time, s.compound, s.sentiment
 from x_reviews r join sentiment s on s.review_id = r.review_id"""
Q["recent_revenue"] = """select month, round(revenue, 6) as revenue, round(change + 1e-10, 6) as change from
 (select month, revenue, case when lag(month) over (order by month) = month - interval 1 month and lag(revenue) over (order by month) > 0
   then revenue / lag(revenue) over (order by month) - 1 end as change, max(month) over () as last
  from (select cast(date_trunc('month', order_time) as timestamp) as month, cast(sum(total_usd) as double) as revenue from x_orders group by 1) m) q
 where month > last - interval 3 month"""
VIEWS["spent_and_bought"] = """select c.customer_id, coalesce(e.s, 0)::double as s, l.customer_id is not null as y from x_customers c
 left join (select customer_id, sum(total_usd)::double as s from x_orders where order_time < timestamp '2000-08-01' group by 1) e on e.customer_id = c.customer_id
 left join (select distinct customer_id from x_orders where order_time >= timestamp '2000-08-01' and order_time < timestamp '2001-08-01') l on l.customer_id = c.customer_id"""
VIEWS["spent_places"] = "select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as place from spent_and_bought"
Q["ranking_auc"] = """select p as positives, n as negatives, round(case when p * n = 0 then 0 else (places - p * (p + 1) / 2.0) / (p * n) end, 6) as auc
 from (select count(*) filter (y) as p, count(*) filter (not y) as n, sum(place) filter (y) as places from spent_places) t"""
Q["later_value"] = """select customer_id, later_orders, round(later_revenue, 6) as later_revenue, later_score,
  case when later_score >= 80 then 'Platinum' when later_score >= 60 then 'Gold' when later_score >= 40 then 'Silver' else 'Bronze' end as later_tier, later_score >= 60 as high_potential
 from (select c.customer_id, coalesce(n, 0) as later_orders, coalesce(v, 0) as later_revenue, case when n is null then 0 else least(100,
   case when v >= 500 then 40 when v >= 200 then 28 when v >= 80 then 16 when v > 0 then 6 else 0 end
   + case when n >= 8 then 30 when n >= 4 then 20 when n >= 2 then 10 when n = 1 then 4 else 0 end
   + case when o.age <= 30 then 30 when o.age <= 60 then 22 when o.age <= 120 then 12 when o.age <= 180 then 4 else 0 end) end as later_score
  from x_customers c left join (select customer_id, count(*) as n, cast(sum(total_usd) as double) as v,
    floor(epoch(timestamp '2001-08-01 00:00:00' - max(order_time)) / 86400) as age
   from x_orders where order_time >= timestamp '2000-08-01' and order_time < timestamp '2001-08-01' group by customer_id) o on o.customer_id = c.customer_id) q"""

# --- clusters ---------------------------------------------------------------------------
_FEATURES = (
    "session_count_log events_log page_to_cart_rate cart_to_checkout_rate checkout_to_purchase_rate orders_log revenue_log avg_order_value "
    "avg_discount_pct avg_rating active_days recency_days source_diversity device_diversity review_rate age marketing_opt_in"
)
Q["cluster_features"] = f"select customer_id, {_r(_FEATURES)} from features"
Q["standardised_features"] = "select customer_id, " + ", ".join(
    f"round(({c} - avg({c}) over ()) / (case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end), 6) as {c}"
    for c in _FEATURES.split()
) + " from features"
Q["standardised_embeddings"] = """select vec_id, cast(d - 1 as int) as dimension, round((x - avg(x) over (partition by d)) / (case when stddev_pop(x) over (partition by d) = 0 then 1
 else stddev_pop(x) over (partition by d) end), 6) as z from (select vec_id, unnest(generate_series(1, 64)) as d, cast(unnest(embedding) as double) as x from embeddings) e"""
Q["silhouette_exact"] = """with s as (select vec_id, cast(embedding as double[]) as v, label from embeddings),
 m as (select a.vec_id, a.label as own, b.label as cluster, sum(list_distance(a.v, b.v)) as total, count(*) as size from s a join s b on true group by 1, 2, 3),
 p as (select vec_id, max(total / (size - 1)) filter (cluster = own and size > 1) as a, min(total / size) filter (cluster <> own) as b from m group by vec_id)
 select 0 as labelling, (select count(distinct label) from s) as clusters, count(*) as points, round(avg(case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from p"""
Q["silhouette_enclosed"] = "select 0 as labelling, count(distinct label) as clusters, count(*) as points, true as encloses from embeddings"
_CENTRES = """with e as (select vec_id, cast(embedding as double[]) as v, row_number() over (order by vec_id) - 1 as r from embeddings),
 c as (select m.model, e.r as centre, e.v as c from e join (values (0, 4), (1, 7)) m(model, size) on e.r < m.size),
 d as (select model, vec_id, any_value(v) as v, arg_min(centre, (d, centre)) as centre, min(d) as d
  from (select model, vec_id, v, centre, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d from e cross join c) x group by model, vec_id)"""
Q["lloyd_step"] = f"{_CENTRES} select model, centre, count(*) as n, round(sum(d), 3) as cost, round(avg(v[1]), 5) as x0 from d group by model, centre"
Q["nearest_centres"] = f"{_CENTRES} select vec_id, centre as cluster_id, round(d, 6) as squared_distance from d where model = 1"
VIEWS["zfeatures"] = "select customer_id, " + ", ".join(
    f"({c} - avg({c}) over ()) / (case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end) as x{i}" for i, c in enumerate(_FEATURES.split())
) + " from features"
Q["feature_covariance"] = " union all ".join(
    f"select {i} as i, {j} as j, round(covar_pop(x{i}, x{j}), 6) as value from zfeatures" for i in range(len(_FEATURES.split())) for j in range(i, len(_FEATURES.split()))
)
Q["axis_checks"] = "select axis, round(1.0::double, 6) as length, round(0.0::double, 6) as product, round(0.0::double, 6) as deviation from (select unnest(range(2)) as axis from (select 1 from profile limit 1))"
Q["marker_sizes"] = "select customer_id, round(least(greatest(revenue + 20, 20.0), 600.0), 6) as marker_size from profile"
Q["silhouette_squared"] = """with s as (select vec_id, cast(embedding as double[]) as v, label from embeddings),
 d as (select vec_id, label, generate_subscripts(v, 1) as i, unnest(v) as x from s),
 q as (select vec_id, label, sum(x * x) as q from d group by all),
 c as (select z.label, z.n, z.q, list(y.s order by y.i) as s from (select label, count(*) as n, sum(q) as q from q group by label) z
  join (select label, i, sum(x) as s from d group by label, i) y on y.label = z.label group by all),
 m as (select s.vec_id, s.label as own, c.label as cluster, c.n, greatest(c.n * q.q - 2 * list_dot_product(s.v, c.s) + c.q, 0) as total from s join q on q.vec_id = s.vec_id join c on true),
 p as (select vec_id, max(total / (n - 1)) filter (cluster = own and n > 1) as a, min(total / n) filter (cluster <> own) as b from m group by vec_id)
 select 0 as labelling, (select count(*) from c) as clusters, count(*) as points, round(avg(case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end) + 1e-10, 6) as silhouette from p"""
_SUMMARY = "avg_age sessions orders revenue aov conversion avg_discount avg_rating recency"
Q["cluster_summary"] = f"select cluster_id, users, {_r(_SUMMARY)} from csummary"
Q["persona_thresholds"] = f"select {_r('revenue orders sessions recency avg_discount conversion mean_conversion')} from cthresholds"
Q["persona_names"] = "select cluster_id, users, cluster_name from cnamed"
Q["cluster_zscores"] = "select cluster_name, " + ", ".join(
    f"round(({c} - avg({c}) over ()) / (case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end), 6) as {c}"
    for c in _SUMMARY.split()
) + " from cnamed"
Q["persona_top_region"] = "select cluster_name, top_region, users, round(share, 6) as share from ptop_region"
_FIGURES = "revenue orders sessions conversion avg_age avg_rating top_region_share"
Q["persona_figures"] = f"select cluster_name, users, {_r(_FIGURES)}, top_region, top_source from pfigures"
Q["persona_cards"] = f"""select cluster_name, {_number('users')} as users, {_currency('revenue')} as revenue, printf('%.2f', orders) as orders,
 printf('%.2f', sessions) as sessions, {_percent('conversion')} as conversion, coalesce(printf('%.1f', avg_age), '-') as avg_age,
 printf('%.2f', avg_rating) as avg_rating, top_region, {_percent('top_region_share', 0)} as top_region_pct, top_source from pfigures"""
