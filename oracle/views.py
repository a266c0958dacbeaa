"""Named SQL views the statements build on: the adapter, then shared results."""

VIEWS: dict[str, str] = {}

# --- test tables as the retail data model --------------------------------------

VIEWS["x_customers"] = """
select c.c_custkey as customer_id, c.c_name as name, n.n_name as country, r.r_name as region,
 cast(10 + (c.c_custkey * 37) % 70 as double) as age, o.first_order as signup_date,
 c.c_acctbal > 5000 as marketing_opt_in, c.c_mktsegment as market_segment
from customer c left join nation n on c.c_nationkey = n.n_nationkey left join region r on n.n_regionkey = r.r_regionkey
left join (select o_custkey, min(o_orderdate) as first_order from orders group by o_custkey) o on o.o_custkey = c.c_custkey
"""

VIEWS["x_events"] = """
select event_id, user_id, min(event_id) over (partition by user_id, grp) as session_id, ts as event_time,
 case event_type when 'view' then 'page_view' when 'click' then 'add_to_cart' when 'signup' then 'checkout' else event_type end as event_type,
 k, case when event_type = 'click' then 1 + k % 5 end as qty, cast(k % 10 as int) as cart_size, value as amount_usd
from (select *, sum(is_new) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as grp
 from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
  case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '12' hour then 0 else 1 end as is_new from events) a) b
"""

VIEWS["x_sessions"] = """
select s.session_id, s.user_id as customer_id, s.start_time,
 case e.k % 3 when 0 then 'desktop' when 1 then 'mobile' else 'tablet' end as device,
 case cast(floor(e.k / 3.0) as int) % 6 when 0 then 'organic' when 1 then 'direct' when 2 then 'paid' when 3 then 'social' when 4 then 'email' else 'referral' end as source,
 c.country
from (select session_id, user_id, min(event_time) as start_time from x_events group by session_id, user_id) s
join x_events e on e.event_id = s.session_id left join x_customers c on c.customer_id = s.user_id
"""

VIEWS["x_orders"] = """
select o.o_orderkey as order_id, o.o_custkey as customer_id, o.o_orderdate as order_time, o.o_orderpriority as payment_method,
 l.disc as discount_pct, l.sub as subtotal_usd, cast(o.o_totalprice as decimal(18,2)) as total_usd, c.country
from orders o left join (select l_orderkey, cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) as disc,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as sub from lineitem group by l_orderkey) l
on l.l_orderkey = o.o_orderkey left join x_customers c on c.customer_id = o.o_custkey
"""

VIEWS["x_order_items"] = """
select l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as int) as quantity,
 cast(l_extendedprice as decimal(18,2)) as line_total_usd from lineitem
"""

VIEWS["x_products"] = """
select p_partkey as product_id, p_type as category, p_name as name, cast(p_retailprice as decimal(18,2)) as price_usd,
 cast(cast(p_retailprice as decimal(18,2)) * 0.25 as decimal(18,2)) as margin_usd from part
"""

VIEWS["x_reviews"] = """
select d.doc_id as review_id, o.o_orderkey as order_id, (d.doc_id * 7) % (select count(*) from part) as product_id,
 cast(1 + d.n_chars % 5 as int) as rating, d.text as review_text, o.o_orderdate + (d.doc_id % 45) * interval '1' day as review_time
from documents d join orders o on o.o_orderkey = (d.doc_id * 13) % (select count(*) from orders)
"""

# --- customer summaries ----------------------------------------------------------

VIEWS["session_summary"] = """
select customer_id, count(session_id) as session_count, min(start_time) as first_session, max(start_time) as last_session,
 count(distinct source) as source_diversity, count(distinct device) as device_diversity
from x_sessions group by customer_id
"""

VIEWS["dominant"] = """
select coalesce(a.customer_id, b.customer_id) as customer_id, a.v as dominant_source, b.v as dominant_device from
(select customer_id, v from (select customer_id, source as v, row_number() over (partition by customer_id order by count(*) desc, source) as rn
  from x_sessions group by customer_id, source) where rn = 1) a
full join
(select customer_id, v from (select customer_id, device as v, row_number() over (partition by customer_id order by count(*) desc, device) as rn
  from x_sessions group by customer_id, device) where rn = 1) b on a.customer_id = b.customer_id
"""

VIEWS["event_user"] = """
select e.event_id, e.session_id, s.customer_id, e.event_type, e.qty, e.cart_size
from x_events e left join x_sessions s on e.session_id = s.session_id
"""

VIEWS["event_counts"] = """
select customer_id, count(*) filter (event_type = 'page_view') as page_views,
 count(*) filter (event_type = 'add_to_cart') as add_to_cart_events,
 count(*) filter (event_type = 'checkout') as checkout_events,
 count(*) filter (event_type = 'purchase') as purchase_events
from event_user where customer_id is not null group by customer_id
"""

VIEWS["event_volume"] = """
select customer_id, count(event_id) as total_events, cast(coalesce(sum(qty), 0) as bigint) as total_qty, avg(cart_size) as mean_cart_size
from event_user where customer_id is not null group by customer_id
"""

VIEWS["order_summary"] = """
select customer_id, count(order_id) as order_count, cast(sum(total_usd) as double) as revenue,
 cast(sum(total_usd) as double) / count(total_usd) as avg_order_value, min(order_time) as first_order, max(order_time) as last_order,
 cast(sum(subtotal_usd) as double) as subtotal, cast(sum(cast(discount_pct as decimal(28,12))) as double) / count(discount_pct) as avg_discount_pct
from x_orders group by customer_id
"""

VIEWS["review_summary"] = """
select o.customer_id, count(r.review_id) as review_count, avg(r.rating) as avg_rating
from x_reviews r join x_orders o on r.order_id = o.order_id group by o.customer_id
"""

_PROFILE = """
select * exclude (span, since), case when span + 1 < 0 then 0 else span + 1 end as active_days, case when since < 0 then 0 else since end as recency_days from (
select c.customer_id, c.name, c.country, c.country as country_name, coalesce(c.region, 'Other') as region, c.age, c.signup_date,
 cast(c.marketing_opt_in as int) as marketing_opt_in, c.market_segment, 'Unknown' as gender_inferred,
 case when c.age > 17 and c.age <= 24 then '18-24' when c.age > 24 and c.age <= 34 then '25-34' when c.age > 34 and c.age <= 44 then '35-44'
  when c.age > 44 and c.age <= 54 then '45-54' when c.age > 54 and c.age <= 64 then '55-64' when c.age > 64 and c.age <= 75 then '65-75' else 'Unknown' end as age_band,
 coalesce(s.session_count, 0) as session_count, s.first_session, s.last_session,
 coalesce(s.source_diversity, 0) as source_diversity, coalesce(s.device_diversity, 0) as device_diversity,
 coalesce(d.dominant_source, 'No Session') as dominant_source, coalesce(d.dominant_device, 'No Session') as dominant_device,
 coalesce(e.page_views, 0) as page_views, coalesce(e.add_to_cart_events, 0) as add_to_cart_events,
 coalesce(e.checkout_events, 0) as checkout_events, coalesce(e.purchase_events, 0) as purchase_events,
 coalesce(v.total_events, 0) as total_events, coalesce(v.total_qty, 0) as total_qty, coalesce(v.mean_cart_size, 0) as mean_cart_size,
 coalesce(o.order_count, 0) as order_count, coalesce(o.revenue, 0) as revenue, coalesce(o.subtotal, 0) as subtotal,
 coalesce(o.avg_order_value, 0) as avg_order_value, coalesce(o.avg_discount_pct, 0) as avg_discount_pct, o.first_order, o.last_order,
 coalesce(r.review_count, 0) as review_count, coalesce(r.avg_rating, 0) as avg_rating,
 cast(floor((epoch_us(coalesce(s.last_session, c.signup_date)) - epoch_us(coalesce(s.first_session, c.signup_date))) / 86400000000) as int) as span,
 cast(floor((epoch_us(@now) - epoch_us(coalesce(@seen, c.signup_date))) / 86400000000) as int) as since,
 case when coalesce(s.session_count, 0) > 0 then coalesce(o.order_count, 0) / s.session_count else 0.0 end as session_to_order_rate,
 case when e.page_views > 0 then e.add_to_cart_events / e.page_views else 0.0 end as page_to_cart_rate,
 case when e.add_to_cart_events > 0 then e.checkout_events / e.add_to_cart_events else 0.0 end as cart_to_checkout_rate,
 case when e.checkout_events > 0 then e.purchase_events / e.checkout_events else 0.0 end as checkout_to_purchase_rate,
 case when o.order_count > 0 then coalesce(r.review_count, 0) / o.order_count else 0.0 end as review_rate,
 case when s.session_count > 0 then coalesce(o.revenue, 0) / s.session_count else 0.0 end as revenue_per_session
from x_customers c left join session_summary s on s.customer_id = c.customer_id left join dominant d on d.customer_id = c.customer_id
left join event_counts e on e.customer_id = c.customer_id left join event_volume v on v.customer_id = c.customer_id
left join order_summary o on o.customer_id = c.customer_id left join review_summary r on r.customer_id = c.customer_id) wide
"""
_LATEST = "(select greatest((select max(event_time) from x_events), (select max(order_time) from x_orders), (select max(start_time) from x_sessions)))"

# recency since the last session, at the latest moment of all
VIEWS["profile_s"] = _PROFILE.replace("@now", _LATEST).replace("@seen", "s.last_session")
# recency since the last order, at the last order of all
VIEWS["profile"] = _PROFILE.replace("@now", "(select max(order_time) from x_orders)").replace("@seen", "o.last_order")

VIEWS["scored"] = """
select *, cast(r_score as varchar) || cast(f_score as varchar) || cast(m_score as varchar) as rfm_score,
 case when r_score >= 4 and f_score >= 4 and m_score >= 4 then 'Champions' when r_score >= 4 and f_score >= 3 then 'Loyal Customers'
  when r_score <= 2 and f_score >= 4 then 'At-Risk High Value' when r_score <= 2 and f_score <= 2 and m_score <= 2 then 'Lost Low Value'
  when f_score <= 2 and m_score <= 2 then 'Price / Casual Shoppers' else 'Potential Loyalists' end as rfm_segment,
 case when order_count = 0 and recency_days <= 30 then 'New Visitor' when order_count = 0 and session_count > 0 then 'Browsing Prospect'
  when order_count = 1 and recency_days <= 45 then 'New Buyer' when order_count >= 2 and recency_days <= 60 then 'Active Repeat Buyer'
  when order_count >= 1 and recency_days > 60 and recency_days <= 120 then 'Cooling Down'
  when order_count >= 1 and recency_days > 120 then 'Dormant Customer' else 'Unclassified' end as lifecycle_stage,
 case when ltv_score >= 80 then 'Platinum' when ltv_score >= 60 then 'Gold' when ltv_score >= 40 then 'Silver' else 'Bronze' end as ltv_tier
from (select *,
  cast(greatest(1, ((row_number() over (order by coalesce(recency_days, (select median(recency_days) from profile)) desc, customer_id) - 1) * 5 + count(*) over () - 2) // (count(*) over () - 1)) as int) as r_score,
  cast(greatest(1, ((row_number() over (order by order_count, customer_id) - 1) * 5 + count(*) over () - 2) // (count(*) over () - 1)) as int) as f_score,
  cast(greatest(1, ((row_number() over (order by revenue, customer_id) - 1) * 5 + count(*) over () - 2) // (count(*) over () - 1)) as int) as m_score,
  least(100, case when revenue >= 500 then 40 when revenue >= 200 then 28 when revenue >= 80 then 16 when revenue > 0 then 6 else 0 end
   + case when order_count >= 8 then 30 when order_count >= 4 then 20 when order_count >= 2 then 10 when order_count = 1 then 4 else 0 end
   + case when recency_days <= 30 then 30 when recency_days <= 60 then 22 when recency_days <= 120 then 12 when recency_days <= 180 then 4 else 0 end) as ltv_score
 from profile) p
"""

_CRM = {
    "New Visitor": "Send a welcome email with a first-order discount code (10–15%).",
    "Browsing Prospect": "Push a limited-time offer on browsed products; highlight top-rated items.",
    "New Buyer": "Send a product guide + cross-sell recommendations 3 days after purchase.",
    "Active Repeat Buyer": "Invite to loyalty programme / points rewards; offer early access to new arrivals.",
    "Cooling Down": "Send a win-back email ('We miss you') with a personalised exclusive discount.",
    "Dormant Customer": "High-value: direct outreach with premium incentive. Low-value: low-cost EDM re-engagement.",
    "Champions": "Invite to VIP events; offer first access to new collections and limited editions.",
    "At-Risk High Value": "Urgent win-back: targeted discount + proactive customer-service contact.",
    "Lost Low Value": "Low-cost EDM only; A/B test reactivation creative.",
}
_cases = " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in _CRM.items())
VIEWS["carded"] = f"""
select *, case case when rfm_segment in ('Champions', 'At-Risk High Value', 'Lost Low Value') then rfm_segment else lifecycle_stage end
 {_cases} else 'Monitor and re-evaluate in 30 days.' end as crm_recommendation from scored
"""

# --- funnel, products, texts -------------------------------------------------------

VIEWS["flags"] = """
select s.session_id, s.device, s.source, coalesce(f.page_view, 0) as page_view, coalesce(f.add_to_cart, 0) as add_to_cart,
 coalesce(f.checkout, 0) as checkout, coalesce(f.purchase, 0) as purchase
from x_sessions s left join (select session_id, max(cast(event_type = 'page_view' as int)) as page_view,
  max(cast(event_type = 'add_to_cart' as int)) as add_to_cart, max(cast(event_type = 'checkout' as int)) as checkout,
  max(cast(event_type = 'purchase' as int)) as purchase from x_events group by session_id) f on f.session_id = s.session_id
"""

VIEWS["funnel"] = """
select 0 as position, 'page_view' as stage, cast(sum(page_view) as bigint) as sessions from flags
union all select 1, 'add_to_cart', cast(sum(add_to_cart) as bigint) from flags
union all select 2, 'checkout', cast(sum(checkout) as bigint) from flags
union all select 3, 'purchase', cast(sum(purchase) as bigint) from flags
"""

VIEWS["sales"] = """
select product_id, cast(sum(quantity) as bigint) as units, sum(line_total_usd) as revenue from x_order_items group by product_id
"""

VIEWS["ratings"] = """
select product_id, avg(rating) as avg_rating, count(review_id) as review_count from x_reviews group by product_id
"""

VIEWS["master"] = """
select p.product_id, p.category, p.name, p.price_usd, p.margin_usd, coalesce(s.units, 0) as total_qty, cast(coalesce(s.revenue, 0) as double) as total_revenue,
 coalesce(r.avg_rating, 0) as avg_rating, coalesce(r.review_count, 0) as review_count
from x_products p left join sales s on s.product_id = p.product_id left join ratings r on r.product_id = p.product_id
"""

VIEWS["monthly"] = """
select coalesce(s.month, o.month) as month, coalesce(s.sessions, 0) as sessions, coalesce(s.active_users, 0) as active_users,
 coalesce(o.orders, 0) as orders, coalesce(o.revenue, 0) as revenue, coalesce(o.aov, 0) as aov, coalesce(o.buyers, 0) as buyers,
 coalesce(r.avg_rating, 0) as avg_rating, coalesce(r.review_count, 0) as review_count
from (select cast(date_trunc('month', start_time) as timestamp) as month, count(*) as sessions, count(distinct customer_id) as active_users from x_sessions group by 1) s
full join (select cast(date_trunc('month', order_time) as timestamp) as month, count(*) as orders, cast(sum(total_usd) as double) as revenue,
  cast(sum(total_usd) as double) / count(*) as aov, count(distinct customer_id) as buyers from x_orders group by 1) o on s.month = o.month
left join (select cast(date_trunc('month', review_time) as timestamp) as month, avg(rating) as avg_rating, count(*) as review_count from x_reviews group by 1) r
 on r.month = coalesce(s.month, o.month)
"""

VIEWS["geo"] = """
select coalesce(s.country, o.country) as country, coalesce(s.country, o.country) as country_name, coalesce(r.r_name, 'Other') as region,
 coalesce(s.sessions, 0) as sessions, coalesce(s.active_users, 0) as active_users, coalesce(o.orders, 0) as orders,
 coalesce(o.revenue, 0) as revenue, coalesce(o.aov, 0) as aov,
 case when s.sessions > 0 then coalesce(o.orders, 0) / s.sessions else 0.0 end as conversion
from (select country, count(*) as sessions, count(distinct customer_id) as active_users from x_sessions where country is not null group by country) s
full join (select country, count(*) as orders, cast(sum(total_usd) as double) as revenue, cast(sum(total_usd) as double) / count(*) as aov
  from x_orders where country is not null group by country) o on s.country = o.country
left join nation n on n.n_name = coalesce(s.country, o.country) left join region r on r.r_regionkey = n.n_regionkey
"""

VIEWS["retention_o"] = """
select a.cohort, a.period, a.active_users, z.cohort_size, a.active_users / z.cohort_size as retention from
(select cohort, (year(m) - year(cohort)) * 12 + month(m) - month(cohort) as period, count(*) as active_users from
 (select distinct c.customer_id, cast(date_trunc('month', c.signup_date) as timestamp) as cohort, cast(date_trunc('month', o.order_time) as timestamp) as m
  from x_customers c join x_orders o on o.customer_id = c.customer_id) x group by 1, 2) a
join (select cast(date_trunc('month', signup_date) as timestamp) as cohort, count(*) as cohort_size from x_customers group by 1) z on z.cohort = a.cohort
where a.period between 0 and 12
"""

VIEWS["retention_s"] = """
select a.cohort, a.period, a.active_users, z.cohort_size, a.active_users / z.cohort_size as retention from
(select cohort, cast(date_diff('day', cohort, w) // 7 as int) as period, count(*) as active_users from weeks group by 1, 2) a
join (select cohort, count(distinct customer_id) as cohort_size from weeks group by 1) z on z.cohort = a.cohort
where a.period between 0 and 12
"""

VIEWS["weeks"] = """
select customer_id, w, min(w) over (partition by customer_id) as cohort
from (select distinct customer_id, cast(date_trunc('week', start_time) as timestamp) as w from x_sessions) x
"""

# Only the words of the lexicon, each with the three before it.
VIEWS["words"] = """
select review_id, product_id, h.w as w, h.b1 as b1, h.b2 as b2, h.b3 as b3 from
(select review_id, product_id, unnest([{'w': ws[i], 'b1': case when i > 1 then ws[i - 1] end, 'b2': case when i > 2 then ws[i - 2] end, 'b3': case when i > 3 then ws[i - 3] end}
  for i in range(1, len(ws) + 1) if ws[i] in ('the', 'and', 'of', 'der', 'und', 'la', 'que', 'el')]) as h
from (select review_id, product_id, [case when length(trim(x, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')) > 2 then trim(x, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~') else x end
  for x in regexp_split_to_array(lower(coalesce(review_text, '')), '\\s+')] as ws from x_reviews) t) u
"""

VIEWS["lexicon"] = """
select * from (values ('the', 0.3::double), ('and', -0.2), ('of', 1.1), ('der', -0.6), ('und', 0.9), ('la', 0.7), ('que', -1.4), ('el', 0.4)) t(token, v0)
"""


def _look_back(value: str, n: int, damping: float) -> str:
    step = f"(case when b{n} in ('is', 'die') then 0.293::double * {damping} when b{n} = 'on' then -0.293::double * {damping} else 0.0 end)"
    flip = f"(case when b{n} in ('in', 'un') then -0.74::double else 1.0 end)"
    return f"(({value}) + (case when v0 < 0 then -1 else 1 end) * {step}) * {flip}"


_VALUE = _look_back(_look_back(_look_back("v0", 1, 1.0), 2, 0.95), 3, 0.9)
VIEWS["sentiment"] = f"""
select review_id, product_id, compound, case when compound >= 0.05 then 'Positive' when compound <= -0.05 then 'Negative' else 'Neutral' end as sentiment
from (select r.review_id, r.product_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 4) as compound
 from x_reviews r left join (select review_id, sum({_VALUE}) as s from words join lexicon on w = token group by review_id) h on h.review_id = r.review_id) q
"""

# All rules: every hit with its neighbours, its place, the text's first contrast word and whether the text is partly in capitals.
_BARE = "case when length(trim({x}, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~')) > 2 then trim({x}, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~') else {x} end"
VIEWS["wordy"] = f"""
select review_id, product_id, t, ws, ks, [{_BARE.format(x="x")} for x in ws] as bs, list_position([k in ('die', 'is') for k in ks], true) as turn,
 len([x for x in ws if x = upper(x) and x <> lower(x)]) > 0 and len([x for x in ws if x = upper(x) and x <> lower(x)]) < len(ws) as mixed
from (select review_id, product_id, t, ws, [{_BARE.format(x="lower(x)")} for x in ws] as ks
 from (select review_id, product_id, coalesce(review_text, '') as t, regexp_split_to_array(coalesce(review_text, ''), '\\s+') as ws from x_reviews) a) b
"""
VIEWS["struck"] = """
select review_id, i, turn, mixed, ks[i] as k, bs[i] as w, case when i > 1 then ks[i - 1] end as b1, case when i > 2 then ks[i - 2] end as b2, case when i > 3 then ks[i - 3] end as b3,
 case when i > 1 then bs[i - 1] end as w1, case when i > 2 then bs[i - 2] end as w2, case when i > 3 then bs[i - 3] end as w3, ks[i + 1] as n1, ks[i + 2] as n2
from (select review_id, turn, mixed, ks, bs, unnest([i for i in range(1, len(ks) + 1) if ks[i] in ('the', 'and', 'of', 'der', 'und', 'la', 'que', 'el')]) as i from wordy) a
"""


def _nearer(value: str, n: int, damping: float) -> str:
    loud = f"case when w{n} = upper(w{n}) and w{n} <> lower(w{n}) and mixed then 0.733 else 0.0 end"
    step = f"(case when b{n} in ('is', 'die') then 0.293::double + {loud} when b{n} = 'on' then -0.293::double + {loud} else 0.0 end)"
    between = " or ".join(f"coalesce(b{m} in ({{0}}), false)" for m in range(1, n)) or "false"
    flip = f"""(case when b{n} = 'un' and ({between.format("'le', 'die'")}) then 1.5::double when b{n} = 'in' and ({between.format("'is'")}) then 1.0 when b{n} in ('in', 'un') then -0.74 else 1.0 end)"""
    return f"(({value}) + (case when v0 < 0 then -1 else 1 end) * {step} * {damping}) * {flip}"


_LOUD = "v0 + case when w = upper(w) and w <> lower(w) and mixed then (case when v0 < 0 then -1 else 1 end) * 0.733::double else 0.0 end"
_LEAST = "(case when b1 = 'les' and coalesce(b2, '') <> 'un' then -0.74::double else 1.0 end)"
_SPANS = ["b3 b2 b1 k", "b2 b1 k n1", "b1 k n1 n2", "b2 b1 k", "b1 k n1", "k n1 n2", "b1 k", "k n1"]
_IDIOM = "coalesce(" + ", ".join(
    "case " + " || ' ' || ".join(span.split()) + " " + " ".join(f"when '{p}' then {v}::double" for p, v in (("of the", 2.5), ("the and", -1.0), ("der und", 1.2), ("la que el", 0.6), ("is the of", -2.0))) + " end"
    for span in _SPANS
)
_RICH = f"{_IDIOM}, ({_nearer(_nearer(_nearer(_LOUD, 1, 1.0), 2, 0.95), 3, 0.9)}) * {_LEAST}) * (case when i < turn then 0.5 when i > turn then 1.5 else 1.0 end)"
VIEWS["valenced"] = f"""
select review_id, product_id, compound, case when compound >= 0.05 then 'Positive' when compound <= -0.05 then 'Negative' else 'Neutral' end as sentiment
from (select review_id, product_id, round(s / sqrt(s * s + 15), 4) as compound
 from (select r.review_id, r.product_id, coalesce(h.s, 0) + sign(coalesce(h.s, 0)) * (least(length(t) - length(replace(t, '!', '')), 4) * 0.292::double
   + case when length(t) - length(replace(t, '?', '')) > 3 then 0.96::double when length(t) - length(replace(t, '?', '')) > 1 then (length(t) - length(replace(t, '?', ''))) * 0.18::double else 0.0 end) as s
  from wordy r left join (select review_id, sum({_RICH}) as s from struck join lexicon on k = token group by review_id) h on h.review_id = r.review_id) q) q2
"""

# --- clusters: the market segment as the given cluster --------------------------------

VIEWS["clustered"] = """
select *, case market_segment when 'AUTOMOBILE' then 0 when 'BUILDING' then 1 when 'FURNITURE' then 2 when 'HOUSEHOLD' then 3 when 'MACHINERY' then 4 end as cluster_id from profile
"""

def _mean(column: str) -> str:
    """The same in whatever order the rows are added."""
    return f"cast(sum(cast({column} as decimal(28,12))) as double) / count({column})"


VIEWS["csummary"] = f"""
select cluster_id, count(*) as users, {_mean("age")} as avg_age, {_mean("session_count")} as sessions, {_mean("order_count")} as orders, {_mean("revenue")} as revenue,
 {_mean("avg_order_value")} as aov, {_mean("session_to_order_rate")} as conversion, {_mean("avg_discount_pct")} as avg_discount, {_mean("avg_rating")} as avg_rating,
 {_mean("recency_days")} as recency
from clustered group by cluster_id
"""

VIEWS["cthresholds"] = f"""
select quantile_cont(revenue, 0.75) as revenue, quantile_cont(orders, 0.75) as orders, quantile_cont(sessions, 0.75) as sessions,
 quantile_cont(recency, 0.75) as recency, quantile_cont(avg_discount, 0.75) as avg_discount, quantile_cont(conversion, 0.75) as conversion,
 {_mean("conversion")} as mean_conversion from csummary
"""

VIEWS["cnamed"] = """
select * exclude (label), case when row_number() over (partition by label order by revenue desc, orders desc, cluster_id) = 1 then label
 else label || ' ' || cast(cluster_id + 1 as varchar) end as cluster_name
from (select s.*, case when s.revenue <= 0 and s.orders <= 0 then 'Never Purchased'
  when s.revenue >= t.revenue and s.orders >= t.orders then 'High-Value Repeat Buyers'
  when s.sessions >= t.sessions and s.conversion < t.mean_conversion then 'Heavy Browsers, Low Conversion'
  when s.avg_discount >= t.avg_discount then 'Promotion Sensitive' when s.recency >= t.recency then 'Dormant / Churn Risk'
  when s.conversion >= t.conversion then 'High Intent, High Conversion' else 'Steady Mainstream' end as label
 from csummary s cross join cthresholds t) q
"""

VIEWS["personas"] = """
select c.*, n.cluster_name from clustered c left join cnamed n on n.cluster_id = c.cluster_id
"""

VIEWS["ptop_region"] = """
select cluster_name, region as top_region, users, users / total as share from
(select cluster_name, region, count(*) as users, sum(count(*)) over (partition by cluster_name) as total,
 row_number() over (partition by cluster_name order by count(*) desc, region) as rn from personas group by cluster_name, region) q where rn = 1
"""

VIEWS["ptop_source"] = """
select cluster_name, dominant_source as top_source from
(select cluster_name, dominant_source, row_number() over (partition by cluster_name order by count(*) desc, dominant_source) as rn
 from personas group by cluster_name, dominant_source) q where rn = 1
"""

VIEWS["pfigures"] = f"""
select p.*, r.top_region, r.share as top_region_share, s.top_source from
(select cluster_name, count(*) as users, {_mean("revenue")} as revenue, {_mean("order_count")} as orders, {_mean("session_count")} as sessions,
 {_mean("session_to_order_rate")} as conversion, {_mean("age")} as avg_age, {_mean("avg_rating")} as avg_rating from personas group by cluster_name) p
left join ptop_region r on r.cluster_name = p.cluster_name left join ptop_source s on s.cluster_name = p.cluster_name
"""

VIEWS["features"] = """
select customer_id, ln(1 + session_count) as session_count_log, ln(1 + total_events) as events_log, page_to_cart_rate, cart_to_checkout_rate,
 checkout_to_purchase_rate, ln(1 + order_count) as orders_log, ln(1 + revenue) as revenue_log, avg_order_value, avg_discount_pct,
 case when avg_rating > 0 then avg_rating else (select coalesce(avg(avg_rating) filter (avg_rating > 0), 0) from profile) end as avg_rating,
 cast(coalesce(active_days, 0) as double) as active_days, cast(coalesce(recency_days, 0) as double) as recency_days, cast(source_diversity as double) as source_diversity,
 cast(device_diversity as double) as device_diversity, review_rate, coalesce(age, (select median(age) from profile)) as age,
 cast(marketing_opt_in as double) as marketing_opt_in from profile
"""

# --- snapshot --------------------------------------------------------------------


def _ranked(section: str, source: str, limit: str = "") -> str:
    return (
        f"select '{section}' as section, cast(row_number() over (order by value desc, key) as int) as rank, key, cast(value as double) as value "
        f"from (select key, value from ({source}) a order by value desc, key {limit}) b"
    )


_HEADLINE = " union all ".join(
    f"select 'headline' as section, {i} as rank, '{key}' as key, cast(({expr}) as double) as value"
    for i, (key, expr) in enumerate(
        [
            ("customers", "select count(*) from x_customers"),
            ("countries", "select count(distinct country) from x_customers"),
            ("sessions", "select count(*) from x_sessions"),
            ("orders", "select count(*) from x_orders"),
            ("revenue", "select sum(total_usd) from x_orders"),
            ("aov", "select cast(sum(total_usd) as double) / count(total_usd) from x_orders"),
            ("conversion", "(select count(*) from x_orders) / (select count(*) from x_sessions)"),
            ("avg_rating", "select avg(rating) from x_reviews"),
            ("reviews", "select count(*) from x_reviews"),
        ],
        start=1,
    )
)

VIEWS["peak"] = """
select month, revenue, strftime(month, '%B %Y') as label from monthly where orders > 0 order by revenue desc, month limit 1
"""

VIEWS["snapshot"] = " union all ".join(
    [
        _HEADLINE,
        "select 'peak_month' as section, 1 as rank, label as key, revenue as value from peak",
        _ranked("lifecycle", "select lifecycle_stage as key, count(*) as value from scored group by 1"),
        _ranked("rfm", "select rfm_segment as key, count(*) as value from scored group by 1"),
        _ranked("region", "select region as key, count(*) as value from scored group by 1"),
        _ranked("country", "select country as key, count(*) as value from x_customers where country is not null group by 1", "limit 10"),
        _ranked(
            "product",
            "select p.name || ' [' || p.category || ']' as key, sum(s.units) as value from sales s join x_products p on p.product_id = s.product_id group by 1",
            "limit 10",
        ),
        _ranked(
            "category",
            "select p.category as key, sum(s.units) as value from sales s join x_products p on p.product_id = s.product_id group by 1",
        ),
    ]
)


def with_views(body: str) -> str:
    """Prefix ``body`` with every view it needs, directly or through other views."""
    import re

    def mentioned(sql: str) -> set[str]:
        return set(re.findall(r"\b[a-z_]+\b", sql)) & VIEWS.keys()

    needed: set[str] = set()
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        needed.add(name)
        # a column may share a view's name; only what stands after from/join counts
        for other in tables_of(VIEWS[name]):
            add(other)
        ordered.append(name)

    def tables_of(sql: str) -> list[str]:
        found = re.findall(r"\b(?:from|join)\s+([a-z_]+)\b", sql)
        return [n for n in dict.fromkeys(found) if n in mentioned(sql)]

    for name in tables_of(body):
        add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in ordered)
    return f"with {ctes}\n{body}"
