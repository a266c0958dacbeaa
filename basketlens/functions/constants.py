"""Fixed values.

Everything in this module is a value that decides results (labels, limits,
lookup tables, word lists).  No logic lives here.
"""

# --- geography: country code, display name, region -------------------------
COUNTRIES = [
    ("AE", "United Arab Emirates", "Middle East & Africa"),
    ("AU", "Australia", "Asia Pacific"),
    ("BR", "Brazil", "Latin America"),
    ("CA", "Canada", "North America"),
    ("DE", "Germany", "Europe"),
    ("ES", "Spain", "Europe"),
    ("FR", "France", "Europe"),
    ("GB", "United Kingdom", "Europe"),
    ("IN", "India", "Asia Pacific"),
    ("JP", "Japan", "Asia Pacific"),
    ("MX", "Mexico", "North America"),
    ("NL", "Netherlands", "Europe"),
    ("PL", "Poland", "Europe"),
    ("SE", "Sweden", "Europe"),
    ("SG", "Singapore", "Asia Pacific"),
    ("US", "United States", "North America"),
    ("ZA", "South Africa", "Middle East & Africa"),
]
DEFAULT_REGION = "Other"

# --- demographics: right-closed bands (17, 24], (24, 34], ... --------------
AGE_EDGES = [17, 24, 34, 44, 54, 64, 75]
AGE_LABELS = ["18-24", "25-34", "35-44", "45-54", "55-64", "65-75"]
UNKNOWN = "Unknown"

TITLE_GENDER = [("mr.", "Male"), ("mrs.", "Female"), ("ms.", "Female"), ("miss", "Female")]
FIRST_NAME_PATTERN = r"^(?:Mr\.|Mrs\.|Ms\.|Miss|Dr\.)?\s*([A-Za-z][A-Za-z'\-]+)"

# --- sessions and events ---------------------------------------------------
NO_SESSION = "No Session"
DEVICES = ["desktop", "mobile", "tablet"]
SOURCES = ["organic", "direct", "paid", "social", "email", "referral"]
FUNNEL_STAGES = ["page_view", "add_to_cart", "checkout", "purchase"]
STAGE_COUNT_COLUMNS = {
    "page_view": "page_views",
    "add_to_cart": "add_to_cart_events",
    "checkout": "checkout_events",
    "purchase": "purchase_events",
}

# --- RFM and lifecycle -----------------------------------------------------
RFM_DEFAULT = "Potential Loyalists"
LIFECYCLE_DEFAULT = "Unclassified"

# --- lifetime value: (threshold, points), first match wins -----------------
LTV_REVENUE_AT_LEAST = [(500, 40), (200, 28), (80, 16)]
LTV_REVENUE_ANY = 6
LTV_ORDERS_AT_LEAST = [(8, 30), (4, 20), (2, 10)]
LTV_ORDERS_ONE = 4
LTV_RECENCY_AT_MOST = [(30, 30), (60, 22), (120, 12), (180, 4)]
LTV_MAX = 100
LTV_TIERS = [(80, "Platinum"), (60, "Gold"), (40, "Silver")]
LTV_LOWEST_TIER = "Bronze"

# --- next-best-action texts ------------------------------------------------
CRM_RFM_FIRST = ["Champions", "At-Risk High Value", "Lost Low Value"]
CRM_DEFAULT = "Monitor and re-evaluate in 30 days."
CRM_RULES = {
    "New Visitor": "Send a welcome email with a first-order discount code (10–15%).",
    "Browsing Prospect": "Push a limited-time offer on browsed products; highlight top-rated items.",
    "New Buyer": "Send a product guide + cross-sell recommendations 3 days after purchase.",
    "Active Repeat Buyer": "Invite to loyalty programme / points rewards; offer early access to new arrivals.",
    "Cooling Down": "Send a win-back email ('We miss you') with a personalised exclusive discount.",
    "Dormant Customer": "High-value: direct outreach with premium incentive. Low-value: low-cost EDM re-engagement.",
    "Champions": "Invite to VIP events; offer first access to new collections and limited editions.",
    "Loyal Customers": "Recognise loyalty with milestone rewards; promote complementary product categories.",
    "At-Risk High Value": "Urgent win-back: targeted discount + proactive customer-service contact.",
    "Lost Low Value": "Low-cost EDM only; A/B test reactivation creative.",
    "Price / Casual Shoppers": "Flash sales and discount events; avoid full-price messaging.",
    "Potential Loyalists": "Nurture with content marketing and personalised product recommendations.",
}

# --- sentiment -------------------------------------------------------------
SENTIMENTS = ["Positive", "Neutral", "Negative"]
COMPOUND_CUTOFF = 0.05
COMPOUND_ALPHA = 15
NEGATION_FACTOR = -0.74
BOOST_DAMPING = [1.0, 0.95, 0.9]
POSITIVE_WORDS = ["excellent", "great", "good", "love", "perfect", "recommend", "value"]
NEGATIVE_WORDS = ["bad", "poor", "disappointed", "worst", "broken", "issue"]

# --- question routing: first family with a matching substring wins ---------
INTENTS = [
    ("revenue", ["revenue", "sales", "income", "earn"]),
    ("orders", ["order", "purchase", "buy", "bought"]),
    ("customers", ["customer", "user", "buyer", "shopper"]),
    ("churn", ["retain", "churn", "dormant", "cooling", "lost"]),
    ("rfm", ["champion", "rfm", "segment", "loyal"]),
    ("rating", ["rating", "review", "sentiment", "feedback"]),
    ("conversion", ["conversion", "funnel", "cart", "checkout"]),
    ("products", ["product", "item", "top", "best"]),
]
INTENT_HELP = "help"
HELP_TEXT = (
    "I couldn't find a specific answer for that question.  \n"
    "Try asking about: **revenue**, **orders**, **customers**, **retention**, "
    "**RFM segments**, **ratings**, **conversion**, or **top products**."
)

# --- printed snapshot: section, title, unit ---------------------------------
SNAPSHOT_TITLE = "BUSINESS SNAPSHOT"
SNAPSHOT_SECTIONS = [
    ("lifecycle", "LIFECYCLE STAGES", ""),
    ("rfm", "RFM SEGMENTS", ""),
    ("persona", "PERSONA CLUSTERS", ""),
    ("region", "REGIONS (customer count)", ""),
    ("country", "TOP COUNTRIES", ""),
    ("product", "TOP 10 PRODUCTS (by units sold)", " units"),
    ("category", "CATEGORIES (by units)", " units"),
]

# --- spending potential ------------------------------------------------------
HIGH_POTENTIAL_TIERS = ["Platinum", "Gold"]

# --- clustering ------------------------------------------------------------
SEED = 42
CLUSTER_COUNTS = [3, 4, 5, 6]
SCATTER_SAMPLE = 3000
CLUSTER_FEATURES = [
    "session_count_log",
    "events_log",
    "page_to_cart_rate",
    "cart_to_checkout_rate",
    "checkout_to_purchase_rate",
    "orders_log",
    "revenue_log",
    "avg_order_value",
    "avg_discount_pct",
    "avg_rating",
    "active_days",
    "recency_days",
    "source_diversity",
    "device_diversity",
    "review_rate",
    "age",
    "marketing_opt_in",
]

# --- valence rules: words that flip, strengthen or weaken the next words ----
NEGATIONS = [
    "not", "no", "never", "none", "nothing", "neither", "nor", "without", "cannot",
    "can't", "don't", "doesn't", "didn't", "isn't", "wasn't", "won't", "wouldn't",
]
BOOSTERS = {
    "very": 0.293,
    "really": 0.293,
    "extremely": 0.293,
    "so": 0.293,
    "totally": 0.293,
    "slightly": -0.293,
    "barely": -0.293,
    "somewhat": -0.293,
}
KEYWORDS_PER_CATEGORY = 120
COLLOCATION_CUTOFF = 30

# --- names of personas, by the rule that gives them ---
PERSONAS = {
    "never": "Never Purchased",
    "value": "High-Value Repeat Buyers",
    "browsing": "Heavy Browsers, Low Conversion",
    "discounts": "Promotion Sensitive",
    "dormant": "Dormant / Churn Risk",
    "intent": "High Intent, High Conversion",
    "other": "Steady Mainstream",
}
