"""The seven-table data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_INT, _LONG, _SHORT, _STR = T.IntegerType(), T.LongType(), T.ShortType(), T.StringType()
_DBL, _BOOL, _TS, _MONEY = T.DoubleType(), T.BooleanType(), T.TimestampNTZType(), T.DecimalType(18, 2)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(
        ("customer_id", _INT),
        ("name", _STR),
        ("email", _STR),
        ("country", _STR),
        ("age", _DBL),
        ("signup_date", _TS),
        ("marketing_opt_in", _BOOL),
    ),
    "sessions": _schema(
        ("session_id", _INT),
        ("customer_id", _INT),
        ("start_time", _TS),
        ("device", _STR),
        ("source", _STR),
        ("country", _STR),
    ),
    "events": _schema(
        ("event_id", _INT),
        ("session_id", _INT),
        ("timestamp", _TS),
        ("event_type", _STR),
        ("product_id", _INT),
        ("qty", _INT),
        ("cart_size", _INT),
        ("payment", _STR),
        ("discount_pct", _DBL),
        ("amount_usd", _MONEY),
    ),
    "orders": _schema(
        ("order_id", _INT),
        ("customer_id", _INT),
        ("order_time", _TS),
        ("payment_method", _STR),
        ("discount_pct", _DBL),
        ("subtotal_usd", _MONEY),
        ("total_usd", _MONEY),
        ("country", _STR),
        ("device", _STR),
        ("source", _STR),
    ),
    "order_items": _schema(
        ("order_id", _INT),
        ("product_id", _INT),
        ("unit_price_usd", _MONEY),
        ("quantity", _SHORT),
        ("line_total_usd", _MONEY),
    ),
    "products": _schema(
        ("product_id", _INT),
        ("category", _STR),
        ("name", _STR),
        ("price_usd", _MONEY),
        ("cost_usd", _MONEY),
        ("margin_usd", _MONEY),
    ),
    "reviews": _schema(
        ("review_id", _INT),
        ("order_id", _INT),
        ("product_id", _INT),
        ("rating", _SHORT),
        ("review_text", _STR),
        ("review_time", _TS),
    ),
}
TABLE_NAMES = list(SCHEMAS)


@dataclass(frozen=True)
class RetailTables:
    """One lazy frame per table, plus the optional lookup tables.

    ``countries`` (country, country_name, region) replaces the built-in country
    list; ``first_names`` (name, is_male, is_female) drives gender inference.
    """

    customers: DataFrame
    sessions: DataFrame
    events: DataFrame
    orders: DataFrame
    order_items: DataFrame
    products: DataFrame
    reviews: DataFrame
    countries: DataFrame | None = None
    first_names: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.customers.sparkSession
