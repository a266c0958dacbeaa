"""Small constant tables (fixed size, so they are always safe to broadcast)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from basketlens.functions import constants as K


def constant_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Local relation from in-code rows: no Python job behind it, size known to the planner."""
    return spark.createDataFrame(pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)}))


def country_table(spark: SparkSession) -> DataFrame:
    return constant_table(spark, K.COUNTRIES, ["country", "country_name", "region"])


def ordered_domain(spark: SparkSession, column: str, values: list[str]) -> DataFrame:
    """A closed list of values with their display position."""
    return constant_table(spark, [(i, v) for i, v in enumerate(values)], ["position", column])
