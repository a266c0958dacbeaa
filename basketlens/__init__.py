"""Retail customer analytics expressed as Spark DataFrame plans."""

from basketlens.sources.tables import RetailTables

__all__ = ["RetailTables"]
