"""Helpers of the tests; a module of its own, since several folders have a ``conftest``."""

import datetime as dt
from decimal import Decimal

SMALL = "/root/testdata/sf0.001"


def moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def typed(value, kind: str):
    if value is None:
        return None
    if kind == "timestamp_ntz":
        return moment(value)
    return Decimal(str(value)) if kind == "decimal" else value
