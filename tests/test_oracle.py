"""Every registered query against its SQL on the smallest tables."""

import re

import pytest
from compare import differences, oracle_connection
from support import SMALL

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, SQL[name]) is None


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    own = {name for name in QUERIES if name != "pipeline" and not re.match(r"op\d+_", name)}
    assert own - set(SQL) == {"kmeans_select", "customer_clusters", "cluster_pca", "cluster_scatter", "spending_potential"}


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns == ["rfm_segment", "customers", "revenue", "avg_orders", "avg_recency"]
    assert result.count() > 0
