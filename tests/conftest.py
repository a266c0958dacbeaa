import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from basketlens.plans.session import local_session  # noqa: E402
from basketlens.sources.tables import SCHEMAS, RetailTables  # noqa: E402
from support import SMALL, typed  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def make_tables(spark):
    """Tables from short dict rows; absent columns are null, absent tables empty."""

    def build(**rows):
        frames = {}
        for name, schema in SCHEMAS.items():
            data = []
            for row in rows.get(name, []):
                unknown = set(row) - set(schema.names)
                assert not unknown, f"{name}: {unknown}"
                data.append([typed(row.get(f.name), f.dataType.typeName()) for f in schema])
            frames[name] = spark.createDataFrame(data, schema)
        extra = {k: rows[k] for k in ("countries", "first_names") if k in rows}
        return RetailTables(**frames, **extra)

    return build


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
