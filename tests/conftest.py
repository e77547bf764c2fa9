import datetime as dt
import decimal
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotwise import Clinic  # noqa: E402
from slotwise.session import local_session  # noqa: E402
from slotwise.sources.lookups import LOOKUPS, lookup  # noqa: E402
from slotwise.sources.schemas import TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    return local_session(4, spark__checkpoint__dir=shared)


@pytest.fixture(scope="session")
def make_clinic(spark):
    """A clinic from lists of row dicts; columns that are left out get a plain value."""

    plain = {
        "bigint": 1,
        "int": 0,
        "string": "x",
        "date": dt.date(1990, 6, 1),
        "timestamp_ntz": dt.datetime(2024, 1, 1),
        "decimal(18,2)": decimal.Decimal(0),
    }

    def fill(field, row):
        if field.name in row:
            return row[field.name]
        return None if field.nullable else plain[field.dataType.simpleString()]

    def build(**tables):
        def frame(name):
            schema = TABLES[name].schema
            rows = [tuple(fill(f, row) for f in schema) for row in tables.get(name, [])]
            return spark.createDataFrame(rows, schema)

        made = {n: frame(n) for n in TABLES if n in tables or n not in LOOKUPS}
        return Clinic({n: lookup(spark, n) for n in LOOKUPS} | made)

    return build


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
