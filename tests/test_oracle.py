"""Every registered query of the image engine that has SQL gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from pixelspark.plans import registry

DATA = "/root/testdata/sf0.01"
TABLES = "supplier lineitem events embeddings".split()


def rows(columns, values):
    order = sorted(columns)
    at = [columns.index(c) for c in order]

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 9) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=lambda r: [(v is None, repr(v)) for v in r])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    result = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())
