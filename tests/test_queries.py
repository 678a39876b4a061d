"""Every registered engine query against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from concord.plans import more  # noqa: F401  registers its queries
from concord.plans.queries import QUERIES, SQL

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


def value(x):
    return round(x, 6) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, PATH)
    rel = tables.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = Counter(tuple(value(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    want = Counter(tuple(value(r[k]) for k in at) for r in rel.fetchall())
    assert got == want and want
