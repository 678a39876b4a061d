"""The numbered operators' queries against their SQL."""

from collections import Counter

import duckdb
import pytest

from concord.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    df, rel = QUERIES[name](spark, f"/root/testdata/{sf}"), con.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(tuple(r[k] for k in at) for r in rel.fetchall())
