"""The registered queries that SQL can express, against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from inkdex.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted([tuple(r[c] for c in order) for r in df.collect()], key=key)
    b = sorted([tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()], key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert all(math.isclose(p, q, abs_tol=1e-8) if isinstance(p, float) else p == q for p, q in zip(x, y)), (x, y)
