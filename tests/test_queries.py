"""Every registered search query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from inkdex import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted([tuple(r[i] for i in at) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    a, b = plain(map(tuple, df.collect()), df.columns, order), plain(want.fetchall(), want.columns, order)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(math.isclose(p, q, abs_tol=2e-5) if isinstance(p, float) else p == q for p, q in zip(x, y)), (x, y)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "score"] and e.entry(spark).count() > 0
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES) and set(e.oracle_sql()) <= set(e.queries())
