"""Every spatial query that SQL can express gives DuckDB's rows."""

import math

import duckdb
import pytest

from tessera.queries_more import QUERIES, SQL
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6) + 0.0
    return v if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    relation = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == pytest.approx(b, abs=2e-6, rel=2e-6) if all(isinstance(v, float) for v in (*a, *b)) else a == b
