"""Each query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in cursor.fetchall())
