"""Every query with SQL beside it gives the same rows in DuckDB."""

import duckdb
import pytest

from tidelog.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def norm(value):
    if isinstance(value, float):
        return round(value, 6)
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    names = sorted(df.columns)
    ours = sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=repr)
    sql = con.sql(catalog.ORACLES[name])
    assert sorted(sql.columns) == names
    spots = [sql.columns.index(n) for n in names]
    assert ours == sorted((tuple(norm(r[i]) for i in spots) for r in sql.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0
