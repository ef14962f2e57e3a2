"""Every query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from gridloom.plans import formats, more, queries, rasters

assert formats and more and rasters  # they register their queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=str)
    want = db.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted((tuple(map(plain, r)) for r in db.sql(f"select {listed} from ({queries.SQL[name]})").fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0
    assert rows.columns[:3] == ["band", "bx", "by_"]
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())
