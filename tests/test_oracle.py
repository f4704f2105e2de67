"""Every query of the library against its DuckDB statement (the driver's gate),
at sf0.001.  Training-data operators have tests of their own."""

import duckdb
import pytest

import __spark_entry__ as E
from shardloom.plans.queries import QUERIES
from tools.check_oracle import TABLES, rows_of

from conftest import SF_SMALL

SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(dcols, res.fetchall())
    assert len(a) == len(b)
    assert a == b


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["data_name", "shard_id", "shard_name", "n_tokens", "n_docs", "split", "file_name"]
