"""The driver's entry points; results against DuckDB at the smallest scale."""

import datetime
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(entry.ORACLE_SQL[name])
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    place = [want.columns.index(c) for c in cols]
    plain = lambda rows: sorted([tuple(str(v) if isinstance(v, datetime.datetime) else v for v in r) for r in rows], key=str)
    assert plain(tuple(r[c] for c in cols) for r in got.collect()) == plain(tuple(r[i] for i in place) for r in want.fetchall())


def test_human_formats_of_large_and_missing_keys(spark, tmp_path):
    """Sizes from 1024 TiB on, which no key of the small tables reaches, on both sides of each unit; a null key gives nulls."""
    import duckdb

    edges = [int((1024**k / 37) ** 0.5) + d for k in range(1, 6) for d in (-1, 0, 1, 2)]
    keys = [0, 1, -1, -8120, *edges, 5516314, 5516315, 8999999, 20_000_000, 499_000_000, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(entry.ORACLE_SQL["human_formats"]).fetchall()
    got = [tuple(r) for r in entry.queries()["human_formats"](spark, str(tmp_path)).select("o_orderkey", "size", "rate", "ratio").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (None, None, None, None) in got
