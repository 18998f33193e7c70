"""Every registered query with SQL against DuckDB, whole results."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(round(float(v[i]), 5) if isinstance(v[i], float) and math.isfinite(v[i]) else v[i] for i in order) for v in values]
    return sorted(names), sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, spark, duck, sf_dir):
    df = entry.queries()[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
