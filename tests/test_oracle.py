"""Every audit query against DuckDB on the smallest tables."""

import importlib
import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: q for m in __spark_entry__.JOBS for n, q in importlib.import_module(m).QUERIES.items()}
ORACLE = {n: q for m in __spark_entry__.JOBS for n, q in importlib.import_module(m).ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def norm(rows):
    one = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert norm(tuple(r) for r in df.select(*names).collect()) == norm(found.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
