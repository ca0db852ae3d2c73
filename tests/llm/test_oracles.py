"""Queries of the training-data operators against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tracklens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    one = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    norm = lambda rows: sorted((tuple(one(v) for v in r) for r in rows), key=str)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names) and norm(tuple(r) for r in df.select(*names).collect()) == norm(found.fetchall())
