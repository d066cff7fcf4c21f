"""The pN_ queries that SQL can express against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from textloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, data, name):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    df = queries.QUERIES[name](spark, data)
    r = c.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(r.columns)
    ours = sorted((tuple(row[x] for x in r.columns) for row in df.collect()), key=repr)
    assert ours == sorted(r.fetchall(), key=repr) and ours
