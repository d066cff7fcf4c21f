"""Every core query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from textloom.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.sql(catalogue.ORACLE[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert ours == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_rows_do_not_depend_on_partitions(spark, data, name):
    """Without SQL: the same rows, and some, however the work is cut."""
    def rows():
        return sorted(map(repr, catalogue.QUERIES[name](spark, data).collect()))

    first, before = rows(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert first and rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name,column", [("dictionary_matches", "fits"), ("highlighted_articles", "same"), ("question_pages", "same"), ("realigned_annotations", "fits"), ("scored_tags", "same"), ("sentence_bounds", "fits"), ("augmented_texts", "fits"), ("detokenised_abstracts", "fits")])
def test_invariants(spark, data, name, column):
    assert catalogue.QUERIES[name](spark, data).filter(f"not {column}").count() == 0
