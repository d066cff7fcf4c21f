"""Dictionary terms of any length in words."""

import os

import duckdb
import pytest

from textloom.operators import dictionary as D
from textloom.plans import annotation, articles
from textloom.plans.views import SQL_ARTICLES, SQL_DICTIONARY, sql_ngrams


@pytest.fixture(scope="module")
def hits(data):
    """(doc_id, term, mentions) of every term, by n-grams as long as the longest term."""
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    most = c.sql(f"select max(len(string_split(term, ' '))) from {SQL_DICTIONARY}").fetchall()[0][0]
    assert most > 5
    return c.sql(f"select g.doc_id, d.term, d.category, count(*) as n from {sql_ngrams(SQL_ARTICLES, 'doc_id', 'abstract', most)} g join {SQL_DICTIONARY} d on d.term = g.k group by all").fetchall()


def test_term_hits_of_every_length(spark, data, hits):
    got = articles.term_hits(spark, data).groupBy("doc_id", "term", "category").count().collect()
    assert sorted(map(tuple, got)) == sorted(hits)
    shares = {r.category: r.mentions for r in articles.concept_type_distribution(spark, data).collect()}
    assert shares == {c: sum(n for _, _, x, n in hits if x == c) for c in {x for _, _, x, _ in hits}}


def test_long_terms_are_matches(spark, data, hits):
    long = {(d, t) for d, t, _, _ in hits if len(t.split()) > 5}
    got = {(r.doc_id, r.text.lower()) for r in annotation.dictionary_matches(spark, data).collect()}
    assert long and long <= got


def test_candidates_of_nine_words_and_of_no_dictionary(spark):
    term = "một hai ba bốn năm sáu bảy tám chín"
    texts = spark.createDataFrame([(1, f"Không, {term.upper()}."), (2, "một hai ba bốn năm sáu bảy tám"), (3, ""), (4, None), (5, "mot hai ba bon nam sau bay tam chin")], "k long, t string")
    entries = spark.createDataFrame([(term, "A00", "DISEASE"), ("chín", "R00", "SYMPTOM")], "key string, code string, category string")
    got = sorted((r.key, r.start, r.end, r.matched_by, r.code) for r in D.candidates(texts, "k", "t", entries).collect())
    n = len(term)
    assert got == [(1, 7, 7 + n, "exact", "A00"), (1, 3 + n, 7 + n, "exact", "R00"), (5, 0, n, "accentless", "A00")]
    assert D.candidates(texts, "k", "t", entries.limit(0)).count() == 0
