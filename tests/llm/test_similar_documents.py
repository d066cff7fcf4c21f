"""Problem 10: the graph that labels flow along."""

import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import subjects
from textloom.llm.neardup import sketch
from tests.llm.corpora import topical


def linked(df):
    rows = subjects.document_terms(df, "doc_id", "text").cache()
    docs = rows.filter("chunk < 0").select("doc_id", "sents")
    return subjects.similar_documents(subjects.blocks(docs, df.sparkSession.sparkContext.broadcast(sketch(rows)), docs.count()))


def test_cosine_by_signs():
    rng = np.random.default_rng(3)
    terms = rng.integers(-(2**62), 2**62, 400)
    signs = subjects._signs(terms)
    for shared in (0, 60, 120, 200):
        a, b = np.zeros(400, np.float32), np.zeros(400, np.float32)
        a[:200], b[200 - shared : 400 - shared] = 1, 1
        differ = ((a @ signs > 0) != (b @ signs > 0)).mean()
        assert abs(np.cos(np.pi * differ) - shared / 200) < 0.25


def test_links_join_documents_of_one_subject(spark):
    docs, truth, _ = topical(random.Random(5), 240, 1)
    links = linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(links) > 200 and all(r.a < r.b and r.cosine >= subjects.MIN_COSINE for r in links)
    assert sum(truth[r.a] == truth[r.b] for r in links) >= 0.95 * len(links)


def test_no_links_no_labels_beyond_the_seeds(spark, monkeypatch):
    """Rows come from propagation: where nothing is similar enough, other documents only get what the seeds' own terms tell."""
    docs, truth, rare = topical(random.Random(6), 240, 1, rare=True)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    first = {s: i for i in reversed(range(240)) for s in truth[i]}  # one seed a subject
    seeds = spark.createDataFrame([(i, s) for s, i in first.items()], "doc_id long, subject string")
    right = lambda: sum(r.subject in truth[r.doc_id] for r in subjects.subject_areas(df, seeds).collect())
    found = right()
    monkeypatch.setattr(subjects, "MIN_COSINE", 2.0)
    monkeypatch.setattr(subjects.similar_documents, "__defaults__", (2.0,))
    assert found >= 1.2 * right()


def test_hot_blocks_are_split_and_labels_rest(spark, monkeypatch):
    monkeypatch.setattr(subjects, "BLOCK_DOCS", 20)
    docs, truth, _ = topical(random.Random(7), 300, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert linked(df).count() > 100
    ring = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 1, 1.0), (1, 2, 1.0), (5, 6, 1.0), (6, 5, 1.0)], "src long, dst long, w double")
    got = {r.doc_id: r.share for r in subjects.propagated(ring, spark.createDataFrame([(0, "law", 1.0)], "doc_id long, subject string, share double")).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 1.0}


def test_wrong_hand_labels_are_doubted(spark):
    links = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(6) if i != j], "src long, dst long, w double")
    seeds = spark.createDataFrame([(0, "law"), (1, "law"), (2, "sport"), (9, "law")], "doc_id long, subject string")
    labels = spark.createDataFrame([(0, "law", 1.0), (1, "law", 1.0), (3, "law", 1.0), (4, "law", 1.0), (5, "law", 1.0)], "doc_id long, subject string, share double")
    kept = {(r.doc_id, r.subject) for r in subjects.supported(links, labels, seeds).collect()}
    assert kept == {(0, "law"), (1, "law"), (9, "law")}


def test_no_partner_is_dropped(spark):
    """All pairs of a block are compared, and a block's centre carries what all its pairs would."""
    met = spark.createDataFrame([(i, [7] * (subjects.BITS // 64), 1) for i in range(9)], "doc_id long, bits array<long>, term long")
    assert subjects.similar_documents(met).count() == 36
    hubs = subjects.gathered(met, subjects.MIN_COSINE)
    labels = spark.createDataFrame([(0, "law", 1.0), (1, "law", 0.5), (1, "sport", 0.5)], "doc_id long, subject string, share double")
    none = spark.createDataFrame([], "src long, dst long, w double")
    got = subjects._votes(none, labels, hubs).groupBy("doc_id", "subject").agg(F.round(F.sum("v"), 6).alias("v")).collect()
    own = {(r.doc_id, r.subject): r.share for r in labels.collect()}
    want = {(i, s): sum(v for (j, t), v in own.items() if t == s and j != i) for i in range(9) for s in ("law", "sport")}
    assert {(r.doc_id, r.subject): r.v for r in got} == want
