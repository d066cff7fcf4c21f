"""Problem 10: trusted labels hold in the result, too."""

from pyspark.sql import functions as F

from textloom.llm import subjects


def test_the_last_pass_holds_trusted_labels(spark, data, monkeypatch):
    calls, real = [], subjects.subject_of_sentences
    monkeypatch.setattr(subjects, "subject_of_sentences", lambda s, t, seeds=None: (calls.append(seeds), real(s, t, seeds))[1])
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/subject_labels.parquet")
    found = subjects.subject_areas(docs, labels)
    held = calls[-1]
    assert held is not None
    names = sorted(r.subject for r in labels.join(docs.filter("length(trim(text)) > 0"), "doc_id").select("subject").distinct().collect())
    named = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("subject"))  # held are numbers of subjects
    held = held.groupBy("doc_id").agg(F.collect_set(named).alias("allowed")).cache()
    assert held.count() > 0
    assert found.join(held, "doc_id").filter("not array_contains(allowed, subject)").count() == 0
