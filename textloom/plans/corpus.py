"""Corpus building: splits, leakage, duplicates, sampling, sequence numbers, events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from textloom.functions import text as T
from textloom.operators import relational as R
from textloom.plans.registry import query
from textloom.plans.texts import _flat
from textloom.plans.views import rows
from textloom.runtime import table

_D = "(select distinct * from documents)"
_KEY = "sha256(lower(" + _flat("text") + "))"
_SPLIT = "case when doc_id % 10 = 0 then 'test' when doc_id % 10 = 1 then 'dev' else 'train' end"


def _splits(spark, folder):
    d = rows(spark, folder, "documents").filter("text is not null")
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")
    return d.select("doc_id", split.alias("split"), T.checksum(F.lower(T.flat("text"))).alias("key"))


@query(f"""select split, count(*) as kept from (select {_SPLIT} as split, row_number() over (partition by {_KEY} order by case {_SPLIT} when 'test' then 1 when 'dev' then 2 else 3 end, doc_id) rn from {_D} where text is not null) where rn = 1 group by 1""")
def dedup_priority_splits(spark, folder):
    """One document per normalised text, test before dev before train."""
    rank = F.when(F.col("split") == "test", 1).when(F.col("split") == "dev", 2).otherwise(3)
    return R.priority_distinct(_splits(spark, folder), "key", [rank, F.col("doc_id")]).groupBy("split").agg(F.count("*").alias("kept"))


@query(f"""with d as (select doc_id, {_SPLIT} as split, {_KEY} as k from {_D} where text is not null) select doc_id, split from d t where split <> 'test' and exists (select 1 from d x where x.split = 'test' and x.k = t.k)""")
def leakage_report(spark, folder):
    """Training documents whose text is a test text."""
    d = _splits(spark, folder)
    return d.filter("split != 'test'").join(d.filter("split = 'test'").select("key").distinct(), "key", "left_semi").select("doc_id", "split")


@query(f"""select {_SPLIT} as split, count(*) filter (where lower(trim(lang)) = 'vi') as vi, count(*) filter (where lower(trim(lang)) = 'en') as en, count(*) filter (where lang is null or lower(trim(lang)) not in ('vi', 'en')) as other, count(*) as n from {_D} group by 1""")
def split_counts(spark, folder):
    """Zero-filled counts per split."""
    d = rows(spark, folder, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train"))
    lang = F.lower(F.trim("lang"))
    return d.groupBy("split").agg(F.count_if(lang == "vi").alias("vi"), F.count_if(lang == "en").alias("en"), F.count_if(F.coalesce(~lang.isin("vi", "en"), F.lit(True))).alias("other"), F.count("*").alias("n"))


@query(f"""select doc_id, s || '_' || lpad(cast(row_number() over (partition by s order by doc_id) as varchar), 6, '0') as seq_id from (select doc_id, coalesce(nullif(lower(trim(source)), ''), 'none') s from {_D})""")
def sequence_ids(spark, folder):
    """Running numbers in each source, by two-level ranks."""
    d = rows(spark, folder, "documents").select("doc_id", F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("none")).alias("s"))
    return R.sequence_ids(d, F.col("s"), [F.col("doc_id")]).select("doc_id", "seq_id")


@query()
def sampled_documents(spark, folder):
    """A seeded sample of 100 valid documents (the limit is the feature)."""
    return R.seeded_sample(rows(spark, folder, "documents").filter("length(trim(text)) > 0").select("doc_id", "source"), "doc_id", 100, 7)


@query()
def covering_sample(spark, folder):
    """Documents that add an unseen source or type, then the rest in hash order up to 60. In order of ids a greedy choice takes a document exactly
    if it is the first of its source or of its type, as all unseen ones before it were taken, so no loop is needed."""
    d = rows(spark, folder, "documents").filter("source is not null and doc_type is not null").select("doc_id", F.lower(F.trim("source")).alias("source"), "doc_type")
    first = lambda c: d.groupBy(c).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    chosen = first("source").union(first("doc_type")).distinct().withColumn("seed", F.lit(0))
    return d.join(chosen, "doc_id", "left").orderBy(F.coalesce("seed", F.lit(1)), F.xxhash64("doc_id"), "doc_id").limit(60).select("doc_id", "source", "doc_type")


@query(f"""select lower(trim(source)) as source, doc_type, count(*) as n, grouping(lower(trim(source))) * 2 + grouping(doc_type) as level from {_D} where source is not null and doc_type is not null group by rollup (lower(trim(source)), doc_type)""")
def source_rollup(spark, folder):
    """Totals over sources and types in one pass (grouping sets)."""
    d = rows(spark, folder, "documents").filter("source is not null and doc_type is not null").select(F.lower(F.trim("source")).alias("source"), "doc_type")
    return d.rollup("source", "doc_type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""select category, median_words, n from (select lower(trim(category)) as category, count(*) as n, cast(median(len(string_split_regex(trim(doctor_answer), '\\s+'))) as double) as median_words from (select distinct * from tamanh_qa) where doctor_answer is not null and category is not null group by 1) where n >= 10""")
def answer_lengths(spark, folder):
    q = rows(spark, folder, "tamanh_qa").filter("doctor_answer is not null and category is not null")
    return q.groupBy(F.lower(F.trim("category")).alias("category")).agg(F.count("*").alias("n"), F.expr("percentile(size(split(trim(doctor_answer), '\\\\s+')), 0.5)").alias("median_words")).filter("n >= 10")


@query("""select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by all""")
def event_hours(spark, folder):
    """Tumbling windows over events; the streaming job gives the same table."""
    return table(spark, folder, "events").groupBy("event_type", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""select user_id, count(*) as runs, max(n) as longest from (select user_id, g, count(*) n from (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) g from events) group by user_id, event_type, g) group by 1""")
def event_runs(spark, folder):
    """Runs of equal events of a user (gaps and islands)."""
    e = table(spark, folder, "events")
    w, v = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    r = e.withColumn("g", F.row_number().over(w) - F.row_number().over(v)).groupBy("user_id", "event_type", "g").agg(F.count("*").alias("n"))
    return r.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))
