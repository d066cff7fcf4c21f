"""Streams run to their end, as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.plans.registry import query
from textloom.runtime import shared_folder
from textloom.streaming import events as S


def _place(spark, name):
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    return f"{base}/out", f"{base}/state"


@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_hours(spark, folder):
    """Windowed counts of the event stream, against the batch answer."""
    out, state = _place(spark, "hours")
    S.run_to_table(S.hourly(S.source(spark, folder, "events"), late="3650 days"), out, state)
    return spark.read.parquet(out).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("select document_id, expert_id, max(id) as id from expert_reviews group by 1, 2")
def stream_latest_reviews(spark, folder):
    """The review log kept as its latest rows."""
    out, state = _place(spark, "reviews")
    reviews = spark.readStream.schema(spark.read.parquet(f"{folder}/expert_reviews.parquet").schema).parquet(f"{folder}/expert_reviews.parquet*")
    last = S.run_upsert(reviews.select("document_id", "expert_id", "id"), out, state, ["document_id", "expert_id"], "id")
    return spark.read.parquet(last).select("document_id", "expert_id", "id")
