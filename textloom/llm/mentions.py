"""Votes on mentions of article abstracts out of review payloads (for problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

NONE = "NONE"
_ANNOTATION = "array<struct<text:string,start:int,end:int,category:string,action:string>>"


def latest(df: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Rows with the greatest order of their keys; copies of such a row stay."""
    top = df.groupBy(*keys).agg(F.max(order).alias(order))
    return df.join(top, [*keys, order], "left_semi")


def anchored(marks: DataFrame, articles: DataFrame) -> DataFrame:
    """marks (document_id, mark{text, start, end, ...}, ...) with start_pos: the start given if the text stands there, else where it
    stands in the abstract; marks whose text is not found, or that have none, are left out."""
    abstracts = articles.select(F.col("doc_id").alias("document_id"), "abstract").filter("abstract is not null").groupBy("document_id").agg(F.max("abstract").alias("abstract"))
    joined = marks.join(abstracts, "document_id")
    joined = joined.select("*", F.explode("marks").alias("mark")).drop("marks").filter("length(mark.text) > 0")
    shown = F.expr("mark.start >= 0 and mark.end > mark.start and substring(abstract, mark.start + 1, mark.end - mark.start) = mark.text")
    place = F.when(F.coalesce(shown, F.lit(False)), F.col("mark.start")).otherwise(F.expr("locate(mark.text, abstract)") - 1)
    return joined.withColumn("start_pos", place.cast("int")).drop("abstract").filter("start_pos >= 0")


def _label(names: DataFrame, marks: DataFrame) -> DataFrame:
    aliases = names.select(F.lower(F.trim("alias")).alias("alias"), "entity_label").groupBy("alias").agg(F.min("entity_label").alias("entity_label"))
    return marks.withColumn("alias", F.lower(F.trim("mark.category"))).join(aliases, "alias", "left")


def expert_votes(reviews: DataFrame, articles: DataFrame, names: DataFrame) -> DataFrame:
    """(document_id, start_pos, expert_id, label) of the reviews in force. DELETE is a vote for NONE, whatever the category; other
    actions vote for the category's label, unknown categories for none. Null annotations accept the original labels if the status is
    CORRECT; broken JSON, and null elsewhere, hold no votes. Rows without document or expert are left out."""
    own = reviews.filter("document_id is not null and expert_id is not null").select("id", "document_id", "expert_id", "review_status", "original_labels_json", "annotations_json")
    accepts = F.upper(F.trim("review_status")) == "CORRECT"
    text = F.when(F.col("annotations_json").isNotNull(), F.col("annotations_json")).when(accepts, F.col("original_labels_json"))
    whole = F.trim(text).endswith("]")  # a payload cut short is broken, though its first entries parse
    marks = F.when(whole & F.get_json_object(text, "$").isNotNull(), F.from_json(text, _ANNOTATION))
    parsed = own.select("id", "document_id", "expert_id", marks.alias("marks"))
    force = latest(parsed, ["document_id", "expert_id"]).filter("size(marks) > 0")
    named = _label(names, anchored(force, articles))
    label = F.when(F.upper(F.trim("mark.action")) == "DELETE", NONE).otherwise(F.col("entity_label"))
    return named.select("document_id", "start_pos", "expert_id", label.alias("label")).filter("label is not null")


def settled_labels(adjudications: DataFrame, articles: DataFrame, names: DataFrame) -> DataFrame:
    """(document_id, start_pos, label) of the adjudications in force that are RESOLVED."""
    own = adjudications.filter("document_id is not null").select("id", "document_id", "resolution_status", F.from_json("final_labels_json", _ANNOTATION).alias("marks"))
    force = latest(own, ["document_id"]).filter("upper(trim(resolution_status)) = 'RESOLVED' and size(marks) > 0").select("document_id", "marks")
    return _label(names, anchored(force, articles)).select("document_id", "start_pos", F.col("entity_label").alias("label")).filter("label is not null").distinct()
