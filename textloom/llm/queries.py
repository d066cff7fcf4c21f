"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import consensus, encoding, forms, language, mentions, mixing, neardup, pairs, sitelines, splitting, subjects
from textloom.llm.oracle import ORACLE  # noqa: F401
from textloom.runtime import materialise, table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    content = forms.differing(table(spark, folder, "article_section"), "section_id", "content")
    answer = forms.differing(table(spark, folder, "tamanh_qa"), "qa_identifier", "doctor_answer")
    named = lambda df, field: df.select(F.lit(field).alias("field"), F.col("key").alias("record_key"))
    return named(content, "content").unionByName(named(answer, "doctor_answer"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    named = lambda name, key, field: table(spark, folder, name).select(F.struct(F.lit(field).alias("field"), F.col(key).alias("key")).alias("at"), F.col(field).alias("text"))
    both = named("article_section", "section_id", "content").unionByName(named("tamanh_qa", "qa_identifier", "doctor_answer"))
    return forms.look_alikes(both, "at", "text").select("key.field", "key.key", "skeleton_id", "members")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    sections, audit = table(spark, folder, "article_section"), table(spark, folder, "corpus_language_audit")
    lines = materialise(sitelines.line_rows(sections), "lines")
    places = sitelines.found_lines(lines, sitelines.site_documents(sections, audit))
    return places.select(F.col("key").alias("section_id"), "line_no")


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    sections, audit = table(spark, folder, "article_section"), table(spark, folder, "corpus_language_audit")
    lines = materialise(sitelines.line_rows(sections), "lines")
    places = sitelines.found_lines(lines, sitelines.site_documents(sections, audit))
    return sitelines.without_lines(sections, places).select("section_id", "content").distinct()


def _languages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    articles, sections, audit = (table(spark, folder, n) for n in ("article_extraction", "article_section", "corpus_language_audit"))
    dictionaries = language.fit(language.sample((articles, "abstract"), (articles, "abstract_en"), (sections, "content")))
    lines = materialise(sitelines.line_rows(sections, language.line_sizes(dictionaries), ", vi int, en int, fr int"), "lines")
    places = sitelines.found_lines(lines, sitelines.site_documents(sections, audit))
    audited = audit.filter("article_id is not null").select(F.col("article_id").alias("doc_id"))
    wholes = language.of_documents(lines, places, audited.unionByName(sections.select("doc_id")))
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("abstract_vi", "abstract_en"))))
    values = articles.select("doc_id", both.alias("v")).select(F.struct("doc_id", "v.field").alias("at"), "v.text")
    values = values.filter(F.length(F.regexp_replace("text", r"[\s\p{Z}\p{Cf}]+", "")) > 0)
    parts = language.stretches(values, dictionaries, "at", "text").select("key.doc_id", "key.field", "seg", "lang", "confidence")
    return wholes, parts


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    wholes, parts = _languages(spark, folder)
    audit = table(spark, folder, "corpus_language_audit")
    label = F.regexp_extract(F.lower(F.trim("pdf_language")), r"^([^-]*)", 1)
    labels = audit.filter("article_id is not null").select(F.col("article_id").alias("doc_id"), F.trim(label).alias("label")).distinct()
    wrong = labels.join(wholes, "doc_id").filter("label is null or label != lang")
    odd = parts.filter((F.col("seg") > 0) | (F.col("lang") != F.expr("right(field, 2)")))
    found = wrong.select("doc_id", F.lit("pdf_language").alias("field"), F.lit(0).alias("seg"), "lang")
    return found.unionByName(odd.select("doc_id", "field", "seg", "lang")).distinct()


def p1_languages(spark: SparkSession, folder: str) -> DataFrame:
    wholes, parts = _languages(spark, folder)
    return wholes.select("doc_id", F.lit("sections").alias("field"), F.lit(0).alias("seg"), "lang", "confidence").unionByName(parts).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = splitting.split_oversized(table(spark, folder, "article_section"), table(spark, folder, "section_limits"), copies=True)
    return cut.filter("piece = 1").select(F.col("key").alias("section_id"), "forced").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "article_section"), table(spark, folder, "section_limits")).withColumnRenamed("key", "section_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pairs.defective(table(spark, folder, "tamanh_qa"), "qa_id", "patient_question", "doctor_answer")
    return found.select(F.col("key").alias("qa_id"), "defect")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encoded(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").withColumn("at", F.struct("doc_id", "source"))
    counts = encoding.encoded(documents, "at", "text", counts_only=True)
    return materialise(counts.select("key.doc_id", "key.source", "n_tokens"), "token-counts")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    drawn = mixing.mixed(_sized(spark, folder), table(spark, folder, "mix_targets"), "doc_id", "source", "n_tokens")
    return drawn.select(F.col("key").alias("doc_id"), "source", "n_tokens", F.explode(F.sequence(F.lit(1), "repeats")).alias("epoch"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    sized, targets = _sized(spark, folder).dropDuplicates(["doc_id"]), table(spark, folder, "mix_targets")
    drawn = mixing.mixed(sized, targets, "doc_id", "source", "n_tokens")
    return mixing.shares(sized, drawn, targets, "source", "n_tokens")


LABELS = ["DISEASE", "SYMPTOM", "CAUSE", "DIAGNOSTIC", "TREATMENT", mentions.NONE]


def _consensus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    articles, names = table(spark, folder, "article_extraction"), table(spark, folder, "label_names")
    item = F.struct("document_id", "start_pos").alias("item")
    votes = mentions.expert_votes(table(spark, folder, "expert_reviews"), articles, names)
    settled = mentions.settled_labels(table(spark, folder, "reviewer_adjudications"), articles, names)
    votes = consensus.prepared(votes.select(item, F.col("expert_id").alias("annotator"), "label"))
    return consensus.consensus(votes, LABELS, settled.select(item, "label"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    items, _ = _consensus(spark, folder)
    return items.filter("n_votes >= 3").select("item.document_id", "item.start_pos", "label")


def p4_agreement(spark: SparkSession, folder: str) -> DataFrame:
    items, _ = _consensus(spark, folder)
    return items.select("item.document_id", "item.start_pos", "label", "agreement", "confidence", "n_votes")


def p4_experts(spark: SparkSession, folder: str) -> DataFrame:
    _, skills = _consensus(spark, folder)
    return skills.withColumnRenamed("annotator", "expert_id")


def _similar(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    articles, answers = table(spark, folder, "article_extraction"), table(spark, folder, "tamanh_qa")
    abstracts = articles.select(F.lit("abstract").alias("field"), F.col("doc_id").alias("id"), F.col("abstract").alias("text"))
    both = abstracts.unionByName(answers.select(F.lit("doctor_answer").alias("field"), F.col("qa_id").alias("id"), F.col("doctor_answer").alias("text")))
    return neardup.similar_records(both, "field", "id", "text", min_words=60, t=0.5)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = _similar(spark, folder)
    return neardup.pairs_of(members, links).select(F.col("grp").alias("field"), F.col("a_key").alias("a_id"), F.col("b_key").alias("b_id"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: class_id is the least id of its group of similar records, links the number of other texts it is similar to."""
    members, links = _similar(spark, folder)
    counts = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    grouped = neardup.groups(members, links).join(counts, "class_id", "left").na.fill(0, ["links"])
    return grouped.select(F.col("grp").alias("field"), F.col("key").alias("id"), F.col("group_key").alias("class_id"), "links")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_shares(spark, folder).select("doc_id", "subject")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_areas(table(spark, folder, "documents"), table(spark, folder, "subject_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_languages, p2_found, p2_pieces, p6_found, p6_groups, p3_found, p3_clean, p4_found, p4_agreement, p4_experts, p5_found, p5_classes, p7_found, p8_ids, p9_mix, p9_shares, p10_found, p10_shares)}
