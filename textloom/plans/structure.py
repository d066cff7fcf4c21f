"""Sections and the language gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import langgate as L, structure as P
from textloom.plans.registry import query
from textloom.plans.views import articles, rows

_S = "(select distinct * from article_section)"


@query()
def section_types(spark, folder):
    """Headings classified."""
    s = rows(spark, folder, "article_section").filter("heading is not null").groupBy("heading", "canonical_type").agg(F.count("*").alias("n"))
    return s.withColumn("found", P.section_type(F.col("heading"))).select("heading", "canonical_type", "n", F.col("found.type").alias("found_type"), "found.confidence")


@query(f"""with recursive t(ancestor, section_id, depth) as (select section_id, section_id, 0 from {_S} union all select t.ancestor, s.section_id, t.depth + 1 from t join {_S} s on s.parent_id = t.section_id where t.depth < 64)
select ancestor, count(*) as sections, cast(sum(coalesce(length(content), 0)) as bigint) as characters, max(depth) as depth from t join {_S} s using (section_id) group by 1""")
def section_rollup(spark, folder):
    """Size of each section with all below it."""
    s = rows(spark, folder, "article_section")
    d = P.descendants(s).join(s.select("section_id", F.coalesce(F.length("content"), F.lit(0)).alias("c")), "section_id")
    return d.groupBy("ancestor").agg(F.count("*").alias("sections"), F.sum("c").alias("characters"), F.max("depth").alias("depth"))


@query(f"""select s.section_id, (select p.section_id from {_S} p where p.doc_id = s.doc_id and p.ord < s.ord and p.level < s.level order by p.ord desc limit 1) as parent_id from {_S} s""")
def section_parents(spark, folder):
    """The tree out of levels in reading order."""
    s = rows(spark, folder, "article_section").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "section_id", "level"))).alias("s"))
    tree = F.explode(P.parents(F.transform("s", lambda x: F.struct(x["section_id"].alias("section_id"), x["level"].alias("level")))))
    return s.select(tree.alias("t")).select("t.section_id", "t.parent_id")


@query(f"""select doc_id, len(p) as present, list_sort(list_filter(['ABSTRACT','INTRODUCTION','METHODS','RESULTS','DISCUSSION','CONCLUSION','REFERENCES'], lambda x: not list_contains(p, x))) as missing
from (select doc_id, list_filter(list(distinct canonical_type), lambda x: x in ('ABSTRACT','INTRODUCTION','METHODS','RESULTS','DISCUSSION','CONCLUSION','REFERENCES')) p from {_S} group by 1)""")
def section_coverage(spark, folder):
    """P14."""
    s = rows(spark, folder, "article_section").groupBy("doc_id").agg(F.collect_set("canonical_type").alias("t"))
    want = F.array(*(F.lit(x) for x in P.EXPECTED))
    return s.select("doc_id", F.size(F.array_intersect(want, "t")).cast("long").alias("present"), F.sort_array(F.array_except(want, "t")).alias("missing"))


@query(f"""select section_id, ord, lead(ord) over (partition by doc_id order by ord, section_id) as next_ord from {_S}""")
def section_bounds(spark, folder):
    """Where a section ends."""
    s = rows(spark, folder, "article_section").withColumn("at", F.struct("ord", "section_id")).withColumn("none", F.lit(None).cast("struct<ord:int,section_id:string>"))
    return P.bounded(s, "doc_id", "at", "none").select("section_id", "ord", F.col("end_position.ord").alias("next_ord"))


@query(f"""select section_id, coalesce(length(trim(content)), 0) = 0 as empty, coalesce(regexp_matches(content, '(?i)issn|doi'), false) as framed from {_S}""")
def section_validation(spark, folder):
    """P10."""
    s = rows(spark, folder, "article_section")
    return s.select("section_id", (F.coalesce(F.length(F.trim("content")), F.lit(0)) == 0).alias("empty"), F.coalesce(F.col("content").rlike("(?i)issn|doi"), F.lit(False)).alias("framed"))


@query()
def language_gate(spark, folder):
    """Assessment and admission of abstracts."""
    a = articles(spark, folder, "abstract").select("doc_id", L.assessment(F.col("abstract")).alias("a"))
    return a.select("doc_id", "a.label", "a.vi_ratio", "a.en_ratio", "a.chars", L.admission(F.col("a")).alias("decision"))


@query()
def gate_review(spark, folder):
    """The gate over bodies against stored decisions."""
    body = rows(spark, folder, "article_section").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "section_id", "content"))), lambda s: F.coalesce(s["content"], F.lit(""))), "\n").alias("body"))
    a = articles(spark, folder).select("doc_id", "abstract", "source_pdf").join(body, "doc_id")
    decision = L.admission(L.assessment(L.text_to_assess(F.col("body"), F.col("abstract"))))
    audit = rows(spark, folder, "corpus_language_audit").select(F.col("article_id").alias("doc_id"), "decision_status")
    j = a.select("doc_id", decision.alias("decision"), L.quarantine_path(F.coalesce("source_pdf", F.lit("")), decision).alias("path")).join(audit, "doc_id")
    return j.groupBy("decision_status", "decision").agg(F.count("*").alias("n"), F.min("path").alias("example"))


@query()
def packed_sections(spark, folder):
    """Sections packed under a length, none cut."""
    s = rows(spark, folder, "article_section").filter("content is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "section_id", "content"))).alias("s"))
    packs = P.packed(F.transform("s", lambda x: x["content"]), 2000)
    return s.select("doc_id", F.posexplode(packs).alias("pack", "text")).select("doc_id", "pack", F.length("text").alias("n"))


def _layout(spark, folder):
    """Layout lines of sections as they would stand on pages: 20 lines a page, a running head on each."""
    lines = rows(spark, folder, "article_section", "section_id", "doc_id", "ord", "content").filter("content is not null").select("doc_id", "section_id", "ord", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    y = (F.col("i") % 20 + 1) * 40.0
    return lines.select("doc_id", F.concat_ws("-", "section_id", (F.col("i") / 20).cast("int")).alias("page"), "text", y.alias("y0"), F.lit(1000.0).alias("height"), F.when(F.col("i") == 0, 13.0).otherwise(10.0).alias("size"))


@query("""select doc_id, 10.0::double as body_size from (select doc_id, sum(case when i = 1 then length(t) else 0 end) as head, sum(case when i > 1 then length(t) else 0 end) as body from
(select doc_id, unnest(string_split(content, chr(10))) t, unnest(range(1, len(string_split(content, chr(10))) + 1)) i from (select distinct * from article_section where content is not null)) group by 1) where body >= head
union all select doc_id, 13.0::double from (select doc_id, sum(case when i = 1 then length(t) else 0 end) as head, sum(case when i > 1 then length(t) else 0 end) as body from
(select doc_id, unnest(string_split(content, chr(10))) t, unnest(range(1, len(string_split(content, chr(10))) + 1)) i from (select distinct * from article_section where content is not null)) group by 1) where body < head""")
def body_sizes(spark, folder):
    """The font size of most characters."""
    return P.body_size(_layout(spark, folder), "doc_id", "size", "text").withColumn("body_size", F.col("body_size").cast("double"))


@query()
def lines_without_frames(spark, folder):
    """Recurring margin lines taken out."""
    return P.without_frames(_layout(spark, folder), "doc_id", "page", "text", "y0", "height").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query()
def heading_candidates(spark, folder):
    """Lines scored as headings."""
    lines = _layout(spark, folder)
    sized = lines.join(P.body_size(lines, "doc_id", "size", "text"), "doc_id")
    return sized.select("doc_id", "page", "text", P.heading_score(F.col("text"), F.col("size"), F.col("body_size"), F.lit(0.0), F.lit(12.0)).alias("score")).filter("score >= 0.4")
