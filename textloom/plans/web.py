"""URLs and pages. Pages are stored HTML; here they are rendered from question-and-answer rows and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T, web as W
from textloom.operators import relational as R
from textloom.plans.registry import query
from textloom.plans.views import rows
from textloom.runtime import materialise

_A = "(select distinct * from corpus_language_audit)"
_Q = "(select distinct * from tamanh_qa)"
_HOST = r"nullif(regexp_replace(regexp_extract(lower(trim({c})), '^https?://([^/?#@]*@)?([^/?#:]+)', 2), '^(www|m)\.', ''), '')"
_CANON = r"""case when lower(regexp_extract({c}, '^([a-zA-Z]+)://', 1)) in ('http', 'https') and regexp_extract({c}, '^[a-zA-Z]+://([^/?#]+)', 1) <> '' then
lower(regexp_extract({c}, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract({c}, '^[a-zA-Z]+://([^/?#]+)', 1)) || regexp_replace(regexp_replace(regexp_extract({c}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/+$', '') || '/' end"""



def _host(c: str) -> str:
    return _HOST.replace("{c}", c)


def _canon(c: str) -> str:
    return _CANON.replace("{c}", c)


@query(f"select id, {_canon('trim(source_url)')} as url, {_host('source_url')} as host from {_A}")
def canonical_urls(spark, folder):
    """H01."""
    return rows(spark, folder, "corpus_language_audit").select("id", W.canonical_url("source_url").alias("url"), W.host("source_url").alias("host"))


@query(f"select {_host('source_url')} as host, count(*) as n, count(*) filter (where {_host('pdf_url')} = {_host('source_url')}) as same_site from {_A} group by 1")
def domain_counts(spark, folder):
    """H02, F10."""
    a = rows(spark, folder, "corpus_language_audit")
    return a.groupBy(W.host("source_url").alias("host")).agg(F.count("*").alias("n"), F.count_if(W.same_site("pdf_url", "source_url")).alias("same_site"))


@query(rf"select id, regexp_replace(regexp_replace(regexp_replace(source_url, '[?#].*$', ''), '(?i)/(issue|article|bai-viet|search|about|login|archive|archives)(/.*)?$', ''), '/+$', '') || '/issue/archive' as archive from {_A}")
def archive_urls(spark, folder):
    """H03."""
    return rows(spark, folder, "corpus_language_audit").select("id", W.archive_url("source_url").alias("archive"))


@query(rf"""select kind, count(*) as n from (select case when regexp_matches(lower(u), '/issue/archive') then 'archive' when regexp_matches(lower(u), '/issue/view/') then 'issue' when regexp_matches(lower(u), '/(article/view|bai-viet)/') then 'article'
when regexp_matches(lower(u), '[?&/](page|trang)[=/]?\d+') then 'page' when regexp_matches(lower(u), '/[a-z0-9-]+/\d+/?$') then 'detail' else 'other' end as kind from (select source_url u from {_A} union all select source_url from {_Q})) group by 1""")
def link_kinds(spark, folder):
    """H04."""
    u = rows(spark, folder, "corpus_language_audit").select(F.col("source_url").alias("u")).unionByName(rows(spark, folder, "tamanh_qa").select(F.col("source_url").alias("u")))
    return u.groupBy(W.link_kind("u").alias("kind")).agg(F.count("*").alias("n"))


def pages(spark, folder):
    q = rows(spark, folder, "tamanh_qa").filter("patient_question is not null and doctor_answer is not null and source_url is not null")
    div = lambda cls, c: F.concat(F.lit(f'<div class="{cls}">'), c, F.lit("</div>"))
    html = F.concat(
        F.lit('<html lang="vi"><head><title> '), T.markup_safe(F.coalesce("question_title", F.lit(""))), F.lit('</title><meta name="citation_year" content="'), F.coalesce(F.col("published_year").cast("string"), F.lit("")),
        F.lit('"/></head><body><a href="'), F.coalesce("category_url", F.lit("#")), F.lit('">x</a><a href="/tim-kiem?q=1">y</a>'), div("question", T.markup_safe(T.flat("patient_question"))), div("doctor", F.coalesce("doctor_name", F.lit(""))),
        F.lit('<div class="answer"><p>'), T.markup_safe(T.flat("doctor_answer")), F.lit("</p><p>Liên hệ tổng đài 1900</p></div></body></html>"),
    )
    return q.select("qa_id", "source_url", html.alias("html"))


_P = f"(select * from {_Q} where patient_question is not null and doctor_answer is not null and source_url is not null)"


@query(f"select qa_id, nullif(coalesce(cast(published_year as varchar), ''), '') as year, 'vi' as lang from {_P}")
def page_meta(spark, folder):
    """H06."""
    return pages(spark, folder).select("qa_id", W.meta("html", "citation_year").alias("year"), W.page_language("html").alias("lang"))


@query(f"""select qa_id, case when category_url is null then null else category_url end as link, 1 as n from {_P} where category_url is not null
union all select qa_id, regexp_extract(source_url, '^(https?://[^/?#]+)', 1) || '/tim-kiem?q=1', 1 from {_P}""")
def page_links(spark, folder):
    """Absolute links of pages."""
    p = pages(spark, folder).select("qa_id", "source_url", F.explode(W.links("html")).alias("href"))
    return p.select("qa_id", W.absolute_url("href", "source_url").alias("link"), F.lit(1).alias("n")).filter("link is not null")


@query()
def question_pages(spark, folder):
    """Pages read back; the flag says whether the question is that of the row."""
    parsed = pages(spark, folder).select("qa_id", W.question_page("html").alias("p"), W.page_title("html").alias("title"))
    q = rows(spark, folder, "tamanh_qa").select("qa_id", T.flat("patient_question").alias("asked"))
    return parsed.join(q, "qa_id").select("qa_id", "p.question", "p.doctor", "p.answer", "title", (F.col("p.question") == F.col("asked")).alias("same"))


@query(f"select category_url, count(*) as n from {_P} where not (starts_with('/' || regexp_extract(category_url, '^https?://[^/?#]+/?([^#]*)', 1), '/nhi')) group by 1")
def allowed_pages(spark, folder):
    """H11."""
    q = rows(spark, folder, "tamanh_qa").filter("patient_question is not null and doctor_answer is not null and source_url is not null and category_url is not null")
    return q.filter(W.allowed_by_robots("category_url", ["/nhi"])).groupBy("category_url").agg(F.count("*").alias("n"))


@query(f"""with recursive e as (select distinct category_url a, source_url b from {_Q} where category_url is not null and source_url is not null union select distinct regexp_replace(category_url, '/[^/]*$', ''), category_url from {_Q} where category_url is not null),
f(u, depth) as (select min(a), 0 from e where a not in (select b from e) union select e.b, f.depth + 1 from f join e on e.a = f.u where f.depth < 4)
select u as url, min(depth) as depth from f group by 1""")
def crawl_order(spark, folder):
    """Breadth-first from a root over a link table, each page once; one anti join a level, driven by levels and not by pages."""
    q = rows(spark, folder, "tamanh_qa").filter("category_url is not null")
    edges = q.filter("source_url is not null").select(F.col("category_url").alias("a"), F.col("source_url").alias("b")).union(q.select(F.regexp_replace("category_url", "/[^/]*$", ""), "category_url")).distinct()
    return reached(edges, edges.join(edges.select(F.col("b").alias("a")), "a", "left_anti").agg(F.min("a").alias("url")), 4)


def reached(edges, roots, depth):
    """(url, depth) of what is reached from roots within depth links."""
    edges = materialise(edges, "links")
    seen = front = materialise(roots.withColumn("depth", F.lit(0)), "front")
    for d in range(1, depth + 1):
        found = edges.join(front, edges.a == front.url).select(F.col("b").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        front = materialise(found.withColumn("depth", F.lit(d)), "front")
        seen = seen.unionByName(front)
    return seen


@query(f"""with n as (select id, source_url, decision_status, validation_version from {_A} where validation_version = '2.0')
select o.source_url, coalesce(n.decision_status, o.decision_status) as decision_status, coalesce(n.validation_version, '1.0') as validation_version from (select distinct source_url, decision_status from {_A}) o left join (select source_url, max(decision_status) decision_status, max(validation_version) validation_version from n group by 1) n using (source_url)""")
def audit_upsert(spark, folder):
    """Rows of a new run put over an old table."""
    a = rows(spark, folder, "corpus_language_audit")
    old = a.select("source_url", "decision_status").distinct().withColumn("validation_version", F.lit("1.0"))
    new = a.filter("validation_version = '2.0'").groupBy("source_url").agg(F.max("decision_status").alias("decision_status"), F.max("validation_version").alias("validation_version"))
    return R.upsert(old, new, ["source_url"], keep=("decision_status",))


@query(f"select count(*) as waiting from {_A} where coalesce(validation_version, '') <> '2.0'")
def audits_to_repeat(spark, folder):
    """Only what was decided under another version."""
    a = rows(spark, folder, "corpus_language_audit").select("id", "validation_version")
    return R.remaining(a, a.filter("validation_version = '2.0'"), "id").agg(F.count("*").alias("waiting"))
