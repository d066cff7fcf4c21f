"""Articles: lists, search, concepts, coverage, relational conformance."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dictionary as D, relational as R
from textloom.plans.registry import query
from textloom.plans.views import SQL_ARTICLES, SQL_DICTIONARY, articles, dictionary, rows, sql_ngrams
from textloom.runtime import materialise, table


def term_hits(spark, folder):
    """(doc_id, at, n, term, category): dictionary terms as runs of words of abstracts. Only words that begin a term meet the dictionary."""
    words = articles(spark, folder, "abstract").select("doc_id", F.regexp_extract_all(F.lower("abstract"), F.lit(T.WORD), F.lit(0)).alias("ws"))
    runs = F.transform("ws", lambda w, i: F.struct(w.alias("first"), (i + 1).alias("at"), F.slice("ws", i + 1, F.col("most")).alias("run")))
    terms = dictionary(spark, folder).select("term", "category", F.size(F.split("term", " ")).alias("n"), F.substring_index("term", " ", 1).alias("first"))
    terms = materialise(terms, "terms")  # read twice; its size is then known, and a small one is broadcast instead of shuffling words
    met = D.with_longest(words, terms).select("doc_id", F.explode(runs).alias("g")).select("doc_id", "g.*").join(terms, "first")
    return met.filter(F.array_join(F.slice("run", F.lit(1), F.col("n")), " ") == F.col("term")).select("doc_id", "at", "n", "term", "category")


@query(f"""select d.term as concept, d.category, count(*) as mentions, count(distinct g.doc_id) as documents
from {sql_ngrams(SQL_ARTICLES, "doc_id", "abstract")} g join {SQL_DICTIONARY} d on d.term = g.k
group by all order by documents desc, mentions desc, concept limit 50""")
def top_concepts(spark, folder):
    """The most frequent dictionary concepts of abstracts."""
    counts = term_hits(spark, folder).groupBy(F.col("term").alias("concept"), "category").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))
    return counts.orderBy(F.desc("documents"), F.desc("mentions"), "concept").limit(50)


@query(f"""select category, count(*) as mentions, round(count(*) / sum(count(*)) over (), 6) as share
from {sql_ngrams(SQL_ARTICLES, "doc_id", "abstract")} g join {SQL_DICTIONARY} d on d.term = g.k group by category""")
def concept_type_distribution(spark, folder):
    """Shares of concept types."""
    counts = term_hits(spark, folder).groupBy("category").agg(F.count("*").alias("mentions"))
    total = counts.agg(F.sum("mentions").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("category", "mentions", F.round(F.col("mentions") / F.col("all"), 6).alias("share"))


@query(f"""select doc_id, title as name, abstract is not null and abstract <> '' as has_abstract,
exists(select 1 from expert_reviews r where r.document_id = a.doc_id) as is_reviewed from {SQL_ARTICLES} a""")
def article_list_flags(spark, folder):
    """Projection, derived boolean, EXISTS as a column."""
    a = articles(spark, folder, "title", "abstract").select("doc_id", F.col("title").alias("name"), F.coalesce(F.col("abstract") != "", F.lit(False)).alias("has_abstract"))
    reviewed = table(spark, folder, "expert_reviews").select(F.col("document_id").alias("doc_id"))
    return R.presence(a, "doc_id", is_reviewed=reviewed)


def search(df, text: str = "", year_from: int | None = None, year_to: int | None = None, columns=("title",)):
    """predicates only for the parameters given; text blind to case and accents; unknown years pass."""
    if text:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(T.accentless_key(c).contains(T.accentless_key(F.lit(text))), F.lit(False))
        df = df.filter(found)
    if year_from is not None or year_to is not None:
        y = F.col("publication_year")
        df = df.filter(y.isNull() | y.between(year_from or 0, year_to or 9999))
    return df


_SQL_KEY = r"replace(strip_accents(array_to_string(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}\p{{M}}]+'), ' ')), 'đ', 'd')"


@query(f"""select doc_id, title from {SQL_ARTICLES} where contains({_SQL_KEY.format(c="title")}, 'tai phat') and (publication_year is null or publication_year between 2010 and 2020)""")
def article_search(spark, folder):
    return search(articles(spark, folder), "TÁI phát", 2010, 2020).select("doc_id", "title")


@query(f"select doc_id, trim(abstract) as abstract from {SQL_ARTICLES} where trim(abstract) <> ''")
def articles_with_text(spark, folder):
    """F05."""
    return articles(spark, folder).filter(F.trim("abstract") != "").select("doc_id", F.trim("abstract").alias("abstract"))


@query(f"select doc_id, title from {SQL_ARTICLES} order by doc_id desc limit 20 offset 40")
def page_slice(spark, folder):
    """A page of a total order."""
    return R.page(articles(spark, folder, "title"), [F.desc("doc_id")], 3, 20)


@query(f"""select unnest(['articles','with_abstract','audited','reviewed','adjudicated','reviewed_and_adjudicated','reviewed_only','adjudicated_only','neither']) as metric,
unnest([count(*), count(*) filter (where abstract <> ''), count(*) filter (where u), count(*) filter (where r), count(*) filter (where j), count(*) filter (where r and j), count(*) filter (where r and not j), count(*) filter (where j and not r), count(*) filter (where not r and not j)]) as n
from (select *, doc_id in (select article_id from corpus_language_audit where article_id is not null) u, doc_id in (select document_id from expert_reviews) r, doc_id in (select document_id from reviewer_adjudications) j from {SQL_ARTICLES})""")
def coverage_dashboard(spark, folder):
    """Presence quadrants in one scan."""
    key = lambda t, c: table(spark, folder, t).select(F.col(c).alias("doc_id"))
    a = R.presence(articles(spark, folder, "abstract"), "doc_id", u=key("corpus_language_audit", "article_id"), r=key("expert_reviews", "document_id"), j=key("reviewer_adjudications", "document_id"))
    n = lambda c, name: F.count_if(c).alias(name)
    u, r, j = F.col("u"), F.col("r"), F.col("j")
    flags = a.agg(F.count("*").alias("articles"), n(F.col("abstract") != "", "with_abstract"), n(u, "audited"), n(r, "reviewed"), n(j, "adjudicated"), n(r & j, "reviewed_and_adjudicated"), n(r & ~j, "reviewed_only"), n(j & ~r, "adjudicated_only"), n(~r & ~j, "neither"))
    return R.tall(flags)


@query(f"""select publication_year as stated_year, try_cast(regexp_extract(title, '(^|\\D)(20\\d{{2}})(\\D|$)', 2) as int) as title_year, count(*) as n from {SQL_ARTICLES} group by all""")
def year_consistency(spark, folder):
    """A22, H10."""
    return articles(spark, folder).groupBy(F.col("publication_year").alias("stated_year"), T.year_in("title").alias("title_year")).agg(F.count("*").alias("n"))


@query(f"""with a as (select {_SQL_KEY.format(c="title")} k, doc_id from {SQL_ARTICLES} where title is not null),
b as (select id, {_SQL_KEY.format(c="article_title")} k from (select distinct * from corpus_language_audit) where article_title is not null)
select b.id from b where not exists (select 1 from a where a.k = b.k)""")
def unmatched_titles(spark, folder):
    """Audit rows whose title no article has (keys equal instead of substring search in file names)."""
    audit = rows(spark, folder, "corpus_language_audit").select("id", T.accentless_key("article_title").alias("k")).filter("k is not null")
    return audit.join(articles(spark, folder).select(T.accentless_key("title").alias("k")), "k", "left_anti").select("id")


@query("""select n_name, r_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where o_orderstatus = 'F' group by all""")
def orders_by_nation(spark, folder):
    """A chain of inner joins; the fixed tables nation and region are broadcast."""
    o, c, n, r = (table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    j = o.filter("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))
    j = j.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.sum("k").alias("orders"), F.round(F.sum("s"), 2).alias("total"))


@query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as discount
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def line_summary(spark, folder):
    li = table(spark, folder, "lineitem").filter(F.col("l_shipdate") <= F.expr("timestamp_ntz '1998-09-02'"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""select rule, violations from (
select 'duplicate audit url' as rule, (select count(*) from (select source_url from (select distinct * from corpus_language_audit) group by 1 having count(*) > 1)) as violations
union all select 'section without article', (select count(*) from (select distinct * from article_section) s where not exists (select 1 from article_extraction a where a.doc_id = s.doc_id))
union all select 'review of unknown expert', (select count(*) from (select distinct * from expert_reviews) s where not exists (select 1 from users a where a.id = s.expert_id))
union all select 'unknown review status', (select count(*) from (select distinct * from expert_reviews) where upper(trim(review_status)) not in ('CORRECT','INCORRECT','NEEDS_REVISION'))
union all select 'seen last before first', (select count(*) from (select distinct * from corpus_language_audit) where last_seen_at < first_seen_at))""")
def integrity_report(spark, folder):
    """Keys, references and checks as validation queries."""
    audit, sections, reviews, users = (rows(spark, folder, t) for t in ("corpus_language_audit", "article_section", "expert_reviews", "users"))
    return R.integrity(
        {
            "duplicate audit url": audit.groupBy("source_url").count().filter("count > 1"),
            "section without article": sections.join(table(spark, folder, "article_extraction").select("doc_id"), "doc_id", "left_anti"),
            "review of unknown expert": reviews.join(users.select(F.col("id").alias("expert_id")), "expert_id", "left_anti"),
            "unknown review status": reviews.filter(~F.upper(F.trim("review_status")).isin("CORRECT", "INCORRECT", "NEEDS_REVISION")),
            "seen last before first": audit.filter("last_seen_at < first_seen_at"),
        }
    )
