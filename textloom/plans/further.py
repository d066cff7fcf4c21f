"""Queries over replacement, rounds, systems side by side, alias upkeep and alignment before scoring."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from textloom.functions import text as T
from textloom.operators import bio as B, dictionary as D, relational as R, spans as S, structure as P
from textloom.plans.annotation import _FOLD, _GOLD, _SYS, expert_spans, system_spans
from textloom.plans.registry import query
from textloom.plans.review import _SQL_DECIDED, decided
from textloom.plans.views import SQL_ARTICLES, SQL_DICTIONARY, SQL_REVIEWS, articles, dictionary, marks, reviews_in_force, rows, sql_marks
from textloom.runtime import table

_R = "(select distinct * from expert_reviews)"
_J = "(select distinct * from reviewer_adjudications)"
_S = "(select distinct * from article_section)"


def _system(spark, folder):
    return system_spans(spark, folder).select("doc_id", "start", "end", F.col("category").alias("label")).distinct()


@query(f"select doc_id, s as start_pos, e as end_pos, label from {_SYS} where doc_id not in (select doc_id from {_GOLD}) union all select doc_id, s, e, label from {_GOLD}")
def replaced_labels(spark, folder):
    """A document's labels replaced as a whole: all old ones out, the new ones in."""
    r = R.replaced(_system(spark, folder), expert_spans(spark, folder).select("doc_id", "start", "end", "label"), "doc_id")
    return r.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "label")


@query(f"""select round, errors, coalesce(errors >= lag(errors) over (order by round), false) as stop from (select year(created_at) * 100 + month(created_at) as round, count(*) as errors from {_R} where upper(trim(review_status)) <> 'CORRECT' group by 1)""")
def stop_rounds(spark, folder):
    """Rounds (months) whose errors have not fallen against the round before. One row a round."""
    r = rows(spark, folder, "expert_reviews", "id", "review_status", "created_at").filter("upper(trim(review_status)) != 'CORRECT'")
    n = r.groupBy((F.year("created_at") * 100 + F.month("created_at")).cast("long").alias("round")).agg(F.count("*").alias("errors"))
    return n.withColumn("stop", F.coalesce(F.col("errors") >= F.lag("errors").over(Window.orderBy("round")), F.lit(False)))


@query(f"""with n as (select section_id, strftime(extracted_at, '%d%m%Y') || '_' || coalesce(canonical_type, 'x') || '_' || lpad(cast(doc_id % 10000 as varchar), 4, '0') || '.txt' as old from {_S}),
m as (select section_id, old, regexp_replace(old, '^(\\d{{8}})_.*_(\\d{{4}})\\.txt$', '\\1_\\2.txt') as new from n)
select section_id, new as new_name, count(*) over (partition by new) > 1 as conflict from m""")
def dated_names(spark, folder):
    """Dated file names shortened, with those that would meet."""
    s = rows(spark, folder, "article_section", "section_id", "doc_id", "canonical_type", "extracted_at")
    old = F.concat(F.date_format("extracted_at", "ddMMyyyy"), F.lit("_"), F.coalesce("canonical_type", F.lit("x")), F.lit("_"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit(".txt"))
    named = s.select("section_id", T.dated_name(old).alias("new_name"))
    met = named.groupBy("new_name").agg(F.count("*").alias("n"))
    return named.join(met, "new_name").select("section_id", "new_name", (F.col("n") > 1).alias("conflict"))


def _sql_source(name: str) -> str:
    return f"""(select document_id d, m.start s, m."end" e, min(m.category) c from (select document_id, unnest({sql_marks("original_labels_json")}) m from {_R} where label_source = '{name}') where m.start is not null and m."end" > m.start group by 1, 2, 3)"""


def _source(spark, folder, name):
    r = rows(spark, folder, "expert_reviews", "id", "document_id", "label_source", "original_labels_json").filter(F.col("label_source") == name)
    m = r.select(F.col("document_id").alias("doc_id"), F.explode(marks("original_labels_json")).alias("m")).filter("m.start is not null and m.end > m.start")
    return m.groupBy("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("end")).agg(F.min("m.category").alias("label"))


@query(f"""select case when b.c is null then 'only_ai' when a.c is null then 'only_icd10' when a.c = b.c then 'same' else 'changed' end as state, count(*) as n from {_sql_source("ai")} a full join {_sql_source("icd10")} b using (d, s, e) group by 1""")
def model_differences(spark, folder):
    """The labels of two sources side by side, by place."""
    c = R.compared(_source(spark, folder, "ai"), _source(spark, folder, "icd10"), ["doc_id", "start", "end"], ["label"])
    state = F.element_at(F.create_map(*(F.lit(x) for x in ("left_only", "only_ai", "right_only", "only_icd10", "same", "same", "changed", "changed"))), F.col("status"))
    return c.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


_RATE = lambda n, d: f"case when {d} > 0 then {n} / {d} else 0 end"


def _sql_deltas(docs: str) -> str:
    return f"""with g as (select * from {_GOLD} where doc_id in ({docs})), a as (select d doc_id, s, e, c label from {_sql_source("ai")} where d in (select doc_id from g)), b as (select d doc_id, s, e, c label from {_sql_source("icd10")} where d in (select doc_id from g)),
t as (select (select count(*) from g) as g, (select count(*) from a) as na, (select count(*) from b) as nb, (select count(*) from a join g using (doc_id, s, e, label)) as ta, (select count(*) from b join g using (doc_id, s, e, label)) as tb)
select round(100 * ({_RATE("tb", "nb")} - {_RATE("ta", "na")}), 4) as precision_pp, round(100 * ({_RATE("tb", "g")} - {_RATE("ta", "g")}), 4) as recall_pp, round(100 * ({_RATE("2 * tb", "(nb + g)")} - {_RATE("2 * ta", "(na + g)")}), 4) as f1_pp from t"""


@query(_sql_deltas(f"select doc_id from {_GOLD}"))
def source_deltas(spark, folder, first: int | None = None):
    """Precision, recall and F1 of two sources against gold, in points of difference."""
    g = expert_spans(spark, folder)
    if first:
        g = g.join(g.select("doc_id").distinct().orderBy("doc_id").limit(first), "doc_id", "left_semi")
    docs, keys = g.select("doc_id").distinct(), ["doc_id", "start", "end", "label"]

    def counts(name):
        p = _source(spark, folder, name).join(docs, "doc_id", "left_semi")
        hit = p.join(g.select(*keys).withColumn("hit", F.lit(1)), keys, "left")
        return hit.agg(F.count("*").alias("n"), F.count("hit").alias("t"))

    rate = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    one = counts("ai").toDF("na", "ta").crossJoin(counts("icd10").toDF("nb", "tb")).crossJoin(g.agg(F.count("*").alias("g")))  # frames of one row
    c = F.col
    diff = lambda x, y: F.round(100 * (x - y), 4)
    return one.select(
        diff(rate(c("tb"), c("nb")), rate(c("ta"), c("na"))).alias("precision_pp"),
        diff(rate(c("tb"), c("g")), rate(c("ta"), c("g"))).alias("recall_pp"),
        diff(rate(2 * c("tb"), c("nb") + c("g")), rate(2 * c("ta"), c("na") + c("g"))).alias("f1_pp"),
    )


@query(_sql_deltas(f"select distinct doc_id from {_GOLD} order by 1 limit 100"))
def first_hundred_deltas(spark, folder):
    """The same over the first hundred documents with gold (the limit is the feature)."""
    return source_deltas(spark, folder, 100)


@query(f"""with p as (select document_id, sha256(original_labels_json) k, max(id) as parent_id from {_R} where created_at < timestamp '2023-01-01' and original_labels_json is not null and json_valid(annotations_json) group by 1, 2)
select r.id, p.parent_id from {_R} r join p on p.document_id = r.document_id and p.k = sha256(r.original_labels_json) where r.created_at >= timestamp '2023-01-01'""")
def inherited_results(spark, folder):
    """Later rows that may take over the result of an earlier one of the same document and the same input bytes, if that has no fault."""
    r = rows(spark, folder, "expert_reviews", "id", "document_id", "created_at", "original_labels_json", "annotations_json").filter("original_labels_json is not null")
    r = r.withColumn("k", F.sha2("original_labels_json", 256))
    cut = F.expr("timestamp_ntz '2023-01-01'")
    parent = r.filter((F.col("created_at") < cut) & marks("annotations_json").isNotNull()).groupBy("document_id", "k").agg(F.max("id").alias("parent_id"))
    return r.filter(F.col("created_at") >= cut).join(parent, ["document_id", "k"]).select("id", "parent_id")


@query(f"""with m as (select r.id, r.document_id, m.text t, m.start s, m."end" e, m.category c from (select id, document_id, unnest({sql_marks("annotations_json")}) m from {_R}) r where length(m.text) > 0),
a as (select m.*, abstract, (length(abstract) - length(replace(abstract, t, ''))) // length(t) as n from m join (select doc_id, min(abstract) abstract from {SQL_ARTICLES} where abstract is not null group by 1) x on x.doc_id = m.document_id),
p as (select distinct id, case when substring(abstract, s + 1, e - s) is not distinct from t then s when n = 1 then instr(abstract, t) - 1 end as place, t, coalesce((select max(entity_label) from label_names l where lower(trim(l.alias)) = lower(trim(c))), 'OTHER') as label from a)
select label, count(*) as n, count(*) filter (where place is null) as unaligned from p group by 1""")
def aligned_predictions(spark, folder):
    """Annotations before scoring: put where their text stands (as given, or if it stands only once), category names resolved, repeats dropped."""
    m = rows(spark, folder, "expert_reviews", "id", "document_id", "annotations_json").select("id", F.col("document_id").alias("doc_id"), F.explode(marks("annotations_json")).alias("m")).filter("length(m.text) > 0")
    a = m.join(articles(spark, folder, "abstract").filter("abstract is not null").groupBy("doc_id").agg(F.min("abstract").alias("abstract")), "doc_id")
    shown = F.substring("abstract", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).eqNullSafe(F.col("m.text"))
    once = F.expr("(length(abstract) - length(replace(abstract, m.text, ''))) div length(m.text)") == 1
    at = F.when(shown, F.col("m.start")).when(once, F.expr("locate(m.text, abstract)") - 1)
    names = rows(spark, folder, "label_names").groupBy(F.lower(F.trim("alias")).alias("a")).agg(F.max("entity_label").alias("entity_label"))
    p = a.select("id", at.alias("at"), F.col("m.text").alias("t"), F.lower(F.trim("m.category")).alias("a")).join(names, "a", "left")
    p = p.select("id", "at", "t", F.coalesce("entity_label", F.lit("OTHER")).alias("label")).distinct()
    return p.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("at").isNull()).alias("unaligned"))


_ADDED = f"""(select id, lower(m.text) as term, m.text as surface, m.code as code from (select id, unnest({sql_marks("annotations_json")}) m from {_R}) where upper(trim(m.action)) = 'ADD' and m.text is not null)"""


def _added(spark, folder):
    m = rows(spark, folder, "expert_reviews", "id", "annotations_json").select("id", F.explode(marks("annotations_json")).alias("m")).filter("upper(trim(m.action)) = 'ADD' and m.text is not null")
    return m.select("id", F.lower("m.text").alias("term"), F.col("m.text").alias("surface"), F.col("m.code").alias("code"))


@query(f"""select term, code, case when code is null or not exists (select 1 from {SQL_DICTIONARY} d where d.code = x.code) then 'unknown_code' when exists (select 1 from {SQL_DICTIONARY} d where d.term = x.term) then 'exists' else 'added' end as state from (select distinct term, code from {_ADDED}) x""")
def saved_aliases(spark, folder):
    """Proposed aliases: only codes that the dictionary has, keys that it has are skipped; the report says which is which."""
    d = dictionary(spark, folder)
    p = _added(spark, folder).select("term", "code").distinct()
    p = p.join(d.select("code").distinct().withColumn("known", F.lit(True)), "code", "left").join(d.select("term").withColumn("there", F.lit(True)), "term", "left")
    return p.select("term", "code", F.when(F.col("known").isNull(), "unknown_code").when(F.col("there"), "exists").otherwise("added").alias("state"))


@query(f"""with a as (select term, code, arg_max(surface, (id, surface)) as surface from {_ADDED} where length(term) >= 3 and code is not null group by 1, 2)
select term, code, surface, regexp_replace(surface, '[^\\p{{L}}]', '', 'g') <> '' and regexp_replace(surface, '[^\\p{{L}}]', '', 'g') = upper(regexp_replace(surface, '[^\\p{{L}}]', '', 'g')) and length(surface) <= 6 as case_sensitive, count(*) over (partition by term) > 1 as ambiguous from a""")
def collected_aliases(spark, folder):
    """Aliases of at least three characters, one per term and code (the last counts); short ones in capitals are case-sensitive; those of
    several codes are ambiguous."""
    a = _added(spark, folder).filter("length(term) >= 3 and code is not null").groupBy("term", "code").agg(F.max(F.struct("id", "surface")).alias("b")).select("term", "code", F.col("b.surface").alias("surface"))
    n = a.groupBy("term").agg(F.count("*").alias("n"))
    return a.join(n, "term").select("term", "code", "surface", (T.all_capitals("surface") & (F.length("surface") <= 6)).alias("case_sensitive"), (F.col("n") > 1).alias("ambiguous"))


_SOURCES = f"""(select term, code, 'icd' as source, 1 as p from {SQL_DICTIONARY} union all select term, min(code), 'custom', 3 from {_ADDED} where code is not null group by 1)"""
_SQL_KEY = "array_to_string(regexp_extract_all(replace(lower(nfc_normalize(term)), 'ß', 'ss'), '[\\p{L}\\p{N}\\p{M}]+'), ' ')"


@query(f"""select key, arg_max(source, (p, code)) as source, count(distinct source) as sources from (select *, {_SQL_KEY} as key from {_SOURCES}) where length(key) > 0 group by 1""")
def prioritised_keys(spark, folder):
    """Two dictionaries in one; where both have a key, the source of greater priority holds it."""
    icd = dictionary(spark, folder).select("term", "code", "category", F.lit("icd").alias("source"), F.lit("canonical").alias("alias_type"), F.lit(1).alias("seq"))
    own = _added(spark, folder).filter("code is not null").groupBy("term").agg(F.min("code").alias("code"))
    own = own.select("term", "code", F.lit(None).cast("string").alias("category"), F.lit("custom").alias("source"), F.lit("alias").alias("alias_type"), F.lit(1).alias("seq"))
    both = icd.unionByName(own)
    n = both.select(T.match_key("term").alias("key"), "source").groupBy("key").agg(F.countDistinct("source").alias("sources"))
    return D.resolved_keys(both).join(n, "key").select("key", "source", "sources")


@query(f"""with l as (select unnest(['DISEASE', 'SYMPTOM', 'CAUSE', 'DIAGNOSTIC', 'TREATMENT']) as label), s as (select distinct label_source from {_R}),
c as (select label_source, m.category as label, count(*) as n from (select label_source, unnest({sql_marks("original_labels_json")}) m from {_R}) group by 1, 2)
select s.label_source, l.label, coalesce(c.n, 0) as n from s cross join l left join c on c.label_source is not distinct from s.label_source and c.label = l.label""")
def labels_by_source(spark, folder):
    """Labels per source over the whole label domain, zeros included."""
    labels = ["DISEASE", "SYMPTOM", "CAUSE", "DIAGNOSTIC", "TREATMENT"]
    r = rows(spark, folder, "expert_reviews", "id", "label_source", "original_labels_json")
    wide = r.select("label_source", F.explode_outer(marks("original_labels_json")).alias("m")).groupBy("label_source").agg(*(F.count_if(F.col("m.category") == x).alias(x) for x in labels))
    return wide.select("label_source", F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in labels))).alias("c")).select("label_source", "c.label", "c.n")


@query(f"""with t as (select lower(m.text) term, m.text surface, m.category c from (select unnest({sql_marks("original_labels_json")}) m from {_R}) where m.text is not null),
s as (select term, surface, count(*) k from t group by 1, 2), u as (select term, min(c) as label, count(*) as n from t group by 1 having count(distinct c) = 1)
select term, label, n, (select surface from s where s.term = u.term order by k desc, surface limit 1) as surface from u""")
def lexicon_surfaces(spark, folder):
    """Terms of one label only, with their frequency and most common surface (ties: the least)."""
    m = rows(spark, folder, "expert_reviews", "id", "original_labels_json").select(F.explode(marks("original_labels_json")).alias("m")).filter("m.text is not null")
    s = m.groupBy(F.lower("m.text").alias("term"), F.col("m.text").alias("surface")).agg(F.count("*").alias("k"), F.min("m.category").alias("lo"), F.max("m.category").alias("hi"))
    u = s.groupBy("term").agg(F.min("lo").alias("label"), F.max("hi").alias("hi"), F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("o"), "surface")).alias("b"))
    return u.filter("label = hi").select("term", "label", "n", F.col("b.surface").alias("surface"))


@query(f"""with g as (select doc_id, row_number() over (order by doc_id) as i from (select distinct doc_id from {_GOLD})), p as (select doc_id, row_number() over (order by doc_id) as i from (select distinct doc_id from {_SYS} where doc_id % 7 <> 0))
select g.doc_id, coalesce(a.doc_id, b.doc_id) as predicted, case when a.doc_id is not null then 'id' when b.doc_id is not null then 'position' else 'none' end as found_by from g left join p a on a.doc_id = g.doc_id left join p b on b.i = g.i""")
def predictions_by_position(spark, folder):
    """Each gold document's prediction by its id, else by its place in the file (every seventh prediction here has lost its id)."""
    at = lambda df: R.sequence_ids(df.select("doc_id").distinct(), F.lit("i"), [F.col("doc_id")]).select("doc_id", F.substring_index("seq_id", "_", -1).cast("long").alias("i"))
    g, p = at(expert_spans(spark, folder)), at(_system(spark, folder).filter("doc_id % 7 != 0"))
    j = g.join(p.select("doc_id", F.col("doc_id").alias("own")), "doc_id", "left").join(p.select("i", F.col("doc_id").alias("placed")), "i", "left")
    return j.select("doc_id", F.coalesce("own", "placed").alias("predicted"), F.when(F.col("own").isNotNull(), "id").when(F.col("placed").isNotNull(), "position").otherwise("none").alias("found_by"))


@query(f"""with u as (select doc_id, s, e, label, 1 as src from {_SYS} union all select doc_id, s, e, label, 2 from {_GOLD}), t as (select doc_id, s, e, count(distinct label) labels, count(distinct src) srcs, max(src) src from u group by 1, 2, 3)
select case when labels > 1 then 'LABEL_CONFLICT' when exists (select 1 from t o where o.doc_id = t.doc_id and o.s < t.e and t.s < o.e and (o.s <> t.s or o.e <> t.e)) then 'BOUNDARY_VARIANT' when srcs > 1 then 'MULTI_SOURCE' when src = 2 then 'GOLD_ONLY' else 'AI_ONLY' end as kind, count(*) as n from t group by 1""")
def union_sources(spark, folder):
    """Kinds of the places in the union of predictions and gold; the first that holds."""
    u = _system(spark, folder).withColumn("src", F.lit(1)).unionByName(expert_spans(spark, folder).select("doc_id", "start", "end", "label").withColumn("src", F.lit(2)))
    t = u.groupBy("doc_id", "start", "end").agg(F.countDistinct("label").alias("labels"), F.countDistinct("src").alias("srcs"), F.max("src").alias("src"))
    places = t.select("doc_id", "start", "end")
    v = S.overlap_join(places, places, ["doc_id"]).filter("l_start != r_start or l_end != r_end").select("doc_id", F.col("l_start").alias("start"), F.col("l_end").alias("end")).distinct().withColumn("v", F.lit(True))
    kind = F.when(F.col("labels") > 1, "LABEL_CONFLICT").when(F.col("v"), "BOUNDARY_VARIANT").when(F.col("srcs") > 1, "MULTI_SOURCE").when(F.col("src") == 2, "GOLD_ONLY").otherwise("AI_ONLY")
    return t.join(v, ["doc_id", "start", "end"], "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""select case when exists (select 1 from {_GOLD} g where g.doc_id = p.doc_id and g.s = p.s and g.e = p.e) then 'LABEL' when exists (select 1 from {_GOLD} g where g.doc_id = p.doc_id and g.s < p.e and p.s < g.e) then 'BOUNDARY' else 'NEW' end as kind, count(*) as n
from {_SYS} p where p.doc_id in (select doc_id from {_GOLD}) and not exists (select 1 from {_GOLD} g where (g.doc_id, g.s, g.e, g.label) = (p.doc_id, p.s, p.e, p.label)) group by 1""")
def prediction_audit(spark, folder):
    """Predictions that gold lacks, by how they lie to it."""
    g = expert_spans(spark, folder).select("doc_id", "start", "end", "label")
    p = _system(spark, folder).join(g.select("doc_id").distinct(), "doc_id", "left_semi").join(g, ["doc_id", "start", "end", "label"], "left_anti")
    same = g.select("doc_id", "start", "end").distinct().withColumn("same", F.lit(True))
    met = S.overlap_join(p, g.select("doc_id", "start", "end"), ["doc_id"]).select("doc_id", F.col("l_start").alias("start"), F.col("l_end").alias("end")).distinct().withColumn("met", F.lit(True))
    j = p.join(same, ["doc_id", "start", "end"], "left").join(met, ["doc_id", "start", "end"], "left")
    return j.groupBy(F.when(F.col("same"), "LABEL").when(F.col("met"), "BOUNDARY").otherwise("NEW").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""select state, count(*) as n from (select case when d.label is null then 'UNVERIFIED' when d.label = 'NONE' then 'VERIFIER_REJECTED' when d.label <> p.label then 'LABEL_CHANGED' else 'KEPT' end as state
from {_SYS} p left join (select document_id, s, min(label) as label from {_SQL_DECIDED} where expert_id = 7 group by 1, 2) d on d.document_id = p.doc_id and d.s = p.s) group by 1""")
def verifier_log(spark, folder):
    """Candidate spans kept, rejected or relabelled by one verifier."""
    d = decided(spark, folder).filter("expert_id = 7").groupBy(F.col("document_id").alias("doc_id"), F.col("s").alias("start")).agg(F.min("label").alias("verdict"))
    j = _system(spark, folder).join(d, ["doc_id", "start"], "left")
    state = F.when(F.col("verdict").isNull(), "UNVERIFIED").when(F.col("verdict") == "NONE", "VERIFIER_REJECTED").when(F.col("verdict") != F.col("label"), "LABEL_CHANGED").otherwise("KEPT")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(f"""select document_id, expert_id, count(*) as labels, count(distinct (s, label)) as places from {_SQL_DECIDED} where label <> 'NONE' group by 1, 2""")
def final_labels(spark, folder):
    """What an expert's decisions leave of a document's labels: deleted ones go."""
    d = decided(spark, folder).filter("label != 'NONE'")
    return d.groupBy("document_id", "expert_id").agg(F.count("*").alias("labels"), F.countDistinct(F.struct("s", "label")).alias("places"))


@query(f"""select id, document_id, coalesce(len({sql_marks("original_labels_json")}), 0) as labels, original_labels_json is not null and not json_valid(original_labels_json) as broken from {_R} where label_source = 'ai'""")
def all_machine_labels(spark, folder):
    """All label payloads of a source; one that cannot be parsed is empty."""
    r = rows(spark, folder, "expert_reviews", "id", "document_id", "label_source", "original_labels_json").filter("label_source = 'ai'").withColumn("m", marks("original_labels_json"))
    return r.select("id", "document_id", F.coalesce(F.when(F.col("m").isNotNull(), F.size("m")), F.lit(0)).cast("long").alias("labels"), (F.col("original_labels_json").isNotNull() & F.col("m").isNull()).alias("broken"))


@query(f"""select document_id, id, upper(trim(resolution_status)) as status from {_J} j where id = (select max(id) from {_J} x where x.document_id = j.document_id) and upper(trim(resolution_status)) <> 'RESOLVED'""")
def gold_drafts(spark, folder):
    """Documents whose adjudication in force is still a draft."""
    j = R.latest(rows(spark, folder, "reviewer_adjudications", "id", "document_id", "resolution_status").filter("document_id is not null"), ["document_id"], "id")
    return j.withColumn("status", F.upper(F.trim("resolution_status"))).filter("status != 'RESOLVED'").select("document_id", "id", "status")


@query(f"""select doc_id, list_filter(ks, lambda k, i: list_position(ks, k) = i) as supported from (select doc_id, list_filter(keywords, lambda k: length(regexp_replace(lower(k), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) >= 3 and contains(lower(abstract), lower(k))) as ks from {SQL_ARTICLES} where abstract is not null and keywords is not null)""")
def supported_values(spark, folder):
    """The keywords that the abstract bears out, each once, in order."""
    a = articles(spark, folder, "keywords", "abstract").filter("abstract is not null and keywords is not null")
    good = F.filter("keywords", lambda k: (F.length(F.regexp_replace(F.lower(k), r"[^\p{L}\p{N}]+", "")) >= 3) & F.lower("abstract").contains(F.lower(k)))
    return a.select("doc_id", F.array_distinct(good).alias("supported"))


@query("""select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) rn from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events) where prev is null or prev <> event_type) where rn <= 300""")
def kept_log(spark, folder):
    """Each user's log without repeats of the entry before, of it the last 300 (the limit is the feature)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events").withColumn("prev", F.lag("event_type").over(order)).filter("prev is null or prev != event_type")
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("rn <= 300").select("user_id", "event_id")


_YEAR = r"(?:^|\D)(20\d{2})(?:\D|$)"


@query(f"""select section_id, last_value(y ignore nulls) over (partition by doc_id order by ord, section_id rows between unbounded preceding and current row) as year from (select section_id, doc_id, ord, try_cast(nullif(regexp_extract(content, '{_YEAR}', 1), '') as int) as y from {_S})""")
def carried_years(spark, folder):
    """The nearest year named in or before each section."""
    s = rows(spark, folder, "article_section", "section_id", "doc_id", "ord", "content").withColumn("y", T.year_in("content"))
    return R.carried(s, ["doc_id"], [F.col("ord"), F.col("section_id")], "y", "year").select("section_id", "year")


@query(f"""with h as (select section_id, doc_id, ord, canonical_type t, row_number() over (partition by doc_id, canonical_type order by ord, section_id) rn, min(case when canonical_type = 'CONCLUSION' then ord end) over (partition by doc_id) as last from {_S} where heading is not null)
select section_id from h where (t is distinct from 'ABSTRACT' or rn = 1) and (last is null or ord <= last)""")
def kept_headings(spark, folder):
    """Headings of an article: one abstract, and none behind the closing section (conclusions here, as the tables hold no list of references)."""
    s = rows(spark, folder, "article_section", "section_id", "doc_id", "ord", "heading", "canonical_type").filter("heading is not null")
    own = Window.partitionBy("doc_id")
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "canonical_type").orderBy("ord", "section_id"))).withColumn("last", F.min(F.when(F.col("canonical_type") == "CONCLUSION", F.col("ord"))).over(own))
    return s.filter("(not canonical_type <=> 'ABSTRACT' or rn = 1) and (last is null or ord <= last)").select("section_id")


@query(f"""with l as (select doc_id, section_id, ord, level, lag(level) over w as pl, lag(ord) over w as po from {_S} window w as (partition by doc_id order by ord, section_id)),
g as (select *, sum(case when pl = level and ord - po <= 1 then 0 else 1 end) over (partition by doc_id order by ord, section_id) as grp from l)
select doc_id, grp as island, min(ord) as first, max(ord) as last, count(*) as lines, min(level) as level from g group by 1, 2""")
def line_groups(spark, folder):
    """Neighbouring lines of one size and small distance as groups (gaps and islands)."""
    w = Window.partitionBy("doc_id").orderBy("ord", "section_id")
    s = rows(spark, folder, "article_section", "section_id", "doc_id", "ord", "level")
    new = F.when((F.lag("level").over(w) == F.col("level")) & (F.col("ord") - F.lag("ord").over(w) <= 1), 0).otherwise(1)
    g = s.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("doc_id", "island").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("lines"), F.min("level").alias("level"))


@query(f"""with r as (select * from {_R}), b as (select label_source, count(*) as k from (select label_source, unnest({sql_marks("annotations_json")}) m from r) where lower(trim(m.category)) not in (select lower(trim(alias)) from label_names) group by 1)
select r.label_source, count(*) as n, round(count(*) filter (where annotations_json is not null and json_valid(annotations_json)) / count(*), 6) as valid_rate, count(*) filter (where annotations_json is null) as missing,
count(*) filter (where annotations_json is not null and not json_valid(annotations_json)) as parse_errors, coalesce(max(b.k), 0) as invalid_labels from r left join b on b.label_source is not distinct from r.label_source group by 1""")
def payload_counters(spark, folder):
    """Missing, broken and valid payloads and unknown labels per source."""
    names = table(spark, folder, "label_names").agg(F.collect_set(F.lower(F.trim("alias"))).alias("names"))  # a fixed table of aliases
    r = rows(spark, folder, "expert_reviews", "id", "label_source", "annotations_json").withColumn("m", marks("annotations_json")).crossJoin(F.broadcast(names))
    bad = F.size(F.filter("m", lambda m: ~F.array_contains("names", F.lower(F.trim(m["category"])))))
    n, there = F.count("*"), F.col("annotations_json").isNotNull()
    return r.groupBy("label_source").agg(n.alias("n"), F.round(F.count_if(F.col("m").isNotNull()) / n, 6).alias("valid_rate"), F.count_if(~there).alias("missing"), F.count_if(there & F.col("m").isNull()).alias("parse_errors"), F.coalesce(F.sum(F.when(F.col("m").isNotNull(), bad)), F.lit(0)).cast("long").alias("invalid_labels"))



@query(f"""select doc_id, case when reviewed then 'Đã duyệt' else 'Chờ duyệt' end as state_name from (select doc_id, doc_id in (select document_id from {SQL_REVIEWS}) as reviewed from {SQL_ARTICLES}) where not reviewed or doc_id % 2 = 0""")
def named_states(spark, folder):
    """a state computed from reviews, filtered, then named."""
    a = R.presence(articles(spark, folder, "title").select("doc_id"), "doc_id", reviewed=reviews_in_force(spark, folder).select(F.col("document_id").alias("doc_id")))
    return a.filter("not reviewed or doc_id % 2 = 0").select("doc_id", F.when(F.col("reviewed"), "Đã duyệt").otherwise("Chờ duyệt").alias("state_name"))


_PRIORITY = "list_position(['DISEASE', 'SYMPTOM', 'DIAGNOSTIC', 'TREATMENT', 'CAUSE'], label)"


@query(f"""with u as (select doc_id, s, e, label, 2 as source_rank from {_SYS} union select doc_id, s, e, label, 1 from {_GOLD}),
l as (select doc_id, list(struct_pack(s := s, e := e, label := label) order by source_rank, s - e, {_PRIORITY}, s, e) o from u group by 1)
select doc_id, len({_FOLD.format(order="o")}) as kept, len(o) as spans from l""")
def source_priority(spark, folder):
    """Overlaps resolved by source (gold before predictions), then length, then label."""
    order = F.array(*(F.lit(x) for x in ("DISEASE", "SYMPTOM", "DIAGNOSTIC", "TREATMENT", "CAUSE")))
    u = _system(spark, folder).withColumn("source_rank", F.lit(2)).unionByName(expert_spans(spark, folder).select("doc_id", "start", "end", "label").withColumn("source_rank", F.lit(1))).distinct()
    u = u.withColumn("priority", F.array_position(order, F.col("label")))
    sets = u.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "source_rank", "priority")).alias("s"))
    return sets.select("doc_id", F.size(S.resolved(F.col("s"), "source", ["label"])).cast("long").alias("kept"), F.size("s").cast("long").alias("spans"))


@query(f"""with t as (select doc_id, section_id, ord, case when canonical_type is null or canonical_type = 'OTHER' then 'O' else 'I-' || canonical_type end as tag from {_S} where heading is not null),
p as (select *, lag(tag) over (partition by doc_id order by ord, section_id) as prev from t)
select section_id, case when tag like 'I-%' and substring(coalesce(prev, 'O'), 3) <> substring(tag, 3) then 'B-' || substring(tag, 3) else tag end as tag from p""")
def repaired_tags(spark, folder):
    """Tags that only say inside (here the types of a document's sections) repaired, so that each run begins with B."""
    s = rows(spark, folder, "article_section", "section_id", "doc_id", "ord", "heading", "canonical_type").filter("heading is not null")
    tag = F.when(F.col("canonical_type").isNull() | (F.col("canonical_type") == "OTHER"), "O").otherwise(F.concat(F.lit("I-"), "canonical_type"))
    sets = s.withColumn("tag", tag).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "section_id", "tag"))).alias("t"))
    fixed = B.repaired(F.transform("t", lambda x: x["tag"]))
    return sets.select(F.explode(F.zip_with("t", fixed, lambda x, f: F.struct(x["section_id"].alias("section_id"), f.alias("tag")))).alias("x")).select("x.section_id", "x.tag")


@query(rf"""select term, list_sort(list_distinct([trim(regexp_replace(term, '[\s\x{{00a0}}]+', ' ', 'g')), trim(regexp_replace(regexp_replace(term, '\s*\([^()]*\)', ' ', 'g'), '[\s\x{{00a0}}]+', ' ', 'g')),
regexp_replace(trim(regexp_replace(regexp_replace(term, '\s*\([^()]*\)', ' ', 'g'), '[\s\x{{00a0}}]+', ' ', 'g')), '(?i)^u ác(?: của)? ', 'ung thư ')])) as names from {SQL_DICTIONARY}""")
def term_names(spark, folder):
    """The safe names of each term."""
    return dictionary(spark, folder).select("term", F.sort_array(T.aliases_of("term")).alias("names"))


_BLOCKS = f"(select doc_id, ord as block, coalesce(heading, '') || ' ' || coalesce(content, '') as text from {_S})"
_COMPACT = "regexp_replace(replace(strip_accents(lower({})), 'đ', 'd'), '[^a-z0-9]+', '', 'g')"


@query(f"""with c as (select s.doc_id, s.ord as block, min(coalesce(canonical_type, 'OTHER')) as name from {_S} s join {_BLOCKS} b on b.doc_id = s.doc_id and b.block = s.ord
where heading is not null and length({_COMPACT.format("heading")}) >= 3 and contains({_COMPACT.format("b.text")}, {_COMPACT.format("heading")}) group by 1, 2),
n as (select *, lead(block) over (partition by doc_id order by block) as until from c)
select n.doc_id, n.name, n.block, max(b.block) as last, count(*) as n, sum(length(b.text)) + count(*) - 1 as characters from n join {_BLOCKS} b on b.doc_id = n.doc_id and b.block >= n.block and (n.until is null or b.block < n.until) group by 1, 2, 3""")
def grounded_sections(spark, folder):
    """Proposed sections (headings and types of the tables) held against the blocks they name, with the text they reach over."""
    s = rows(spark, folder, "article_section", "section_id", "doc_id", "ord", "heading", "canonical_type", "content")
    blocks = s.select("doc_id", F.col("ord").alias("block"), F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))).alias("text"))
    proposed = s.filter("heading is not null").select("doc_id", F.coalesce("canonical_type", F.lit("OTHER")).alias("name"), F.col("ord").alias("block"), F.col("heading").alias("evidence"))
    return P.grounded(proposed, blocks).select("doc_id", "name", "block", "last", "n", F.length("text").cast("long").alias("characters"))


@query(f"""select section_id from {_S} s where ord >= coalesce((select min(ord) from {_S} f where f.doc_id = s.doc_id and canonical_type in ('ABSTRACT', 'INTRODUCTION')), ord)""")
def trimmed_fronts(spark, folder):
    """Sections from an article's front on: what stands before its abstract or introduction goes, where it has one."""
    s = rows(spark, folder, "article_section", "section_id", "doc_id", "ord", "canonical_type")
    front = s.filter("canonical_type in ('ABSTRACT', 'INTRODUCTION')").groupBy("doc_id").agg(F.min("ord").alias("front"))
    return s.join(front, "doc_id", "left").filter("front is null or ord >= front").select("section_id")
