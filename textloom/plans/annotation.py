"""Dictionary matching, spans, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import bio as B, dictionary as D, relational as R, spans as S
from textloom.plans.registry import query
from textloom.plans.views import SQL_ARTICLES, SQL_DICTIONARY, articles, dictionary, marks, rows, sql_marks, sql_ngrams, sql_placed, SQL_BLANK, SQL_PLAIN

_R = "(select distinct * from expert_reviews)"
_J = "(select * from (select distinct * from reviewer_adjudications) j where id = (select max(id) from reviewer_adjudications x where x.document_id = j.document_id) and upper(trim(resolution_status)) = 'RESOLVED')"


def entries(spark, folder):
    d = dictionary(spark, folder).select("term", "code", "category", F.lit("icd").alias("source"), F.lit("canonical").alias("alias_type"), F.lit(1).alias("seq"))
    return D.resolved_keys(d)


_KEYED = f"""(select arg_max(term, (term, code)) term, arg_max(code, (term, code)) code, arg_max(category, (term, code)) category, array_to_string(regexp_extract_all(term, '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), ' ') as key from {SQL_DICTIONARY} group by 4)"""


@query(f"select key, count(*) as n from {_KEYED} where length(key) > 0 group by 1")
def dictionary_keys(spark, folder):
    """One entry per key."""
    return entries(spark, folder).groupBy("key").agg(F.count("*").alias("n"))


_PL = "replace(strip_accents(key), 'đ', 'd')"


@query(f"""select {_PL} as plain, max_by(key, (length(key), key)) as key from {_KEYED} where {_PL} <> key and contains(key, ' ') group by 1 having count(distinct (code, category)) = 1""")
def accentless_index(spark, folder):
    """D05."""
    return D.accentless_index(entries(spark, folder)).select("plain", "key")


@query(f"""with k as {_KEYED}, idx as (select {_PL} as plain, max_by(code, (length(key), key)) as code from k where {_PL} <> key and contains(key, ' ') group by 1 having count(distinct (code, category)) = 1),
e as (select key, code, 'exact' as how from k union all select plain, code, 'accentless' from idx)
select e.how as matched_by, e.code, count(*) as n, count(distinct g.doc_id) as documents from {sql_ngrams(SQL_ARTICLES, "doc_id", "abstract")} g join e on e.key = g.k group by all""")
def dictionary_candidates(spark, folder):
    """All candidates, exact and accentless."""
    found = D.candidates(articles(spark, folder, "abstract"), "doc_id", "abstract", entries(spark, folder))
    return found.groupBy("matched_by", "code").agg(F.count("*").alias("n"), F.countDistinct("key").alias("documents"))


def matches(spark, folder):
    return D.longest_matches(D.candidates(articles(spark, folder, "abstract"), "doc_id", "abstract", entries(spark, folder)))


_CHOSEN = """list_reduce(list_concat([[]::struct(s int, e int, t varchar, code varchar, category varchar, how varchar)[]], list_transform(o, lambda x: [x])), lambda acc, x: case when len(list_filter(acc, lambda k: k.s < x[1].e and x[1].s < k.e)) > 0 then acc else list_concat(acc, x) end)"""
_WORDS = sql_placed(f"(select distinct doc_id, abstract from {SQL_ARTICLES} where abstract is not null)", "doc_id", "abstract", r"[\p{L}\p{N}\p{M}]+", r"[^\p{L}\p{N}\p{M}]+")
_MATCHES = f"""with k as (select *, len(string_split(key, ' ')) as n from {_KEYED} where length(key) > 0), idx as (select {_PL} as plain, any_value(code) as code, any_value(category) as category from k where {_PL} <> key and contains(key, ' ') group by 1 having count(distinct (code, category)) = 1),
e as (select key, code, category, 'exact' as how, 0 as rank from k union all select plain, code, category, 'accentless', 3 from idx),
w as (select doc_id, list(struct_pack(w := lower(word), s := s, e := e) order by pos) as ws from {_WORDS} group by 1),
g as (select doc_id, array_to_string(list_transform(ws[i:i+n-1], lambda x: x.w), ' ') as key, ws[i].s as s, ws[i+n-1].e as e from w, unnest(range(1, len(ws) + 1)) a(i), unnest(range(1, (select max(n) from k) + 1)) b(n) where i + n - 1 <= len(ws)),
c as (select doc_id, list(struct_pack(s := g.s, e := g.e, t := e.key, code := e.code, category := e.category, how := e.how) order by g.s - g.e, e.rank, g.s, e.code, e.key) as o from g join e using (key) group by 1),
m as (select doc_id, unnest({_CHOSEN}) as m from c)"""


@query(f"""{_MATCHES} select m.doc_id, m.m.s as start, m.m.e as "end", substring(a.abstract, m.m.s + 1, m.m.e - m.m.s) as text, m.m.code as code, m.m.category as category, m.m.how as matched_by, true as fits from m join (select distinct doc_id, abstract from {SQL_ARTICLES}) a using (doc_id)""")
def dictionary_matches(spark, folder):
    """The matches that stay; fits says whether the term's words stand in the abstract where the offsets say."""
    m = matches(spark, folder).join(articles(spark, folder, "abstract").select(F.col("doc_id").alias("key"), "abstract"), "key")
    shown = T.match_key(F.substring("abstract", F.col("start") + 1, F.col("end") - F.col("start")))
    fits = F.when(F.col("matched_by") == "accentless", T.no_accents(shown)).otherwise(shown) == F.col("term")
    return m.select(F.col("key").alias("doc_id"), "start", "end", "text", "code", "category", "matched_by", fits.alias("fits"))


@query()
def highlighted_articles(spark, folder):
    """Markup that is the text again once stripped."""
    m = matches(spark, folder).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "code"))).alias("spans"))
    a = articles(spark, folder, "abstract").select(F.col("doc_id").alias("key"), "abstract").join(m, "key")
    html = D.highlighted(F.col("abstract"), F.col("spans"))
    bare = F.regexp_replace(html, r"</?mark[^>]*>", "")
    return a.select(F.col("key").alias("doc_id"), html.alias("html"), (bare == T.markup_safe("abstract")).alias("same"))


_SP = f"""(select document_id as doc_id, m.start as s, m."end" as e, m.text as text, m.category as category, m.code as code from (select document_id, unnest({sql_marks("original_labels_json")}) m from {_R}) where m.start is not null and m."end" > m.start)"""


def system_spans(spark, folder):
    """(doc_id, start, end, text, category, code) of original labels, each once."""
    m = rows(spark, folder, "expert_reviews", "id", "document_id", "original_labels_json").select(F.col("document_id").alias("doc_id"), F.explode(marks("original_labels_json")).alias("m"))
    return m.select("doc_id", "m.start", "m.end", "m.text", "m.category", "m.code").filter("start is not null and end > start").distinct()


def expert_spans(spark, folder):
    """(doc_id, start, end, label): final labels of each document's adjudication in force (the greatest id), where it is resolved."""
    j = R.latest(rows(spark, folder, "reviewer_adjudications", "id", "document_id", "resolution_status", "final_labels_json"), ["document_id"], "id")
    m = j.filter("upper(trim(resolution_status)) = 'RESOLVED'").select(F.col("document_id").alias("doc_id"), F.explode(marks("final_labels_json")).alias("m"))
    return m.select("doc_id", "m.start", "m.end", F.col("m.category").alias("label")).filter("start is not null and end > start").distinct()


_GOLD = f"""(select distinct document_id as doc_id, m.start as s, m."end" as e, m.category as label from (select document_id, unnest({sql_marks("final_labels_json")}) m from {_J}) where m.start is not null and m."end" > m.start)"""
_SYS = f"(select distinct doc_id, s, e, category as label from {_SP})"


@query(f"""select p.doc_id, p.s as p_start, p.e as p_end, p.label as p_label, g.s as g_start, g.e as g_end, g.label as g_label,
round((least(p.e, g.e) - greatest(p.s, g.s)) / (greatest(p.e, g.e) - least(p.s, g.s)), 6) as iou from {_SYS} p join {_GOLD} g on p.doc_id = g.doc_id and p.s < g.e and g.s < p.e""")
def span_iou_pairs(spark, folder):
    """Overlapping pairs by bins, with their IoU."""
    p = system_spans(spark, folder).select("doc_id", "start", "end", F.col("category").alias("label")).distinct()
    j = S.overlap_join(p, expert_spans(spark, folder), ["doc_id"])
    iou = F.round(S.iou(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")), 6)
    return j.select("doc_id", F.col("l_start").alias("p_start"), F.col("l_end").alias("p_end"), F.col("l_label").alias("p_label"), F.col("r_start").alias("g_start"), F.col("r_end").alias("g_end"), F.col("r_label").alias("g_label"), iou.alias("iou"))


_FOLD = """list_reduce(list_concat([[]::struct(s int, e int, label varchar)[]], list_transform({order}, lambda x: [x])), lambda acc, x: case when len(list_filter(acc, lambda k: k.s < x[1].e and x[1].s < k.e)) > 0 then acc else list_concat(acc, x) end)"""


@query(f"""with u as (select doc_id, s, e, label from {_SYS}), l as (select doc_id, list(struct_pack(s := s, e := e, label := label) order by e - s desc, s, e, label) o, list(struct_pack(s := s, e := e, label := label) order by e - s, s, e, label) o2 from u group by 1)
select doc_id, len({_FOLD.format(order="o")}) as longest, len({_FOLD.format(order="o2")}) as shortest from l""")
def overlap_policies(spark, folder):
    """Two of the named policies."""
    p = system_spans(spark, folder).select("doc_id", F.struct("start", "end", F.col("category").alias("label")).alias("s")).distinct()
    sets = p.groupBy("doc_id").agg(F.collect_list("s").alias("s"))
    n = lambda policy: F.size(S.resolved(F.col("s"), policy, ["label"])).cast("long")
    return sets.select("doc_id", n("gold").alias("longest"), n("shortest").alias("shortest"))


@query(f"""with t as (select doc_id, s, e, count(distinct label) labels, count(*) n from {_SYS} group by all)
select case when labels > 1 then 'LABEL_CONFLICT' when exists (select 1 from {_SYS} o where o.doc_id = t.doc_id and o.s < t.e and t.s < o.e and (o.s <> t.s or o.e <> t.e)) then 'BOUNDARY_VARIANT' when exists (select 1 from {_GOLD} g where g.doc_id = t.doc_id and g.s = t.s and g.e = t.e) then 'MULTI_SOURCE' else 'ONE_SOURCE' end as kind, count(*) as n from t group by 1""")
def union_classes(spark, folder):
    """Kinds of spans in the union of systems."""
    p = system_spans(spark, folder).select("doc_id", "start", "end", F.col("category").alias("label")).distinct()
    t = p.groupBy("doc_id", "start", "end").agg(F.countDistinct("label").alias("labels"))
    places = t.select("doc_id", "start", "end")
    variant = S.overlap_join(places, places, ["doc_id"]).filter("l_start != r_start or l_end != r_end").select("doc_id", F.col("l_start").alias("start"), F.col("l_end").alias("end")).distinct().withColumn("v", F.lit(True))
    gold = expert_spans(spark, folder).select("doc_id", "start", "end").distinct().withColumn("g", F.lit(True))
    k = t.join(variant, ["doc_id", "start", "end"], "left").join(gold, ["doc_id", "start", "end"], "left")
    kind = F.when(F.col("labels") > 1, "LABEL_CONFLICT").when(F.col("v"), "BOUNDARY_VARIANT").when(F.col("g"), "MULTI_SOURCE").otherwise("ONE_SOURCE")
    return k.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""select count(*) as labels, count(*) filter (where ok) as verbatim, count(*) filter (where not ok and n = 1) as corrected, count(*) filter (where not ok and n <> 1) as rejected from (
select substring(abstract, m.start + 1, m."end" - m.start) is not distinct from m.text as ok, (length(abstract) - length(replace(abstract, m.text, ''))) // length(m.text) as n
from (select document_id, unnest({sql_marks("annotations_json")}) m from {_R}) r join (select distinct doc_id, abstract from article_extraction where abstract is not null) a on a.doc_id = r.document_id where length(m.text) > 0)""")
def offset_repair(spark, folder):
    """Offsets kept, corrected where the text stands once, or rejected."""
    m = rows(spark, folder, "expert_reviews").select(F.col("document_id").alias("doc_id"), F.explode(marks("annotations_json")).alias("m")).filter("length(m.text) > 0")
    j = m.join(articles(spark, folder, "abstract").filter("abstract is not null"), "doc_id")
    ok = F.substring("abstract", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).eqNullSafe(F.col("m.text"))
    n = F.expr("(length(abstract) - length(replace(abstract, m.text, ''))) div length(m.text)")
    return j.select(ok.alias("ok"), n.alias("n")).agg(F.count("*").alias("labels"), F.count_if("ok").alias("verbatim"), F.count_if(~F.col("ok") & (F.col("n") == 1)).alias("corrected"), F.count_if(~F.col("ok") & (F.col("n") != 1)).alias("rejected"))


def token_rows(spark, folder):
    """(doc_id, pos, word, start, end) of abstracts with gold labels."""
    a = articles(spark, folder, "abstract").join(expert_spans(spark, folder).select("doc_id").distinct(), "doc_id", "left_semi")
    return a.select("doc_id", F.posexplode(S.tokens(F.col("abstract"), "plain")).alias("pos", "t")).select("doc_id", "pos", "t.word", "t.start", "t.end")


_TOKENS = sql_placed(f"(select distinct doc_id, abstract from {SQL_ARTICLES} where abstract is not null and doc_id in (select doc_id from {_GOLD}))", "doc_id", "abstract", SQL_PLAIN, SQL_BLANK)
_TAGS = f"""(select t.doc_id, t.pos, t.word, t.s, t.e, case when g.s is null then 'O' when g.s = t.s then 'B-' || g.label else 'I-' || g.label end as tag from {_TOKENS} t left join
(select * from (select t.doc_id, t.pos, g.s, g.label, row_number() over (partition by t.doc_id, t.pos order by g.s, g.e desc, g.label) rn from {_TOKENS} t join {_GOLD} g on g.doc_id = t.doc_id and g.s <= t.s and t.e <= g.e) where rn = 1) g using (doc_id, pos))"""


@query(f"""select doc_id, pos, word, s as start, e as "end", tag from {_TAGS}""")
def token_tags(spark, folder):
    """Tags of tokens by gold spans."""
    return B.tagged(token_rows(spark, folder), expert_spans(spark, folder), ["doc_id"])


@query(f"""with t as (select *, lag(tag) over (partition by doc_id order by pos) as prev from {_TAGS}),
i as (select *, sum(case when tag like 'B-%' or (tag like 'I-%' and coalesce(substring(prev, 3) <> substring(tag, 3), true)) then 1 else 0 end) over (partition by doc_id order by pos) as island from t),
b as (select doc_id, island, min(s) as s, max(e) as e, arg_min(substring(tag, 3), pos) as label from i where tag <> 'O' group by 1, 2)
select g.doc_id, g.s as start, g.e as "end", g.label, exists (select 1 from b where (b.doc_id, b.s, b.e, b.label) = (g.doc_id, g.s, g.e, g.label)) as same from {_GOLD} g""")
def tags_round_trip(spark, folder):
    """Spans out of tags; same says whether a gold span comes back with its label and bounds."""
    back = B.to_spans(B.tagged(token_rows(spark, folder), expert_spans(spark, folder), ["doc_id"]), ["doc_id"]).select("doc_id", "start", "end", "label", F.lit(True).alias("same"))
    return expert_spans(spark, folder).join(back, ["doc_id", "start", "end", "label"], "left").withColumn("same", F.coalesce("same", F.lit(False)))


@query(f"""select label, count(*) as n, count(distinct doc_id) as documents from {_SYS} group by 1""")
def entity_counts(spark, folder):
    """A09."""
    p = system_spans(spark, folder).select("doc_id", "start", "end", F.col("category").alias("label")).distinct()
    return p.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(f"""select term, label, n from (select lower(text) term, min(category) as label, count(*) n, count(distinct category) c from {_SP} group by 1) where c = 1 and n >= 2""")
def unambiguous_lexicon(spark, folder):
    """Terms of one label only, met twice at least."""
    m = rows(spark, folder, "expert_reviews").select(F.explode(marks("original_labels_json")).alias("m")).filter("m.start is not null and m.end > m.start")
    t = m.groupBy(F.lower("m.text").alias("term")).agg(F.min("m.category").alias("label"), F.count("*").alias("n"), F.countDistinct("m.category").alias("c"))
    return t.filter("c = 1 and n >= 2").drop("c")


@query(f"""select doc_id, list_distinct(list_concat(case when o then ['offset'] else [] end, case when v then ['overlap'] else [] end)) as rules from
(select a.doc_id, bool_or(not (substring(a.abstract, s + 1, e - s) = text)) as o, bool_or(exists (select 1 from {_SP} y where y.doc_id = x.doc_id and y.s < x.e and x.s < y.e and (y.s, y.e, y.text, y.category, y.code) <> (x.s, x.e, x.text, x.category, x.code))) as v
from {_SP} x join (select distinct doc_id, abstract from article_extraction where abstract is not null) a on a.doc_id = x.doc_id group by 1)""")
def record_validation(spark, folder):
    """Rules a document's set of spans breaks."""
    p = system_spans(spark, folder).select("doc_id", F.struct("start", "end", "text", F.col("category").alias("label"), "code").alias("s"))
    sets = p.groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("s")).join(articles(spark, folder, "abstract").filter("abstract is not null"), "doc_id")
    return sets.select("doc_id", B.invalid(F.col("abstract"), F.col("s")).alias("rules"))


@query(f"""select tag, n, round((avg(n) over () / n) / avg(avg_w) over (), 6) as weight from (select label as tag, count(*) n, 1 as avg_w from {_GOLD} group by 1)""".replace("round((avg(n) over () / n) / avg(avg_w) over (), 6)", "round((1.0 / n) / (avg(1.0 / n) over ()), 6)"))
def class_weights(spark, folder):
    """Inverse frequencies with mean 1."""
    c = expert_spans(spark, folder).groupBy(F.col("label").alias("tag")).agg(F.count("*").alias("n"))
    mean = c.agg(F.avg(1 / F.col("n")).alias("mean"))
    return c.crossJoin(F.broadcast(mean)).select("tag", "n", F.round(1 / F.col("n") / F.col("mean"), 6).alias("weight"))


@query(f"""select m.code as code, count(*) as n, case when upper(m.code[1]) = 'R' then 'SYMPTOM' when upper(m.code[1]) in ('V','W','X','Y','Z') then null when regexp_matches(upper(m.code[1]), '[A-U]') then 'DISEASE' end as kind from (select unnest({sql_marks("original_labels_json")}) m from {_R}) where m.code is not null group by all""")
def code_chapters(spark, folder):
    """F14."""
    m = rows(spark, folder, "expert_reviews").select(F.explode(marks("original_labels_json")).alias("m")).filter("m.code is not null").groupBy("m.code").agg(F.count("*").alias("n"))
    return m.withColumn("kind", D.by_chapter(F.col("code")))


@query(f"select term, code from {SQL_DICTIONARY} d where not exists (select 1 from {_GOLD} g join (select distinct doc_id, abstract from article_extraction) a using (doc_id) where lower(substring(abstract, g.s + 1, g.e - g.s)) = d.term)")
def terms_without_gold(spark, folder):
    """Dictionary terms that no gold span shows."""
    g = expert_spans(spark, folder).join(articles(spark, folder, "abstract"), "doc_id").select(F.lower(F.substring("abstract", F.col("start") + 1, F.col("end") - F.col("start"))).alias("term"))
    return R.remaining(dictionary(spark, folder), g.distinct(), "term").select("term", "code")


@query()
def merged_labels(spark, folder):
    """reviewers' labels merged with dictionary matches."""
    ai = system_spans(spark, folder).select(F.col("doc_id").alias("key"), "start", "end", "text", "code", "category")
    return D.merged_sources(ai, matches(spark, folder)).withColumnRenamed("key", "doc_id")


@query()
def standoff_files(spark, folder):
    """Standoff and column text of documents."""
    p = system_spans(spark, folder).select("doc_id", F.struct("start", "end", "text", F.col("category").alias("label")).alias("s")).distinct()
    ann = p.groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("s")).select("doc_id", B.standoff(F.col("s")).alias("ann"))
    tags = B.tagged(token_rows(spark, folder), expert_spans(spark, folder), ["doc_id"])
    sets = tags.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "tag"))).alias("t"))
    return ann.join(sets.select("doc_id", B.conll(F.transform("t", lambda x: x["word"]), F.transform("t", lambda x: x["tag"])).alias("conll")), "doc_id", "left")
