"""Evaluation of labels before review (predictions) against adjudicated ones (gold)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import evaluate as E, spans as S
from textloom.plans.annotation import _GOLD, _SYS, expert_spans, system_spans
from textloom.plans.registry import query
from textloom.plans.views import rows
from textloom.runtime import materialise

LABELS = ["DISEASE", "SYMPTOM", "CAUSE", "DIAGNOSTIC", "TREATMENT"]


def _pred(spark, folder):
    """Predictions of documents with gold, with ids by place and label."""
    gold = expert_spans(spark, folder).select("doc_id").distinct()
    p = system_spans(spark, folder).select("doc_id", "start", "end", F.col("category").alias("label")).distinct().join(gold, "doc_id", "left_semi")
    return p.withColumn("id", F.col("start") * 100_000 + F.col("end") * 10 + F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col("label")))


def _gold(spark, folder):
    g = expert_spans(spark, folder)
    return g.withColumn("id", F.col("start") * 100_000 + F.col("end") * 10 + F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col("label")))


def _sides(spark, folder):
    """Predictions and gold, written once, as errors read them many times."""
    return materialise(_pred(spark, folder), "predictions"), materialise(_gold(spark, folder), "gold")


_P = f"(select * from {_SYS} where doc_id in (select doc_id from {_GOLD}))"
_L = "(select unnest(['DISEASE','SYMPTOM','CAUSE','DIAGNOSTIC','TREATMENT']) as label)"
_COUNTS = f"""(select label, count(*) filter (where p and g) as tp, count(*) filter (where p and not g) as fp, count(*) filter (where g and not p) as fn from
(select doc_id, s, e, label, bool_or(p) p, bool_or(g) g from (select *, true p, false g from {_P} union all select *, false, true from {_GOLD}) group by 1, 2, 3, 4) group by 1)"""
_RATES = """round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1"""


_EXACT = f"""with c as (select l.label, coalesce(tp, 0) tp, coalesce(fp, 0) fp, coalesce(fn, 0) fn from {_L} l left join {_COUNTS} using (label)), r as (select label, tp, fp, fn, {_RATES} from c)
select label, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, precision, recall, f1 from r
union all select 'MICRO', tp, fp, fn, {_RATES} from (select cast(sum(tp) as bigint) tp, cast(sum(fp) as bigint) fp, cast(sum(fn) as bigint) fn from c)
union all select 'MACRO', cast(sum(tp) as bigint), cast(sum(fp) as bigint), cast(sum(fn) as bigint), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) from r"""


@query(_EXACT)
def exact_report(spark, folder):
    """E02, A10, A11, E06, S11."""
    return E.report(E.exact_counts(_pred(spark, folder), _gold(spark, folder), ["doc_id"]), LABELS)


def _sql_relaxed(score: str, least: str) -> str:
    """Greedy one-to-one matches by falling score, then falling ids, in SQL; ids as in _pred."""
    ident = "s * 100000 + e * 10 + list_position(['DISEASE','SYMPTOM','CAUSE','DIAGNOSTIC','TREATMENT'], label)"
    fold = """list_reduce(list_concat([[]::struct(l bigint, r bigint)[]], list_transform(o, lambda x: [x])), lambda acc, x: case when len(list_filter(acc, lambda k: k.l = x[1].l or k.r = x[1].r)) > 0 then acc else list_concat(acc, x) end)"""
    return f"""with p as (select *, {ident} as id from {_P}), g as (select *, {ident} as id from {_GOLD}),
j as (select p.doc_id, p.label, cast(p.id as bigint) as l, cast(g.id as bigint) as r, {score} as score from p join g on p.doc_id = g.doc_id and p.label = g.label and p.s < g.e and g.s < p.e),
o as (select doc_id, label, list(struct_pack(l := l, r := r) order by score desc, l desc, r desc) as o from j where score >= {least} group by 1, 2),
t as (select label, sum(len({fold})) as tp from o group by 1),
c as (select l.label, coalesce(t.tp, 0) as tp, coalesce(np, 0) - coalesce(t.tp, 0) as fp, coalesce(ng, 0) - coalesce(t.tp, 0) as fn from {_L} l left join t using (label) left join (select label, count(*) as np from p group by 1) using (label) left join (select label, count(*) as ng from g group by 1) using (label)),
r as (select label, tp, fp, fn, {_RATES} from c)
select label, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, precision, recall, f1 from r
union all select 'MICRO', tp, fp, fn, {_RATES} from (select cast(sum(tp) as bigint) tp, cast(sum(fp) as bigint) fp, cast(sum(fn) as bigint) fn from c)
union all select 'MACRO', cast(sum(tp) as bigint), cast(sum(fp) as bigint), cast(sum(fn) as bigint), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) from r"""


@query(_sql_relaxed("(least(p.e, g.e) - greatest(p.s, g.s)) / (greatest(p.e, g.e) - least(p.s, g.s))", "0.5"))
def relaxed_report(spark, folder):
    """Greedy matching by IoU of one half."""
    p, g = _pred(spark, folder), _gold(spark, folder)
    return E.report(E.matched_counts(p, g, E.relaxed_pairs(p, g, ["doc_id"])), LABELS)


@query(_sql_relaxed("least(p.e, g.e) - greatest(p.s, g.s)", "1"))
def overlap_report(spark, folder):
    """Any overlap counts."""
    p, g = _pred(spark, folder), _gold(spark, folder)
    return E.report(E.matched_counts(p, g, E.relaxed_pairs(p, g, ["doc_id"], by="overlap")), LABELS)


@query()
def bipartite_matches(spark, folder):
    """The size of a maximum matching per document and label."""
    p, g = _pred(spark, folder), _gold(spark, folder)
    j = S.overlap_join(p, g, ["doc_id", "label"])
    j = j.filter(S.iou(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")) >= 0.5)
    return S.bipartite_size(j.select("doc_id", "label", F.col("l_id").alias("l"), F.col("r_id").alias("r")), ["doc_id", "label"])


@query(f"""select error_type, count(*) as n from (
select 'LABEL' as error_type from {_P} p where not exists (select 1 from {_GOLD} g where (g.doc_id, g.s, g.e, g.label) = (p.doc_id, p.s, p.e, p.label)) and exists (select 1 from {_GOLD} g where (g.doc_id, g.s, g.e) = (p.doc_id, p.s, p.e)
 and not exists (select 1 from {_P} q where (q.doc_id, q.s, q.e, q.label) = (g.doc_id, g.s, g.e, g.label)))) group by 1""")
def label_errors(spark, folder):
    """Predictions with a gold span's bounds and another label."""
    return E.errors(_pred(spark, folder), _gold(spark, folder), ["doc_id"], one_to_one=False).filter("error_type = 'LABEL'").groupBy("error_type").agg(F.count("*").alias("n"))


_IDENT = "cast(s * 100000 + e * 10 + list_position(['DISEASE','SYMPTOM','CAUSE','DIAGNOSTIC','TREATMENT'], label) as bigint)"
_ONE = """list_reduce(list_concat([[]::struct(l bigint, r bigint, kind varchar, label varchar)[]], list_transform(o, lambda x: [x])), lambda acc, x: case when len(list_filter(acc, lambda k: k.l = x[1].l or k.r = x[1].r)) > 0 then acc else list_concat(acc, x) end)"""
_ERRORS = f"""with p as (select *, {_IDENT} as id from {_P}), g as (select *, {_IDENT} as id from {_GOLD}),
lp as (select * from p where (doc_id, s, e, label) not in (select (doc_id, s, e, label) from g)), lg as (select * from g where (doc_id, s, e, label) not in (select (doc_id, s, e, label) from p)),
j as (select lp.doc_id, lp.id as l, lg.id as r, lg.label as label, case when lp.s = lg.s and lp.e = lg.e then 'LABEL' when lp.label = lg.label then 'BOUNDARY' else 'LABEL_BOUNDARY' end as kind,
 case when lp.s = lg.s and lp.e = lg.e then 2.0 when lp.label = lg.label then 1.0 else 0.0 end + ((least(lp.e, lg.e) - greatest(lp.s, lg.s)) / (greatest(lp.e, lg.e) - least(lp.s, lg.s))) / 2 as score from lp join lg on lp.doc_id = lg.doc_id and lp.s < lg.e and lg.s < lp.e),
o as (select doc_id, list(struct_pack(l := l, r := r, kind := kind, label := label) order by score desc, l desc, r desc) as o from j group by 1),
m as (select doc_id, unnest({_ONE}) as m from o), errors as (select m.m.kind as kind, m.m.label as label from m union all select 'FALSE_POSITIVE', label from lp where (doc_id, id) not in (select (doc_id, m.l) from m) union all select 'FALSE_NEGATIVE', label from lg where (doc_id, id) not in (select (doc_id, m.r) from m))"""


@query(f"{_ERRORS} select 'original' as system, kind as error_type, label, count(*) as n from errors group by 2, 3")
def error_classes(spark, folder):
    """Each error once, by system, type and label."""
    p, g = _sides(spark, folder)
    e = E.errors(p, g, ["doc_id"])
    e = e.join(p.select("doc_id", F.col("id").alias("p"), F.col("label").alias("pl")), ["doc_id", "p"], "left").join(g.select("doc_id", F.col("id").alias("g"), F.col("label").alias("gl")), ["doc_id", "g"], "left")
    return e.groupBy(F.lit("original").alias("system"), "error_type", F.coalesce("gl", "pl").alias("label")).agg(F.count("*").alias("n"))


# Names of error kinds in reports.
KINDS = {"LABEL": "sai_nhan", "BOUNDARY": "sai_bien", "LABEL_BOUNDARY": "sai_nhan", "FALSE_POSITIVE": "nhan_du", "FALSE_NEGATIVE": "bo_sot"}


@query(f"{_ERRORS} select case kind when 'BOUNDARY' then 'sai_bien' when 'FALSE_POSITIVE' then 'nhan_du' when 'FALSE_NEGATIVE' then 'bo_sot' else 'sai_nhan' end as kind, count(*) as n from errors group by 1")
def error_kinds(spark, folder):
    """Errors in four kinds: label, bounds, surplus, omission."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("error_type"))
    return error_classes(spark, folder).groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"))


def _patterns(spark, folder):
    p, g = _sides(spark, folder)
    e = E.errors(p, g, ["doc_id"])
    texts = system_spans(spark, folder).select("doc_id", "start", "end", F.lower("text").alias("text")).distinct()
    e = e.join(p.select("doc_id", F.col("id").alias("p"), F.col("label").alias("pl"), "start", "end"), ["doc_id", "p"], "left").join(g.select("doc_id", F.col("id").alias("g"), F.col("label").alias("gl")), ["doc_id", "g"], "left")
    e = e.join(texts, ["doc_id", "start", "end"], "left").withColumn("pattern_key", E.pattern_key(F.col("error_type"), F.col("pl"), F.col("gl"), F.col("text")))
    return e.groupBy("pattern_key").agg(F.min("error_type").alias("error_type"), F.min(F.coalesce("pl", "gl")).alias("label"), F.count("*").alias("frequency"), F.countDistinct("doc_id").alias("documents"))


@query()
def error_patterns(spark, folder):
    """Error patterns with frequencies."""
    return _patterns(spark, folder)


@query()
def diverse_errors(spark, folder):
    """A varied choice of patterns for a prompt of a given length."""
    chosen = E.diverse(_patterns(spark, folder), 20)
    return E.within_budget(chosen, [F.desc("frequency"), F.col("pattern_key")], F.length("pattern_key"), 600).select("pattern_key", "error_type", "label", "frequency", "used")


_ROUND = "(select document_id d, expert_id x, min(upper(trim(review_status))) v from (select distinct * from expert_reviews) where {c} group by 1, 2)"


@query(f"""select case when b.v is null then 'NEW' when a.v is null then 'RESOLVED' when a.v = b.v then 'PERSISTENT' else 'CHANGED' end as status, count(*) as n from {_ROUND.format(c="created_at < timestamp '2023-01-01'")} b full join {_ROUND.format(c="created_at >= timestamp '2023-01-01'")} a using (d, x) group by 1""")
def round_transitions(spark, folder):
    """What became of each place between two rounds."""
    r = rows(spark, folder, "expert_reviews").select("document_id", "expert_id", F.upper(F.trim("review_status")).alias("v"), "created_at")
    cut = F.expr("timestamp_ntz '2023-01-01'")
    t = E.transitions(r.filter(F.col("created_at") < cut), r.filter(F.col("created_at") >= cut), ["document_id", "expert_id"], "v")
    return t.groupBy("status").agg(F.count("*").alias("n"))


@query(f"""select label, before, after, round(100.0 * (after - before) / before, 4) as change from (select label, count(*) filter (where src = 1) as before, count(*) filter (where src = 2) as after from (select label, 1 src from {_P} union all select label, 2 from {_GOLD}) group by 1) where before > 0""")
def system_comparison(spark, folder):
    """Counts of two systems side by side."""
    p, g = _pred(spark, folder).select("label", F.lit(1).alias("src")), _gold(spark, folder).select("label", F.lit(2).alias("src"))
    w = p.unionByName(g).groupBy("label").agg(F.count_if(F.col("src") == 1).alias("before"), F.count_if(F.col("src") == 2).alias("after")).filter("before > 0")
    return w.withColumn("change", F.round(100.0 * (F.col("after") - F.col("before")) / F.col("before"), 4))


@query(f"select precision >= 0.78 as precision_met, recall >= 0.82 as recall_met, f1 >= 0.8 as f1_met from ({_EXACT}) where label = 'MICRO'")
def goals(spark, folder):
    """Goals of the report as booleans."""
    r = exact_report(spark, folder).filter("label = 'MICRO'")
    return r.select((F.col("precision") >= 0.78).alias("precision_met"), (F.col("recall") >= 0.82).alias("recall_met"), (F.col("f1") >= 0.8).alias("f1_met"))
