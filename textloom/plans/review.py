"""Review and adjudication analytics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from textloom.operators import relational as R
from textloom.plans.registry import query
from textloom.plans.views import SQL_ARTICLES, SQL_REVIEWS, articles, marks, reviews_in_force, rows, sql_marks

_J = "(select distinct * from reviewer_adjudications)"
_R = "(select distinct * from expert_reviews)"
_U = "(select distinct * from users)"


@query(f"select document_id, expert_id, max(id) as id, arg_max(upper(trim(review_status)), id) as status from {_R} group by 1, 2")
def latest_review_per_expert(spark, folder):
    """Latest row per group as an aggregation."""
    r = rows(spark, folder, "expert_reviews").select("document_id", "expert_id", "id", F.upper(F.trim("review_status")).alias("status"))
    return R.latest(r, ["document_id", "expert_id"], "id").select("document_id", "expert_id", "id", "status")


@query(f"select reviewer_id, max(id) as id, arg_max(document_id, id) as document_id from {_J} group by 1")
def latest_adjudication_per_reviewer(spark, folder):
    """M08."""
    return R.latest(rows(spark, folder, "reviewer_adjudications").select("reviewer_id", "id", "document_id"), ["reviewer_id"], "id").select("reviewer_id", "id", "document_id")


@query(f"""select count(*) as reviews, count(distinct document_id) as documents, count(distinct expert_id) as experts, count(*) filter (where upper(trim(review_status)) = 'CORRECT') as correct,
count(*) filter (where annotations_json is null) as without_annotations, min(created_at) as first_at, max(created_at) as last_at from {_R}""")
def reviewer_dashboard(spark, folder):
    """Several KPIs in one pass."""
    r = rows(spark, folder, "expert_reviews")
    return r.agg(F.count("*").alias("reviews"), F.countDistinct("document_id").alias("documents"), F.countDistinct("expert_id").alias("experts"), F.count_if(F.upper(F.trim("review_status")) == "CORRECT").alias("correct"), F.count_if(F.col("annotations_json").isNull()).alias("without_annotations"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query(f"""with e as (select document_id d from {_R} union select article_id from corpus_language_audit where article_id is not null and decision_status = 'ACCEPTED')
select (select count(*) from e) as eligible, (select count(*) from e where not exists (select 1 from {_R} r where r.document_id = e.d and r.expert_id = 7)) as pending,
(select count(*) from {_R} where expert_id = 7) as reviews, (select count(distinct document_id) from {_R} where expert_id = 7) as reviewed""")
def expert_dashboard(spark, folder):
    """Union of keys, anti join against an expert's reviews."""
    r, audit = rows(spark, folder, "expert_reviews").select("document_id", "expert_id"), rows(spark, folder, "corpus_language_audit")
    eligible = r.select("document_id").union(audit.filter("article_id is not null and decision_status = 'ACCEPTED'").select("article_id")).distinct()
    own = r.filter("expert_id = 7")
    pending = eligible.join(own.select("document_id").distinct(), "document_id", "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(eligible, "eligible").crossJoin(one(pending, "pending")).crossJoin(one(own, "reviews"))  # one-row frames
    return out.crossJoin(own.agg(F.countDistinct("document_id").alias("reviewed")))


@query(f"""select u.id, u.full_name, u.user_role, count(r.id) as reviews, count(distinct r.document_id) as documents, max(r.created_at) as last_at from {_U} u left join {_R} r on r.expert_id = u.id group by all""")
def users_with_review_counts(spark, folder):
    """Zero-preserving join; reviews are counted before they meet users."""
    counts = rows(spark, folder, "expert_reviews").groupBy("expert_id").agg(F.count("*").alias("reviews"), F.countDistinct("document_id").alias("documents"), F.max("created_at").alias("last_at"))
    u = rows(spark, folder, "users").select("id", "full_name", "user_role")
    return u.join(counts, u.id == counts.expert_id, "left").select("id", "full_name", "user_role", F.coalesce("reviews", F.lit(0)).alias("reviews"), F.coalesce("documents", F.lit(0)).alias("documents"), "last_at")


@query(f"""with a as (select document_id, arg_max(upper(trim(resolution_status)), id) s from {_J} group by 1)
select r.document_id, case when count(distinct expert_id) < 2 then 'PENDING' when max(a.s) is not null then max(a.s) else 'CONFLICT' end as state from {_R} r left join a using (document_id) group by 1""")
def case_resolution(spark, folder):
    """State of each case."""
    a = R.latest(rows(spark, folder, "reviewer_adjudications").select("document_id", "id", F.upper(F.trim("resolution_status")).alias("s")), ["document_id"], "id")
    r = rows(spark, folder, "expert_reviews").groupBy("document_id").agg(F.countDistinct("expert_id").alias("n")).join(a, "document_id", "left")
    return r.select("document_id", F.when(F.col("n") < 2, "PENDING").otherwise(F.coalesce("s", F.lit("CONFLICT"))).alias("state"))


@query(f"""select a.doc_id, a.title, string_agg(distinct m.code, ', ' order by m.code) as codes, count(distinct m.code) as n_codes
from {SQL_ARTICLES} a join (select document_id, unnest({sql_marks("original_labels_json")}) m from {_R}) r on r.document_id = a.doc_id and m.code <> '' group by all""")
def coded_documents(spark, folder):
    """Documents with their codes in one ordered list."""
    codes = rows(spark, folder, "expert_reviews").select(F.col("document_id").alias("doc_id"), F.explode(marks("original_labels_json")).alias("m")).select("doc_id", "m.code").filter("code != ''").distinct()
    lists = codes.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("code")), ", ").alias("codes"), F.count("*").alias("n_codes"))
    return articles(spark, folder).select("doc_id", "title").join(lists, "doc_id")


@query(f"select expert_id, sum(case when upper(trim(review_status)) = 'CORRECT' then 1 else 0 end) as correct, count(*) as n from {_R} group by 1 having sum(case when upper(trim(review_status)) = 'CORRECT' then 1 else 0 end) >= 5")
def experts_with_correct(spark, folder):
    """Conditional sum, filter after aggregation."""
    r = rows(spark, folder, "expert_reviews").groupBy("expert_id").agg(F.sum(F.when(F.upper(F.trim("review_status")) == "CORRECT", 1).otherwise(0)).alias("correct"), F.count("*").alias("n"))
    return r.filter("correct >= 5")


@query(f"""select id, document_id, full_name, upper(trim(review_status)) as status, created_at from {_R} r join (select id uid, full_name from {_U}) u on u.uid = r.expert_id order by created_at desc, id desc limit 100""")
def review_feed(spark, folder):
    """Newest first."""
    r = rows(spark, folder, "expert_reviews").join(rows(spark, folder, "users").select(F.col("id").alias("expert_id"), "full_name"), "expert_id")
    return r.orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "document_id", "full_name", F.upper(F.trim("review_status")).alias("status"), "created_at")


@query(f"""select document_id, max(case when rn = 1 then expert_id end) as expert_a, max(case when rn = 2 then expert_id end) as expert_b from
(select *, row_number() over (partition by document_id order by created_at, id) rn from {SQL_REVIEWS}) where rn <= 2 group by 1""")
def expert_columns(spark, folder):
    """The first two experts of a document as columns; the two least rows by aggregation."""
    r = reviews_in_force(spark, folder).withColumn("rn", F.row_number().over(Window.partitionBy("document_id").orderBy("created_at", "id"))).filter("rn <= 2")
    return r.groupBy("document_id").agg(F.max(F.when(F.col("rn") == 1, F.col("expert_id"))).alias("expert_a"), F.max(F.when(F.col("rn") == 2, F.col("expert_id"))).alias("expert_b"))


_SQL_DECIDED = f"""(select document_id, expert_id, m.start s, m."end" e, lower(m.text) t, case when upper(trim(m.action)) = 'DELETE' then 'NONE' else coalesce(l.entity_label, 'OTHER') end as label
from (select document_id, expert_id, unnest({sql_marks("annotations_json")}) m from {SQL_REVIEWS}) left join (select distinct lower(trim(alias)) a, entity_label from label_names) l on l.a = lower(trim(m.category)) where m.start is not null)"""


def decided(spark, folder):
    """(document_id, expert_id, s, e, t, label) of annotations with offsets in force."""
    m = reviews_in_force(spark, folder).select("document_id", "expert_id", F.explode(marks("annotations_json")).alias("m"))
    names = rows(spark, folder, "label_names").select(F.lower(F.trim("alias")).alias("a"), "entity_label").distinct()
    m = m.filter("m.start is not null").withColumn("a", F.lower(F.trim("m.category"))).join(F.broadcast(names), "a", "left")  # a row per alias, fixed
    label = F.when(F.upper(F.trim("m.action")) == "DELETE", "NONE").otherwise(F.coalesce("entity_label", F.lit("OTHER")))
    return m.select("document_id", "expert_id", F.col("m.start").alias("s"), F.col("m.end").alias("e"), F.lower("m.text").alias("t"), label.alias("label"))


@query(f"""with p as (select document_id, min(expert_id) a, max(expert_id) b from (select *, row_number() over (partition by document_id order by created_at, id) rn from {SQL_REVIEWS}) where rn <= 2 group by 1 having count(*) = 2),
x as (select p.document_id, s, e, t, min(label) label from p join {_SQL_DECIDED} d on d.document_id = p.document_id and d.expert_id = p.a group by all),
y as (select p.document_id, s, e, t, min(label) label from p join {_SQL_DECIDED} d on d.document_id = p.document_id and d.expert_id = p.b group by all)
select state, count(*) as n from (select case when x.label is null then 'only_b' when y.label is null then 'only_a' when x.label = y.label then 'agree' else 'conflict' end as state from x full join y using (document_id, s, e, t)) group by 1""")
def expert_pair_comparison(spark, folder):
    """The first two experts of each document compared mention by mention."""
    pair = expert_columns(spark, folder).filter("expert_b is not null").select("document_id", F.least("expert_a", "expert_b").alias("a"), F.greatest("expert_a", "expert_b").alias("b"))
    d = decided(spark, folder)
    side = lambda c: d.join(pair.select("document_id", F.col(c).alias("expert_id")), ["document_id", "expert_id"]).groupBy("document_id", "s", "e", "t").agg(F.min("label").alias("label"))
    both = R.compared(side("a"), side("b"), ["document_id", "s", "e", "t"], ["label"])
    state = F.element_at(F.create_map(*(F.lit(x) for x in ("left_only", "only_a", "right_only", "only_b", "same", "agree", "changed", "conflict"))), F.col("status"))
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(f"""select document_id, s as start_pos, label, count(*) as votes, count(distinct expert_id) as experts from {_SQL_DECIDED} group by all""")
def mention_votes(spark, folder):
    """Votes per mention and label."""
    return decided(spark, folder).groupBy("document_id", F.col("s").alias("start_pos"), "label").agg(F.count("*").alias("votes"), F.countDistinct("expert_id").alias("experts"))


@query(f"""select id, 'annotations' as rule from {_R} where annotations_json is not null and not json_valid(annotations_json)
union all select id, 'status' from {_R} where upper(trim(review_status)) not in ('CORRECT','INCORRECT','NEEDS_REVISION')
union all select id, 'no_decision' from {_R} where annotations_json is null and upper(trim(review_status)) <> 'CORRECT'""")
def review_validation(spark, folder):
    """Broken submissions as rows of rules."""
    r = rows(spark, folder, "expert_reviews")
    broken = F.col("annotations_json").isNotNull() & marks("annotations_json").isNull()
    status = F.upper(F.trim("review_status"))
    rules = F.array(F.when(broken, "annotations"), F.when(~status.isin("CORRECT", "INCORRECT", "NEEDS_REVISION"), "status"), F.when(F.col("annotations_json").isNull() & (status != "CORRECT"), "no_decision"))
    return r.select("id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))


@query(f"""select document_id, id, coalesce(len({sql_marks("final_labels_json")}), 0) as labels, upper(trim(resolution_status)) = 'RESOLVED' and coalesce(len({sql_marks("final_labels_json")}), 0) = 0 as resolved_without_labels from {_J}""")
def adjudication_validation(spark, folder):
    """Resolved cases must carry labels."""
    j = rows(spark, folder, "reviewer_adjudications").withColumn("m", marks("final_labels_json"))
    n = F.coalesce(F.when(F.col("m").isNotNull(), F.size("m")), F.lit(0))
    return j.select("document_id", "id", n.alias("labels"), ((F.upper(F.trim("resolution_status")) == "RESOLVED") & (n == 0)).alias("resolved_without_labels"))


@query(f"""select r.document_id, list(struct_pack(id := r.id, status := upper(trim(r.review_status)), full_name := u.full_name) order by r.id) as history from {_R} r join {_U} u on u.id = r.expert_id group by 1""")
def review_history(spark, folder):
    """A document's reviews nested in one row; a document has a review per expert and repeat, not a share of the table."""
    r = rows(spark, folder, "expert_reviews").join(rows(spark, folder, "users").select(F.col("id").alias("expert_id"), "full_name"), "expert_id")
    item = F.struct("id", F.upper(F.trim("review_status")).alias("status"), "full_name")
    return r.groupBy("document_id").agg(F.sort_array(F.collect_list(item)).alias("history"))


@query(f"select document_id, count(*) as payloads, count(distinct annotations_json) as distinct_payloads from {_R} where annotations_json is not null group by 1 having count(*) > count(distinct annotations_json)")
def repeated_payloads(spark, folder):
    """Equal payloads of one document."""
    r = rows(spark, folder, "expert_reviews").filter("annotations_json is not null").groupBy("document_id").agg(F.count("*").alias("payloads"), F.countDistinct("annotations_json").alias("distinct_payloads"))
    return r.filter("payloads > distinct_payloads")


@query(f"""select document_id, coalesce(max(case when json_valid(annotations_json) then annotations_json end), max(original_labels_json)) is not null as has_labels, max(case when json_valid(annotations_json) then 1 else 0 end) = 1 as from_review from {SQL_REVIEWS} group by 1""")
def label_source_choice(spark, folder):
    """Review annotations where they parse, else the seed."""
    r = reviews_in_force(spark, folder).withColumn("ok", marks("annotations_json").isNotNull())
    return r.groupBy("document_id").agg((F.max(F.when(F.col("ok") | F.col("original_labels_json").isNotNull(), 1).otherwise(0)) == 1).alias("has_labels"), F.max("ok").alias("from_review"))


@query("""select decision_status, rejection_reason, count(*) as n, count(distinct source_url) as urls from (select distinct * from corpus_language_audit) group by all""")
def rejection_counts(spark, folder):
    """M04."""
    return rows(spark, folder, "corpus_language_audit").groupBy("decision_status", "rejection_reason").agg(F.count("*").alias("n"), F.countDistinct("source_url").alias("urls"))
