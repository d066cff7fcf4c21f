"""Smaller operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from textloom.functions import text as T
from textloom.operators import bio as B, dictionary as D, relational as R, spans as S, structure as P
from textloom.plans.annotation import _GOLD, _SYS, expert_spans, system_spans
from textloom.plans.registry import query
from textloom.plans.review import _SQL_DECIDED, decided
from textloom.plans.views import SQL_ARTICLES, SQL_DICTIONARY, articles, dictionary, marks, rows, sql_marks, sql_placed

_R = "(select distinct * from expert_reviews)"
_J = "(select distinct * from reviewer_adjudications)"
_A = "(select distinct * from corpus_language_audit)"
_S = "(select distinct * from article_section)"
_Q = "(select distinct * from tamanh_qa)"
_U = "(select distinct * from users)"


@query(f"select doc_id, title from {SQL_ARTICLES} where doc_id in (3, 5, 8, 13, 21, 34, 55)")
def chosen_articles(spark, folder):
    """F06."""
    return articles(spark, folder, "title").filter(F.col("doc_id").isin(3, 5, 8, 13, 21, 34, 55))


@query(f"select id, full_name from {_U} where is_active and user_role = 'EXPERT' and created_at + interval 12 hour < timestamp '2021-09-01'")
def valid_users(spark, folder):
    """active and within a time limit."""
    return rows(spark, folder, "users").filter("is_active and user_role = 'EXPERT' and created_at + interval 12 hours < timestamp_ntz '2021-09-01'").select("id", "full_name")


@query(f"select doc_id, case when doc_id in (select document_id from {_R}) then 'reviewed' else 'pending' end as state from {SQL_ARTICLES} where doc_id not in (select document_id from {_J})")
def open_documents(spark, folder):
    """A computed state, filtered afterwards."""
    a = R.presence(articles(spark, folder, "title").select("doc_id"), "doc_id", r=rows(spark, folder, "expert_reviews", "id", "document_id").select(F.col("document_id").alias("doc_id")), j=rows(spark, folder, "reviewer_adjudications", "id", "document_id").select(F.col("document_id").alias("doc_id")))
    return a.filter("not j").select("doc_id", F.when(F.col("r"), "reviewed").otherwise("pending").alias("state"))


@query(f"select term, category from {SQL_DICTIONARY} where length(array_to_string(regexp_extract_all(term, '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), ' ')) >= 2 and regexp_matches(term, '\\p{{L}}')")
def admissible_terms(spark, folder):
    """F13."""
    return dictionary(spark, folder).filter(D.admissible(F.col("term"), F.lit(True), F.lit(False))).select("term", "category")


@query(f"select doc_id from {SQL_ARTICLES} a where exists (select 1 from {_R} r where r.document_id = a.doc_id and r.expert_id = 7) or exists (select 1 from {_A} u where u.article_id = a.doc_id and u.decision_status = 'ACCEPTED')")
def accessible_documents(spark, folder):
    """Either of two keys' sets."""
    keys = rows(spark, folder, "expert_reviews", "id", "document_id", "expert_id").filter("expert_id = 7").select(F.col("document_id").alias("doc_id"))
    keys = keys.union(rows(spark, folder, "corpus_language_audit", "id", "article_id", "decision_status").filter("decision_status = 'ACCEPTED'").select("article_id")).distinct()
    return articles(spark, folder, "title").select("doc_id").join(keys, "doc_id", "left_semi")


@query(f"select p.doc_id, p.s as start_pos, p.e as end_pos from {_SYS} p where exists (select 1 from {_GOLD} g where g.doc_id = p.doc_id and g.s <= p.s and p.e <= g.e) group by all")
def contained_spans(spark, folder):
    """Spans inside gold spans."""
    p = system_spans(spark, folder).select("doc_id", "start", "end").distinct()
    j = S.overlap_join(p, expert_spans(spark, folder).select("doc_id", "start", "end").distinct(), ["doc_id"])
    return j.filter("r_start <= l_start and l_end <= r_end").select("doc_id", F.col("l_start").alias("start_pos"), F.col("l_end").alias("end_pos")).distinct()


@query(f"""select (select count(*) from (select doc_id from {_GOLD} except select doc_id from {_SYS})) as missing, (select count(*) from (select doc_id from {_SYS} except select doc_id from {_GOLD})) as extra""")
def id_sets(spark, folder):
    """Documents that only one side has."""
    g, p = expert_spans(spark, folder).select("doc_id").distinct(), system_spans(spark, folder).select("doc_id").distinct()
    return R.remaining(g, p, "doc_id").agg(F.count("*").alias("missing")).crossJoin(R.remaining(p, g, "doc_id").agg(F.count("*").alias("extra")))


@query(f"select doc_id, count(*) as n, count(distinct label) as labels, min(s) as first, max(e) as last from {_SYS} group by 1")
def spans_per_article(spark, folder):
    """A12."""
    p = system_spans(spark, folder).select("doc_id", "start", "end", F.col("category").alias("label")).distinct()
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.min("start").alias("first"), F.max("end").alias("last"))


@query(f"""select label_source, count(*) as n, count(*) filter (where annotations_json is not null and not json_valid(annotations_json)) as broken, round(avg(coalesce(len({sql_marks("annotations_json")}), 0)), 6) as mean_labels from {_R} group by 1""")
def payload_quality(spark, folder):
    """Averages and faults per source of labels."""
    r = rows(spark, folder, "expert_reviews", "id", "label_source", "annotations_json").withColumn("m", marks("annotations_json"))
    return r.groupBy("label_source").agg(F.count("*").alias("n"), F.count_if(F.col("annotations_json").isNotNull() & F.col("m").isNull()).alias("broken"), F.round(F.avg(F.coalesce(F.when(F.col("m").isNotNull(), F.size("m")), F.lit(0))), 6).alias("mean_labels"))


@query(f"select publication_year as year, count(*) as n, count(*) filter (where source_hash is null or trim(source_hash) = '') as without_hash, count(distinct source_hash) as hashes from {SQL_ARTICLES} group by 1")
def storage_audit(spark, folder):
    """Articles, hashes and missing hashes by year."""
    a = articles(spark, folder, "publication_year", "source_hash")
    return a.groupBy(F.col("publication_year").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("source_hash") == "", F.lit(True))).alias("without_hash"), F.countDistinct("source_hash").alias("hashes"))


@query(f"select section_id, last_value(canonical_type ignore nulls) over (partition by doc_id order by ord, section_id rows between unbounded preceding and current row) as carried from {_S}")
def carried_types(spark, folder):
    """The last known type up to each section."""
    s = rows(spark, folder, "article_section", "section_id", "doc_id", "ord", "canonical_type")
    return R.carried(s, ["doc_id"], [F.col("ord"), F.col("section_id")], "canonical_type", "carried").select("section_id", "carried")


@query(f"select section_id, cast(coalesce(sum(len(string_split(content, chr(10)))) over (partition by doc_id order by ord, section_id rows between unbounded preceding and 1 preceding), 0) as bigint) as first_line from {_S}")
def line_index(spark, folder):
    """Where each section's lines begin in its document."""
    s = rows(spark, folder, "article_section", "section_id", "doc_id", "ord", "content")
    w = Window.partitionBy("doc_id").orderBy("ord", "section_id").rowsBetween(Window.unboundedPreceding, -1)
    n = F.when(F.col("content").isNotNull(), F.size(F.split("content", "\n")))
    return s.select("section_id", F.coalesce(F.sum(n).over(w), F.lit(0)).alias("first_line"))


@query(f"select doc_id from {SQL_ARTICLES} where doc_id not in (select doc_id from {_S}) or abstract is null order by doc_id limit 50")
def first_misses(spark, folder):
    """The first misses (the limit is the feature)."""
    a = R.presence(articles(spark, folder, "abstract"), "doc_id", s=rows(spark, folder, "article_section", "section_id", "doc_id").select("doc_id"))
    return a.filter("not s or abstract is null").orderBy("doc_id").limit(50).select("doc_id")


@query(f"""select doc_id, s as start_pos, e as end_pos, label, string_agg(distinct src, '+' order by src) as sources from (select *, 'system' src from {_SYS} union all select *, 'gold' from {_GOLD}) group by 1, 2, 3, 4""")
def merged_spans(spark, folder):
    """Equal spans of several sources merged."""
    p = system_spans(spark, folder).select("doc_id", "start", "end", F.col("category").alias("label"), F.lit("system").alias("src")).unionByName(expert_spans(spark, folder).withColumn("src", F.lit("gold")))
    return p.groupBy("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "label").agg(F.array_join(F.sort_array(F.collect_set("src")), "+").alias("sources"))


@query(f"""select count(*) filter (where p and g) as both_sides, count(*) filter (where p and not g) as system_only, count(*) filter (where g and not p) as gold_only from (select bool_or(src = 1) p, bool_or(src = 2) g from (select *, 1 src from {_SYS} union all select *, 2 from {_GOLD}) group by doc_id, s, e, label)""")
def span_sets(spark, folder):
    """Intersection and differences of span sets."""
    m = merged_spans(spark, folder)
    return m.agg(F.count_if(F.col("sources") == "gold+system").alias("both_sides"), F.count_if(F.col("sources") == "system").alias("system_only"), F.count_if(F.col("sources") == "gold").alias("gold_only"))


@query(f"select document_id as doc_id, lower(m.text) as text, m.code as code, min(m.start) as first from (select document_id, unnest({sql_marks('original_labels_json')}) m from {_R}) where m.text is not null group by 1, 2, 3")
def distinct_concepts(spark, folder):
    """Concepts of a document, each at its first place."""
    m = rows(spark, folder, "expert_reviews", "id", "document_id", "original_labels_json").select(F.col("document_id").alias("doc_id"), F.explode(marks("original_labels_json")).alias("m")).filter("m.text is not null")
    return m.groupBy("doc_id", F.lower("m.text").alias("text"), F.col("m.code").alias("code")).agg(F.min("m.start").alias("first"))


@query(f"""select m.category as category, coalesce(max(l.entity_label), 'OTHER') as label, count(*) as n from (select unnest({sql_marks("annotations_json")}) m from {_R}) left join (select distinct lower(trim(alias)) a, entity_label from label_names) l on l.a = lower(trim(m.category)) group by 1""")
def category_map(spark, folder):
    """Spellings of categories and what they mean."""
    m = rows(spark, folder, "expert_reviews", "id", "annotations_json").select(F.explode(marks("annotations_json")).alias("m")).groupBy("m.category").agg(F.count("*").alias("n"))
    names = rows(spark, folder, "label_names").groupBy(F.lower(F.trim("alias")).alias("a")).agg(F.max("entity_label").alias("label"))
    return m.join(names, F.lower(F.trim("category")) == F.col("a"), "left").select("category", F.coalesce("label", F.lit("OTHER")).alias("label"), "n")


@query(f"select lower(m.code) as code, min(m.text) as canonical, count(distinct lower(m.text)) as terms from (select unnest({sql_marks('original_labels_json')}) m from {_R}) where m.code is not null group by 1")
def code_catalogue(spark, folder):
    """Each code's term."""
    m = rows(spark, folder, "expert_reviews", "id", "original_labels_json").select(F.explode(marks("original_labels_json")).alias("m")).filter("m.code is not null")
    return m.groupBy(F.lower("m.code").alias("code")).agg(F.min("m.text").alias("canonical"), F.countDistinct(F.lower("m.text")).alias("terms"))


@query(f"select category, count(*) as terms, count(distinct code) as codes from {SQL_DICTIONARY} group by 1")
def dictionary_counts(spark, folder):
    """D10."""
    return dictionary(spark, folder).groupBy("category").agg(F.count("*").alias("terms"), F.countDistinct("code").alias("codes"))


@query()
def aliases(spark, folder):
    """Terms with their safe aliases, and whether they are written in capitals only."""
    a = D.with_aliases(dictionary(spark, folder).select("term", "code", "category"))
    return a.withColumn("capitals", T.all_capitals("term"))


@query(f"""select document_id, id, list_filter({sql_marks("original_labels_json")}, lambda m: m.code is not null and m.code <> '')[1].code as first_code from {_R} where json_valid(original_labels_json)""")
def first_codes(spark, folder):
    """The first coded label of a payload."""
    r = rows(spark, folder, "expert_reviews", "id", "document_id", "original_labels_json").withColumn("m", marks("original_labels_json")).filter("m is not null")
    return r.select("document_id", "id", F.get(F.filter("m", lambda m: m["code"].isNotNull() & (m["code"] != "")), F.lit(0))["code"].alias("first_code"))


@query()
def classified_terms(spark, folder):
    """Symptom or disease by lexicon (terms that the reviews' original labels call by one of the two only), words before, form."""
    m = system_spans(spark, folder).filter("category in ('DISEASE', 'SYMPTOM')")
    known = m.groupBy(F.lower("text").alias("known")).agg(F.min("category").alias("lo"), F.max("category").alias("hi"), F.countDistinct("doc_id").alias("n")).filter("lo = hi and n >= 3").select("known", F.col("lo").alias("lexicon"))
    j = m.join(articles(spark, folder, "abstract").filter("abstract is not null"), "doc_id").join(known, F.lower("text") == F.col("known"), "left")
    before = F.substring("abstract", F.greatest(F.lit(1), F.col("start") - 79), F.least(F.col("start"), F.lit(80)))
    return j.select("doc_id", "start", "text", "category", D.symptom_or_disease(F.col("text"), before, F.col("lexicon")).alias("c")).select("doc_id", "start", "text", "category", "c.*")


@query(f"""select document_id as doc_id, count(*) as fresh from (select distinct document_id, lower(m.text) t from (select document_id, unnest({sql_marks("annotations_json")}) m from {_R}) where upper(trim(m.action)) = 'ADD') x where not exists (select 1 from {SQL_DICTIONARY} d where d.term = x.t) group by 1""")
def new_terms(spark, folder):
    """Added terms that the dictionary does not know."""
    m = rows(spark, folder, "expert_reviews", "id", "document_id", "annotations_json").select(F.col("document_id").alias("doc_id"), F.explode(marks("annotations_json")).alias("m")).filter("upper(trim(m.action)) = 'ADD'")
    m = m.select("doc_id", F.lower("m.text").alias("term")).distinct()
    return m.join(dictionary(spark, folder).select("term"), "term", "left_anti").groupBy("doc_id").agg(F.count("*").alias("fresh"))


@query(f"""select term, len(regexp_split_to_array(trim(term), '\\s+')) > 12 as long from {SQL_DICTIONARY}""")
def long_terms(spark, folder):
    """Terms too long to be entities."""
    return dictionary(spark, folder).select("term", F.array_contains(B.quality_flags(F.col("term")), "LONG").alias("long"))


@query()
def augmented_texts(spark, folder):
    """In each abstract the first gold span with a synonym (another term of its code in the dictionary) replaced by it, the rest shifted; fits
    says whether all spans still stand."""
    d = dictionary(spark, folder)
    synonyms = d.groupBy("code").agg(F.sort_array(F.collect_set("term")).alias("terms")).filter("size(terms) > 1")  # bounded by the terms of a code
    own = d.join(synonyms, "code").select("term", F.get(F.filter("terms", lambda t: t != F.col("term")), F.lit(0)).alias("other"))
    g = expert_spans(spark, folder).join(articles(spark, folder, "abstract").filter("abstract is not null"), "doc_id")
    g = g.filter("end <= length(abstract)").withColumn("text", F.substring("abstract", F.col("start") + 1, F.col("end") - F.col("start")))
    g = g.join(own, F.lower("text") == F.col("term"), "left")
    sets = g.groupBy("doc_id").agg(F.max("abstract").alias("abstract"), F.sort_array(F.collect_list(F.struct("start", "end", "label", "text", "other"))).alias("s"))
    at = F.array_position(F.transform("s", lambda x: x["other"].isNotNull()), True).cast("int")
    sets = sets.withColumn("at", at).filter("at > 0")
    spans = F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end")))
    made = sets.select("doc_id", B.replaced_span(F.col("abstract"), spans, F.col("at"), F.element_at("s", F.col("at"))["other"]).alias("r"))
    fits = F.forall("r.spans", lambda x: F.substring(F.col("r.text"), x["start"] + 1, x["end"] - x["start"]) == x["text"])
    return made.select("doc_id", "r.text", fits.alias("fits"))


@query(f"""select d.label as verdict, count(*) as n from (select document_id, s, label from {_SQL_DECIDED} where expert_id = 7) d join (select distinct doc_id, s from {_SYS}) p on p.doc_id = d.document_id and p.s = d.s group by 1""")
def verifier_verdicts(spark, folder):
    """What one verifier made of the system's spans; NONE is a rejection."""
    d = decided(spark, folder).filter("expert_id = 7").select(F.col("document_id").alias("doc_id"), "s", "label")
    p = system_spans(spark, folder).select("doc_id", F.col("start").alias("s")).distinct()
    return d.join(p, ["doc_id", "s"]).groupBy(F.col("label").alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""select id, sha256(string_agg(x, chr(10) order by x)) as checksum from (select id, unnest(list_transform({sql_marks("final_labels_json")}, lambda m: coalesce(cast(m.start as varchar), '') || ':' || coalesce(m.text, ''))) x from {_J} where upper(trim(resolution_status)) = 'RESOLVED') group by 1""")
def gold_checksums(spark, folder):
    """Digests of final label sets."""
    j = rows(spark, folder, "reviewer_adjudications").filter("upper(trim(resolution_status)) = 'RESOLVED'").withColumn("m", marks("final_labels_json")).filter("size(m) > 0")
    lines = F.array_sort(F.transform("m", lambda m: F.concat(F.coalesce(m["start"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(m["text"], F.lit("")))))
    return j.select("id", F.sha2(F.array_join(lines, "\n"), 256).alias("checksum"))


@query(f"""select expert_id, arg_max(id, (created_at, id)) as last_id from {_R} where upper(trim(review_status)) = 'NEEDS_REVISION' group by 1""")
def resumable_reviews(spark, folder):
    """The last open row of each key."""
    r = rows(spark, folder, "expert_reviews", "id", "expert_id", "review_status", "created_at").filter("upper(trim(review_status)) = 'NEEDS_REVISION'")
    return r.groupBy("expert_id").agg(F.max(F.struct("created_at", "id")).alias("b")).select("expert_id", F.col("b.id").alias("last_id"))


@query(f"select id, resolution_status, created_at from {_J} order by created_at desc, id desc limit 30")
def newest_adjudications(spark, folder):
    """Newest first (a top-k report)."""
    return rows(spark, folder, "reviewer_adjudications", "id", "resolution_status", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(30)


@query(f"""select doc_id, len(list_filter(keywords, lambda k: length(regexp_replace(lower(k), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) >= 3 and contains(lower(abstract), lower(k)))) as supported from {SQL_ARTICLES} where abstract is not null and keywords is not null""")
def supported_keywords(spark, folder):
    """Keywords that the abstract bears out."""
    a = articles(spark, folder, "keywords", "abstract").filter("abstract is not null and keywords is not null")
    good = F.filter("keywords", lambda k: (F.length(F.regexp_replace(F.lower(k), r"[^\p{L}\p{N}]+", "")) >= 3) & F.lower("abstract").contains(F.lower(k)))
    return a.select("doc_id", F.size(good).cast("long").alias("supported"))


@query(f"select section_id, substring(trim(content), 1, 300) as preview from {_S} where content is not null")
def previews(spark, folder):
    """M23."""
    return rows(spark, folder, "article_section", "section_id", "content").filter("content is not null").select("section_id", F.substring(F.trim("content"), 1, 300).alias("preview"))


@query("""select doc_id, s as start, e as "end", true as fits from """ + sql_placed(f"(select distinct doc_id, abstract from {SQL_ARTICLES} where abstract is not null)", "doc_id", "abstract", r"[^.!?\n]+(?:[.!?]+|\n|$)|[.!?\n]+"))
def sentence_bounds(spark, folder):
    """Sentences with offsets; fits says whether the text stands there."""
    a = articles(spark, folder, "abstract").filter("abstract is not null")
    parts = F.regexp_extract_all("abstract", F.lit(r"[^.!?\n]+(?:[.!?]+|\n|$)|[.!?\n]+"), F.lit(0))
    s = a.select("doc_id", "abstract", F.explode(S.laid_out(parts)).alias("s"))
    return s.select("doc_id", "s.start", "s.end", (F.substring("abstract", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")) == F.col("s.word")).alias("fits"))


@query()
def detokenised_abstracts(spark, folder):
    """Tokens joined again, with offsets that show them."""
    a = articles(spark, folder, "abstract").filter("abstract is not null").select("doc_id", F.transform(S.tokens(F.col("abstract"), "hyphen"), lambda t: t["word"]).alias("w"))
    d = a.select("doc_id", "w", B.detokenised(F.col("w")).alias("d"))
    fits = F.forall(F.arrays_zip(F.col("w").alias("w"), F.col("d.spans").alias("s")), lambda x: F.substring(F.col("d.text"), x["s"]["start"] + 1, x["s"]["end"] - x["s"]["start"]) == x["w"])
    return d.select("doc_id", "d.text", fits.alias("fits"))


@query()
def toned_questions(spark, folder):
    """Questions typed without accents, common phrases accented; how much the doctor's line looks like a name."""
    q = rows(spark, folder, "tamanh_qa", "qa_id", "patient_question", "doctor_name").filter("patient_question is not null")
    phrases = {"bac si": "bác sĩ", "dieu tri": "điều trị", "em nam nay": "em năm nay", "chan doan": "chẩn đoán", "cam on": "cảm ơn"}
    return q.select("qa_id", T.with_tones("patient_question", phrases).alias("text"), T.person_score(F.coalesce("doctor_name", F.lit(""))).alias("name_score"))


@query()
def ordered_layout(spark, folder):
    """Blocks of two-column pages in reading order, with the share each lies in a table's area."""
    s = rows(spark, folder, "article_section", "section_id", "doc_id", "ord", "content").filter("content is not null")
    b = s.select("doc_id", "section_id", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    left = F.col("i") % 2 == 0
    b = b.select("doc_id", "section_id", "text", F.when(F.col("i") == 0, 50.0).when(left, 50.0).otherwise(320.0).alias("x0"), (F.col("i") * 10.0).alias("y0"), F.when(F.col("i") == 0, 550.0).when(left, 280.0).otherwise(550.0).alias("x1"), (F.col("i") * 10.0 + 9).alias("y1"), F.lit(600.0).alias("page_width"))
    area = F.struct(F.lit(300.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(560.0).alias("x1"), F.lit(25.0).alias("y1"))
    o = P.reading_order(b, ["doc_id", "section_id"])
    return o.select("doc_id", "section_id", "ord", F.round(P.box_overlap(F.struct("x0", "y0", "x1", "y1"), area), 4).alias("in_table"))


@query()
def realigned_annotations(spark, folder):
    """Annotations put on the next unused place of their text; fits says whether it stands there."""
    r = rows(spark, folder, "expert_reviews", "id", "document_id", "annotations_json").select("id", F.col("document_id").alias("doc_id"), marks("annotations_json").alias("m")).filter("size(m) > 0")
    j = r.join(articles(spark, folder, "abstract").filter("abstract is not null"), "doc_id")
    placed = j.select("id", "abstract", F.explode(S.realigned(F.col("abstract"), F.transform("m", lambda m: F.struct(F.coalesce(m["text"], F.lit("")).alias("text"), m["start"].alias("start"))))).alias("p"))
    return placed.select("id", "p.text", "p.start", "p.end", F.coalesce(F.substring("abstract", F.col("p.start") + 1, F.length("p.text")) == F.col("p.text"), F.col("p.start").isNull()).alias("fits"))


@query()
def token_chunks(spark, folder):
    """Tokens of abstracts with gold labels in chunks of 64 units that cut no entity."""
    from textloom.plans.annotation import token_rows

    t = B.tagged(token_rows(spark, folder), expert_spans(spark, folder), ["doc_id"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "tag"))).alias("t"))
    sizes, joined = F.transform("t", lambda x: F.greatest(F.lit(1), (F.length(x["word"]) / 3).cast("int"))), F.transform("t", lambda x: x["tag"].startswith("I-"))
    c = t.select("doc_id", "t", S.whole_chunks(sizes, joined, 64).alias("c")).select("doc_id", F.explode(F.arrays_zip("t", "c")).alias("x"))
    return c.groupBy("doc_id", F.col("x.c").alias("chunk")).agg(F.count("*").alias("tokens"), F.min_by("x.t.tag", "x.t.pos").alias("first_tag"))


@query(f"""select label, s % 5 = 0 as fifth, count(*) as n from {_SYS} where label in ('DISEASE', 'SYMPTOM') group by all""")
def filtered_spans(spark, folder):
    """Spans filtered by label."""
    p = system_spans(spark, folder).select("doc_id", "start", "end", F.col("category").alias("label")).distinct().filter("label in ('DISEASE', 'SYMPTOM')")
    return p.groupBy("label", (F.col("start") % 5 == 0).alias("fifth")).agg(F.count("*").alias("n"))


@query(f"""select doc_id, 'Text: ' || any_value(abstract) || chr(10) || 'Labels: ' || string_agg(distinct label || ': ' || substring(abstract, s + 1, e - s), '; ' order by label || ': ' || substring(abstract, s + 1, e - s)) as example
from {_GOLD} join (select distinct doc_id, abstract from {SQL_ARTICLES} where abstract is not null) using (doc_id) group by 1 order by 1 limit 10""")
def prompt_examples(spark, folder):
    """The first ten adjudicated abstracts with their labels as examples (the limit is the feature)."""
    g = expert_spans(spark, folder).join(articles(spark, folder, "abstract").filter("abstract is not null"), "doc_id")
    line = F.concat(F.col("label"), F.lit(": "), F.substring("abstract", F.col("start") + 1, F.col("end") - F.col("start")))
    one = g.groupBy("doc_id").agg(F.max("abstract").alias("abstract"), F.array_join(F.sort_array(F.collect_set(line)), "; ").alias("answer"))
    return one.orderBy("doc_id").limit(10).select("doc_id", B.few_shots(F.col("abstract"), F.col("answer")).alias("example"))


@query()
def scored_tags(spark, folder):
    """Tags out of scores of pieces; here scores put the word's own tag first."""
    from textloom.plans.annotation import token_rows

    labels = ["O", *(f"{p}-{x}" for x in ("DISEASE", "SYMPTOM", "CAUSE", "DIAGNOSTIC", "TREATMENT") for p in "BI")]
    t = B.tagged(token_rows(spark, folder), expert_spans(spark, folder), ["doc_id"])
    scores = F.array(*(F.when(F.col("tag") == x, 1.0).otherwise(0.1) for x in labels))
    pieces = t.select(F.col("doc_id").alias("sent_id"), F.col("pos").alias("word"), F.explode(F.sequence(F.lit(0), F.length("word") % 3)).alias("piece"), scores.alias("scores"), "tag")
    back = B.word_tags(pieces, labels)
    return back.join(t.select(F.col("doc_id").alias("sent_id"), F.col("pos").alias("word"), F.col("tag").alias("own")), ["sent_id", "word"]).select("sent_id", "word", "tag", (F.col("tag") == F.col("own")).alias("same"))


@query(f"""with d as (select doc_id, abstract as t, sha256(lower(abstract)) k from {SQL_ARTICLES} where trim(abstract) <> ''), b as (select k, min(doc_id) as doc_id, count(*) as n from d group by 1)
select doc_id % 10 < 2 as held, count(*) as n, cast(sum(n) as bigint) as with_copies from b where not exists (select 1 from d x where x.doc_id % 10 >= 2 and x.k = b.k and b.doc_id % 10 < 2) group by 1""")
def benchmark_parts(spark, folder):
    """A held-out part without copies and without texts of the rest."""
    d = articles(spark, folder, "abstract").filter("trim(abstract) != ''").select("doc_id", F.sha2(F.lower("abstract"), 256).alias("k"))
    b = d.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).withColumn("held", F.col("doc_id") % 10 < 2)
    rest = d.filter("doc_id % 10 >= 2").select("k").distinct().withColumn("leak", F.lit(True))
    kept = b.join(rest, "k", "left").filter("not (held and coalesce(leak, false))")
    return kept.groupBy("held").agg(F.count("*").alias("n"), F.sum("n").alias("with_copies"))
