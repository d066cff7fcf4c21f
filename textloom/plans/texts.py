"""Text functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import spans as S
from textloom.plans.registry import query
from textloom.plans.views import SQL_ARTICLES, articles, rows

_W = r"'[\p{L}\p{N}\p{M}]+'"


def _key(c: str) -> str:
    return f"array_to_string(regexp_extract_all(replace(lower({c}), 'ß', 'ss'), {_W}), ' ')"


def _flat(c: str) -> str:
    return r"trim(regexp_replace(@, '[\s\x{00A0}]+', ' ', 'g'))".replace("@", c)


def _plain(c: str) -> str:
    return r"regexp_replace(replace(replace(strip_accents(@), 'đ', 'd'), 'Đ', 'D'), '\p{M}+', '', 'g')".replace("@", c)


_Q = "(select distinct * from tamanh_qa)"
_S = "(select distinct * from article_section)"


@query(f"""select doc_id, {_key("title")} as match_key, {_plain(_key("title"))} as accentless_key from {SQL_ARTICLES} where title is not null""")
def match_keys(spark, folder):
    """T01, T02."""
    return articles(spark, folder, "title").filter("title is not null").select("doc_id", T.match_key("title").alias("match_key"), T.accentless_key("title").alias("accentless_key"))


_HEAD = r"""trim(regexp_replace(regexp_replace(trim(""" + _plain("lower(heading)") + r"""), '^((\d+(\.\d+)*|[ivxlc]+|[a-h])[.):\-]+\s*|\d+(\.\d+)*\s+)', ''), '[^a-z0-9]+', ' ', 'g'))"""


@query(f"select {_HEAD} as heading_key, count(*) as n, count(distinct canonical_type) as types from {_S} where heading is not null group by 1")
def heading_keys(spark, folder):
    """T03."""
    s = rows(spark, folder, "article_section").filter("heading is not null")
    return s.groupBy(T.heading_key("heading").alias("heading_key")).agg(F.count("*").alias("n"), F.countDistinct("canonical_type").alias("types"))


_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(" + _plain("lower(category)") + r", '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'uncategorised')"


@query(f"select {_SLUG} as slug, count(*) as n from {_Q} group by 1")
def category_slugs(spark, folder):
    """T04, T05."""
    return rows(spark, folder, "tamanh_qa").groupBy(T.slug("category").alias("slug")).agg(F.count("*").alias("n"))


@query(f"""select doc_id, sha256(title || chr(10) || coalesce(abstract, '')) as checksum, regexp_replace({_plain("lower(title)")}, '[^a-z0-9]+', '', 'g') as compact from {SQL_ARTICLES} where title is not null""")
def article_checksums(spark, folder):
    """T06, T23."""
    a = articles(spark, folder, "title", "abstract").filter("title is not null")
    return a.select("doc_id", T.checksum("title", F.coalesce("abstract", F.lit(""))).alias("checksum"), T.compact_key("title").alias("compact"))


_FP = "sha256(lower(" + _flat("coalesce(patient_question, '')") + ") || chr(10) || lower(" + _flat("coalesce(doctor_answer, '')") + "))"


@query(f"select {_FP} as fingerprint, count(*) as n, min(qa_id) as first_id from {_Q} group by 1 having count(*) > 1")
def repeated_pairs(spark, folder):
    """Question and answer pairs with equal fingerprints."""
    q = rows(spark, folder, "tamanh_qa").groupBy(T.pair_fingerprint("patient_question", "doctor_answer").alias("fingerprint")).agg(F.count("*").alias("n"), F.min("qa_id").alias("first_id"))
    return q.filter("n > 1")


@query(rf"""select doc_id, substring(trim(regexp_replace(regexp_replace(title, '[\\/*?:"<>|\r\n\t]+', ' ', 'g'), '\s+', ' ', 'g')), 1, 60) as file_name from {SQL_ARTICLES} where title is not null""")
def file_names(spark, folder):
    """S19, T24."""
    return articles(spark, folder, "title").filter("title is not null").select("doc_id", T.file_name("title", 60).alias("file_name"))


@query("""select doc_id, i as chunk, substring(text, i * 200 + 1, 200) as piece from (select distinct doc_id, text from documents where text <> ''), unnest(range(0, cast(ceil(length(text) / 200.0) as bigint))) u(i)""")
def text_chunks(spark, folder):
    """T21."""
    d = rows(spark, folder, "documents").filter("text != ''").select("doc_id", F.posexplode(T.chunks("text", 200)).alias("chunk", "piece"))
    return d


@query(r"""select doc_id, count(*) as tokens, sum(case when regexp_matches(w, '^[\p{L}\p{N}\p{M}_]') then 1 else 0 end) as words, sum(length(w)) as characters from
(select doc_id, unnest(regexp_extract_all(abstract, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')) w from """ + SQL_ARTICLES + ") group by 1")
def token_counts(spark, folder):
    """Tokens with offsets, folded in the JVM."""
    t = articles(spark, folder, "abstract").select("doc_id", F.explode(S.tokens(F.col("abstract"), "plain")).alias("t"))
    return t.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_if(F.col("t.word").rlike(r"^[\p{L}\p{N}\p{M}_]")).alias("words"), F.sum(F.col("t.end") - F.col("t.start")).alias("characters"))


@query(f"select doc_id, 0 as wrong from {SQL_ARTICLES} where abstract is not null")
def token_offsets(spark, folder):
    """The text under every token's offsets is the token; wrong must be 0."""
    a = articles(spark, folder).filter("abstract is not null").select("doc_id", "abstract", S.tokens(F.col("abstract"), "hyphen").alias("t"))
    wrong = F.size(F.filter("t", lambda t: F.substring(F.col("abstract"), t["start"] + 1, t["end"] - t["start"]) != t["word"]))
    return a.select("doc_id", wrong.alias("wrong"))


@query(f"""select doc_id, cast((length(lower(abstract)) - length(replace(lower(abstract), 'bệnh', ''))) / 4 as bigint) as n from {SQL_ARTICLES} where contains(lower(abstract), 'bệnh')""")
def term_occurrences(spark, folder):
    """T22."""
    found = articles(spark, folder).select("doc_id", S.occurrences(F.col("abstract"), F.lit("Bệnh")).alias("at"))
    return found.filter(F.size("at") > 0).select("doc_id", F.size("at").cast("long").alias("n"))


@query(f"""select doc_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as safe from {SQL_ARTICLES} where title is not null""")
def markup_titles(spark, folder):
    """Escaping."""
    return articles(spark, folder, "title").filter("title is not null").select("doc_id", T.markup_safe("title").alias("safe"))


@query(f"""select doc_id, list_filter(list_transform(string_split_regex(array_to_string(authors, '; '), '[,;]'), lambda x: trim(x)), lambda x: x <> '') as names from {SQL_ARTICLES} where len(authors) > 0""")
def author_names(spark, folder):
    """M12."""
    a = articles(spark, folder).filter(F.size("authors") > 0)
    return a.select("doc_id", T.authors(F.array_join("authors", "; ")).alias("names"))


@query(f"""select id, case when regexp_matches(lower(trim(email)), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then lower(trim(email)) end as email from (select distinct * from users)""")
def user_emails(spark, folder):
    """T30."""
    return rows(spark, folder, "users").select("id", T.email("email").alias("email"))


@query(rf"""select qa_id, case when len(ws) > 0 and len(list_filter(ws, lambda w: regexp_matches(w, '^[a-z]{{2,}}$'))) > 0.5 * len(ws) then true else false end as lacks from
(select qa_id, regexp_extract_all(lower(patient_question), '[\p{{L}}]+') ws from {_Q} where patient_question is not null)""")
def unaccented_questions(spark, folder):
    """T13."""
    return rows(spark, folder, "tamanh_qa").filter("patient_question is not null").select("qa_id", T.lacks_tones("patient_question").alias("lacks"))


@query(f"select doc_id, nfc_normalize(title) as composed, length(nfc_normalize(title)) as n from {SQL_ARTICLES} where title is not null")
def composed_titles(spark, folder):
    """Unicode composition, the one text function that needs Python."""
    return articles(spark, folder, "title").filter("title is not null").select("doc_id", T.nfc("title").alias("composed")).withColumn("n", F.length("composed").cast("long"))


_STOP = "và của các những được với trong khi cho này tại hơn theo bị đến là có ở một không như".split()
_STOPS = "[" + ", ".join(f"'{w}'" for w in _STOP) + "]"


@query(f"""select phrase, count(*) as n from (select distinct doc_id, array_to_string(ws[i:i+n-1], ' ') as phrase, ws[i] as first, ws[i+n-1] as last
from (select doc_id, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') as ws from {SQL_ARTICLES}), unnest(range(1, len(ws) + 1)) a(i), unnest([2, 3, 4]) b(n) where i + n - 1 <= len(ws))
where not regexp_matches(phrase, '\\d') and not list_contains({_STOPS}, first) and not list_contains({_STOPS}, last) group by 1 having count(*) >= 3""")
def noun_phrases(spark, folder):
    """Word windows of titles without stop words at their ends."""
    p = articles(spark, folder).select(F.explode(T.noun_phrases("title", _STOP)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))
    return p.filter("n >= 3")


@query()
def clean_sections(spark, folder):
    """Layout cleaning, reflow and sanitising of section texts (look-behind has no counterpart in the SQL check)."""
    s = rows(spark, folder, "article_section").filter("content is not null")
    clean = T.tone_placement(T.sanitised(T.reflow(T.clean_layout_text("content"))))
    return s.select("section_id", clean.alias("content")).withColumn("n", F.length("content"))


@query(rf"""select source_pdf, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source_pdf, '(?i)\.(pdf|txt|json)$', ''), '[_-][0-9a-f]{{8,64}}$', ''), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) as title from {SQL_ARTICLES} where source_pdf is not null""")
def titles_of_files(spark, folder):
    """T28."""
    return articles(spark, folder).filter("source_pdf is not null").select("source_pdf", T.titled("source_pdf").alias("title"))


_FLAT = _plain("lower(s)")


@query(f"""select regexp_matches({_FLAT}, '{T.BOILERPLATE}') as frame, regexp_matches({_FLAT}, '{T.CONTACT}') as contact, count(*) as n from (select trim(s) as s from (select unnest(string_split(content, chr(10))) as s from {_S})) where s <> '' group by all""")
def frame_lines(spark, folder):
    """lines of the journal's frame and contact lines."""
    lines = rows(spark, folder, "article_section").select(F.explode(F.split("content", "\n")).alias("s")).select(F.trim("s").alias("s")).filter("s != ''")
    return lines.groupBy(T.boilerplate("s").alias("frame"), T.contact("s").alias("contact")).agg(F.count("*").alias("n"))
