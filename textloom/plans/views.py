"""Logical tables of the queries: copies of rows count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.runtime import table

MARKS = "array<struct<text:string,start:int,end:int,category:string,code:string,label:string,action:string>>"
SQL_MARKS = """'[{"text":"VARCHAR","start":"INTEGER","end":"INTEGER","category":"VARCHAR","code":"VARCHAR","label":"VARCHAR","action":"VARCHAR"}]'"""


def marks(json: Column | str) -> Column:
    """Spans of a payload; null where it is null or no whole JSON array."""
    text = F.col(json) if isinstance(json, str) else json
    return F.when(F.trim(text).endswith("]") & F.get_json_object(text, "$").isNotNull(), F.from_json(text, MARKS))


def sql_marks(column: str) -> str:
    return f"case when json_valid({column}) then json_transform({column}, {SQL_MARKS}) end"


def rows(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The rows of a table, copies once; only columns (which must hold the key) are read and shuffled where they are named."""
    df = table(spark, folder, name)
    return (df.select(*columns) if columns else df).distinct()


def articles(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return rows(spark, folder, "article_extraction", "doc_id", *columns) if columns else table(spark, folder, "article_extraction").dropDuplicates(["doc_id"])


def reviews_in_force(spark: SparkSession, folder: str) -> DataFrame:
    """The review of the greatest id of each document and expert."""
    r = rows(spark, folder, "expert_reviews")
    return r.join(r.groupBy("document_id", "expert_id").agg(F.max("id").alias("id")), ["document_id", "expert_id", "id"], "left_semi")


SQL_REVIEWS = "(select * from (select distinct * from expert_reviews) r where id = (select max(id) from expert_reviews x where x.document_id = r.document_id and x.expert_id = r.expert_id))"


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """(term, code, category): terms of the original labels of reviews, each with its most frequent code and category (ties: the least)."""
    m = rows(spark, folder, "expert_reviews", "id", "original_labels_json").select(F.explode(marks("original_labels_json")).alias("m")).select(F.lower("m.text").alias("term"), "m.code", "m.category")
    counts = m.filter("length(term) >= 2 and code is not null").groupBy("term", "code", "category").agg(F.count("*").alias("n"))
    return counts.groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("k"), "code", "category")).alias("b")).select("term", "b.code", "b.category")


SQL_DICTIONARY = f"""(select term, code, category from (
  select term, code, category, row_number() over (partition by term order by count(*) desc, code, category) rn
  from (select lower(m.text) term, m.code code, m.category category from (select unnest({sql_marks("original_labels_json")}) m from (select distinct * from expert_reviews)))
  where length(term) >= 2 and code is not null group by term, code, category) where rn = 1)"""

SQL_WORDS = r"'[\p{L}\p{N}\p{M}]+'"
SQL_ARTICLES = "(select distinct * from article_extraction)"


def sql_ngrams(source: str, key: str, column: str, most: int | str | None = None) -> str:
    """(key, i, n, k): word n-grams of a column in SQL, by default as long as the dictionary's longest term."""
    most = f"(select max(len(string_split(term, ' '))) from {SQL_DICTIONARY})" if most is None else most
    return f"""(select {key}, i, n, array_to_string(ws[i:i+n-1], ' ') k
      from (select {key}, regexp_extract_all(lower({column}), {SQL_WORDS}) ws from {source}), unnest(range(1, len(ws) + 1)) a(i), unnest(range(1, {most} + 1)) b(n) where i + n - 1 <= len(ws))"""


def sql_placed(source: str, key: str, column: str, pattern: str, gap: str | None = None) -> str:
    """(key, pos, word, s, e): the matches of a pattern in a column with their offsets, which are sums of the lengths of matches and gaps."""
    parts, kept = (pattern, "true") if gap is None else (f"(?:{pattern})|{gap}", f"not regexp_matches(p, '^{gap}')")
    return f"""(select {key}, row_number() over (partition by {key} order by i) - 1 as pos, p as word, cast(at_ as int) as s, cast(at_ + length(p) as int) as e from
      (select {key}, i, p, coalesce(sum(length(p)) over (partition by {key} order by i rows between unbounded preceding and 1 preceding), 0) as at_
       from (select {key}, generate_subscripts(ps, 1) as i, unnest(ps) as p from (select {key}, regexp_extract_all({column}, '{parts}') as ps from {source}))) where {kept})"""


SQL_PLAIN = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_ \t\n\x0b\f\r]"
SQL_BLANK = r"[ \t\n\x0b\f\r]+"
