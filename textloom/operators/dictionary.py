"""Term dictionaries and dictionary matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import text as T
from textloom.operators import spans as S
from textloom.runtime import materialise

# Match ranks (smaller is surer) and priorities of sources (greater wins).
RANK = {"exact": 0, "abbreviation": 1, "alias": 2, "clinical_form": 2, "accentless": 3}
PRIORITY = {"custom": 3, "traditional": 2, "icd": 1}
FIRST_WORDS = 200_000  # distinct first words of terms that are sent to all tasks, at most
SUFFIX = 8  # signs at the end of a term's surface, at most


def by_chapter(code: Column) -> Column:
    """Entity type of an ICD-10 code by its chapter: R is symptoms; V to Z are none; all else diseases."""
    first = F.upper(F.substring(code, 1, 1))
    return F.when(first == "R", "SYMPTOM").when(first.isin(*"VWXYZ"), F.lit(None).cast("string")).when(first.rlike("[A-U]"), "DISEASE")


def admissible(term: Column, active: Column, ambiguous: Column) -> Column:
    key = T.match_key(term)
    return (F.length(key) >= 2) & key.rlike(r"\p{L}") & F.coalesce(active, F.lit(True)) & ~F.coalesce(ambiguous, F.lit(False))


def with_aliases(terms: DataFrame) -> DataFrame:
    """terms (term, ...) with a row for each safe alias; alias_type canonical or alias."""
    return terms.withColumn("__a", F.explode(T.aliases_of("term"))).withColumn("alias_type", F.when(F.col("__a") == T.flat("term"), "canonical").otherwise("alias")).withColumn("canonical_term", F.col("term")).withColumn("term", F.col("__a")).drop("__a")


def resolved_keys(terms: DataFrame) -> DataFrame:
    """One entry per match key of terms (term, code, category, source, alias_type, seq): the source of greater priority, a form
    never before an entry of another kind, then the later one."""
    keyed = terms.withColumn("key", T.match_key("term")).filter("length(key) > 0")
    priority = F.coalesce(F.element_at(F.create_map(*(x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v)))), F.col("source")), F.lit(0))
    rest = [c for c in terms.columns if c != "seq"]
    best = keyed.groupBy("key").agg(F.max(F.struct((F.col("alias_type") != "clinical_form").cast("int").alias("form"), priority.alias("p"), "seq", *rest)).alias("b"))
    return best.select("key", *(F.col(f"b.{c}").alias(c) for c in rest))


def accentless_index(entries: DataFrame) -> DataFrame:
    """(plain, key, code, category) for keys of several words that accents alone lead to one (code, category); the longest key counts."""
    plain = entries.select("key", "code", "category", T.no_accents("key").alias("plain")).filter("plain != key and instr(key, ' ') > 0")
    one = plain.groupBy("plain").agg(F.countDistinct("code", "category").alias("targets"), F.max(F.struct(F.length("key").alias("n"), "key", "code", "category")).alias("b"))
    return one.filter("targets = 1").select("plain", "b.key", "b.code", "b.category")


def with_longest(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """texts with most: the words of the longest of terms (n), a frame of one row; 1 where there are none."""
    return texts.crossJoin(F.broadcast(terms.agg(F.coalesce(F.max("n"), F.lit(1)).alias("most"))))


def _runs(firsts, most: int):
    """Column function text -> array<struct<first, start, run array<struct<word, end>>, seen>>: at each word that begins a term, the words from it on,
    as many as the longest term has, folded for comparison, with their ends in the untouched text, and that text itself."""

    def find(text: str) -> list[dict]:
        import unicodedata

        import regex

        found = [(m.start(), m.end(), unicodedata.normalize("NFC", m[0]).lower().replace("ß", "ss")) for m in regex.finditer(S.TOKENS["words"], text)]
        known, out = firsts.value if firsts is not None else None, []
        for i, (start, _, word) in enumerate(found):
            if known is None or word in known:
                run = found[i : i + most]
                out.append({"first": word, "start": start, "run": [{"word": w, "end": e} for _, e, w in run], "seen": text[start : run[-1][1] + SUFFIX]})
        return out

    return S.row_function("array<struct<first:string,start:int,run:array<struct<word:string,end:int>>,seen:string>>", find)


def candidates(texts: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """(key, start, end, text, term, code, category, matched_by, rank) of dictionary terms in texts. Offsets are those of the untouched text.

    entries: (key, code, category[, alias_type, surface, case_sensitive]). Words are met by the first word of a term, then compared whole, so that runs
    that begin no term are never formed; up to FIRST_WORDS first words are known to the tasks that cut the texts, beyond that all words go to
    the join. A run that is itself without accents also meets the accentless index. A run is as long as the dictionary's longest term, so that no
    term is left out. Signs that end the term's surface belong to the match where they stand behind it; a case-sensitive term is met only in capitals.
    """
    has = lambda c, other: F.col(c) if c in entries.columns else other
    suffix = F.regexp_extract(has("surface", F.lit("")), r"([^\p{L}\p{N}\p{M}\s]{1,%d})\s*$" % SUFFIX, 1)
    kind = F.when(F.col("alias_type") == "canonical", "exact").otherwise(F.col("alias_type")) if "alias_type" in entries.columns else F.lit("exact")
    exact = entries.select(F.col("key").alias("term"), "code", "category", kind.alias("matched_by"), suffix.alias("suffix"), F.coalesce(has("case_sensitive", F.lit(False)), F.lit(False)).alias("cased"))
    own = exact.select(F.col("term").alias("key"), "suffix", "cased")
    plain = accentless_index(entries).join(own, "key").select(F.col("plain").alias("term"), "code", "category", F.lit("accentless").alias("matched_by"), "suffix", "cased")
    every = exact.unionByName(plain).withColumn("n", F.size(F.split("term", " "))).withColumn("first", F.substring_index("term", " ", 1))
    every = materialise(every, "terms")
    firsts = [r.first for r in every.select(F.col("first")).distinct().limit(FIRST_WORDS + 1).collect()]
    known = every.sparkSession.sparkContext.broadcast(frozenset(firsts)) if len(firsts) <= FIRST_WORDS else None
    most = every.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    words = texts.select(F.col(key).alias("key"), F.explode(_runs(known, most)(F.col(text))).alias("t")).select("key", "t.*")
    met = words.join(every, "first")
    run = F.slice("run", F.lit(1), F.col("n"))
    met = met.filter(F.array_join(F.transform(run, lambda x: x["word"]), " ") == F.col("term"))
    bare = F.element_at(run, -1)["end"]
    behind = F.substring("seen", bare - F.col("start") + 1, F.length("suffix"))
    met = met.withColumn("end", (bare + F.when(behind == F.col("suffix"), F.length("suffix")).otherwise(0)).cast("int")).withColumn("text", F.substring("seen", F.lit(1), F.col("end") - F.col("start")))
    met = met.filter(~F.col("cased") | T.all_capitals("text"))
    rank = F.element_at(F.create_map(*(x for k, v in RANK.items() for x in (F.lit(k), F.lit(v)))), F.col("matched_by"))
    return met.select("key", "start", "end", "text", "term", "code", "category", "matched_by", F.coalesce(rank, F.lit(9)).alias("rank"))


def longest_matches(found: DataFrame) -> DataFrame:
    """Candidates without overlaps: the longest, then the surest, then the first. Per document, folded in the JVM."""
    fields = ["start", "end", "text", "term", "code", "category", "matched_by", "rank"]
    sets = found.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("s"))
    return sets.select("key", F.explode(S.resolved(F.col("s"), "engine", ["code", "term"])).alias("s")).select("key", "s.*")


def highlighted(text: Column, spans: Column) -> Column:
    """Markup of a text with its spans (sorted, free of overlaps) marked; without the tags and escapes it is the text again."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = T.markup_safe(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], before, F.lit('<mark data-code="'), T.markup_safe(F.coalesce(s["code"], F.lit(""))), F.lit('">'), T.markup_safe(F.substring(text, s["start"] + 1, s["end"] - s["start"])), F.lit("</mark>")).alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], T.markup_safe(F.substring(text, acc["at"] + 1, F.length(text)))))


def merged_sources(ai: DataFrame, found: DataFrame) -> DataFrame:
    """AI spans (key, start, end, text, code, category) and dictionary spans in one set: AI spans must stand verbatim (the caller's check); those
    strictly inside a dictionary span go; equal spans take the dictionary's metadata with source ai+dictionary."""
    d = found.select("key", "start", "end", "text", "code", "category", F.lit("dictionary").alias("source"))
    inside = S.overlap_join(ai.select("key", "start", "end"), d.select("key", "start", "end"), ["key"]).filter("l_start >= r_start and l_end <= r_end and l_end - l_start < r_end - r_start")
    kept = ai.join(inside.select("key", F.col("l_start").alias("start"), F.col("l_end").alias("end")).distinct(), ["key", "start", "end"], "left_anti")
    both = d.unionByName(kept.select("key", "start", "end", "text", "code", "category", F.lit("ai").alias("source")))
    top = F.max(F.struct(F.col("source") == "dictionary", "text", "code", "category")).alias("m")
    return both.groupBy("key", "start", "end").agg(top, F.array_join(F.sort_array(F.collect_set("source")), "+").alias("source")).select("key", "start", "end", "m.text", "m.code", "m.category", "source")


def symptom_or_disease(text: Column, before: Column, lexicon: Column) -> Column:
    """struct(label, confidence, by): lexicon (DISEASE, SYMPTOM or null for the term), then the words before, then the form of the term, else symptom at one half."""
    t, b = T.no_accents(T.fold(text)), T.no_accents(T.fold(before))
    pick = lambda label, conf, by: F.struct(F.lit(label).alias("label"), F.lit(conf).alias("confidence"), F.lit(by).alias("by"))
    return (
        F.when(lexicon == "DISEASE", pick("DISEASE", 0.99, "lexicon"))
        .when(lexicon == "SYMPTOM", pick("SYMPTOM", 0.99, "lexicon"))
        .when(b.rlike(r"(trieu chung|dau hieu|bieu hien)\W*(\w+\W+){0,4}$"), pick("SYMPTOM", 0.85, "context"))
        .when(b.rlike(r"(chan doan|mac|benh|dieu tri)\W*(\w+\W+){0,3}$"), pick("DISEASE", 0.8, "context"))
        .when(t.rlike(r"^(benh|viem|ung thu|hoi chung|suy|u) "), pick("DISEASE", 0.75, "pattern"))
        .when(t.rlike(r"^(dau|sot|ho|non|buon non|chong mat|met|phu|te|ngua)( |$)"), pick("SYMPTOM", 0.75, "pattern"))
        .otherwise(pick("SYMPTOM", 0.5, "default"))
    )
