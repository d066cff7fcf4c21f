"""Language gate by signals of marks and words: evidence of chunks, assessment of a document, admission.

The probability of a language comes from a pluggable column; by default the share of stop words. This is the gate of the corpus
pipeline, not an identification of languages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions import text as T

# Signal words and thresholds of the gate.
VI_WORDS = ["và", "của", "các", "được", "trong", "người", "bệnh", "nghiên", "cứu", "điều", "trị", "kết", "quả", "phương", "pháp", "tại", "với", "cho", "theo", "đánh", "giá", "mục", "tiêu", "đối", "tượng", "thời", "gian"]
EN_WORDS = ["the", "and", "of", "in", "for", "with", "this", "that", "study", "patients", "methods", "results", "conclusion", "background", "objective", "treatment", "medical", "clinical", "were", "was", "from", "between", "data"]
VI_MARKS = "[ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ]"
CHUNK, MIN_CHARS = 1000, 40
VI_CHUNK, EN_CHUNK, VI_LEAD, EN_LEAD = 0.52, 0.58, 0.08, 0.10
VI_DOCUMENT, EN_DOCUMENT = 0.72, 0.65
MARK_MOST, WORD_MOST, WORD_EACH = 0.28, 0.24, 0.035
VERSION = "2.0"


def evidence(chunk: Column, p_vi: Column | None = None) -> Column:
    """struct(label, vi, en, chars) of a chunk."""
    low = T.fold(chunk)
    seen = F.struct(low.alias("low"), F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)).alias("words"), F.length(F.regexp_replace(low, r"[^\p{L}]", "")).alias("letters"))
    hits = lambda s, ws: F.size(F.array_intersect(s["words"], F.array(*(F.lit(w) for w in ws))))
    counted = lambda s: F.struct(hits(s, VI_WORDS).alias("nv"), hits(s, EN_WORDS).alias("ne"), s["letters"].alias("letters"), F.regexp_count(s["low"], F.lit(VI_MARKS)).alias("marks"))

    def scored(c: Column) -> Column:
        p = p_vi if p_vi is not None else F.when(c["nv"] + c["ne"] > 0, c["nv"] / (c["nv"] + c["ne"])).otherwise(F.lit(0.5))
        marked = F.when(c["letters"] > 0, F.least(F.lit(MARK_MOST), 4 * c["marks"] / c["letters"])).otherwise(0.0)
        vi = F.least(F.lit(1.0), 0.72 * p + marked + F.least(F.lit(WORD_MOST), WORD_EACH * c["nv"]))
        en = F.least(F.lit(1.0), 0.76 * (1 - p) + F.least(F.lit(WORD_MOST), WORD_EACH * c["ne"]))
        return F.struct(vi.alias("vi"), en.alias("en"), c["letters"].alias("letters"))

    def labelled(v: Column) -> Column:
        vi, en = v["vi"], v["en"]
        label = F.when(v["letters"] == 0, "unknown").when((vi >= VI_CHUNK) & (vi >= en + VI_LEAD), "vi").when((en >= EN_CHUNK) & (en >= vi + EN_LEAD), "en").otherwise("mixed")
        return F.struct(label.alias("label"), F.round(vi, 4).alias("vi"), F.round(en, 4).alias("en"), F.length(chunk).alias("chars"))

    return T.let(seen, lambda s: T.let(counted(s), lambda c: T.let(scored(c), labelled)))


def assessment(text: Column) -> Column:
    """struct(label, vi_ratio, en_ratio, chars): chunks weighed by their characters."""
    def summed(parts: Column) -> Column:
        chars = lambda name: F.aggregate(F.filter(parts, lambda p: p["label"] == name), F.lit(0), lambda a, p: a + p["chars"])
        return F.struct(F.aggregate(parts, F.lit(0), lambda a, p: a + p["chars"]).alias("total"), chars("vi").alias("vi"), chars("en").alias("en"), chars("unknown").alias("unknown"))

    def judged(t: Column) -> Column:
        ratio = lambda c: F.when(t["total"] > 0, F.round(t[c] / t["total"], 4)).otherwise(0.0)
        label = F.when(t["total"] == t["unknown"], "unknown").when(ratio("vi") >= VI_DOCUMENT, "vi").when(ratio("en") >= EN_DOCUMENT, "en").otherwise("mixed")
        return F.struct(label.alias("label"), ratio("vi").alias("vi_ratio"), ratio("en").alias("en_ratio"), t["total"].alias("chars"))

    pieces = T.let(T.flat(F.coalesce(text, F.lit(""))), lambda x: T.chunks(x, CHUNK))
    return T.let(F.transform(pieces, lambda c: evidence(c)), lambda parts: T.let(summed(parts), judged))


def text_to_assess(body: Column, full: Column) -> Column:
    """The body, unless it is less than half of the full text."""
    return F.when(F.length(F.coalesce(body, F.lit(""))) >= 0.5 * F.length(F.coalesce(full, F.lit(""))), body).otherwise(full)


def admission(assessed: Column) -> Column:
    decide = lambda a: F.when(a["chars"] < MIN_CHARS, "REJECTED_NO_TEXT").when(a["label"] == "vi", "ACCEPTED").when(a["label"] == "en", "REJECTED_ENGLISH").when(a["label"] == "unknown", "REJECTED_NO_TEXT").otherwise("REJECTED_MIXED")
    return T.let(assessed, decide)


def quarantine_path(source: Column, status: Column, root: str = "quarantine") -> Column:
    """Where a rejected file goes: by status, with a digest of its path so that equal names do not meet."""
    name = F.element_at(F.split(source, "/"), -1)
    return F.concat(F.lit(f"{root}/"), F.lower(status), F.lit("/"), F.substring(F.sha2(source, 256), 1, 8), F.lit("_"), name)
