"""Document structure: layout lines in reading order, repeated frames, headings, section types and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions import text as T
from textloom.runtime import materialise

# Section types with the headings that name them; compared without accents.
ONTOLOGY = {
    "ABSTRACT": ["tóm tắt", "abstract", "summary"],
    "GRAPHICAL_ABSTRACT": ["graphical abstract"],
    "KEYWORDS": ["từ khóa", "keywords", "key words"],
    "INTRODUCTION": ["đặt vấn đề", "mở đầu", "giới thiệu", "introduction"],
    "BACKGROUND": ["bối cảnh", "background"],
    "OBJECTIVES": ["mục tiêu", "objective", "objectives", "aims"],
    "METHODS": ["đối tượng và phương pháp", "phương pháp nghiên cứu", "phương pháp", "materials and methods", "patients and methods", "methods"],
    "STUDY_POPULATION": ["đối tượng nghiên cứu", "study population", "participants"],
    "INCLUSION_CRITERIA": ["tiêu chuẩn lựa chọn", "inclusion criteria"],
    "EXCLUSION_CRITERIA": ["tiêu chuẩn loại trừ", "exclusion criteria"],
    "STUDY_DESIGN": ["thiết kế nghiên cứu", "study design"],
    "STUDY_TIME": ["thời gian nghiên cứu", "study period", "study time"],
    "STUDY_LOCATION": ["địa điểm nghiên cứu", "study setting", "study location"],
    "SAMPLE_SIZE": ["cỡ mẫu", "sample size"],
    "SAMPLING": ["phương pháp chọn mẫu", "sampling"],
    "DATA_COLLECTION": ["thu thập số liệu", "data collection"],
    "STATISTICAL_ANALYSIS": ["xử lý số liệu", "phân tích số liệu", "statistical analysis", "data analysis"],
    "ETHICS": ["đạo đức nghiên cứu", "ethics approval", "ethical approval"],
    "RESULTS": ["kết quả", "kết quả nghiên cứu", "results"],
    "PARTICIPANT_CHARACTERISTICS": ["đặc điểm chung", "đặc điểm đối tượng", "participant characteristics"],
    "DISCUSSION": ["bàn luận", "discussion"],
    "RESULTS_DISCUSSION": ["kết quả và bàn luận", "results and discussion"],
    "CONCLUSION": ["kết luận", "conclusion", "conclusions"],
    "RECOMMENDATION": ["khuyến nghị", "kiến nghị", "recommendation", "recommendations"],
    "ACKNOWLEDGEMENT": ["lời cảm ơn", "acknowledgement", "acknowledgment", "acknowledgements", "acknowledgments"],
    "FUNDING": ["kinh phí", "funding"],
    "CONFLICT_OF_INTEREST": ["xung đột lợi ích", "conflict of interest", "conflict of interest statement", "competing interests"],
    "DATA_AVAILABILITY": ["data availability", "availability of data and materials"],
    "AUTHOR_CONTRIBUTIONS": ["author contributions", "credit authorship contribution statement"],
    "SUPPLEMENTARY_DATA": ["supplementary data"],
    "REFERENCES": ["tài liệu tham khảo", "references", "bibliography"],
}
# Types that a type may stand below, the nearer first.
PARENTS = {
    "BACKGROUND": ["INTRODUCTION"], "OBJECTIVES": ["INTRODUCTION"], "STUDY_POPULATION": ["METHODS"], "INCLUSION_CRITERIA": ["STUDY_POPULATION", "METHODS"],
    "EXCLUSION_CRITERIA": ["STUDY_POPULATION", "METHODS"], "STUDY_DESIGN": ["METHODS"], "STUDY_TIME": ["METHODS"], "STUDY_LOCATION": ["METHODS"], "SAMPLE_SIZE": ["METHODS"],
    "SAMPLING": ["METHODS"], "DATA_COLLECTION": ["METHODS"], "STATISTICAL_ANALYSIS": ["METHODS"], "ETHICS": ["METHODS"], "PARTICIPANT_CHARACTERISTICS": ["RESULTS"],
}
EXPECTED = ["ABSTRACT", "INTRODUCTION", "METHODS", "RESULTS", "DISCUSSION", "CONCLUSION", "REFERENCES"]


def section_type(heading: Column) -> Column:
    """struct(type, confidence): an alias as it stands, else the type whose alias shares most words (three quarters at least), else OTHER;
    UNKNOWN without words."""
    pick = lambda name, c: F.struct(F.lit(name).alias("type"), c.alias("confidence"))
    keyed = F.struct(T.heading_key(heading).alias("key"), T.no_accents(T.fold(F.trim(heading))).alias("raw"))

    def named(k: Column) -> Column:
        words = F.array_distinct(F.split(k["key"], " "))
        share = lambda a: F.size(F.array_intersect(words, F.split(F.lit(a), " "))) / F.greatest(F.size(words), F.lit(len(set(a.split()))))
        flat = [(n, T.plain_letters(a)) for n, al in ONTOLOGY.items() for a in al]
        near = F.array_max(F.array(*(F.struct(share(a).alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, a) in enumerate(flat))))
        close = lambda n: F.when(n["s"] >= 0.75, F.struct(n["name"].alias("type"), F.round(0.7 + 0.2 * n["s"], 4).alias("confidence"))).otherwise(pick("OTHER", F.lit(0.35)))
        exact = F.element_at(F.create_map(*(F.lit(x) for n, a in flat for x in (a, n))), k["key"])
        sure = F.struct(exact.alias("type"), F.when(k["raw"] == k["key"], 0.99).otherwise(0.91).alias("confidence"))
        return F.when(k["key"] == "", pick("UNKNOWN", F.lit(0.0))).when(exact.isNotNull(), sure).otherwise(T.let(near, close))

    return T.let(keyed, named)


def numbering_depth(heading: Column) -> Column:
    """1 for `2.` and roman numbers, one more for each further number; null without numbering."""
    number = F.regexp_extract(F.trim(heading), r"^(\d+(?:\.\d+)*)[.)]?\s", 1)
    return F.when(number != "", F.size(F.split(number, r"\."))).when(F.trim(heading).rlike(r"^[IVX]+[.)]\s"), 1)


def bounded(headings: DataFrame, key: str, position: str, length: str) -> DataFrame:
    """Each heading's end: where the next of its document begins, else the end of the text."""
    w = Window.partitionBy(key).orderBy(position)
    return headings.withColumn("end_position", F.coalesce(F.lead(position).over(w), F.col(length)))


def parents(sections: Column) -> Column:
    """array<struct<section_id, level, parent_id>> of array<struct<section_id, level>> in reading order: a fold with a stack of open sections."""
    kind = "array<struct<section_id:string,level:int>>"
    zero = F.struct(F.array().cast(kind).alias("stack"), F.array().cast("array<struct<section_id:string,level:int,parent_id:string>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        open_ = F.filter(acc["stack"], lambda o: o["level"] < s["level"])
        parent = F.when(F.size(open_) > 0, F.element_at(open_, -1)["section_id"])
        me = F.struct(s["section_id"].alias("section_id"), s["level"].alias("level"))
        return F.struct(F.array_append(open_, me).alias("stack"), F.array_append(acc["out"], F.struct(s["section_id"].alias("section_id"), s["level"].alias("level"), parent.alias("parent_id"))).alias("out"))

    return F.aggregate(sections, zero, step, lambda acc: acc["out"])


def descendants(sections: DataFrame, depth: int = 64) -> DataFrame:
    """(ancestor, section_id, depth) of sections (section_id, parent_id), each section its own ancestor at 0; at most depth levels, which also
    ends rings. Each level is written and joined once, and the walk ends with the first level that is empty."""
    pairs = sections.select(F.col("section_id").alias("ancestor"), "section_id").distinct()
    edges = materialise(sections.filter("parent_id is not null").select("parent_id", F.col("section_id").alias("child")).distinct(), "edges")
    levels = [materialise(pairs.withColumn("depth", F.lit(0)), "level")]
    for d in range(1, depth + 1):
        below = levels[-1].join(edges, F.col("section_id") == F.col("parent_id")).select("ancestor", F.col("child").alias("section_id"), F.lit(d).alias("depth"))
        below = materialise(below, "level")
        if below.isEmpty():
            break
        levels.append(below)
    return reduce(DataFrame.unionByName, levels)


def grounded(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, name, block, last, n, text) of proposed sections (doc_id, name, block, evidence) over blocks (doc_id, block, text): a proposal holds
    where its evidence stands in the block it names, blind to case, accents and signs; it reaches to the block before the next that holds, and its
    text is that of its blocks. Proposals without evidence in their block are dropped; of several for one block the first by name holds."""
    shown = candidates.join(blocks, ["doc_id", "block"]).filter(T.supported("evidence", "text")).groupBy("doc_id", "block").agg(F.min("name").alias("name"))
    own = Window.partitionBy("doc_id").orderBy("block")
    bounds = shown.withColumn("until", F.lead("block").over(own))
    inside = bounds.join(blocks.select("doc_id", F.col("block").alias("b"), "text"), "doc_id").filter("b >= block and (until is null or b < until)")
    out = inside.groupBy("doc_id", "name", "block").agg(F.max("b").alias("last"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("b", "text"))).alias("t"))
    return out.select("doc_id", "name", "block", "last", "n", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def reading_order(blocks: DataFrame, key: list[str], width: str = "page_width") -> DataFrame:
    """blocks (key..., x0, y0, x1, y1, page_width) with ord: blocks as wide as the page part it into regions; in a region the left column first."""
    full = (F.col("x1") - F.col("x0")) >= 0.6 * F.col(width)
    w = Window.partitionBy(*key).orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, 0)
    region = 2 * F.sum(full.cast("int")).over(w) - full.cast("int")
    column = F.when(full, 0).when((F.col("x0") + F.col("x1")) / 2 < F.col(width) / 2, 0).otherwise(1)
    r = blocks.withColumn("__r", region).withColumn("__c", column)
    return r.withColumn("ord", F.row_number().over(Window.partitionBy(*key).orderBy("__r", "__c", "y0", "x0"))).drop("__r", "__c")


def without_frames(lines: DataFrame, doc: str, page: str, text: str, y: str, height: str) -> DataFrame:
    """Layout lines without page numbers and without texts in the margins (8 %) that recur, numbers apart, on two pages of a document."""
    key = F.regexp_replace(T.compact_key(text), r"\d+", "#")
    margin = (F.col(y) < 0.08 * F.col(height)) | (F.col(y) > 0.92 * F.col(height))
    marked = lines.withColumn("__k", key).withColumn("__m", margin)
    often = marked.filter("__m").groupBy(doc, "__k").agg(F.countDistinct(page).alias("n")).filter("n >= 2").select(doc, "__k", F.lit(True).alias("__often"))
    out = marked.join(often, [doc, "__k"], "left")
    return out.filter(~(F.col("__m") & (F.coalesce("__often", F.lit(False)) | F.col(text).rlike(r"^\s*\d+\s*$")))).drop("__k", "__m", "__often")


def body_size(lines: DataFrame, doc: str, size: str, text: str) -> DataFrame:
    """(doc, body_size): the font size of most characters; ties to the smaller."""
    n = lines.groupBy(doc, F.round(size, 1).alias("__s")).agg(F.sum(F.length(text)).alias("__n"))
    return n.groupBy(doc).agg(F.max(F.struct("__n", (-F.col("__s")).alias("s"))).alias("b")).select(doc, (-F.col("b.s")).alias("body_size"))


def heading_score(text: Column, size: Column, body: Column, bold: Column, gap: Column) -> Column:
    """Evidence 0 to 1 that a layout line is a heading: known name, larger, bold, numbered, short, apart."""
    known = F.when(section_type(text)["confidence"] >= 0.9, 1.0).otherwise(0.0)
    parts = [(0.22, known), (0.20, F.when(size > body * 1.08, 1.0).otherwise(0.0)), (0.20, F.when(bold >= 0.6, 1.0).otherwise(0.0)), (0.10, F.when(numbering_depth(text).isNotNull(), 1.0).otherwise(0.0)), (0.20, F.when(F.length(text) <= 90, 1.0).otherwise(0.0)), (0.08, F.when(gap > 1.2 * size, 1.0).otherwise(0.0))]
    return F.round(reduce(lambda a, p: a + p[0] * p[1], parts, F.lit(0.0)), 4)


def box_overlap(a: Column, b: Column) -> Column:
    """Share of box a that lies in b; boxes are structs of x0, y0, x1, y1."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def packed(records: Column, budget: int) -> Column:
    """array<string>: records joined by newlines into packs of at most budget characters; none is cut, a longer one is a pack of its own."""
    zero = F.array().cast("array<string>")

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(r) <= budget)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws("\n", last, r)))).otherwise(F.array_append(acc, r))

    return F.aggregate(records, zero, step)
