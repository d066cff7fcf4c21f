"""Token tags: spans to tags and back, repair, validation, detokenising, standoff and column text."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.spans import row_function


def tagged(tokens: DataFrame, spans: DataFrame, key: list[str], outside: str = "O") -> DataFrame:
    """tokens (key..., pos, word, start, end) with tag: B- where a span begins, I- inside, else outside (O, or IGN where only some labels were
    annotated). Of several spans over a token the first by start, then the longest."""
    s = spans.select(*key, F.col("start").alias("s"), F.col("end").alias("e"), "label")
    cut = 256  # bins keep a long document's join spread
    t = tokens.withColumn("__b", (F.col("start") / cut).cast("int"))
    s = s.withColumn("__b", F.explode(F.sequence((F.col("s") / cut).cast("int"), ((F.col("e") - 1) / cut).cast("int"))))
    met = t.join(s, [*key, "__b"]).filter("start >= s and end <= e")
    best = met.groupBy(*key, "pos").agg(F.min(F.struct("s", (-F.col("e")).alias("x"), "label", F.col("start").alias("at"))).alias("b"))
    tag = F.concat(F.when(F.col("b.at") == F.col("b.s"), "B-").otherwise("I-"), F.col("b.label"))
    return tokens.join(best.select(*key, "pos", tag.alias("tag")), [*key, "pos"], "left").withColumn("tag", F.coalesce("tag", F.lit(outside)))


def repaired(tags: Column) -> Column:
    """array<string>: an I-X that follows no X begins one; anything but O, IGN, B-X and I-X becomes O."""
    fit = F.transform(tags, lambda t: F.when(t.rlike(r"^(O|IGN|[BI]-\S+)$"), t).otherwise("O"))
    prev = lambda i: F.when(i > 0, F.element_at(fit, F.when(i > 0, i).otherwise(F.lit(1)))).otherwise("O")
    return F.transform(fit, lambda t, i: F.when(t.startswith("I-") & (F.substring(prev(i), 3, 1000) != F.substring(t, 3, 1000)), F.concat(F.lit("B-"), F.substring(t, 3, 1000))).otherwise(t))


def to_spans(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., label, first, last, start, end) of rows (key..., pos, tag, start, end): gaps and islands within a sentence."""
    w = Window.partitionBy(*key).orderBy("pos")
    prev = F.lag("tag").over(w)
    begins = F.col("tag").startswith("B-") | (F.col("tag").startswith("I-") & F.coalesce(F.substring(prev, 3, 1000) != F.substring("tag", 3, 1000), F.lit(True)))
    marked = rows.withColumn("__begin", begins.cast("int"))
    marked = marked.withColumn("__island", F.sum("__begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("tag").rlike("^[BI]-"))
    spans = marked.groupBy(*key, "__island").agg(F.min_by(F.substring("tag", 3, 1000), "pos").alias("label"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.drop("__island")


@lru_cache(maxsize=None)
def _detokenised():
    def join(words: list[str]) -> dict:
        out, spans, at, last = [], [], 0, "("
        for w in words:
            if not (last[-1:] in "([{“" or w[:1] in ",.;:!?%)]}…”"):
                out.append(" ")
                at += 1
            out.append(w)
            spans.append({"start": at, "end": at + len(w)})
            at += len(w)
            last = w or last
        return {"text": "".join(out), "spans": spans}

    return row_function("struct<text:string,spans:array<struct<start:int,end:int>>>", join)


def detokenised(words: Column) -> Column:
    """struct(text, spans array<struct<start, end>>): words joined, signs that close on their left and open on their right without a space."""
    return _detokenised()(words)


def conll(words: Column, tags: Column) -> Column:
    """Column text of a document: a word and its tag a line, a blank line behind the end of a sentence."""
    lines = F.zip_with(words, tags, lambda w, t: F.concat(w, F.lit("\t"), t, F.when(w.isin(".", "!", "?"), "\n").otherwise("")))
    return F.array_join(lines, "\n")


def standoff(spans: Column) -> Column:
    """Standoff lines `T1<tab>LABEL start end<tab>text` of array<struct<text, label, start, end>>."""
    line = lambda s, i: F.concat(F.lit("T"), (i + 1).cast("string"), F.lit("\t"), s["label"], F.lit(" "), s["start"].cast("string"), F.lit(" "), s["end"].cast("string"), F.lit("\t"), s["text"])
    return F.array_join(F.transform(spans, line), "\n")


def invalid(text: Column, spans: Column) -> Column:
    """Rule names that array<struct<text, label, start, end>> of a text breaks: offsets, order, overlap."""
    n = F.size(spans)
    off = F.exists(spans, lambda s: F.coalesce((s["start"] < 0) | (s["end"] <= s["start"]) | (F.substring(text, s["start"] + 1, s["end"] - s["start"]) != s["text"]), F.lit(True)))
    at = lambda i, c: F.element_at(spans, i)[c]
    pairs = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    order = F.exists(pairs, lambda i: at(i, "start") < at(i - 1, "start"))
    over = F.exists(pairs, lambda i: at(i, "start") < at(i - 1, "end"))
    return F.filter(F.array(F.when(off, "offset"), F.when(order, "order"), F.when(over, "overlap")), lambda x: x.isNotNull())


def quality_flags(text: Column) -> Column:
    """Flags of doubtful entities: more than 12 words; like a clause."""
    return F.filter(F.array(F.when(F.size(F.split(F.trim(text), r"\s+")) > 12, "LONG"), F.when(text.rlike(r"[.;!?]|\b(là|được|nhưng|because|which)\b"), "CLAUSE")), lambda x: x.isNotNull())


def replaced_span(text: Column, spans: Column, index: Column, new: Column) -> Column:
    """struct(text, spans): the span at index (from 1) replaced, those behind it shifted."""
    old = F.element_at(spans, index)
    shift = F.length(new) - (old["end"] - old["start"])
    moved = F.transform(spans, lambda s: F.struct(F.when(s["start"] == old["start"], new).otherwise(s["text"]).alias("text"), s["label"].alias("label"), F.when(s["start"] > old["start"], s["start"] + shift).otherwise(s["start"]).cast("int").alias("start"), F.when(s["start"] >= old["start"], s["end"] + shift).otherwise(s["end"]).cast("int").alias("end")))
    return F.struct(F.concat(F.substring(text, F.lit(1), old["start"]), new, F.substring(text, old["end"] + 1, F.length(text))).alias("text"), moved.alias("spans"))


def argmax_tags(scores: Column, labels: list[str]) -> Column:
    """The label of the greatest score of array<double>; ties to the first."""
    return F.element_at(F.array(*(F.lit(x) for x in labels)), F.array_position(scores, F.array_max(scores)).cast("int"))


def word_tags(pieces: DataFrame, labels: list[str]) -> DataFrame:
    """(sent_id, word, tag) of rows (sent_id, word, piece, scores): each word's tag is that of its first piece."""
    first = pieces.groupBy("sent_id", "word").agg(F.min(F.struct("piece", "scores")).alias("f"))
    return first.select("sent_id", "word", argmax_tags(F.col("f.scores"), labels).alias("tag"))


def few_shots(text: Column, answer: Column) -> Column:
    """One example of a prompt."""
    return F.concat(F.lit("Text: "), text, F.lit("\nLabels: "), answer)
