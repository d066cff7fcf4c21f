"""Files: JSON lines, column text, standoff, CSV reports, binaries, dictionaries, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from textloom.operators import bio


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, keep_broken: bool = False) -> DataFrame:
    """JSON lines by an explicit schema; blank lines and a byte order mark are skipped. Broken lines are dropped, or kept with
    their text in _corrupt and an id in _invalid."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter("length(trim(value)) > 0")
    parsed = lines.select(F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value")
    good = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    if not keep_broken:
        return parsed.filter(good).select("r.*").drop("_corrupt")
    digest = F.concat(F.lit("__invalid_line_"), F.substring(F.sha2("value", 256), 1, 12))
    return parsed.select(*(F.when(good, F.col(f"r.{f.name}")).alias(f.name) for f in schema.fields), F.when(~good, F.col("value")).alias("_corrupt"), F.when(~good, digest).alias("_invalid"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """S04, S22."""
    df.write.mode("append" if append else "overwrite").json(path)


def polymorphic_entities(record: str = "value"):
    """Entities out of a line that holds them as entities, as output_text (JSON in a string, perhaps fenced) or in contents."""
    kind = "array<struct<text:string,label:string,start:int,end:int>>"
    direct = F.from_json(F.get_json_object(record, "$.entities"), kind)
    fenced = F.regexp_replace(F.get_json_object(record, "$.output_text"), r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    turn = F.get_json_object(record, "$.contents[1].parts[0].text")
    inner = lambda c: F.coalesce(F.from_json(F.get_json_object(c, "$.entities"), kind), F.from_json(c, kind))
    return F.coalesce(direct, inner(fenced), inner(turn))


def tuning_record(instruction: str, prompt, answer):
    """A supervised tuning record as JSON: instruction, the user's and the model's turn."""
    part = lambda c: F.array(F.struct(c.alias("text")))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), part(c).alias("parts"))
    return F.to_json(F.struct(F.struct(part(F.lit(instruction)).alias("parts")).alias("systemInstruction"), F.array(turn("user", prompt), turn("model", answer)).alias("contents")))


def read_conll(spark: SparkSession, path: str, strict: list[str] | None = None) -> DataFrame:
    """(sent_id, pos, token, tag) of column text: the last column is the tag, blank lines part sentences (they are read as records, so any
    number of files is read in parallel). With strict, tags other than O, IGN, B-x and I-x of these labels go to column issue."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).withColumn("file", F.input_file_name())
    rows = blocks.filter("length(trim(value)) > 0").select(F.sha2(F.concat_ws("|", "file", "value"), 256).alias("sent_id"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)).alias("pos", "line"))
    out = rows.select("sent_id", "pos", F.regexp_extract("line", r"^(.*?)[\t ]+\S+\s*$", 1).alias("token"), F.regexp_extract("line", r"[\t ]+(\S+)\s*$", 1).alias("tag"))
    if strict is None:
        return out
    fit = F.col("tag").isin("O", "IGN") | F.col("tag").rlike(rf"^[BI]-({'|'.join(strict)})$")
    return out.withColumn("issue", F.when(~fit, F.concat(F.lit("BAD_TAG:"), "tag")).when(F.col("token") == "", "NO_TOKEN"))


def read_standoff(annotations: DataFrame, texts: DataFrame, keep: list[str] | None = None, window: int = 200) -> DataFrame:
    """(doc_id, text, label, start, end, issue) of annotations (doc_id, ann) against texts (doc_id, text).

    Parted spans are left out as DISCONTINUOUS_EXCLUDED. Text that does not stand at its offsets is looked for within window characters,
    then in the whole text, where it must stand once (OFFSET_CORRECTED); else TEXT_MISMATCH."""
    lines = annotations.select("doc_id", F.explode(F.split("ann", r"\r?\n")).alias("line")).filter("line like 'T%'")
    cols = F.split("line", "\t")
    head = F.split(cols[1], " ", 2)
    a = lines.select("doc_id", head[0].alias("label"), head[1].alias("place"), cols[2].alias("surface"))
    if keep:
        a = a.filter(F.col("label").isin(*keep))
    a = a.withColumn("apart", F.col("place").contains(";")).withColumn("s", F.regexp_extract("place", r"^(\d+)", 1).cast("int")).withColumn("e", F.regexp_extract("place", r"(\d+)$", 1).cast("int"))
    j = a.join(texts.select("doc_id", F.col("text").alias("whole")), "doc_id")
    shown = F.substring("whole", F.col("s") + 1, F.col("e") - F.col("s")) == F.col("surface")
    lo = F.greatest(F.lit(0), F.col("s") - window)
    near = F.substring("whole", lo + 1, F.length("surface") + 2 * window)
    count = lambda hay: (F.length(hay) - F.length(F.replace(hay, F.col("surface"), F.lit("")))) / F.length("surface")
    start = F.when(shown, F.col("s")).when(count(near) == 1, lo + F.call_function("locate", F.col("surface"), near) - 1).when(count(F.col("whole")) == 1, F.call_function("locate", F.col("surface"), F.col("whole")) - 1)
    issue = F.when(F.col("apart"), "DISCONTINUOUS_EXCLUDED").when(shown, F.lit(None).cast("string")).when(start.isNotNull(), "OFFSET_CORRECTED").otherwise("TEXT_MISMATCH")
    place = F.when(F.col("apart"), F.lit(None).cast("int")).otherwise(start)
    return j.select("doc_id", F.col("surface").alias("text"), "label", place.cast("int").alias("start"), (place + F.length("surface")).cast("int").alias("end"), issue.alias("issue"))


def write_texts(df: DataFrame, path: str, partition: list[str], column: str) -> None:
    """Texts in folders by partition columns, one line per row."""
    df.select(*partition, F.col(column).alias("value")).write.mode("overwrite").partitionBy(*partition).text(path)


def write_standoff(df: DataFrame, path: str) -> None:
    """Standoff lines of df (doc_id, spans) in folders by document."""
    write_texts(df.select("doc_id", bio.standoff(F.col("spans")).alias("ann")), path, ["doc_id"], "ann")


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, order: list[str]) -> str:
    """A small result (a report of fixed labels; at most 10,000 rows) as a table in Markdown."""
    rows = df.orderBy(*order).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("not a report: more than 10,000 rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])


def read_binaries(spark: SparkSession, path: str, magic: bytes = b"%PDF", most: int = 50 << 20) -> DataFrame:
    """(path, length, sha256, reason) of files: reason is null for one of the right kind and size."""
    files = spark.read.format("binaryFile").load(path)
    head = F.substring("content", 1, len(magic))
    reason = F.when(F.col("length") == 0, "EMPTY").when(F.col("length") > most, "TOO_LARGE").when(head != F.lit(bytearray(magic)), "WRONG_KIND")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), reason.alias("reason"))


def unprocessed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose digest the index of processed ones does not hold; equal files once."""
    return files.filter("reason is null").dropDuplicates(["sha256"]).join(index.select("sha256"), "sha256", "left_anti")


def read_dictionary(spark: SparkSession, path: str, required: list[str], header_row: int = 1) -> DataFrame:
    """A dictionary sheet as CSV, all columns strings; header_row counts from 1
    in each file (beyond 1, cells stay on their line). Missing columns raise."""
    if header_row == 1:
        df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).csv(path)
    else:  # the rows before the header stand in each file
        sheets = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n", -1).alias("rows"))
        names = [c.strip() for c in sheets.select(F.get("rows", F.lit(header_row - 1)).alias("h")).first().h.split(",")]
        below = F.expr(f"slice(rows, {header_row + 1}, greatest(size(rows) - {header_row}, 0))")
        rows = sheets.select(F.explode(below).alias("row")).filter("length(trim(row)) > 0")
        df = rows.select(F.from_csv("row", ", ".join(f"`{n}` string" for n in names)).alias("r")).select("r.*")
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def wrapped_rows(df: DataFrame, order: str, code: str, text: str, pattern: str = r"^650\d{4}$") -> DataFrame:
    """(code, text): rows of a table whose cells wrapped over lines; a row without a code goes on with the one before. One table of a printed
    dictionary is read in order, so it is one window."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = df.withColumn("__c", F.last(F.when(F.col(code).rlike(pattern), F.col(code)), ignorenulls=True).over(w)).filter("__c is not null")
    return named.groupBy("__c").agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("p")).select(F.col("__c").alias(code), F.array_join(F.transform("p", lambda x: F.trim(x[text])), " ").alias(text))


def write_manifest(path: str, version: str, artefacts: dict[str, str]) -> dict:
    """A manifest with digest, size and version of local files, put in place at once."""
    made = {"version": version, "artefacts": {}}
    for name, file in artefacts.items():
        with open(file, "rb") as f:
            raw = f.read()
        made["artefacts"][name] = {"file": os.path.basename(file), "sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw)}
    scratch = f"{path}.{uuid.uuid4().hex[:8]}"
    with open(scratch, "w", encoding="utf-8") as f:
        json.dump(made, f, ensure_ascii=False, indent=1)
    os.replace(scratch, path)
    return made


def verified(path: str, folder: str) -> dict:
    """The manifest at path, its files checked; a difference raises."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    for name, a in made["artefacts"].items():
        with open(os.path.join(folder, a["file"]), "rb") as f:
            if hashlib.sha256(f.read()).hexdigest() != a["sha256"]:
                raise ValueError(f"{name} is not the file of the manifest")
    return made
