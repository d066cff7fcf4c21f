"""Evaluation of spans: exact, relaxed, error classes, rounds, sampling of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators import spans as S


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; 0 where undefined."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1")]


def exact_counts(pred: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """(label, tp, fp, fn) by equal bounds and label; repeated spans match one for one."""
    n = lambda df, name: df.groupBy(*key, "start", "end", "label").agg(F.count("*").alias(name))
    both = n(pred, "p").join(n(gold, "g"), [*key, "start", "end", "label"], "full").na.fill(0, ["p", "g"])
    tp = F.least("p", "g")
    return both.groupBy("label").agg(F.sum(tp).alias("tp"), F.sum(F.col("p") - tp).alias("fp"), F.sum(F.col("g") - tp).alias("fn"))


def relaxed_pairs(pred: DataFrame, gold: DataFrame, key: list[str], least: float = 0.5, by: str = "iou") -> DataFrame:
    """(key..., label, p, g) one-to-one greedy matches of spans with ids p and g: pairs of one label with an IoU of at least `least` (by iou), or any
    overlap (by overlap, by its length), from the greatest on; ties to the later spans."""
    joined = S.overlap_join(pred.select(*key, "label", "start", "end", F.col("id")), gold.select(*key, "label", "start", "end", F.col("id")), [*key, "label"])
    iou = S.iou(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    score = iou if by == "iou" else (F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).cast("double")
    pairs = joined.withColumn("score", score).filter(F.col("score") >= least if by == "iou" else F.lit(True))
    sets = pairs.groupBy(*key, "label").agg(F.collect_list(F.struct("score", F.col("l_id").alias("l"), F.col("r_id").alias("r"))).alias("pairs"))
    return sets.select(*key, "label", F.explode(S.greedy_pairs(F.col("pairs"))).alias("m")).select(*key, "label", F.col("m.l").alias("p"), F.col("m.r").alias("g"))


def matched_counts(pred: DataFrame, gold: DataFrame, matches: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) of one-to-one matches."""
    n = lambda df, name: df.groupBy("label").agg(F.count("*").alias(name))
    c = n(pred, "p").join(n(gold, "g"), "label", "full").join(n(matches, "tp"), "label", "left").na.fill(0, ["p", "g", "tp"])
    return c.select("label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def report(counts: DataFrame, labels: list[str], groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups..., label, tp, fp, fn, precision, recall, f1) for each of the fixed labels, MICRO (summed counts) and MACRO (mean of labels).
    counts: (groups..., label, tp, fp, fn); labels without counts are zeros."""
    per = [F.sum(F.when(F.col("label") == x, F.col(c)).otherwise(0)).alias(f"{c}_{i}") for i, x in enumerate(labels) for c in ("tp", "fp", "fn")]
    wide = counts.groupBy(*groups).agg(*per) if groups else counts.agg(*per)
    z = lambda c, i: F.coalesce(F.col(f"{c}_{i}"), F.lit(0))
    entry = lambda name, tp, fp, fn: F.struct(F.lit(name).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    total = lambda c: sum((z(c, i) for i in range(1, len(labels))), z(c, 0))
    rows = [entry(x, z("tp", i), z("fp", i), z("fn", i)) for i, x in enumerate(labels)] + [entry("MICRO", total("tp"), total("fp"), total("fn"))]
    tall = wide.select(*groups, F.explode(F.array(*rows)).alias("r")).select(*groups, "r.*")
    tall = tall.select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))
    only = tall.filter("label != 'MICRO'")
    mean = [F.lit("MACRO").alias("label"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1"))]
    macro = only.groupBy(*groups).agg(*mean) if groups else only.agg(*mean)
    return tall.unionByName(macro)


def errors(pred: DataFrame, gold: DataFrame, key: list[str], one_to_one: bool = True) -> DataFrame:
    """(key..., error_type, p, g): LABEL (equal bounds, another label), BOUNDARY (overlap, equal label), then both differing as LABEL_BOUNDARY,
    FALSE_POSITIVE and FALSE_NEGATIVE of what stays alone. Spans have ids, unique in a document; exact matches are no errors.
    With one_to_one each span is in one error (greedy by kind, then IoU), else a gold span may explain several predictions."""
    exact = pred.select(*key, "start", "end", "label", F.col("id").alias("p")).join(gold.select(*key, "start", "end", "label", F.col("id").alias("g")), [*key, "start", "end", "label"])
    lp = pred.join(exact.select(*key, F.col("p").alias("id")), [*key, "id"], "left_anti")
    lg = gold.join(exact.select(*key, F.col("g").alias("id")), [*key, "id"], "left_anti")
    cols = [*key, "start", "end", "label", "id"]
    j = S.overlap_join(lp.select(*cols), lg.select(*cols), key)
    same_bounds = (F.col("l_start") == F.col("r_start")) & (F.col("l_end") == F.col("r_end"))
    kind = F.when(same_bounds, "LABEL").when(F.col("l_label") == F.col("r_label"), "BOUNDARY").otherwise("LABEL_BOUNDARY")
    iou = S.iou(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    rank = F.when(same_bounds, 2.0).when(F.col("l_label") == F.col("r_label"), 1.0).otherwise(0.0)
    j = j.select(*key, kind.alias("error_type"), (rank + iou / 2).alias("score"), F.col("l_id").alias("l"), F.col("r_id").alias("r"))
    if one_to_one:
        sets = j.groupBy(*key).agg(F.collect_list(F.struct("score", "l", "r", "error_type")).alias("pairs"))
        met = sets.select(*key, F.explode(S.greedy_pairs(F.col("pairs"))).alias("m")).select(*key, "m.error_type", F.col("m.l").alias("p"), F.col("m.r").alias("g"))
    else:
        met = j.groupBy(*key, F.col("l").alias("p")).agg(F.max(F.struct("score", F.col("r").alias("g"), "error_type")).alias("b")).select(*key, "b.error_type", "p", "b.g")
    alone = lambda df, side: df.select(*key, F.col("id").alias(side)).join(met.select(*key, side).distinct(), [*key, side], "left_anti")
    fp = alone(lp, "p").select(*key, F.lit("FALSE_POSITIVE").alias("error_type"), "p", F.lit(None).cast("long").alias("g"))
    fn = alone(lg, "g").select(*key, F.lit("FALSE_NEGATIVE").alias("error_type"), F.lit(None).cast("long").alias("p"), "g")
    return met.unionByName(fp).unionByName(fn)


def pattern_key(kind: Column, pred_label: Column, gold_label: Column, text: Column) -> Column:
    return F.concat_ws("|", kind, F.coalesce(pred_label, F.lit("-")), F.coalesce(gold_label, F.lit("-")), F.lower(F.coalesce(text, F.lit("-"))))


def transitions(before: DataFrame, after: DataFrame, anchor: list[str], value: str) -> DataFrame:
    """(anchor..., status) between two rounds of errors: NEW, RESOLVED, PERSISTENT or CHANGED (same place, another value)."""
    b, a = before.groupBy(*anchor).agg(F.min(value).alias("b")), after.groupBy(*anchor).agg(F.min(value).alias("a"))
    status = F.when(F.col("b").isNull(), "NEW").when(F.col("a").isNull(), "RESOLVED").when(F.col("a") == F.col("b"), "PERSISTENT").otherwise("CHANGED")
    return b.join(a, anchor, "full").select(*anchor, status.alias("status"))


def diverse(patterns: DataFrame, k: int) -> DataFrame:
    """k patterns (pattern_key, error_type, label, frequency): of each type at most max(2, ceil(k / 3)), types and labels covered before
    frequency decides. Ranks by aggregation-friendly windows over types and labels; patterns are already one row each."""
    quota = max(2, -(-k // 3))
    order = [F.desc("frequency"), "pattern_key"]
    r = patterns.withColumn("in_type", F.row_number().over(Window.partitionBy("error_type").orderBy(*order))).filter(F.col("in_type") <= quota)
    r = r.withColumn("in_label", F.row_number().over(Window.partitionBy("label").orderBy(*order)))
    return r.orderBy((F.col("in_type") > 1).cast("int"), (F.col("in_label") > 1).cast("int"), *order).limit(k)


def within_budget(rows: DataFrame, order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest prefix of rows in order whose sizes sum to at most budget. For prompt lines: the caller limits rows to a prompt's number."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)
