"""Problem 9: mixing sources to target weights.

Records get hash-random keys; within each source they are taken in key order up to the source's exact budget of tokens, over as
many epochs as that needs and may have. Prefix sums are two-level: sums of key ranges first, then inside the one range of each source
that its cut falls into.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from textloom.runtime import materialise

RANGE_ROWS = 100_000  # records of a key range at most, about: their number grows with the records, from 2^10 up to 2^24


def source_name(column: str):
    """A source without case and outer blanks; null if blank."""
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))


def budgets(sizes: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """(source, target_share, max_repeats, size, budget): tokens that each source is to give.

    total: tokens of the mix, by default as many as the targets' sources have; a source too small for its share within its
    repeats gives all it may. total "exact" is the most tokens that let every source with records reach its share. Sources of no
    target get no budget, targets without records a size of 0."""
    wanted = targets.select(source_name("source").alias("source"), F.col("target_share").cast("double"), F.greatest(F.col("max_repeats"), F.lit(0)).cast("long").alias("max_repeats"))
    wanted = wanted.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = sizes.filter("source is not null").join(wanted, "source", "full")
    both = both.na.fill(0, ["size", "max_repeats"]).na.fill(0.0, ["target_share"])
    room = F.col("size") * F.col("max_repeats")
    if total is None or total == "exact":
        fit = F.min(F.when((F.col("target_share") > 0) & (room > 0), room / F.col("target_share")))
        have = F.sum(F.when(F.col("target_share") > 0, F.col("size").cast("double")))
        both = both.crossJoin(F.broadcast(both.agg((fit if total else have).alias("whole"))))  # one row
    else:
        both = both.withColumn("whole", F.lit(float(total)))
    return both.withColumn("budget", F.least(F.round(F.col("target_share") * F.coalesce("whole", F.lit(0.0))).cast("long"), room)).drop("whole")


def mixed(records: DataFrame, targets: DataFrame, key: str, source: str, size: str, total: int | str | None = None, seed: int = 17) -> DataFrame:
    """(key, source, n_tokens, repeats): records of the mix, each with the number of epochs it appears in (1 to max_repeats).

    A source's budget is cut where the running sum comes nearest to it. Repeated rows of a key count once (the greatest source and
    size); records of null key, null or unlisted source, and null or no size, are not drawn. Ties of keys fall to the smaller record key.
    """
    own = records.select(F.col(key).alias("key"), source_name(source).alias("source"), F.col(size).cast("long").alias("n_tokens")).filter("key is not null")
    own = own.groupBy("key").agg(F.max(F.struct("source", "n_tokens")).alias("r")).select("key", "r.source", "r.n_tokens")
    own = materialise(own.filter("source is not null and n_tokens > 0"), "mix-records")
    bits = min(24, max(10, math.ceil(math.log2(max(1, own.count()) / RANGE_ROWS))))
    own = own.withColumn("draw", F.xxhash64("key", F.lit(seed)))
    own = own.withColumn("range", F.shiftrightunsigned("draw", 64 - bits).cast("int"))
    ranges = own.groupBy("source", "range").agg(F.sum("n_tokens").alias("range_size"))  # at most 2^bits rows a source
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("before", F.coalesce(before, F.lit(0)))
    plan = budgets(ranges.groupBy("source").agg(F.sum("range_size").alias("size")), targets, total)
    plan = plan.filter("budget > 0 and size > 0").withColumn("epochs", F.expr("budget div size")).withColumn("rest", F.expr("budget % size"))
    where = ranges.join(plan.select("source", "rest"), "source").filter("before <= rest and rest < before + range_size")  # one row a source
    cuts = materialise(plan.join(where.select("source", F.col("range").alias("cut_range"), "before"), "source").select("source", "epochs", "rest", "max_repeats", "cut_range", "before"), "mix-cuts")
    joined = own.join(cuts, "source")
    inside = Window.partitionBy("source").orderBy(F.shiftrightunsigned("draw", 1), "draw", "key").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n_tokens").over(inside)
    at_cut = joined.filter("range = cut_range").withColumn("once", (upto - F.col("n_tokens") / 2 <= F.col("rest")).cast("long"))
    whole = joined.filter("range != cut_range").withColumn("once", (F.col("range") < F.col("cut_range")).cast("long"))
    both = at_cut.unionByName(whole).withColumn("repeats", F.least(F.col("epochs") + F.col("once"), F.col("max_repeats")).cast("int"))
    return both.filter("repeats > 0").select("key", "source", "n_tokens", "repeats")


def shares(records: DataFrame, drawn: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """(source, target_share, size, taken, share, off_target, times): what each source of records or targets gives to the mix; null is the
    source of records that name none. records must be without repeated rows."""
    have = records.groupBy(source_name(source).alias("source")).agg(F.sum(F.col(size).cast("long")).alias("size"))
    wanted = targets.select(source_name("source").alias("source"), F.col("target_share").cast("double")).groupBy("source").agg(F.max("target_share").alias("target_share"))
    taken = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("taken"))
    both = have.join(wanted, have.source.eqNullSafe(wanted.source), "full").select(F.coalesce(have.source, wanted.source).alias("source"), "target_share", "size")
    both = both.join(taken, "source", "left").na.fill(0, ["size", "taken"]).na.fill(0.0, ["target_share"])
    whole = drawn.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("whole"))  # one row
    both = both.crossJoin(F.broadcast(whole))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    share = ratio("taken", "whole")
    return both.select("source", "target_share", "size", "taken", share.alias("share"), F.round(share - F.col("target_share"), 6).alias("off_target"), ratio("taken", "size").alias("times"))
