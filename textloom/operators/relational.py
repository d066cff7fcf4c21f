"""Relational helpers: latest rows, presence quadrants, paging, upsert, set differences, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per keys, that of the greatest order (ties: the greatest row). Aggregation with partial sums, no window: a key may hold any share of the rows."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("__top"))
    return top.select(*keys, *(F.col(f"__top.{c}").alias(c) for c in rest))


def presence(base: DataFrame, key: str, **others: DataFrame) -> DataFrame:
    """base with a boolean column per name: whether the key stands in that frame (EXISTS as a column)."""
    for name, other in others.items():
        flag = other.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
        base = base.join(flag, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return base


def tall(df: DataFrame, name: str = "metric", value: str = "n") -> DataFrame:
    """A one-row frame of counts as rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("long").alias(value)) for c in df.columns))
    return df.select(F.explode(pairs).alias("p")).select(f"p.{name}", f"p.{value}")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a total order: number from 1, size from 1 to 100. Top-k, never a full sort to one task."""
    number, size = max(1, number), min(100, max(1, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new: equal keys take new's values, those in keep only where they are not null."""
    n = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in new.columns if c not in keys), F.lit(True).alias("__new"))
    joined = old.join(n, keys, "full")
    value = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in keep else F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))
    return joined.select(*keys, *(value(c).alias(c) for c in old.columns if c not in keys))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of the keys in new taken out and new's put in."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remaining(work: DataFrame, done: DataFrame, key: str, ok: Column | None = None) -> DataFrame:
    """Rows of work not yet in done; rows of done that failed (not ok) do not count."""
    return work.join((done.filter(ok) if ok is not None else done).select(key).distinct(), key, "left_anti")


def compared(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: status left_only, right_only, same or changed."""
    a = left.select(*keys, F.struct(*values).alias("left_value"))
    b = right.select(*keys, F.struct(*values).alias("right_value"))
    status = F.when(F.col("right_value").isNull(), "left_only").when(F.col("left_value").isNull(), "right_only").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("changed")
    return a.join(b, keys, "full").withColumn("status", status)


def integrity(checks: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) of named frames of violating rows."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in checks.items()))


def priority_distinct(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in order (which must be total)."""
    rest = [c for c in df.columns if c != key]
    named = df.select("*", *(o.alias(f"__{i}") for i, o in enumerate(order)))
    first = named.groupBy(key).agg(F.min(F.struct(*(f"__{i}" for i in range(len(order))), *rest)).alias("__f"))
    return first.select(key, *(F.col(f"__f.{c}").alias(c) for c in rest))


def sequence_ids(df: DataFrame, group: Column, order: list[Column], digits: int = 6, buckets: int = 64) -> DataFrame:
    """df with seq_id `group_000001`: a running number in each group, by two-level ranks so that a large group is spread over buckets.
    order must be total and its first column is what buckets are cut by."""
    named = df.withColumn("__g", group).withColumn("__o", order[0])
    edges = named.groupBy("__g").agg(F.percentile_approx("__o", [i / buckets for i in range(1, buckets)], 1000).alias("__edges"))
    # a row's bucket is the number of edges below it, so buckets of a group are in order
    named = named.join(edges, "__g").withColumn("__b", F.size(F.filter("__edges", lambda e: e < F.col("__o")))).drop("__edges")
    counts = named.groupBy("__g", "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__g", "__b", before.alias("__before"))
    ranked = named.join(offsets, ["__g", "__b"]).withColumn("__r", F.row_number().over(Window.partitionBy("__g", "__b").orderBy(*order)) + F.col("__before"))
    return ranked.withColumn("seq_id", F.concat("__g", F.lit("_"), F.lpad(F.col("__r").cast("string"), digits, "0"))).drop("__g", "__b", "__o", "__r", "__before")


def carried(df: DataFrame, group: list[str], order: list[Column], column: str, alias: str) -> DataFrame:
    """The last non-null value of column up to each row of its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(alias, F.last(column, ignorenulls=True).over(w))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in hash order: the same for the same seed whatever the partitions."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)
