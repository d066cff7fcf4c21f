"""Problem 4: one label per item from annotators who disagree, with reliabilities by the spectral method.

The agreement of annotators i and j beyond chance, over the n_ij items both voted on, is in expectation the product of their skills. The skills
are therefore the leading eigenvector of the chance-centred agreement matrix corrected for overlap counts. Its power iteration runs in sparse
joins, annotators -> items -> annotators, never forming pairs of votes: each step solves r_i = sum_j M_ij r_j / sum_j n_ij r_j^2, M being
the sums of centred agreements. Where all overlaps are equal this is the power iteration of M / n; where they are not, its fixed point is the
rank-one fit of M / n in which each pair weighs by its overlap, exact for any overlaps if M_ij = n_ij r_i r_j.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window, functions as F

from textloom.runtime import cut, materialise, parallelism

ROUNDS, CLOSE = 100, 1e-3  # steps of the iteration at most, and the sine of the angle between two steps below which it rests
SKILL = (0.02, 0.98)  # bounds of a skill where it weighs a vote


def reliabilities(votes: DataFrame, labels: list[str]) -> DataFrame:
    """(annotator, n_votes, n_met, skill, accuracy, rounds, residual) from votes (item, annotator, label), one row per item and annotator,
    held in partitions of whole items.

    skill is 1 for one who is always right, 0 for guessing by chance, below 0 for worse; null for annotators who met no other one.
    residual is the last step's sine: beyond CLOSE the iteration had not come to rest after ROUNDS. Votes for other labels than
    those given do not count. An item has at most one vote per annotator, so no item grows with the rows. Empty votes give no rows.
    """
    votes = votes.filter(F.col("label").isin(labels))
    share = {r.label: r.n for r in votes.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row per label
    total = sum(share.values())
    if not total:
        none = F.lit(None).cast("double")
        return votes.select("annotator", F.lit(0).alias("n_votes"), F.lit(0).alias("n_met"), none.alias("skill"), none.alias("accuracy"), F.lit(0).alias("rounds"), none.alias("residual")).limit(0)
    q = {x: share.get(x, 0) / total for x in labels}
    square = sum(v * v for v in q.values())
    ofq = reduce(lambda c, x: c.when(F.col("label") == x, q[x]), labels[1:], F.when(F.col("label") == labels[0], q[labels[0]])).otherwise(0.0)
    item = Window.partitionBy("item")
    met = votes.withColumn("others", F.count("*").over(item) - 1)
    state = materialise(met.groupBy("annotator").agg(F.count("*").alias("n_votes"), F.sum("others").alias("n_met")).withColumn("r", F.lit(1.0)), "skills")
    scale, residual, rounds = 0.0, None, 0
    for rounds in range(1, ROUNDS + 1):
        v = votes.join(state.select("annotator", "r"), "annotator").select("item", "annotator", "label", "r")
        by_label = (F.sum(F.when(F.col("label") == x, F.col("r")).otherwise(0.0)).over(item).alias(f"s{i}") for i, x in enumerate(labels))
        v = v.select("annotator", "label", "r", F.sum("r").over(item).alias("all"), F.sum(F.col("r") ** 2).over(item).alias("squares"), *by_label)
        same = reduce(add, (F.when(F.col("label") == x, F.col(f"s{i}")).otherwise(0.0) for i, x in enumerate(labels)))
        mean = reduce(add, (q[x] * F.col(f"s{i}") for i, x in enumerate(labels)))
        # sum over the others of: 1 where equal - q(own) - q(theirs) + sum of q squared
        agreement = same - ofq * F.col("all") - mean + square * F.col("all") - F.col("r") * (1 - 2 * ofq + square)
        sums = v.groupBy("annotator").agg(F.sum(agreement).alias("y"), F.sum(F.col("squares") - F.col("r") ** 2).alias("z"))
        new = state.join(sums, "annotator").withColumn("t", F.when(F.col("z") > 1e-12, F.col("y") / F.col("z")).otherwise(0.0))
        new = materialise(new.select("annotator", "n_votes", "n_met", F.col("r").alias("old"), "y", "z", "t"), "skills")
        w = F.col("n_met")
        s = new.agg(F.sum(w * F.col("t") * F.col("old")).alias("to"), F.sum(w * F.col("old") ** 2).alias("oo"), F.sum(w * F.col("t") ** 2).alias("tt"), F.sum(w).alias("m"), F.sum(F.col("y") * F.col("old")).alias("yr"), F.sum(F.col("z") * F.col("old") ** 2).alias("zrr")).first()
        if not s.m or not s.tt:
            residual = 0.0
            break
        scale = s.yr / s.zrr if s.zrr else 0.0  # of old: skill = old * sqrt(scale / (1 - square))
        residual = max(0.0, 1 - s.to**2 / (s.tt * s.oo)) ** 0.5
        if residual < CLOSE:
            state = new.withColumnRenamed("old", "r")
            break
        state = new.select("annotator", "n_votes", "n_met", (F.col("t") / (s.tt / s.m) ** 0.5).alias("r"))
    else:
        state = new.withColumnRenamed("old", "r")
    sign = state.agg(F.sum(F.col("n_met") * F.col("r"))).first()[0] or 0
    unit = (max(scale, 0.0) / max(1 - square, 1e-9)) ** 0.5 * (1 if sign >= 0 else -1)
    skill = F.when(F.col("n_met") > 0, F.least(F.col("r") * unit, F.lit(1.0)))
    chance = 1 / max(len(labels), 2)
    told = (F.lit(rounds).alias("rounds"), F.lit(residual).cast("double").alias("residual"))
    return state.select("annotator", "n_votes", "n_met", F.round(skill, 6).alias("skill"), F.round(chance + skill * (1 - chance), 6).alias("accuracy"), *told)


def prepared(votes: DataFrame) -> DataFrame:
    """Votes (item, annotator, label) without nulls, one per item and annotator (of several the first label by name), in
    partitions of whole items and cut off from their lineage."""
    one = votes.filter("item is not null and annotator is not null and label is not null").groupBy("item", "annotator").agg(F.min("label").alias("label"))
    return cut(one.repartition(parallelism(one.sparkSession), "item").sortWithinPartitions("item"))


def consensus(votes: DataFrame, labels: list[str], settled: DataFrame | None = None, settled_accuracy: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """((item, label, agreement, confidence, n_votes), reliabilities).

    votes as prepared() gives them; those for other labels than the given ones do not count. label is that of the greatest sum of weights, a vote weighing the log odds of its annotator's
    accuracy; ties go to the label with more votes overall, then the first by name. agreement is the share of votes for the label,
    confidence its posterior. settled (item, label): decisions that count as one more vote of settled_accuracy, but not in n_votes.
    """
    votes = votes.filter(F.col("label").isin(labels))
    skills = reliabilities(votes, labels)
    k = max(len(labels), 2)
    held = lambda s: F.greatest(F.lit(SKILL[0]), F.least(F.lit(SKILL[1]), s))
    p = 1 / k + held(F.coalesce(F.col("skill"), F.lit(0.5))) * (1 - 1 / k)
    weighed = votes.join(skills.select("annotator", F.log(p * (k - 1) / (1 - p)).alias("w")), "annotator").select("item", "label", "w", F.lit(1).alias("n"))
    if settled is not None:
        w = F.log(F.lit(settled_accuracy * (k - 1) / (1 - settled_accuracy)))
        decided = settled.filter("item is not null and label is not null").groupBy("item").agg(F.min("label").alias("label"))
        weighed = weighed.unionByName(decided.join(votes.select("item").distinct(), "item", "left_semi").select("item", "label", w.alias("w"), F.lit(0).alias("n")))
    sums = weighed.groupBy("item").agg(
        F.sum("n").alias("n_votes"),
        *(F.sum(F.when(F.col("label") == x, F.col("w")).otherwise(0.0)).alias(f"w{i}") for i, x in enumerate(labels)),
        *(F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(labels)),
    )
    ranked = F.array(*(F.struct(F.round(F.col(f"w{i}"), 9).alias("w"), F.lit(-i).alias("o"), F.col(f"n{i}").alias("n"), F.lit(x).alias("label")) for i, x in enumerate(labels)))
    best = F.array_max(ranked)
    odds = reduce(add, (F.exp(F.col(f"w{i}") - F.col("best.w")) for i in range(len(labels))))
    out = sums.withColumn("best", best).select(
        "item", F.col("best.label").alias("label"), F.round(F.col("best.n") / F.greatest("n_votes", F.lit(1)), 6).alias("agreement"), F.round(1 / odds, 6).alias("confidence"), F.col("n_votes").cast("int").alias("n_votes")
    )
    return out, skills
