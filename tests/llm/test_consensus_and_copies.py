"""Problems 4 and 5."""

import random

import pytest

from textloom.llm import consensus, neardup
from textloom.llm.forms import form

LABELS = ["A", "B", "C"]


def test_skills_and_labels(spark):
    rng = random.Random(5)
    skill = {1: 0.95, 2: 0.9, 3: 0.8, 4: 0.6, 5: 1 / 3, 6: 1 / 3}
    truth = {i: rng.choice(LABELS) for i in range(600)}
    votes = []
    for i, t in truth.items():
        for a in rng.sample(sorted(skill), 4):
            votes.append((i, a, t if rng.random() < skill[a] else rng.choice([x for x in LABELS if x != t])))
    votes += votes[:20] + [(None, 1, "A"), (1, None, "A"), (2, 2, None)]
    df = consensus.prepared(spark.createDataFrame(votes, "item long, annotator long, label string"))
    items, skills = consensus.consensus(df, LABELS)
    got = {r.annotator: r.accuracy for r in skills.collect()}
    assert all(abs(got[a] - s) < 0.12 for a, s in skill.items()), got
    items = items.collect()
    assert len(items) == len(truth) and all(0 <= r.agreement <= 1 and 0 < r.confidence <= 1 for r in items)
    plain = {}
    for i, a, v in set(votes):
        if None not in (i, a, v):
            plain.setdefault(i, []).append(v)
    major = sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in plain.items())
    assert sum(r.label == truth[r.item] for r in items) >= major


def test_unequal_overlaps_are_corrected_by_pair(spark):
    """Good annotators mostly meet good ones, poor ones poor ones: row sums would mislead, the fit by pairs does not."""
    rng = random.Random(15)
    skill = {1: 0.95, 2: 0.9, 3: 0.85, 4: 0.5, 5: 0.45, 6: 0.4, 7: 0.7}
    groups = [([1, 2, 3], 900), ([4, 5, 6], 900), ([1, 4, 7], 150), ([2, 5, 7], 150), ([3, 6, 7], 150)]
    votes, i = [], 0
    for who, n in groups:
        for _ in range(n):
            i += 1
            t = rng.choice(LABELS)
            votes += [(i, a, t if rng.random() < skill[a] else rng.choice([x for x in LABELS if x != t])) for a in who]
    df = consensus.prepared(spark.createDataFrame(votes + [(1, 1, "other")], "item long, annotator long, label string"))
    got = {r.annotator: r for r in consensus.reliabilities(df, LABELS).collect()}
    assert all(abs(got[a].accuracy - s) < 0.07 for a, s in skill.items()), got
    assert all(r.residual < consensus.CLOSE and r.rounds < consensus.ROUNDS for r in got.values())
    # the same fixed point by the pair matrix
    import numpy as np

    by = {}
    for i, a, v in votes:
        by.setdefault(i, {})[a] = v
    q = {x: sum(v == x for _, _, v in votes) / len(votes) for x in LABELS}
    c, n = np.zeros((7, 7)), np.zeros((7, 7))
    for own in by.values():
        for a, x in own.items():
            for b, y in own.items():
                if a != b:
                    c[a - 1, b - 1] += (x == y) - q[x] - q[y] + sum(p * p for p in q.values())
                    n[a - 1, b - 1] += 1
    r = np.ones(7)
    for _ in range(500):
        r = (c @ r) / (n @ r**2)
        r /= np.sqrt((r**2).mean())
    r *= np.sqrt((r @ c @ r) / (r**2 @ n @ r**2) / (1 - sum(p * p for p in q.values())))
    assert all(abs(got[a].skill - r[a - 1]) < 0.01 for a in skill)


def test_votes_of_one_or_none(spark):
    schema = "item long, annotator long, label string"
    none = consensus.prepared(spark.createDataFrame([], schema))
    items, skills = consensus.consensus(none, LABELS)
    assert items.count() == 0 and skills.count() == 0
    lone = consensus.prepared(spark.createDataFrame([(1, 1, "B")], schema))
    items, skills = consensus.consensus(lone, LABELS, spark.createDataFrame([(1, "B"), (9, "A")], "item long, label string"))
    assert [(r.item, r.label, r.n_votes) for r in items.collect()] == [(1, "B", 1)]
    assert skills.first().skill is None


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_links_by_brute_force(spark, t):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 80)}" for _ in range(rng.randint(15, 60))] for _ in range(25)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            at = rng.randrange(len(words))
            kind = rng.random()
            if kind < 0.4:
                words[at] = f"w{rng.randint(0, 80)}"
            elif kind < 0.7:
                words.insert(at, "thêm")
            else:
                del words[at]
        rows.append((rng.choice("xy"), i, " ".join(words)))
    rows += [rows[0], ("x", 900, None), ("x", 901, ""), ("x", 902, "quá ngắn thôi"), ("x", None, rows[1][2])]
    df = spark.createDataFrame(rows, "g string, id long, text string")
    members, links = neardup.similar_records(df, "g", "id", "text", min_words=10, t=t)
    got = {tuple(r) for r in neardup.pairs_of(members, links).collect()}
    sets = {}
    for g, i, s in rows:
        w = form(s or "").lower().split()
        if i is not None and len(w) >= 10:
            sets[g, i] = set(zip(w, w[1:], w[2:]))
    want = set()
    for (g, i), a in sets.items():
        for (h, j), b in sets.items():
            if g == h and i < j and len(a & b) >= t * len(a | b):
                want.add((g, i, j))
    assert got == want and len(want) > 50


def test_a_group_of_copies_and_nothing(spark):
    text = " ".join(f"từ{i}" for i in range(40))
    df = spark.createDataFrame([("g", i, text) for i in range(50)] + [("g", 99, text + " cuối")], "g string, id long, text string")
    members, links = neardup.similar_records(df, "g", "id", "text", min_words=10, t=0.8)
    assert members.select("class_id").distinct().count() == 2 and links.count() == 1 and members.count() == 51
    members, links = neardup.similar_records(df.limit(0), "g", "id", "text")
    assert members.count() == 0 and links.count() == 0


def test_hot_shingles_are_split_and_nothing_is_lost(spark, monkeypatch):
    """With blocks of a few records each, links are those of whole trees; groups join chains of edits."""
    rng = random.Random(16)
    base = [f"từ{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"khác{rng.randint(0, 30)}"
        rows.append(("g", i, " ".join(words)))
    rows += [("g", 500 + i, " ".join(f"lẻ{i}x{j}" for j in range(40))) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, id long, text string")
    members, links = neardup.similar_records(df, "g", "id", "text", min_words=10, t=0.5)
    whole = {tuple(r) for r in links.select("a", "b").collect()}
    grouped = {r.key: r.group_key for r in neardup.groups(members, links).collect()}
    step = {i: i for i in grouped}
    near = {tuple(r) for r in neardup.pairs_of(members, links).select("a_key", "b_key").collect()}
    for _ in grouped:
        for a, b in near:
            step[a] = step[b] = min(step[a], step[b])
    assert grouped == step and len(set(step.values())) >= 6
    import numpy as np

    tok, own, pos = np.array([7, 9], dtype=np.uint32), np.array([0, 1]), np.array([0, 0])
    counts = np.zeros(1 << neardup.SKETCH_BITS, dtype=np.int32)
    counts[0] = 3 * neardup.HOT
    got = [neardup.blocked(tok[:1], own[:1], pos[:1], np.array([d], dtype=np.int64), counts)[0] for d in range(1, 200)]
    assert all(len(g) == 3 for g in got) and len({t for g in got for t in g.tolist()}) == 6
    assert all(set(a.tolist()) & set(b.tolist()) for a in got for b in got)
    links_again = spark.sparkContext.broadcast(np.full(1 << neardup.SKETCH_BITS, 3 * neardup.HOT, dtype=np.int32))
    rows = neardup.shingled(df, "g", "id", "text", 10).filter("chunk < 0")
    parts = neardup.routed(rows, links_again, 4, 0.5).repartitionById(4, neardup.F.col("part"))
    split = {tuple(r) for r in neardup.verified(neardup.candidates(parts, 0.5), rows, 0.5).select("a", "b").collect()}
    assert split == whole


@pytest.mark.parametrize("rows", [40, 700])
def test_leaves_are_compared_as_tables_and_lose_no_pair(rows):
    """All similar pairs of a hot shingle are found, and the pairs of large leaves are not tested one by one."""
    import numpy as np

    rng = np.random.default_rng(rows)
    base = [rng.integers(1, 2**32, 130, dtype=np.uint64) for _ in range(rows // 4)]
    sets = [np.unique(np.concatenate([[0], rng.choice(base[i % len(base)], rng.integers(60, 130), replace=False)])) for i in range(rows)]
    n = np.array([len(s) for s in sets])
    bits = np.zeros((rows, neardup.BITS), dtype=bool)
    for i, s in enumerate(sets):
        bits[i, (s % neardup.BITS).astype(int)] = True
    order = np.argsort(n, kind="stable")
    trees = neardup.SignatureTrees(np.zeros(rows, dtype=np.int64), n[order], np.zeros(rows, dtype=np.int64), order, np.packbits(bits, axis=1).view(np.uint64), 0.5)
    tested, real = [0], trees.possible
    trees.possible = lambda level, a, b: (tested.append(len(a) if level == 0 else 0), real(level, a, b))[1]
    found = {tuple(sorted((order[a], order[b]))) for x, y in trees.pairs() for a, b in zip(x, y)}
    alike = lambda a, b: 2 * (both := len(np.intersect1d(a, b))) >= len(a) + len(b) - both
    want = {(i, j) for i in range(rows) for j in range(i + 1, rows) if alike(sets[i], sets[j])}
    assert want <= found and len(want) > 20
    assert rows < 100 or sum(tested) < rows * rows / 20
