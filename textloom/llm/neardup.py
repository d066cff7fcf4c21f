"""Problem 5: records that share most of their content, exactly and without comparing all pairs.

A record is its set of distinct three-word shingles. Two sets with a Jaccard similarity of at least t share a shingle among the rarest of each
(prefix filter, rarest by a fixed-size count sketch of the whole corpus), so records meet in parts of the shingle space. In a part
each shingle's records form a signature tree: nodes hold the OR of their records' token bitmaps and a range of sizes, and a
dual traversal of the tree with itself drops node pairs whose greatest possible overlap is too small. What is left is checked exactly.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.forms import form
from textloom.runtime import cut, materialise, parallelism

WORDS = 3  # of a shingle
SKETCH_BITS, CHUNKS = 20, 16  # counters of the sketch: 4 MB, whatever the corpus
BITS = 512  # of a record's bitmap: eight words, whose bit counts fit one word
FAN = 8  # children of a tree node
LEAF = 64  # records of a leaf
DENSE = 2048  # record pairs of a leaf with its partners from which they are compared as one table
COLUMNS = 2048  # of such a table at once
TOGETHER = 1 << 13  # record pairs of tables whose bitmaps are compared at once, about
SLABS = 16  # of ranks by size, in which a tree's records are ordered, so that leaves have narrow ranges of ranks
PART_TOKENS = 2_000_000  # prefix shingles of a part, about
HOT = 50_000  # records of one tree, about: a shingle of more is cut into blocks of records, one tree for each two blocks
SEEN = 1_000_000  # digests a task remembers to leave out copies early
WORDS_KEPT, CHUNK_KEPT = 1_000_000, 64  # words with the signs next to them that a task remembers, and the characters of each, at most
FRONTIER = 1 << 18  # node pairs tested at once
BROADCAST_ROWS = 1_000_000  # candidates up to which they are sent to all executors

_word = re.compile(r"[^\W_]+")
_LANES, _ONES = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Chunks(dict):
    """What stands between blanks -> the digests of its words in bytes."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > WORDS_KEPT:
            self.clear()
        own = b"".join(self.digest(w.encode("utf-8", "surrogatepass")).to_bytes(8, sys.byteorder) for w in _word.findall(chunk))
        if len(chunk) <= CHUNK_KEPT:
            self[chunk] = own
        return own


class Shingles:
    """text -> sorted distinct 32-bit shingle hashes; equal words hash alike in every task. No word reaches over a blank."""

    def __init__(self):
        self.words = Chunks()

    def __call__(self, text: str, seed: int, least: int) -> np.ndarray | None:
        h = np.frombuffer(b"".join(map(self.words.__getitem__, form(text).lower().split())), dtype=np.uint64)
        if len(h) < max(least, WORDS):
            return None
        s = ((h[:-2] * _A + h[1:-1]) * _B + h[2:] + np.uint64(seed)) * _C
        s ^= s >> np.uint64(31)
        s *= _A
        out = (s >> np.uint64(32)).astype(np.uint32)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def shingled(df: DataFrame, group: str, key: str, text: str, min_words: int) -> DataFrame:
    """(grp, key, digest, n, tokens) of every text of at least min_words words, and (chunk, tokens) rows of the task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, counts = Shingles(), np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for batch in batches:
            rows = []
            for g, k, t in zip(*(c.to_pylist() for c in batch.columns)):
                if t is None or k is None:
                    continue
                s = shingles(t, xxhash.xxh3_64_intdigest(str(g)) & 0xFFFFFFFF, min_words)
                if s is not None and len(s):
                    raw = s.tobytes()
                    rows.append((g, k, xxhash.xxh3_64_intdigest(raw + str(g).encode()) - (1 << 63), len(s), raw, -1))
            if rows:
                every = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint32)
                counts += np.bincount(every >> np.uint32(32 - SKETCH_BITS), minlength=1 << SKETCH_BITS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        if counts.any():
            rows = [(None, None, None, None, c.tobytes(), i) for i, c in enumerate(np.split(counts, CHUNKS))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    names = ["grp", "key", "digest", "n", "tokens", "chunk"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
    schema = "grp string, key long, digest long, n int, tokens binary, chunk int"
    return df.select(F.col(group).cast("string"), F.col(key).cast("long"), F.col(text)).mapInArrow(run, schema)


def sketch(rows: DataFrame) -> np.ndarray:
    """The summed counters. Sums go over lanes first, so that no task gets those of all tasks at once; 4 MB reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for raw in table.column("tokens"):
            c = np.frombuffer(raw.as_py(), dtype=np.int32)
            total = c.astype(np.int64) if total is None else total + c
        total = np.minimum(total, 2**31 - 1).astype(np.int32)
        return pa.table({"chunk": table.column("chunk")[:1], "tokens": pa.array([total.tobytes()], pa.binary())})

    parts = rows.filter("chunk >= 0").select("chunk", "tokens", (F.spark_partition_id() % 64).alias("lane"))
    sums = parts.groupBy("chunk", "lane").applyInArrow(add, "chunk int, tokens binary").groupBy("chunk").applyInArrow(add, "chunk int, tokens binary")
    got = {r.chunk: np.frombuffer(r.tokens, dtype=np.int32) for r in sums.collect()}
    return np.concatenate([got[i] for i in range(CHUNKS)]) if got else np.zeros(1 << SKETCH_BITS, dtype=np.int32)


def blocked(tok: np.ndarray, own: np.ndarray, pos: np.ndarray, digests: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with each hot shingle replaced by its pairs of blocks that the record's block is in. Another shingle of equal name only
    makes a tree larger: pairs are checked exactly later."""
    cut = -(-counts[tok >> np.uint32(32 - SKETCH_BITS)].astype(np.int64) // HOT)
    if (cut <= 1).all():
        return tok, own, pos
    cut = np.maximum(cut, 1)
    which = np.repeat(np.arange(len(tok)), cut)
    other = np.arange(len(which)) - np.repeat(np.cumsum(cut) - cut, cut)
    b = cut[which]
    mine = ((digests[own[which]].view(np.uint64) * _C >> np.uint64(33)) % b.astype(np.uint64)).astype(np.int64)
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    mixed = (tok[which].astype(np.uint64) * _A + (low * b + high).astype(np.uint64) * _B) * _C >> np.uint64(32)
    return np.where(b > 1, mixed.astype(np.uint32), tok[which]), own[which], pos[which]


def routed(rows: DataFrame, counts, parts: int, t: float) -> DataFrame:
    """(part, digest, n, bits, toks, pos): for each part, a record's prefix shingles in it with their rank among its own.

    A hot shingle stands for its pairs of blocks: a record goes to the trees of its own block with each other one, so that any two records
    meet in one and no task gets all records of a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = counts.value
        seen: set[int] = set()
        for batch in batches:
            digests, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if len(seen) > SEEN:
                seen.clear()
            new = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
            for at in range(0, len(new), 2048):
                some = new[at : at + 2048]
                sets = [np.frombuffer(raws[i], dtype=np.uint32) for i in some]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                tok, own = np.concatenate(sets), np.repeat(np.arange(len(some)), n)
                flags = np.zeros((len(some), BITS), dtype=bool)
                flags[own, (tok * np.uint32(2654435761) >> np.uint32(23)).astype(np.int64)] = True
                bits = np.packbits(flags, axis=1)
                common = df[tok >> np.uint32(32 - SKETCH_BITS)]
                order = np.argsort(own << 32 | common, kind="stable")  # by record, count and shingle: a record's shingles come sorted
                pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
                keep = (pos <= np.repeat(n - np.ceil(t * n - 1e-9).astype(np.int64), n)) & (common[order] > 1)
                tok, own, pos = tok[order][keep], own[keep], pos[keep]
                if not len(tok):
                    continue
                tok, own, pos = blocked(tok, own, pos, np.array([digests[i] for i in some], dtype=np.int64), df)
                part = (tok.astype(np.uint64) * _B >> np.uint64(40)).astype(np.int64) % parts
                order = np.argsort(own * parts + part, kind="stable")  # by record, part and rank: they come by record and rank
                tok, own, pos, part = tok[order], own[order], pos[order], part[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(part) != 0)]))
                ends = pa.array(np.concatenate([first, [len(tok)]]).astype(np.int32))
                who = own[first]
                raw = bits[who].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[first].astype(np.int32)),
                        pa.array(np.array([digests[i] for i in some], dtype=np.int64)[who]),
                        pa.array(n[who].astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer((np.arange(len(who) + 1) * (BITS // 8)).astype(np.int32)), pa.py_buffer(raw)]),
                        pa.ListArray.from_arrays(ends, pa.array(tok.view(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(np.minimum(pos, 32767).astype(np.int16))),
                    ],
                    names=["part", "digest", "n", "bits", "toks", "pos"],
                )

    return rows.select("digest", "tokens").mapInArrow(run, "part int, digest long, n int, bits binary, toks array<int>, pos array<short>")


def _bits_of(maps: np.ndarray) -> np.ndarray:
    """Of each bitmap of eight words the bits that are set: the counts, a byte a word, are added in lanes of 16 bits."""
    counts = np.bitwise_count(maps).view(np.uint64)[:, 0]
    counts = (counts & _LANES) + (counts >> np.uint64(8) & _LANES)
    return (counts * _ONES >> np.uint64(48)).astype(np.int64)


class SignatureTrees:
    """The trees of all shingles of a part, level by level; level 0 are records (with rank pos), in order of shingle, slab of ranks and size,
    level 1 are leaves of LEAF records. Pairs of leaves that may hold similar records are compared as tables of bitmaps."""

    def __init__(self, tree: np.ndarray, n: np.ndarray, pos: np.ndarray, row: np.ndarray, bits: np.ndarray, t: float):
        self.t, self.share = t, t / (1 + t)
        excess = n - _bits_of(bits)[row]
        self.levels = [(tree, n, n, pos, excess, row)]
        self.reach = np.floor(np.minimum(n / t, (n - pos) / self.share - n) + 1e-6)  # size of the largest partner that size and rank allow
        self.least = np.floor(self.share * n).astype(np.int64)  # shingles that a pair must share are at least those of both
        self.lacking = self.least - excess
        self.bits, self.starts = [bits], []
        while True:
            tree, low, high, pos, excess, row = self.levels[-1]
            rank = np.arange(len(tree)) - np.searchsorted(tree, tree)
            starts = np.flatnonzero(rank % (FAN if self.starts else LEAF) == 0)
            if self.starts and len(starts) == len(tree):
                break
            own = self.bits[-1] if self.starts else self.bits[0][row]
            self.starts.append(starts)
            self.bits.append(np.bitwise_or.reduceat(own, starts))
            self.levels.append((tree[starts], np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.minimum.reduceat(pos, starts), np.maximum.reduceat(excess, starts), None))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs may hold records similar enough: by sizes, by ranks (the shingle being the first they share), by bitmaps."""
        _, low, high, pos, excess, row = self.levels[level]
        need = np.ceil(self.share * (low[a] + low[b]) - 1e-9)
        ok = (low[b] * self.t <= high[a] + 1e-9) & (low[a] * self.t <= high[b] + 1e-9)
        ok &= (high[a] - pos[a] >= need) & (high[b] - pos[b] >= need)
        left = np.flatnonzero(ok)
        x, y = a[left], b[left]
        own = self.bits[level]
        shared = _bits_of((own[row[x]] & own[row[y]]) if row is not None else (own[x] & own[y]))
        ok[left] = shared + np.minimum(excess[x], excess[y]) >= need[left]
        return ok

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Record pairs of one tree that no level drops (dual traversal of each tree with itself)."""
        top = len(self.levels) - 1
        tree = self.levels[top][0]
        yield from self._down(top, np.arange(len(tree)), np.arange(len(tree)))

    def _below(self, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children of node pairs, each once."""
        starts = self.starts[level - 1]
        ends = np.append(starts[1:], len(self.levels[level - 1][0]))
        nx, ny = ends[x] - starts[x], ends[y] - starts[y]
        reps = nx * ny
        which = np.repeat(np.arange(len(x)), reps)
        k = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
        a, b = starts[x][which] + k // ny[which], starts[y][which] + k % ny[which]
        half = (x[which] != y[which]) | (a <= b)
        return a[half], b[half]

    def _down(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = FRONTIER // FAN**2
        for at in range(0, len(a), size):
            x, y = a[at : at + size], b[at : at + size]
            ok = (x == y) | self.possible(level, x, y)
            x, y = x[ok], y[ok]
            if level > 1:
                yield from self._down(level - 1, *self._below(level, x, y))
            elif len(x):
                yield self._leaves(x, y)

    def _leaves(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The record pairs that may be similar of leaf pairs: of a leaf with its partners those of a table that sizes and ranks allow, or pair by
        pair if they are few. Bitmaps are compared for many tables at once."""
        starts, n = self.starts[0], self.levels[0][1]
        sizes = np.diff(np.append(starts, len(self.levels[0][0])))
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        last = np.append(first[1:], len(x))
        many = sizes[x[first]] * np.add.reduceat(sizes[y], first) >= DENSE
        few = np.repeat(~many, last - first)
        a, b = self._below(1, x[few], y[few])
        differ = a != b
        held, waiting, found = [(a[differ], b[differ])], 0, []
        for i in np.flatnonzero(many):
            others = y[first[i] : last[i]]
            each = sizes[others]
            columns = np.arange(each.sum()) + np.repeat(starts[others] - np.cumsum(each) + each, each)
            rows = np.arange(starts[x[first[i]]], starts[x[first[i]]] + sizes[x[first[i]]])
            columns = columns[(n[columns] <= self.reach[rows].max()) & (self.reach[columns] >= n[rows].min())]
            for at in range(0, len(columns), COLUMNS):
                held.append(self._table(rows, columns[at : at + COLUMNS]))
                waiting += len(held[-1][0])
                if waiting >= TOGETHER:
                    found.append(self._checked(held))
                    held, waiting = [], 0
        if held:
            found.append(self._checked(held))
        return tuple(np.concatenate(c) for c in zip(*found))

    def _table(self, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a row and a later column whose sizes and ranks let them be similar."""
        n = self.levels[0][1]
        near = n[columns] <= self.reach[rows][:, None]
        near &= self.reach[columns] >= n[rows][:, None]
        near &= columns > rows[:, None]
        at = np.flatnonzero(near)  # much faster than nonzero of two dimensions
        row = at // len(columns)
        return rows[row], columns[at - row * len(columns)]

    def _checked(self, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs whose bitmaps, too, let them be similar. Few pass the first look, which knows the excess of one side only."""
        a, b = (np.concatenate(c) for c in zip(*held))
        row, bits = self.levels[0][5], self.bits[0]
        shared = _bits_of(bits.take(row[a], axis=0) & bits.take(row[b], axis=0))
        left = np.flatnonzero(shared >= self.least[a] + self.lacking[b])
        a, b = a[left], b[left]
        ok = self.possible(0, a, b)
        return a[ok], b[ok]


def candidates(parts: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: digests of records that the trees of some part let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        digest = table.column("digest").to_numpy()
        _, one = np.unique(digest, return_index=True)  # the same set from several tasks
        table = table.take(pa.array(np.sort(one)))
        digest, n = table.column("digest").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(len(digest), BITS // 64)
        toks = table.column("toks").combine_chunks()
        tok, pos = toks.flatten().to_numpy(), table.column("pos").combine_chunks().flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(digest)), np.diff(toks.offsets.to_numpy()))
        order = np.argsort(tok.view(np.uint32).astype(np.uint64) << np.uint64(32) | (pos * SLABS // n[row] << 27 | np.minimum(n[row], (1 << 27) - 1)).astype(np.uint64))
        tok, row, pos = tok[order], row[order], pos[order]
        edge = np.concatenate([[True], np.diff(tok) != 0])
        group = np.cumsum(edge) - 1
        many = np.bincount(group)[group] > 1
        tok, row, pos = group[many], row[many], pos[many]
        if not len(tok):
            return
        trees = SignatureTrees(tok, n[row], pos, row, bits, t)
        for x, y in trees.pairs():
            both = np.unique(np.minimum(row[x], row[y]) * len(digest) + np.maximum(row[x], row[y]))
            a, b = digest[both // len(digest)], digest[both % len(digest)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return parts.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, records: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity) of candidate pairs (a, b) with a similarity of at least t, from records (digest, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= t * (len(x) + len(y) - both) - 1e-9:
                    out.append((a, b, round(both / (len(x) + len(y) - both), 6)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "similarity"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    if pairs.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = records.join(wanted, "digest", "left_semi").select("digest", "tokens").dropDuplicates(["digest"])
    sets = materialise(sets, "candidate-sets")
    joined = pairs.join(sets.select(F.col("digest").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("digest").alias("b"), F.col("tokens").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def similar_records(df: DataFrame, group: str, key: str, text: str, min_words: int = 60, t: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members (grp, key, class_id), links (a, b, similarity)).

    Records with the same shingles form a class, class_id; links join classes of one group with a Jaccard similarity of at least t, a < b.
    Together they hold every pair of similar records; copies are not multiplied out. Records of null key or text, and with
    fewer than min_words words, are left out; repeated rows count once. Keys are whole numbers. Groups are never compared with one another.
    The work is exact: no bucket is capped, and a shingle that many records share is a deeper tree. Shingles are 32-bit hashes.
    """
    spark = df.sparkSession
    rows = materialise(shingled(df, group, key, text, min_words), "shingles")
    counts = sketch(rows)
    records = rows.filter("chunk < 0")
    copied = counts.astype(np.int64) * -(-counts.astype(np.int64) // HOT)  # a hot shingle's records go to as many trees as it has blocks
    parts = max(parallelism(spark), math.ceil(int(copied.sum()) * (1 - t) / PART_TOKENS))
    pairs = candidates(routed(records, spark.sparkContext.broadcast(counts), parts, t).repartitionById(parts, F.col("part")), t)
    pairs = materialise(pairs, "candidates")
    links = verified(pairs, records, t)
    members = records.groupBy("grp", "key").agg(F.max("digest").alias("class_id"))
    return members, links


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(grp, key, class_id, group_key): members with the least key of their group, a group being the classes that links join, over any
    number of steps. Least classes flow along the links, each round also over the class reached so far, until none changes; only classes with links take part."""
    spark = members.sparkSession
    lanes = parallelism(spark)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(both.repartition(lanes, "a"))
    state = cut(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
    while True:
        near = edges.join(state.select(F.col("a").alias("b"), F.col("to").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        step = state.join(near, "a").select("a", F.col("to").alias("old"), F.least("to", "theirs").alias("to"))
        jump = state.select(F.col("a").alias("to"), F.col("to").alias("further"))
        new = cut(step.join(jump, "to", "left").select("a", "old", F.least("to", F.coalesce("further", "to")).alias("to")).repartition(lanes, "a"))
        if new.filter("old != to").isEmpty():
            break
        state = new.select("a", "to")
    own = members.join(state.select(F.col("a").alias("class_id"), "to"), "class_id", "left").withColumn("to", F.coalesce("to", "class_id"))
    least = own.groupBy("grp", "to").agg(F.min("key").alias("group_key"))
    return own.join(least, ["grp", "to"]).select("grp", "key", "class_id", "group_key")


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(grp, a_key, b_key), a_key < b_key: all pairs of similar records, copies multiplied out."""
    own = members.select("grp", F.col("key").alias("a_key"), F.col("class_id").alias("a"))
    other = members.select(F.col("grp").alias("grp_b"), F.col("key").alias("b_key"), F.col("class_id").alias("b"))
    copied = members.groupBy("class_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("class_id").alias("a"))
    same = own.join(copied, "a").join(other.withColumnRenamed("b", "a"), "a").filter("a_key < b_key and grp = grp_b").select("grp", "a_key", "b_key")
    linked = links.select("a", "b").join(own, "a").join(other, "b").filter("grp = grp_b")
    return same.unionByName(linked.select("grp", F.least("a_key", "b_key").alias("a_key"), F.greatest("a_key", "b_key").alias("b_key"))).distinct()
