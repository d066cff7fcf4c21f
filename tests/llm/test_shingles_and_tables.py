"""Problem 5: shingles by what stands between blanks, and tables that look at bitmaps only where sizes and ranks allow."""

import random

import numpy as np
import xxhash

from textloom.llm import neardup
from textloom.llm.forms import form


def by_words(text, seed, least):
    found = neardup._word.findall(form(text).lower())
    if len(found) < max(least, 3):
        return None
    h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in found], dtype=np.uint64)
    s = ((h[:-2] * neardup._A + h[1:-1]) * neardup._B + h[2:] + np.uint64(seed)) * neardup._C
    s ^= s >> np.uint64(31)
    s *= neardup._A
    return np.unique((s >> np.uint64(32)).astype(np.uint32)).tolist()


def test_shingles_are_those_of_the_words():
    rng, shingles = random.Random(4), neardup.Shingles()
    parts = ["điều", "trị", "ΟΔΟΣ", "Σ.", "a_b", "(x)", "16,2%", " ", "　", "\x1c", "\x85", " ", " ", "\n", "-", "…", "İ", "é", "​", "đau", "\ud800"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        got = shingles(text, 7, 3)
        assert (None if got is None else got.tolist()) == by_words(text, 7, 3)


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(neardup, "WORDS_KEPT", 50)
    shingles = neardup.Shingles()
    for i in range(100):
        text = f"w{i} x{i} y{i}, {'z' * 100}{i}"
        assert shingles(text, 1, 3).tolist() == by_words(text, 1, 3)
        assert len(shingles.words) <= 51 and all(len(w) <= neardup.CHUNK_KEPT for w in shingles.words)


def test_bits_are_counted():
    maps = np.random.default_rng(1).integers(0, 2**63, (50, 8), dtype=np.uint64)
    maps[0], maps[1] = 0, 2**64 - 1
    assert neardup._bits_of(maps).tolist() == [sum(int(w).bit_count() for w in m) for m in maps] and len(neardup._bits_of(maps[:0])) == 0


def test_bitmaps_are_read_only_where_sizes_and_ranks_allow(monkeypatch):
    """The ranks of one leaf span many sizes of partners: most pairs of a table are refused without their bitmaps, and none that may be similar is lost."""
    rng, rows = np.random.default_rng(9), 600
    n = np.sort(rng.integers(60, 400, rows))
    pos = (n * rng.random(rows) / 2).astype(np.int64)
    bits = np.packbits(rng.random((rows, neardup.BITS)) < 0.9, axis=1).view(np.uint64)
    trees = neardup.SignatureTrees(np.zeros(rows, dtype=np.int64), n, pos, np.arange(rows), bits, 0.5)
    a, b = np.triu_indices(rows, 1)
    want = {(int(x), int(y)) for x, y in zip(a, b) if trees.possible(0, np.array([x]), np.array([y]))[0]}
    allowed = int(((n[b] <= trees.reach[a]) & (trees.reach[b] >= n[a])).sum())
    read, real = [], neardup._bits_of
    monkeypatch.setattr(neardup, "_bits_of", lambda maps: (read.append(len(maps)), real(maps))[1])
    found = {(min(x, y), max(x, y)) for p, q in trees.pairs() for x, y in zip(p.tolist(), q.tolist())}
    assert found == want and len(want) > 100 and allowed < len(a) / 2
    assert sum(read) <= 2 * allowed + 4 * rows < len(a) / 2  # a first and an exact look, and nodes
