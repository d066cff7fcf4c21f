"""Problem 2: oversized texts in pieces under a limit, cut at natural boundaries, with overlap.

Every position of a text has a boundary strength (paragraph, sentence, word end, none). A sparse table answers which
position of a window is strongest, ties rightward; each piece ends there, and the next one begins overlap characters before.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from textloom.llm.arrow import map_batches

PARAGRAPH, SENTENCE, WORD = 3, 2, 1
_paragraph = re.compile(r"\n\s*")
_sentence = re.compile(r"[.!?…]+[\"”’»)\]]*(?=\s|$)")
_space = re.compile(r"\s+")
_stretch = re.compile(r"\S+")


def strengths(text: str) -> np.ndarray:
    """Of cutting before position i, for i from 0 to len(text): cuts stand at either end of white space or within it, best behind it."""
    out = np.zeros(len(text) + 1, dtype=np.int8)
    ends = np.zeros(len(text) + 1, dtype=bool)
    for m in _sentence.finditer(text):
        ends[m.end()] = True
    for m in _space.finditer(text):
        out[m.start() : m.end() + 1] = PARAGRAPH if "\n" in m[0] else SENTENCE if ends[m.start()] else WORD
    out[0] = 0
    return out


class Strongest:
    """The rightmost strongest position of any window of at most span positions, in constant time.

    A sparse table over a stretch of the strengths, moved along as windows ask for what lies beyond it: memory depends on the span, not on
    the length of the text, and each position is in at most two tables."""

    def __init__(self, values: np.ndarray, span: int | None = None):
        self.values, self.span, self.at, self.end = values, span or len(values), 0, 0
        self.stretch = max(2 * self.span, 1 << 14)

    def _move(self, lo: int) -> None:
        self.at, self.end = lo, min(lo + self.stretch, len(self.values))
        part = self.values[self.at : self.end]
        n = self.width = len(part)
        kind = np.int32 if (int(part.max(initial=0)) + 1) * n < 1 << 31 else np.int64
        self.rows, width = [part.astype(kind) * n + np.arange(n, dtype=kind)], 1  # the greater position wins ties
        while 2 * width <= min(n, self.span):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def query(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) within [lo, hi], hi - lo < span."""
        if lo < self.at or hi >= self.end:
            self._move(lo)
        k = (hi - lo + 1).bit_length() - 1
        row = self.rows[k]
        strength, place = divmod(int(max(row[lo - self.at], row[hi - self.at - (1 << k) + 1])), self.width)
        return strength, place + self.at


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of its end) of pieces of at most limit characters; strength 0 is a cut inside a stretch without blanks.

    A window is the second half of what a piece may hold; where that has no boundary, all beyond the piece before it.
    Overlaps of the limit or more are cut to limit - 1."""
    if len(text) <= limit:
        return [(0, len(text), PARAGRAPH)] if text else []
    overlap = max(0, min(overlap, limit - 1))
    table = Strongest(strengths(text), limit + 1)
    out, start, last = [], 0, 0
    while True:
        if len(text) - start <= limit:
            out.append((start, len(text), PARAGRAPH))
            return out
        top = start + limit
        strength, end = table.query(min(max(last + 1, start + (limit + 1) // 2), top), top)
        if not strength:
            strength, end = table.query(last + 1, top)
        if not strength:
            end = top
        out.append((start, end, strength))
        last, start = end, max(end - overlap, 0)


def split_oversized(df: DataFrame, limits: DataFrame, key: str = "section_id", text: str = "content", kind: str = "canonical_type", copies: bool = False) -> DataFrame:
    """(key, piece, start_pos, end_pos, boundary, text, forced): the pieces of every text longer than the limit of its kind.

    limits: (canonical_type, max_chars, overlap_chars), the kind `*` holding for kinds not listed and for null; with no
    such row these are left whole. forced is 1 if a stretch without white space is longer than the limit. Null, empty and short
    texts give no rows; repeated rows (same key and text) count once. limits is broadcast: it has a row per kind and is
    checked to have at most 10,000.
    """
    held = {r[0]: (r[1], r[2] or 0) for r in limits.select("canonical_type", "max_chars", "overlap_chars").limit(10_001).collect() if r[1]}
    if len(held) > 10_000:
        raise ValueError("more than 10,000 kinds of limits")

    def work():
        def step(columns):
            for k, name, t in zip(*columns):
                limit, overlap = held.get(name) or held.get("*") or (None, 0)
                if limit is None or len(t) <= limit:
                    continue
                forced = int(any(m.end() - m.start() > limit for m in _stretch.finditer(t)))
                for i, (a, b, strength) in enumerate(pieces(t, limit, overlap), 1):
                    yield k, i, a, b, strength, t[a:b], forced

        return step

    shortest = min((v[0] for v in held.values()), default=0)
    source = df.select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(text).alias("text"))
    source = source.filter(F.length("text") > shortest)
    if not copies:
        source = source.dropDuplicates(["key", "kind", "text"])
    schema = f"key {df.schema[key].dataType.simpleString()}, piece int, start_pos int, end_pos int, boundary int, text string, forced int"
    return map_batches(source, work, schema)
