"""Spans of text: tokens, occurrences, overlap joins, overlap resolution, matching.

Offsets are code points from 0, half open, on the untouched text. What walks a text or a document's spans once, in order, is an Arrow
function over batches (the JVM's folds copy their array at each step); sorting and joins are the JVM's; joins between spans are equi-joins on the
document with a range condition.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

# Token patterns. words: letters and digits with marks; hyphen: also hyphenated, and signs; slash: also with slashes; plain: words or single signs.
TOKENS = {
    "words": r"[\p{L}\p{N}\p{M}]+",
    "hyphen": r"[\p{L}\p{N}\p{M}_]+(?:[-+][\p{L}\p{N}\p{M}_]+)*|[^\p{L}\p{N}\p{M}_ \t\n\x0b\f\r]",
    "slash": r"[\p{L}\p{N}\p{M}_]+(?:[-/][\p{L}\p{N}\p{M}_]+)*|[^\p{L}\p{N}\p{M}_ \t\n\x0b\f\r]",
    "plain": r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_ \t\n\x0b\f\r]",
}
_PLACED = "array<struct<word:string,start:int,end:int>>"


def row_function(kind: str, work: Callable):
    """A Column function from work(*values of a row) to a value of the type kind, run over Arrow batches; null where the first value is null."""
    arrow = to_arrow_type(_parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([None if v[0] is None else work(*v) for v in zip(*(c.to_pylist() for c in columns))], arrow)

    return run


@lru_cache(maxsize=None)
def _tokens(kind: str):
    def cut(text: str) -> list[dict]:
        import regex

        return [{"word": m[0], "start": m.start(), "end": m.end()} for m in regex.finditer(TOKENS[kind], text)]

    return row_function(_PLACED, cut)


def tokens(text: Column, kind: str = "plain") -> Column:
    """array<struct<word, start, end>>, in order."""
    return _tokens(kind)(text)


@lru_cache(maxsize=None)
def _laid_out():
    def lay(parts: list[str]) -> list[dict]:
        out, at = [], 0
        for p in parts:
            out.append({"word": p, "start": at, "end": at + len(p)})
            at += len(p)
        return out

    return row_function(_PLACED, lay)


def laid_out(parts: Column) -> Column:
    """array<struct<word, start, end>> of strings that make up a text without gaps."""
    return _laid_out()(parts)


@lru_cache(maxsize=None)
def _occurrences(mode: str):
    def find(text: str, term: str | None) -> list[int]:
        import regex

        if not term:
            return []
        pattern = regex.escape(term)
        if mode == "tokens":
            pattern = rf"(?<![\p{{L}}\p{{N}}\p{{M}}]){pattern}(?![\p{{L}}\p{{N}}\p{{M}}])"
        return [m.start() for m in regex.finditer(pattern, text, regex.IGNORECASE, overlapped=mode == "overlapping")]

    return row_function("array<int>", find)


def occurrences(text: Column, term: Column, mode: str = "free") -> Column:
    """array<int>: starts of a term in a text, left to right, blind to case. free: not overlapping; overlapping: all; tokens: not overlapping
    and with no letter, digit or mark next to it."""
    return _occurrences(mode)(text, term)


@lru_cache(maxsize=None)
def _realigned():
    def align(text: str, marks: list[dict] | None) -> list[dict]:
        out, after = [], {}
        for m in marks or []:
            t, start = m["text"], m["start"]
            if not t:
                start = None
            elif start is None or start < 0 or text[start : start + len(t)] != t:
                start = text.find(t, after.get(t, 0))
                start = None if start < 0 else start
            end = None if start is None else start + len(t)
            if end is not None:
                after[t] = max(after.get(t, 0), end)
            out.append({"text": t, "start": start, "end": end})
        return out

    return row_function("array<struct<text:string,start:int,end:int>>", align)


def realigned(text: Column, marks: Column) -> Column:
    """array<struct<text, start, end>> of array<struct<text, start>> in order: a mark keeps its start if its text stands there; else it
    takes the next place of its text behind all marks before it of the same text; where there is none it has null and the cursor stays."""
    return _realigned()(text, marks)


@lru_cache(maxsize=None)
def _whole_chunks(budget: int):
    def cut(sizes: list[int], joined: list[bool]) -> list[int]:
        runs = list(sizes)  # units from a token to the end of its entity
        for i in range(len(sizes) - 2, -1, -1):
            if joined[i + 1]:
                runs[i] += runs[i + 1]
        out, chunk, used = [], 0, 0
        for size, run, inside in zip(sizes, runs, joined):
            if used + size > budget if inside else used > 0 and used + run > budget:
                chunk, used = chunk + 1, 0
            used += size
            out.append(chunk)
        return out

    return row_function("array<int>", cut)


def whole_chunks(sizes: Column, joined: Column, budget: int) -> Column:
    """array<int>: the chunk of each token, of at most budget units, where a token that is joined to the one before (inside an entity)
    never begins a chunk, unless the entity alone is over the budget. sizes: units of each token; joined: booleans."""
    return _whole_chunks(budget)(sizes, joined)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    return both / (F.greatest(e1, e2) - F.least(s1, s2))


# Sort keys of overlap policies over spans with start, end and (where used) rank, priority, frequency, source_rank: smaller first.
POLICIES = {
    "engine": lambda s: [s["start"] - s["end"], s["rank"], s["start"]],
    "experiment": lambda s: [s["start"] - s["end"], s["priority"], s["start"], s["end"]],
    "gold": lambda s: [s["start"] - s["end"], s["start"], s["end"]],
    "lexicon": lambda s: [s["start"] - s["end"], -s["frequency"], s["start"]],
    "pilot": lambda s: [s["start"] - s["end"], s["start"], s["priority"]],
    "shortest": lambda s: [s["end"] - s["start"], s["start"], s["end"]],
    "source": lambda s: [s["source_rank"], s["start"] - s["end"], s["priority"], s["start"], s["end"]],
    "earliest": lambda s: [s["start"], s["start"] - s["end"]],
}


@lru_cache(maxsize=None)
def _free():
    def choose(starts: list[int], ends: list[int]) -> list[bool]:
        taken_s, taken_e, out = [], [], []
        for s, e in zip(starts, ends):
            i = bisect_left(taken_s, e)  # those before i begin before e; the last of them ends last
            ok = i == 0 or taken_e[i - 1] <= s
            if ok:
                taken_s.insert(i, s)
                taken_e.insert(i, e)
            out.append(ok)
        return out

    return row_function("array<boolean>", choose)


def resolved(spans: Column, policy: str, fields: list[str]) -> Column:
    """The spans that a greedy choice in the policy's order keeps free of overlaps, by start. fields: all names of a span, which break what ties are left.
    What is kept is free of overlaps, so each span is only held against the last kept one before its end. Spans hold at least one character."""
    keyed = F.transform(spans, lambda s: F.struct(*(k.alias(f"k{i}") for i, k in enumerate(POLICIES[policy](s))), *(s[f].alias(f"t{i}") for i, f in enumerate(fields)), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])
    flags = _free()(F.transform(ordered, lambda s: s["start"]), F.transform(ordered, lambda s: s["end"]))
    kept = F.filter(F.zip_with(ordered, flags, lambda s, k: F.when(k, s)), lambda s: s.isNotNull())
    return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("k"), s.alias("s")))), lambda k: k["s"])


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: int = 256) -> DataFrame:
    """Pairs of left and right spans of one document (and equal other keys of on) that overlap, each once.

    Spans are put into bins of width characters, so that a long document is spread over (document, bin) keys."""
    binned = lambda df, p: df.select(*on, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in on)).withColumn("__bin", F.explode(F.sequence((F.col(f"{p}_start") / width).cast("int"), (F.greatest(F.col(f"{p}_end") - 1, F.col(f"{p}_start")) / width).cast("int"))))
    joined = binned(left, "l").join(binned(right, "r"), [*on, "__bin"]).filter("l_start < r_end and r_start < l_end")
    first = F.greatest((F.col("l_start") / width).cast("int"), (F.col("r_start") / width).cast("int"))
    return joined.filter(F.col("__bin") == first).drop("__bin")


@lru_cache(maxsize=None)
def _one_to_one():
    def choose(ls: list[int], rs: list[int]) -> list[bool]:
        left, right, out = set(), set(), []
        for a, b in zip(ls, rs):
            ok = a not in left and b not in right
            if ok:
                left.add(a)
                right.add(b)
            out.append(ok)
        return out

    return row_function("array<boolean>", choose)


def greedy_pairs(pairs: Column) -> Column:
    """Of array<struct<score, l, r>> a one-to-one choice by falling score, then falling l and r."""
    ordered = F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct((-p["score"]).alias("a"), (-p["l"]).alias("b"), (-p["r"]).alias("c"), p.alias("p")))), lambda k: k["p"])
    flags = _one_to_one()(F.transform(ordered, lambda p: p["l"]), F.transform(ordered, lambda p: p["r"]))
    return F.filter(F.zip_with(ordered, flags, lambda p, k: F.when(k, p)), lambda p: p.isNotNull())


def bipartite_size(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group..., matched): the size of a maximum one-to-one matching of the edges (group..., l, r) of each group.

    Augmenting paths per group in Python; a group is one document's overlapping spans of one label."""

    def run(table: pa.Table) -> pa.Table:
        cols = table.to_pydict()
        near: dict = {}
        for a, b in zip(cols["l"], cols["r"]):
            near.setdefault(a, []).append(b)
        taken: dict = {}
        for root in near:
            seen, back, queue, end = {root}, {}, [root], None
            owner: dict = {}
            while queue and end is None:
                a = queue.pop(0)
                for b in near[a]:
                    if b in owner:
                        continue
                    owner[b] = a
                    if b not in taken:
                        end = b
                        break
                    if taken[b] not in seen:
                        seen.add(taken[b])
                        back[taken[b]] = b
                        queue.append(taken[b])
            while end is not None:
                a = owner[end]
                taken[end], end = a, back.get(a)
        return pa.table({**{g: pa.array([cols[g][0]], table.schema.field(g).type) for g in group}, "matched": pa.array([len(taken)], pa.int64())})

    kinds = ", ".join(f"{g} {edges.schema[g].dataType.simpleString()}" for g in group)
    return edges.select(*group, "l", "r").groupBy(*group).applyInArrow(run, f"{kinds}, matched long")
