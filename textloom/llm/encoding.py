"""Problem 8: token ids of every text by a public byte-level tokenizer.

Byte pairs that stand inside no token of the vocabulary force a boundary: no merge can reach across. Every text is cut at all such
pairs where the pre-tokenizer's pattern cannot notice the cut, fragments are encoded on their own (each distinct one once a task) and joined.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k"
#: The pre-tokenizer's pattern of the vocabulary (fixed value, as published with it).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 400_000  # distinct fragments a task remembers
VOCABULARY_BYTES = 64 << 20  # of a vocabulary file, at most: it is sent to all executors


def vocabulary(folder: str = FOLDER, name: str = VOCABULARY) -> bytes:
    """The vocabulary file, read where the driver runs; executors get it from there and need no such folder."""
    path = f"{folder}/{name}.tiktoken"
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def inner_pairs(tokens) -> np.ndarray:
    """256 x 256 table: whether a byte pair stands inside any token."""
    table = np.zeros((256, 256), dtype=bool)
    for t in tokens:
        if len(t) > 1:
            b = np.frombuffer(t, dtype=np.uint8)
            table[b[:-1], b[1:]] = True
    return table


def forced_cuts(tokens) -> Callable[[bytes], np.ndarray]:
    """text in UTF-8 -> positions of its forced cuts.

    A pair inside no token forces a cut, unless the pattern could read the two sides otherwise than the whole: after a blank (blanks
    belong to what follows or to one another), before an apostrophe that may end a run of signs, and inside a character."""
    table = ~inner_pairs(tokens)
    table[:, 0x80:0xC0] = False
    table[[*range(0x09, 0x0E), *range(0x1C, 0x21)], :] = False
    word = np.zeros(256, dtype=bool)
    word[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
    table[~word, ord("'")] = False

    def cuts(raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw, dtype=np.uint8)
        at = np.flatnonzero(table[b[:-1], b[1:]]) + 1
        wide = b[at - 1] >= 0x80
        if wide.any():  # after a blank of several bytes
            one, two, three = b[at - 1], b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
            blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
            blank |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
            blank |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
            blank |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
            blank |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
            at = at[~(blank & wide)]
        return at

    return cuts


def encoder(raw_vocabulary: bytes | None = None, name: str = VOCABULARY) -> Callable[[str], bytes]:
    """text -> its ids as 32-bit integers in bytes."""
    import tiktoken

    ranks = ranks_of(raw_vocabulary if raw_vocabulary is not None else vocabulary(name=name))
    encode = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    cuts, kept = forced_cuts(ranks), {}

    def ids(text: str) -> bytes:
        raw = text.encode()
        ends, out, at = cuts(raw).tolist(), [], 0
        ends.append(len(raw))
        for end in ends:
            fragment = raw[at:end]
            at = end
            got = kept.get(fragment)
            if got is None:
                if len(kept) >= KEPT:
                    kept.clear()
                got = kept[fragment] = np.array(encode(fragment.decode()), dtype=np.int32).tobytes()
            out.append(got)
        return b"".join(out)

    return ids


def encoded(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """(key, ids): one row per row of df, without special tokens; an empty list for empty and null texts. With counts_only
    (key, n_tokens). Strings of special tokens inside a text are ordinary text. Nothing is shuffled; other columns are not read."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])
    held = df.sparkSession.sparkContext.broadcast(vocabulary(folder, name))  # at most VOCABULARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(held.value, name)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [ids(t) if t else b"" for t in part.column(1).to_pylist()]
                sizes = np.array([len(m) // 4 for m in made], dtype=np.int64)
                if counts_only:
                    column = pa.array(sizes)
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=schema.names)

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
