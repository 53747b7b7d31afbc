"""Token counts of every prefix of a text.

One pass over a text finds how many tokens each of its prefixes has, as the
tokenizers library would count that prefix on its own. Stored next to the
text, the counts answer how long it is, where it must be cut to fit a budget
and how much a part costs, without encoding again.

The counts are stored as 16-bit differences, one per code point: the last
token of a prefix ends at most one token (128 bytes) before its end, so two
neighbouring prefixes never differ by more.

Within a piece of the split, counts come from dynamic programming over all
matching tokens (``bpe.Vocabulary.prefix_counts``). Cutting a text can change
its split at the end only; those cases are a run of white space that is cut
before the word it belongs to, a contraction cut after its first letter, and
a special string that is not yet complete. Each is counted as the split of
the prefix itself gives it.

Defined results:

* null or empty text: no prefixes, 0 tokens;
* special strings in a text: one token each, as is the library's default;
* very long texts: linear in their length;
* repeated rows, empty tables: row by row;
* columns of the input named like an output: kept inside ``row``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm import bpe
from driftline.llm.tables import packed

DELTA = np.dtype("<i2")
# fixed value: contractions whose prefix of two characters is split otherwise
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Differences of the counts of all prefixes of a text."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.vocabulary, special = bpe.from_json(path)
        self.split = bpe.splitter(pattern)
        self.run = regex.compile(r"\s{2,}(?=\S)")
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo = bpe.Memo(self.piece)

    def piece(self, piece: str) -> bytes:
        data = piece.encode()
        counts = np.array(self.vocabulary.prefix_counts(data))
        if len(data) > len(piece):  # count at ends of code points only
            starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            counts = counts[np.append(np.flatnonzero(starts), len(data))]
        if piece in LONG_CONTRACTIONS:
            counts[2] = 2
        return np.diff(counts).astype(DELTA).tobytes()

    def size(self, piece: str) -> int:
        return int(np.frombuffer(self.memo[piece], DELTA).sum())

    def ordinary(self, text: str) -> np.ndarray:
        """Of a text taken without special strings."""
        out = np.frombuffer(b"".join(map(self.memo.__getitem__, self.split(text))), DELTA)
        runs = list(self.run.finditer(text))
        if runs:
            out = out.copy()
        for run in runs:
            space, end = run.group(), run.end()
            step = self.size(space) - self.size(space[:-1]) - self.size(space[-1])
            out[end - 1] += step
            out[end] -= step
        return out

    def __call__(self, text: str) -> bytes:
        marks = list(self.special.finditer(text)) if self.special else []
        parts, start = [], 0
        for mark in marks:
            whole = self.ordinary(text[start:mark.end()]).copy()
            at = mark.start() - start
            whole[-1] = 1 - whole[at:-1].sum()
            parts.append(whole)
            start = mark.end()
        parts.append(self.ordinary(text[start:]))
        return b"".join(p.tobytes() for p in parts)


@functools.cache
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def prefix_deltas(path: str, pattern: str):
    """Column function: a text to the differences of its prefix counts."""

    @F.arrow_udf("binary")
    def deltas(texts: pa.Array) -> pa.Array:
        count = counter(path, pattern)
        return pa.array([count(text.as_py() or "") for text in texts], pa.binary())

    return deltas


def prefix_counts(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``row`` and ``prefixes``, the stored counts of the whole text."""
    return packed(df, text=text).select("row", prefix_deltas(path, pattern)("text").alias("prefixes"))


def budget(prefixes: Column, limit: int) -> Column:
    """``n_tokens`` of the text, and ``fitting_chars``, its longest prefix within ``limit`` tokens."""

    @F.arrow_udf("n_tokens long, fitting_chars long")
    def answer(stored: pa.Array) -> pa.Array:
        totals, fitting = [], []
        for value in stored:
            counts = np.frombuffer(value.as_buffer() or b"", DELTA).cumsum(dtype=np.int64)
            totals.append(int(counts[-1]) if len(counts) else 0)
            within = np.flatnonzero(counts[::-1] <= limit)
            fitting.append(len(counts) - int(within[0]) if len(within) else 0)
        return pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(fitting, pa.int64())],
                                          ["n_tokens", "fitting_chars"])

    return answer(prefixes)


def tokens_between(prefixes: Column, start: Column, end: Column) -> Column:
    """Tokens of the first ``end`` code points less those of the first ``start``; null without counts."""

    @F.arrow_udf("long")
    def part(stored: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for value, a, b in zip(stored, starts, ends):
            known = value.is_valid and a.is_valid and b.is_valid
            out.append(int(np.frombuffer(value.as_buffer(), DELTA)[a.as_py():b.as_py()].sum(dtype=np.int64))
                       if known else None)
        return pa.array(out, pa.int64())

    return part(prefixes, start, end)
