"""Best-fit packing of documents into sequences under several capacities.

A sequence holds so many tokens, so many documents and so much attention cost (a piece of n
tokens costs n^2, as attention does not cross documents). Pieces are placed in decreasing
length; each goes to the sequence whose residual capacities it fits best: the smallest
weighted norm of what is left, or the smallest weighted dot product of what is left with
the piece's own demands. A sequence that would break any capacity is no candidate.

Pieces of one length are alike, so the choice is made for counts, not for pieces: the
histogram of lengths (at most one row per possible length) goes to the driver, best fit
runs over groups of equal sequences, and its result are slots: a range of ranks among
the pieces of a length, the sequences they go to and their offsets. Under both rules a
sequence that has taken a piece fits the next of that length even better, until one
capacity is spent; so a group of equal sequences is filled at once, with the result
that one piece after another would give. The number of groups grows with the number of
lengths, not of documents. Pieces get ranks from counts by scan task and length, and look
their slot up where they are; neither texts nor tokens are shuffled.

Tokens are those of the tokenizers library. Its normaliser and splitter do not look across
white space, so words between white space are encoded once, all new ones of a slice of texts
in one call of the library, and remembered in a memo of bounded size.

Defined results:

* null or empty text: only the end id, one piece;
* null ids, repeated rows: pieces of their own; ties in length: in the order of the scan;
* very long texts: cut into whole pieces of the largest length, the last may be shorter;
* special strings in a text: as the library takes them by default;
* empty table: empty result; columns of the input named like an output: kept inside ``row``.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.joins import broadcast_if_small
from driftline.llm.byte_bpe import slices
from driftline.llm.tables import packed, release, written

TOKENS = 2048
END_ID = 0
#: Words of a memo's generation, of which there are two: about 70 MB each.
MEMO_WORDS = 400_000
MEMO_CHARS = 64
WORDS_A_CALL = 256
#: Text whose different words are looked up together.
SLICE_BYTES = 8 << 20


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold, and how much each residual counts in the choice of a sequence."""

    tokens: int = TOKENS
    documents: int = TOKENS
    attention: int = TOKENS * TOKENS
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)

    @property
    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)

    @property
    def longest(self) -> int:
        """The largest piece that an empty sequence can take."""
        return min(self.tokens, math.isqrt(self.attention))


# ---------------------------------------------------------------------- tokens
#: What the splitter takes for white space (not the separators \x1c to \x1f); the ASCII ones are Arrow's as well.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: ASCII letters and a little punctuation after them (no apostrophe, which can begin a piece with letters).
TAILED = re.compile(r"([A-Za-z]+)([!-&(-/:-@\[-`{-~]{1,3})")


class WordTokens:
    """Token ids of texts by a tokenizers file, through a memo of words.

    New words go to the library as one text, with a special string between them whose id
    marks where a word ends; words of letters with a space between them (see ``letters``). Punctuation
    at the end of a word is a piece of its own, and its ids are taken from the memo as well. A full memo becomes the old generation, from which words that
    come again return.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        vocabulary = tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end what the splitter gives
        if suffix:
            self.closing[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.apart: dict[str, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def alone(self, word: str) -> bytes:
        return np.array(self.encode([word], add_special_tokens=False)[0].ids, np.uint32).tobytes()

    def ids(self, words: list[str]) -> Iterator[bytes]:
        for start in range(0, len(words), WORDS_A_CALL):
            part = words[start:start + WORDS_A_CALL]
            mark, mark_id = next(((t, i) for t, i in self.special.items() if not any(t in w for w in part)), ("", None))
            if mark_id is None:
                yield from map(self.alone, part)
                continue
            found = np.array(self.encode([mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            data, begin = found.tobytes(), 0
            for end in (*np.flatnonzero(found == mark_id).tolist(), len(found)):
                yield data[4 * begin:4 * end]
                begin = end + 1

    def comes_apart(self, tail: str) -> bool:
        """Whether the tokenizer ends a piece between letters and this punctuation."""
        known = self.apart.get(tail)
        if known is None:
            known = self.apart[tail] = all(self.alone(s + tail) == self.alone(s) + self.alone(tail) for s in ("ab", "thE"))
        return known

    def letters(self, words: list[str]) -> Iterator[bytes]:
        """``ids`` of words of letters only, joined by spaces, which costs the library less than marks.

        A word gives one piece at least, and every piece ends in one closing token; so with as many
        closing tokens as words, each word ends where its closing token is.
        """
        for start in range(0, len(words), WORDS_A_CALL):
            part = words[start:start + WORDS_A_CALL]
            found = np.array(self.encode([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = (4 * np.flatnonzero(self.closing[found]) + 4).tolist()
            if len(ends) != len(part) or ends[-1] != 4 * len(found):
                yield from self.ids(part)
                continue
            data = found.tobytes()
            yield from (data[a:b] for a, b in zip((0, *ends), ends))

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of different words; what is new goes through the memo."""
        found = list(map(self.memo.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.old, self.memo, new = self.memo, {}, words
        memo, old = self.memo, self.old
        again = list(map(old.get, new))
        memo.update((w, ids) for w, ids in zip(new, again) if ids is not None)
        made, given = [], set()
        for word in [w for w, ids in zip(new, again) if ids is None]:
            if (m := TAILED.fullmatch(word)) and self.comes_apart(m[2]):
                made.append((word, m.groups()))
            elif not word.isascii() and SPACES.search(word):
                made.append((word, [x for x in SPACES.split(word) if x]))
            else:
                given.add(word)
        parts = {x for _, own in made for x in own if x not in memo}
        memo.update([(x, old[x]) for x in parts if x in old])
        given.update([x for x in parts if x not in old])
        plain = [w for w in given if w.isalpha()] if self.closing.any() else []
        mixed = [w for w in given if not w.isalpha()] if plain else list(given)
        memo.update(zip(plain, self.letters(plain)))
        memo.update(zip(mixed, self.ids(mixed)))
        memo.update([(w, b"".join([memo[x] for x in own])) for w, own in made])
        found = [memo[w] if ids is None else ids for w, ids in zip(words, found)]
        for word in itertools.chain(new, parts):
            if len(word) > MEMO_CHARS:
                memo.pop(word, None)
        return found

    def __call__(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: none) as little-endian 32-bit integers.

        Arrow splits at ASCII white space, numbers the different words and puts the ids of all words
        in a row; only different words become Python strings. Other white space is split in ``known``.
        """
        if not len(texts):
            return
        given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(given, ""))
        words = split.values.dictionary_encode()
        own = self.known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, ends, data = pa.array(own, pa.large_binary()).take(words.indices).buffers()
        bounds = np.frombuffer(ends, np.int64)[np.asarray(split.offsets)].tolist()
        data = memoryview(data or b"")
        for begin, end in zip(bounds, bounds[1:]):
            yield data[begin:end].tobytes()


@functools.cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(df: DataFrame, path: str, longest: int = TOKENS, end_id: int = END_ID, text: str = "text",
           keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``row``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``), written in scan order.

    ``part`` and ``nth`` number the pieces of a length within their task; they are written
    with the pieces, so they cannot change under a retry.
    """
    given = packed(df, keep, text=text)
    schema = T.StructType([given.schema["row"], *(T.StructField(n, T.LongType()) for n in (
        "piece", "start", "length", "ids_crc32", "part", "nth")), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seen = word_tokens(path), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text"), SLICE_BYTES):
                owner, place, lengths, crcs, nth, ids = [], [], [], [], [], []
                for k, own in enumerate(tokens(texts)):
                    data = own + end
                    for piece, start in enumerate(range(0, len(data), 4 * longest)):
                        span = data[start:start + 4 * longest]
                        owner.append(done + k)
                        place.append(piece)
                        lengths.append(len(span) // 4)
                        crcs.append(zlib.crc32(span))
                        nth.append(seen[len(span)])
                        seen[len(span)] += 1
                        ids.append(np.frombuffer(span, np.int32) if with_ids else None)
                done += len(texts)
                row = batch.column("row").take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [row, pa.array(place, pa.int64()), pa.array([p * longest for p in place], pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
                     pa.array([part] * len(owner), pa.int64()), pa.array(nth, pa.int64()),
                     pa.array(ids, pa.list_(pa.int32()))], names=schema.names)
            del batch
            release()

    return written(given.mapInArrow(cut, schema), "pieces")


# -------------------------------------------------------------------- best fit
@dataclass
class Group:
    """Equal sequences with consecutive numbers, and the ranks of the pieces they hold."""

    base: int
    size: int
    held: list[tuple[int, int, int]]  # (length, rank of the first piece, pieces in each sequence)

    def split(self, size: int) -> Group:
        """Cut off the sequences after the first ``size``."""
        rest = Group(self.base + size, self.size - size,
                     [(n, rank + size * each, each) for n, rank, each in self.held])
        self.size = size
        return rest


RULES = ("norm", "dot")


def fit(residual: np.ndarray, demand: np.ndarray, capacity: Capacity, rule: str) -> np.ndarray:
    """How much is left, for each row of ``residual``, once a piece is placed; the smallest fits best."""
    left = (residual - demand) / capacity.limits
    if rule == "norm":
        return (np.array(capacity.weights) * left * left).sum(1)
    return (np.array(capacity.weights) * left * (demand / capacity.limits)).sum(1)


def demand_of(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


def best_fit(histogram: dict[int, int], capacity: Capacity = Capacity(), rule: str = "norm") -> list[Group]:
    """Groups of sequences that hold ``histogram[length]`` pieces of each length.

    Lengths go from the largest to the smallest; of equal fits the group opened first wins.
    """
    if histogram and max(histogram) > capacity.longest:
        raise ValueError(f"no sequence can take a piece of {max(histogram)} tokens")
    groups: list[Group] = []
    residual = np.zeros((64, 3), np.int64)  # a row per group, and spare rows of zeros
    numbers = 0

    def opened(group: Group, left: np.ndarray) -> int:
        nonlocal residual
        if len(groups) == len(residual):
            residual = np.concatenate([residual, np.zeros_like(residual)])
        residual[len(groups)] = left
        groups.append(group)
        return len(groups) - 1

    for length in sorted(histogram, reverse=True):
        demand, left, rank = demand_of(length), histogram[length], 0

        def place(at: int, size: int, each: int) -> None:
            """``each`` pieces into each of the first ``size`` sequences of a group; the others split off."""
            nonlocal left, rank
            if size < groups[at].size:
                opened(groups[at].split(size), residual[at].copy())
            groups[at].held.append((length, rank, each))
            residual[at] -= each * demand
            left, rank = left - size * each, rank + size * each

        fits = np.flatnonzero((residual >= demand).all(1))
        for at in fits[np.argsort(fit(residual[fits], demand, capacity, rule), kind="stable")].tolist():
            if not left:
                break
            each = int((residual[at] // demand).min())
            full = min(groups[at].size, left // each)
            whole = full == groups[at].size
            if full:
                place(at, full, each)
            if left and not whole:  # fewer than the next equal sequence could take
                place(len(groups) - 1 if full else at, 1, left)
        if left:
            each = int((capacity.limits // demand).min())
            for size, count in ((left // each, each), (min(left % each, 1), left % each)):
                if size:
                    at = opened(Group(numbers, size, []), capacity.limits)
                    numbers += size
                    place(at, size, count)
    return groups


def slots(groups: list[Group]) -> np.ndarray:
    """Rows (length, first rank, pieces in each sequence, first sequence, offset), in this order."""
    out = []
    for g in groups:
        offset = 0
        for length, rank, each in g.held:
            out.append((length, rank, each, g.base, offset))
            offset += length * each
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def lookup(table: np.ndarray, counts: dict[int, int], lengths: np.ndarray, ranks: np.ndarray):
    """Sequence and offset of pieces given by length and rank among pieces of the length."""
    order = sorted(counts)
    begin = dict(zip(order, itertools.accumulate([0, *(counts[n] for n in order)])))
    shift = np.zeros(max(order, default=0) + 1, np.int64)
    for n in order:
        shift[n] = begin[n]
    at = np.searchsorted(shift[table[:, 0]] + table[:, 1], shift[lengths] + ranks, side="right") - 1
    slot = table[at]
    sequence, nth = np.divmod(ranks - slot[:, 1], slot[:, 2])
    return slot[:, 3] + sequence, slot[:, 4] + nth * lengths


PLACED = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack(found: DataFrame, capacity: Capacity = Capacity(), rules=RULES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; of the rules, the one that needs fewest sequences."""
    parts = written(found.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    # at most capacity.longest rows, whatever the table
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plans = [best_fit(counts, capacity, rule) for rule in rules]
    table = slots(min(plans, key=lambda p: sum(g.size for g in p)))
    shared = found.sparkSession.sparkContext.broadcast((table, counts))
    # the window holds one row per scan task for a length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written(parts.select(F.col("part").alias("p"), F.col("length").alias("len"), F.coalesce(
        F.sum("n").over(before), F.lit(0)).alias("before")), "ranks")

    @F.arrow_udf(PLACED)
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        slots_, counts_ = shared.value
        got = lookup(slots_, counts_, np.asarray(lengths), np.asarray(ranks))
        return pa.StructArray.from_arrays([pa.array(x) for x in got], PLACED.fieldNames())

    ranked = found.join(broadcast_if_small(shifts), (F.col("part") == F.col("p")) & (F.col("length") == F.col("len")))
    placed = ranked.withColumn("placed", place("length", F.col("before") + F.col("nth")))
    return placed.select("row", "piece", "start", "length", "ids_crc32", "ids", "placed.sequence_id", "placed.offset")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The sequences themselves: ``ids`` and the lengths of their pieces, for pieces that keep ids.

    A group is one sequence, so its size is bounded by the capacity.
    """
    whole = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(whole.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"))
