"""Byte-pair vocabularies: tables, matching and the compatibility of adjacent tokens.

A vocabulary is read once per Python process from a file that every machine
has (its path is a parameter). Nothing here depends on Spark.
"""

from __future__ import annotations

import base64
import functools
import json
import re

#: Entries of a memo's generation, of which there are two: about 40 MB for pieces, 40 MB for
#: pairs of tokens, 60 MB for the chains of tokens.
MEMO = 200_000
PAIRS = 200_000
CHAINS = 8_000


class Memo(dict):
    """``memo[key]`` computes and keeps ``fn(key)``.

    A full memo becomes the old generation, from which keys that are asked for
    again return; so memory is bounded by twice ``size`` entries.
    """

    def __init__(self, fn, size: int = MEMO):
        super().__init__()
        self.fn, self.size, self.old = fn, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value


class Vocabulary:
    """Tokens as bytes, the rank at which two neighbours merge, and an Aho-Corasick matcher.

    ``pairs`` gives the rank of a merge by (left id, right id); without it two
    neighbours merge whenever their joined bytes are a token, at its id.
    """

    def __init__(self, tokens: dict[bytes, int], pairs: dict[tuple[int, int], int] | None = None):
        import ahocorasick
        self.ids = tokens
        self.bytes = {i: t for t, i in tokens.items()}
        self.pairs = pairs
        self.letters = {t.decode("latin-1"): i for t, i in tokens.items()}
        self.longest = max(map(len, tokens))
        self.matcher = ahocorasick.Automaton()
        for token, i in tokens.items():
            self.matcher.add_word(token.decode("latin-1"), (i, len(token)))
        self.matcher.make_automaton()
        self.chains = Memo(self._chains, CHAINS)
        self.fits = Memo(self._fits, PAIRS)

    def rank(self, left: int, right: int) -> int | None:
        if self.pairs is not None:
            return self.pairs.get((left, right))
        return self.ids.get(self.bytes[left] + self.bytes[right])

    def _chains(self, token: int):
        """The tokens that stand at the left and at the right edge of ``token`` while it forms.

        Each chain runs from a byte to the token: (id, bytes, rank of the
        merge that ends it, time of that merge). Time is the highest rank seen so far,
        since a merge of lower rank follows at once when it becomes possible.
        """
        data = self.bytes[token]
        parts = [self.ids[data[i:i + 1]] for i in range(len(data))]
        left, right, time = [], [], -1
        while len(parts) > 1:
            ranks = [(r, i) for i in range(len(parts) - 1)
                     if (r := self.rank(parts[i], parts[i + 1])) is not None]
            if not ranks:
                return None  # no merges lead to this token
            r, i = min(ranks)
            time = max(time, r)
            if i == 0:
                left.append((parts[0], self.bytes[parts[0]], r, time))
            if i == len(parts) - 2:
                right.append((parts[-1], self.bytes[parts[-1]], r, time))
            parts[i:i + 2] = [self.ids[self.bytes[parts[i]] + self.bytes[parts[i + 1]]]]
        whole = (token, data, 1 << 60, 1 << 60)
        return [*left, whole], [*right, whole]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay apart when their joined bytes are merged.

        Both form on their own unless, at some time, the token at the right
        edge of the first and the one at the left edge of the second merge
        before either takes part in another merge. Of equal ranks the
        leftmost merge goes first.
        """
        a, b = self.chains[pair[0]], self.chains[pair[1]]
        if a is None or b is None:
            return False
        right, left, ids, pairs = a[1], b[0], self.ids, self.pairs
        i, j, last_i, last_j = 0, 0, len(right) - 1, len(left) - 1
        u, data_u, rank_u, time_u = right[0]
        v, data_v, rank_v, time_v = left[0]
        while True:
            r = ids.get(data_u + data_v) if pairs is None else pairs.get((u, v))
            if r is not None and r < rank_u and r <= rank_v:
                return False
            if time_u <= time_v and i < last_i:
                i += 1
                u, data_u, rank_u, time_u = right[i]
            elif j < last_j:
                j += 1
                v, data_v, rank_v, time_v = left[j]
            else:
                return True

    def encode(self, data: bytes) -> list[int]:
        """Tokens of one piece by backtracking from longest matches.

        The longest token at the current place is tried first, then the
        shorter ones; a token is taken when it fits the one before it and its
        end is not known as a dead end. Every place becomes dead at most
        once, so the work is linear in the length.
        """
        text = data.decode("latin-1")
        whole = self.letters.get(text)
        if whole is not None and self.chains[whole] is not None:
            return [whole]
        find, known, fits, longest = self.letters.get, self.matcher.longest_prefix, self.fits, self.longest
        n, at, before, tokens, ends, dead = len(text), 0, -1, [], [0], set()
        window = text[:longest]
        size = known(window)
        while at < n:
            while size:
                token = find(window[:size])
                if token is not None and (before < 0 or fits[before, token]) and at + size not in dead:
                    break
                size -= 1
            if size:
                at += size
                before = token
                tokens.append(token)
                ends.append(at)
                window = text[at:at + longest]
                size = known(window)
            else:
                if not tokens:
                    raise ValueError("no merges give this piece")
                dead.add(ends.pop())
                tokens.pop()
                size = at - ends[-1] - 1
                at, before = ends[-1], tokens[-1] if tokens else -1
                window = text[at:at + longest]
        return tokens

    def prefix_counts(self, data: bytes) -> list[int]:
        """Number of tokens of every prefix of one piece, the empty one first.

        The last token of a prefix is the one match ending there that fits the
        last token of what precedes it, so one pass over the matches suffices.
        """
        counts, last, fits = [0] * (len(data) + 1), [-1] * (len(data) + 1), self.fits
        for end, (token, length) in self.matcher.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:  # matches come longest first, and one is right
                start = end - length
                if fits[last[start], token] if start else self.chains[token] is not None:
                    last[end], counts[end] = token, counts[start] + 1
        return counts


# fixed value: classes of the splitting patterns, and the same classes within ASCII
ASCII_CLASSES = (
    (r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"),
    (r"\s", r"[\t-\r ]"), (r"\S", r"[^\t-\r ]"))


@functools.cache
def splitter(pattern: str):
    """Function from a text to its pieces.

    An ASCII text is split by the same pattern with its classes written out
    for ASCII, which the standard module matches faster.
    """
    import regex
    anywhere, plain = regex.compile(pattern).findall, pattern
    for name, members in ASCII_CLASSES:
        plain = plain.replace(name, members)
    if "\\p" in plain or "(?" in plain.replace("(?!", ""):
        return anywhere
    within_ascii = re.compile(plain).findall
    return lambda text: within_ascii(text) if text.isascii() else anywhere(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, file)}


@functools.cache
def from_ranks(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


@functools.cache
def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies in JSON write for bytes: printable bytes for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def from_json(path: str) -> tuple[Vocabulary, tuple[str, ...]]:
    """A tokenizers file with a byte-level BPE model: the vocabulary, and its special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pair = lambda m: m if isinstance(m, list) else m.split(" ")
    merges = [[bytes(letters[c] for c in side) for side in pair(m)] for m in spec["model"]["merges"]]
    pairs = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(merges)}
    return Vocabulary(ids, pairs), tuple(t["content"] for t in spec["added_tokens"])
