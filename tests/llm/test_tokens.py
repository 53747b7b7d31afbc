"""Token operators against the libraries, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import bpe, byte_bpe, token_counts

RANKS, PATTERN = byte_bpe.public_vocabulary("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a   b", "x're they'll don't we''re", "a\n\nfoo \n bar", "", "  ", "!!<|endoftext|>", "<|endoftext|>",
         "hi <|endoftext|> you<|endoftext|>", "tab\t\t x　　y été \U0001f600\U0001f601 z", "ok <|endof",
         "aaaaaaaaaa      bbbb", "Fußgängerübergänge 12345,67 — “quoted”", "\r\n\r\nx\x85\x1c y"]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.from_ranks(RANKS).ids, special_tokens={})


def test_encode_equals_library(encoding):
    vocabulary, rng = bpe.from_ranks(RANKS), random.Random(3)
    tokens = list(vocabulary.ids)
    for _ in range(2000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 7)))
        assert vocabulary.encode(piece) == encoding._encode_single_piece(piece)


@pytest.mark.parametrize("piece", [b"a" * 3000, b" " * 2000, b"ab" * 2000, bytes(range(256))])
def test_long_pieces(encoding, piece):
    assert bpe.from_ranks(RANKS).encode(piece) == encoding._encode_single_piece(piece)


def test_splitter_within_ascii():
    import regex
    text = "".join(map(chr, range(128))) * 2 + " 's'll don't  x\n\n y"
    assert bpe.splitter(PATTERN)(text) == regex.findall(PATTERN, text)


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(text):
    tokenizer = Tokenizer.from_file(JSON)
    counts = np.frombuffer(token_counts.PrefixCounter(JSON, PATTERN)(text), token_counts.DELTA).cumsum()
    want = [len(tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
    assert counts.tolist() == want


def test_white_space_of_all_code_points():
    tokenizer, counter = Tokenizer.from_file(JSON), token_counts.PrefixCounter(JSON, PATTERN)
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 64):
        text = "".join(f"a{c}{c}b1{c}! " for c in points[start:start + 64])
        got = int(np.frombuffer(counter(text), token_counts.DELTA).sum())
        assert got == len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("together", [True, False, "digest"])
def test_odd_documents(odd_documents, encoding, together):
    coded = byte_bpe.round_trip(odd_documents, RANKS, PATTERN, digest=together == "digest") if together else byte_bpe.decode(
        byte_bpe.encode(odd_documents, RANKS, PATTERN), RANKS)
    rows = byte_bpe.digests(coded, "text").withColumn(
        "same", F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert len(rows) == 9 and all(r.same for r in rows)
    assert all(r.n_tokens == len(encoding.encode_ordinary(r.text or "")) for r in rows)


def test_budget_answers(odd_documents):
    tokenizer = Tokenizer.from_file(JSON)
    prefixes = token_counts.prefix_counts(odd_documents, JSON, PATTERN)
    rows = prefixes.select("row.text", token_counts.budget(F.col("prefixes"), 9).alias("a"), token_counts.tokens_between(
        F.col("prefixes"), F.lit(0), F.lit(5)).alias("five")).collect()
    size = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    for r in rows:
        text = r.text or ""
        assert r.a.n_tokens == size(text) and size(text[:r.a.fitting_chars]) <= 9
        assert all(size(text[:k]) > 9 for k in range(r.a.fitting_chars + 1, min(len(text), 200) + 1))
        assert r.five == size(text[:5])


def test_empty_table(no_documents):
    assert byte_bpe.decode(byte_bpe.encode(no_documents, RANKS, PATTERN), RANKS).count() == 0
    counted = token_counts.prefix_counts(no_documents, JSON, PATTERN)
    assert counted.select(token_counts.budget(F.col("prefixes"), 9)).count() == 0
