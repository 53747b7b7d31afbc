"""Byte-level BPE encoding and decoding with a rank file.

Texts are split by the vocabulary's pattern. Each piece is encoded by matching
all tokens in it at once and backtracking from the longest ones, with the
compatibility of neighbouring tokens kept in a memo (see ``bpe``); pieces that
come again are taken from a memo too. All memos are bounded.

Defined results:

* null or empty text: no tokens, decoded to no bytes;
* null ids: decoded to no bytes;
* ids that the vocabulary lacks: an error, since no bytes belong to them;
* very long texts and pieces: time and memory linear in the length; texts are coded in
  slices of bounded size, and a text above that size alone;
* repeated rows, empty tables: row by row;
* columns of the input named like an output: kept inside ``row``.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm import bpe
from driftline.llm.tables import packed, release


def public_vocabulary(name: str) -> tuple[str, str]:
    """Path and splitting pattern of an installed public vocabulary."""
    import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


#: Pieces of a memo's generation, of which there are two: about 20 MB each.
PIECES = 100_000


@functools.cache
def piece_encoder(path: str, pattern: str):
    """The splitter, and a memo from a piece to its ids as 32-bit integers."""
    encode = bpe.from_ranks(path).encode
    return bpe.splitter(pattern), bpe.Memo(lambda piece: array("i", encode(piece.encode())).tobytes(), PIECES)


@functools.cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: token for token, i in bpe.read_ranks(path).items()}


def encoder(path: str, pattern: str):
    """Column function: a text to its token ids.

    Marked as not deterministic so that the planner computes ids once where
    several columns use them (it would else repeat the call for each).
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        split, memo = piece_encoder(path, pattern)
        values = [b"".join(map(memo.__getitem__, split(text.as_py() or ""))) for text in texts]
        ends = np.cumsum([0, *(len(v) // 4 for v in values)], dtype=np.int32)
        return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(values), np.int32))

    return encode.asNondeterministic()


def decoder(path: str):
    """Column function: token ids to bytes."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        known = token_bytes(path).__getitem__
        return pa.array([b"".join(map(known, x.values.to_pylist())) if x.is_valid else b""
                         for x in ids], pa.binary())

    return decode


#: Texts are coded in slices of about so many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 21


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of ``texts`` of about ``size`` bytes; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def coder(path: str, pattern: str, digest: bool):
    """Column function: a text to its ids and the bytes they decode to, in one Python worker per task.

    With ``digest`` the decoded bytes do not leave the worker, only their SHA-256 does.
    Besides the batch that Spark sends, a worker holds one slice and the memos.
    """
    name, kind = ("decoded_sha256", T.StringType()) if digest else ("decoded", T.BinaryType())
    coded = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField(name, kind)])

    @F.arrow_udf(coded)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split, memo = piece_encoder(path, pattern)
        known = bpe.from_ranks(path).bytes.__getitem__
        for batch in batches:
            for texts in slices(batch):
                ids, decoded, ends = [], [], [0]
                for text in texts:
                    own = b"".join(map(memo.__getitem__, split(text.as_py() or "")))
                    ids.append(own)
                    back = b"".join(map(known, np.frombuffer(own, np.int32).tolist()))
                    decoded.append(hashlib.sha256(back).hexdigest() if digest else back)
                    ends.append(ends[-1] + len(own) // 4)
                lists = pa.ListArray.from_arrays(np.array(ends, np.int32), np.frombuffer(b"".join(ids), np.int32))
                given = pa.array(decoded, pa.string() if digest else pa.binary())
                yield pa.StructArray.from_arrays([lists, given], ["ids", name])
            del batch
            release()

    return code.asNondeterministic()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``row`` and ``ids``, the tokens of the whole text."""
    return packed(df, text=text).select("row", encoder(path, pattern)("text").alias("ids"))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None,
               digest: bool = False) -> DataFrame:
    """``row`` (all input columns, or those to keep), ``ids``, and ``decoded``, what the ids give back.

    With ``digest``, ``decoded_sha256`` takes the place of ``decoded``.
    """
    coded = packed(df, keep, text=text).select("row", coder(path, pattern, digest)("text").alias("coded"))
    return coded.select("row", "coded.*")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the ids."""
    return encoded.withColumn("decoded", decoder(path)("ids"))


def digests(decoded: DataFrame, *columns: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded bytes, next to columns of ``row``."""
    back = F.col("decoded_sha256") if "decoded_sha256" in decoded.columns else F.sha2("decoded", 256)
    return decoded.select(
        *[F.col(f"row.`{c}`").alias(c) for c in columns],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        back.alias("decoded_sha256"))
