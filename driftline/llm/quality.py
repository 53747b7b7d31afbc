"""Quality by Bradley-Terry ranking.

A document has a strength, linear in features of its text; the chance that one
document is better than another is the logistic function of the difference of
their strengths. Weights are learned from pairs of a good and a bad labelled
document, by logistic regression on feature differences without intercept.
The cut between good and bad is the quantile of the training strengths at the
share of bad labels; scores are shifted so that the cut is at ``CUT_SCORE``.

Features are shares of the text's bytes, words and lines, so they need no
vocabulary. Labels, language, source and id are no inputs.

Defined results:

* null or empty text: all features 0, scored like any other;
* labels that are null, contradict each other or have no document: not learned from;
* only one class of labels: every document has the score ``CUT_SCORE``;
* very long texts: linear in their length; repeated rows, empty tables: row by row;
* columns of the input named like an output: kept inside ``row``.

The fit reads every document whose label may be learned from, with ``PAIRS``
opponents for each; the cut is an exact quantile over all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.order_stats import exact_percentiles, ordered_rank
from driftline.llm.samples import fold, labelled_documents
from driftline.llm.tables import packed, written

PAIRS = 4
CUT_SCORE = 0.7
SCALE = 4.0
PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
BASE = 16


def text_features(text: str) -> np.ndarray:
    """Shares that describe how regular a text is; their number is fixed."""
    out = np.zeros(BASE + len(PUNCTUATION))
    words = text.split()
    n = len(words)
    if not n:
        return out
    data = text.encode()
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    same = sum(map(str.__eq__, words, words[1:]))
    out[0] = math.log1p(n) / 10
    out[1] = len(distinct) / n
    out[2] = same / n
    out[3] = sizes.mean() / 10
    out[4] = sizes.std() / 10
    out[5] = math.log1p(sizes.max()) / 10
    out[6] = (sizes <= 1).mean()
    out[7] = len(lines) / n
    out[8] = 1 - len(set(lines)) / len(lines)
    out[9] = bytes_of[48:58].sum()
    out[10] = bytes_of[65:91].sum()
    out[11] = bytes_of[97:123].sum()
    out[12] = bytes_of[128:].sum()
    out[13] = bytes_of[PUNCTUATION].sum()
    out[14] = (bytes_of[PUNCTUATION] > 0).sum() / len(PUNCTUATION)
    out[15] = float(n < 20)
    out[BASE:] = np.sqrt(bytes_of[PUNCTUATION])
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features(texts: pa.Array) -> pa.Array:
    rows = [text_features(t.as_py() or "") for t in texts]
    width = BASE + len(PUNCTUATION)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), flat)


def preference_pairs(sample: DataFrame) -> DataFrame:
    """(features, label) of pairs: the good less the bad document, every second one mirrored.

    ``sample`` has (doc_id, label, features). Each document of the larger class
    meets ``PAIRS`` of the other, at steps through their hash order.
    """
    hashed = sample.withColumn("_hash", F.xxhash64(F.col("doc_id").cast("string")))
    ranked = written(ordered_rank(hashed, "label", "_hash", "doc_id"), "ranked")
    n = {r.label: r.n for r in ranked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = n.get(1, 0), n.get(0, 0)
    most = max(good, bad)
    meet = F.explode(F.sequence(F.lit(0), F.lit(PAIRS - 1)))
    if not good or not bad:
        return None
    rounds = ranked.sparkSession.range(most).select("id", meet.alias("k"))
    rounds = rounds.select(
        (F.col("id") % good).alias("good"), ((F.col("id") + F.col("k") * (most // PAIRS + 1)) % bad).alias("bad"),
        ((F.col("id") + F.col("k")) % 2).alias("mirror"))
    side = lambda label, name: ranked.filter(F.col("label") == label).select(
        (F.col("rank") - label * bad).alias(name), F.col("features").alias(f"x_{name}"))  # bad ones come first
    pairs = rounds.join(side(1, "good"), "good").join(side(0, "bad"), "bad")
    sign = F.when(F.col("mirror") == 1, -1.0).otherwise(1.0)
    return pairs.select((F.col("mirror") == 0).cast("double").alias("label"), array_to_vector(
        F.transform(F.arrays_zip("x_good", "x_bad"), lambda z: sign * (z["x_good"] - z["x_bad"]))).alias("features"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", hold_out: bool = True) -> tuple[list[float], float]:
    """Weights of the strength, and the strength at the cut."""
    known = labelled_documents(docs, labels, label, hold_out)
    known = written(known.select("doc_id", "label", features("text").alias("features")), "labelled")
    pairs = preference_pairs(known)
    if pairs is None:
        return [0.0] * (BASE + len(PUNCTUATION)), 0.0
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=40).fit(written(pairs, "pairs"))
    weights = np.array(model.coefficients.toArray())

    @F.arrow_udf("double")
    def strength(rows: pa.Array) -> pa.Array:
        return pa.array([float(np.dot(weights, r)) for r in rows.flatten().to_numpy().reshape(len(rows), -1)], pa.float64())

    strengths = written(known.select("label", strength("features").alias("strength")), "strengths")
    n, bad = strengths.agg(F.count("*"), F.count_if(F.col("label") == 0)).first()
    # between the last of as many as are bad, and the next
    at = (min(max(bad, 1), n - 1) - 0.5) / (n - 1)
    cut = exact_percentiles(strengths, [], "strength", {"cut": at}).first()["cut"]
    return weights.tolist(), float(cut)


def score(df: DataFrame, weights: list[float], cut: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, ``held_out``, ``score`` between 0 and 1, and ``predicted``."""
    w, shift = np.array(weights), math.log(CUT_SCORE / (1 - CUT_SCORE))

    @F.arrow_udf("double")
    def strength(texts: pa.Array) -> pa.Array:
        return pa.array([float(np.dot(w, text_features(t.as_py() or ""))) for t in texts], pa.float64())

    out = packed(df, doc_id=doc_id, text=text).select(
        "row", (fold(F.col("doc_id")) == 2).alias("held_out"), strength("text").alias("strength"))
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (F.col("strength") - cut) / SCALE + shift))
    value = F.round(1 / (1 + F.exp(-z)), 9)
    return out.select("row", "held_out", value.alias("score"), (value >= CUT_SCORE).cast("int").alias("predicted"))
