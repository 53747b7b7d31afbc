"""Toxicity by cumulative-link ordinal regression.

Severity has ordered grades 0 (none), 1 and 2. One weight per text feature is
shared by all thresholds: P(grade <= k) is the logistic function of threshold
k less the weighted sum of the features. The expected severity is the sum of
P(grade > k) over the thresholds.

Features are the words of a text and the beginnings of its words, as
log(1 + count); a bounded number of them is chosen by how well they tell toxic
from other labelled documents. Labels say only whether a document is toxic, so
toxic documents are graded by the share of their words that are evidence:
grade 2 from the median on, else 1.

Defined results:

* null or empty text: no features, so the severity of a text without evidence;
* labels that are null, contradict each other or have no document: not learned from;
* only one class of labels: no features, severity from the thresholds alone;
* very long texts: linear in their length; repeated rows, empty tables: row by row;
* columns of the input named like an output: kept inside ``row``.

The fit reads at most ``MAX_PER_CLASS`` labelled documents of each class,
keeps ``MAX_FEATURES`` features and weighs classes by their share of all
labels; scoring covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.samples import labelled_sample, labelled_share
from driftline.llm.tables import packed, written

MAX_PER_CLASS = 4000
MAX_FEATURES = 4096
PREFIXES = (4, 5, 6, 8)
MIN_DOCS = 3
GRADES = 3
RIDGE = 1e-4
TOKEN = re.compile(r"\w+")


def text_features(text: str) -> Counter:
    """Counts of words (as they are, lower case) and of beginnings of words (marked by ^)."""
    words = Counter(TOKEN.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        for size in PREFIXES:
            if len(word) >= size:
                out["^" + word[:size]] += n
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def distinct_features(texts: pa.Array) -> pa.Array:
    return pa.array([list(text_features(t.as_py() or "")) for t in texts], pa.list_(pa.string()))


def choose_features(sample: DataFrame, max_features: int = MAX_FEATURES) -> list[str]:
    """The features whose log odds between the classes are largest against their error."""
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []
    counts = sample.select("label", F.explode(distinct_features("text")).alias("feature")).groupBy("feature").agg(
        F.sum("label").alias("toxic"), F.count("*").alias("docs")).filter(F.col("docs") >= MIN_DOCS)
    a, b = F.col("toxic") + 0.5, F.col("docs") - F.col("toxic") + 0.5
    odds = F.log(a / (n[1] + 1 - a)) - F.log(b / (n[0] + 1 - b))
    error = F.sqrt(1 / a + 1 / b)
    ranked = counts.select("feature", F.abs(odds / error).alias("z")).filter("z > 2.5").orderBy(
        F.desc("z"), "feature").limit(max_features)
    return [r.feature for r in ranked.collect()]


def vectors(sample: DataFrame, features: list[str]) -> list:
    """(label, n_words, at, counts) of each sampled document on the chosen features."""
    index = {f: i for i, f in enumerate(features)}
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())),
                         T.StructField("count", T.ArrayType(T.IntegerType()))])

    @F.arrow_udf(kind)
    def select(texts: pa.Array) -> pa.Array:
        n, at, count = [], [], []
        for t in texts:
            text = t.as_py() or ""
            found = text_features(text)
            hits = sorted((index[f], found[f]) for f in found.keys() & index.keys())
            n.append(len(text.split()))
            at.append([i for i, _ in hits])
            count.append([c for _, c in hits])
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))],
            ["n", "at", "count"])

    return sample.select("doc_id", "label", select("text").alias("v")).select("doc_id", "label", "v.*").collect()


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_cumulative(row_of, at, value, grades, weight, n_features: int, steps: int = 400, rate: float = 0.1):
    """Shared weights and ordered thresholds by full gradient steps on the weighted likelihood.

    Thresholds are the first one and logarithms of the gaps, so they stay in order.
    """
    n = len(grades)
    w, base, gaps = np.zeros(n_features), np.zeros(1), np.zeros(GRADES - 2)
    moments = [np.zeros_like(p) for p in (w, base, gaps)], [np.zeros_like(p) for p in (w, base, gaps)]
    for step in range(1, steps + 1):
        eta = np.bincount(row_of, w[at] * value, minlength=n)
        theta = np.concatenate([[-np.inf], base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]), [np.inf]])
        high, low = sigmoid(theta[grades + 1] - eta), sigmoid(theta[grades] - eta)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = weight * high * (1 - high) / p, weight * low * (1 - low) / p
        g_eta = d_high - d_low  # of the negative log likelihood
        g_theta = np.array([d_low[grades == k + 1].sum() - d_high[grades == k].sum() for k in range(GRADES - 1)])
        tail = np.cumsum(g_theta[::-1])[::-1]
        grads = (np.bincount(at, g_eta[row_of] * value, minlength=n_features) + RIDGE * w,
                 tail[:1], tail[1:] * np.exp(gaps))
        for k, (p_, g) in enumerate(zip((w, base, gaps), grads)):
            moments[0][k][:] = 0.9 * moments[0][k] + 0.1 * g
            moments[1][k][:] = 0.999 * moments[1][k] + 0.001 * g * g
            p_ -= rate * (moments[0][k] / (1 - 0.9 ** step)) / (np.sqrt(moments[1][k] / (1 - 0.999 ** step)) + 1e-9)
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_per_class: int = MAX_PER_CLASS,
        hold_out: bool = False) -> tuple[dict[str, float], list[float]]:
    """Weight by feature, and the thresholds."""
    sample = labelled_sample(docs, labels, label, max_per_class, hold_out)
    features = choose_features(sample)
    share = labelled_share(docs, labels, label, hold_out) or 0.0
    rows = vectors(sample, features)
    classes = np.array([r.label for r in rows], np.int64)
    if not features:
        return {}, [float(np.log((1.01 - share) / (share + 0.01))), 5.0]
    row_of = np.repeat(np.arange(len(rows)), [len(r.at) for r in rows])
    at = np.array([i for r in rows for i in r.at], np.int64)
    counts = np.array([c for r in rows for c in r["count"]], float)
    positive = np.bincount(at, classes[row_of], minlength=len(features)) / np.maximum(
        np.bincount(at, minlength=len(features)), 1) > 0.5
    evidence = np.bincount(row_of, counts * positive[at], minlength=len(rows)) / np.maximum([r.n for r in rows], 1)
    grades = np.where(classes == 0, 0, 1 + (evidence >= np.median(evidence[classes == 1])))
    weight = np.where(classes == 1, share / max((classes == 1).sum(), 1), (1 - share) / max((classes == 0).sum(), 1))
    w, theta = fit_cumulative(row_of, at, np.log1p(counts), grades, weight, len(features))
    return dict(zip(features, w.tolist())), theta.tolist()


def score(df: DataFrame, weights: dict[str, float], thresholds: list[float], text: str = "text") -> DataFrame:
    """``row``, ``p_toxic``, expected ``severity``, most likely ``grade`` and ``toxic``."""
    known = weights.keys()

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            found = text_features(t.as_py() or "")
            out.append(float(sum(weights[f] * np.log1p(found[f]) for f in sorted(found.keys() & known))))
        return pa.array(out, pa.float64())

    above = [1 / (1 + F.exp(F.least(F.lit(40.0), F.greatest(F.lit(-40.0), F.lit(t) - F.col("eta")))))
             for t in thresholds]
    out = packed(df, text=text).select("row", evidence("text").alias("eta"))
    chances = [1 - above[0], *[a - b for a, b in zip(above, above[1:])], above[-1]]
    best = F.greatest(*chances)
    grade = F.coalesce(*[F.when(c == best, F.lit(k)) for k, c in enumerate(chances)])
    return out.select("row", F.round(above[0], 9).alias("p_toxic"), F.round(sum(above[1:], above[0]), 9).alias("severity"),
                      grade.cast("int").alias("grade"), (above[0] >= 0.5).alias("toxic"))
