"""Classifiers by held-out accuracy and on odd input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import quality, toxicity
from driftline.llm.samples import fold
from driftline.llm.tables import read

SF = "/root/testdata/sf0.01"


def held_out(spark, result, label):
    return result.join(read(spark, SF, "labels").select("doc_id", F.col(label).alias("label")), "doc_id").where(
        (fold(F.col("doc_id")) == 2) & F.col("label").isNotNull()).toPandas()


def auc(scores, labels):
    good, bad = scores[labels == 1], scores[labels == 0]
    return np.mean([(good > x).mean() + 0.5 * (good == x).mean() for x in bad])


def test_quality_ranks_held_out_documents(spark):
    docs = read(spark, SF, "documents")
    weights, cut = quality.fit(docs, read(spark, SF, "labels"))
    found = held_out(spark, quality.score(docs, weights, cut).select("row.doc_id", "score", "predicted"), "quality")
    assert auc(found.score.to_numpy(), found.label.to_numpy()) > 0.97
    assert found.predicted[found.label == 1].mean() > 0.97  # good documents stay
    assert found.predicted[found.label == 0].mean() < 0.2


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs = read(spark, SF, "documents")
    mixed = F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))  # classes that overlap
    labels = read(spark, SF, "labels").select("doc_id", mixed.cast("int").alias("quality"))
    weights, cut = quality.fit(docs, labels)
    flipped = labels.withColumn("quality", F.when(fold(F.col("doc_id")) == 2, 1).otherwise(F.col("quality")))
    absent = spark.range(10**9, 10**9 + 5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    again, moved = quality.fit(docs, flipped.unionByName(absent))
    assert again == pytest.approx(weights, abs=1e-9) and moved == pytest.approx(cut, abs=1e-9)


def test_quality_on_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (4, 0), (7, None), (None, 1), (99, 1)],
                                   "doc_id long, quality int")
    for hold_out in (True, False):
        weights, cut = quality.fit(odd_documents, labels, hold_out=hold_out)
        rows = quality.score(odd_documents, weights, cut).select("row.doc_id", "score", "predicted").collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    weights, cut = quality.fit(no_documents, labels.limit(0))
    rows = quality.score(odd_documents, weights, cut).select("score").distinct().collect()
    assert [r.score for r in rows] == [0.7]  # nothing was learned
    assert quality.score(no_documents, weights, cut).count() == 0


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    """More documents than any sample of 4,000 a class; of rows that share an id the smallest text counts."""
    n = 4500
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 2 == 0, F.concat(F.lit("plain words "), "id")).otherwise(F.concat(F.lit("## !! "), "id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    seen, pairs_of = [], quality.preference_pairs
    monkeypatch.setattr(quality, "preference_pairs", lambda known: (seen.append(known), pairs_of(known))[1])
    twice = docs.unionByName(docs.where("doc_id < 10").withColumn("text", F.lit("zzz")))
    weights, cut = quality.fit(twice, labels, hold_out=False)
    assert seen[0].count() == seen[0].select("doc_id").distinct().count() == 2 * n
    assert pairs_of(seen[0]).count() == quality.PAIRS * n
    scores = quality.score(docs, weights, cut).select("row.doc_id", "predicted").toPandas()
    assert ((scores.doc_id % 2 == 0) == (scores.predicted == 1)).all()
    strengths = sorted(np.dot(weights, r.features) for r in seen[0].select("features").collect())
    assert cut == pytest.approx((strengths[n - 1] + strengths[n]) / 2, abs=1e-9)


def test_pairs_prefer_the_good_document(spark):
    sample = spark.createDataFrame([(i, i % 2, [float(i % 2), float(i)]) for i in range(40)],
                                   "doc_id long, label int, features array<double>")
    pairs = quality.preference_pairs(sample).collect()
    assert len(pairs) == 20 * quality.PAIRS
    assert all(p.features[0] == (1.0 if p.label == 1.0 else -1.0) for p in pairs)
    assert {p.label for p in pairs} == {0.0, 1.0}
    assert quality.preference_pairs(sample.where("label = 1")) is None


def test_toxicity_on_held_out_documents(spark):
    docs = read(spark, SF, "documents")
    weights, thresholds = toxicity.fit(docs, read(spark, SF, "labels"), hold_out=True)
    assert thresholds == sorted(thresholds)
    found = held_out(spark, toxicity.score(docs, weights, thresholds).select("row.doc_id", "severity", "toxic"), "toxic")
    assert auc(found.severity.to_numpy(), found.label.to_numpy()) > 0.9
    assert found.toxic[found.label == 0].mean() < 0.05
    assert found.toxic[found.label == 1].mean() > 0.7


def test_toxicity_learns_only_from_agreed_labels_of_documents(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels").select("doc_id", "toxic")
    given = toxicity.fit(docs, labels, hold_out=True)
    absent = spark.range(10**9, 10**9 + 5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 2, 1).otherwise(F.col("toxic")))
    weights, thresholds = toxicity.fit(docs, flipped.unionByName(absent), hold_out=True)
    assert thresholds == pytest.approx(given[1], abs=1e-9) and weights == pytest.approx(given[0], abs=1e-9)


def test_severity_equals_a_plain_model(spark):
    """Words and word beginnings counted and weighed without the operator's own feature code."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    weights, thresholds = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, weights, thresholds).select("row.text", "severity").limit(60).collect():
        words = re.findall(r"\w+", (r.text or "").lower())
        times = lambda f: sum(w.startswith(f[1:]) if f[0] == "^" else w == f for w in words)
        eta = sum(w * np.log1p(times(f)) for f, w in weights.items())
        want = sum(1 / (1 + np.exp(np.clip(t - eta, -40, 40))) for t in thresholds)
        assert r.severity == pytest.approx(want, abs=1e-6)


def test_toxicity_on_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (4, 0), (7, None), (None, 1), (99, 1)],
                                   "doc_id long, toxic int")
    for table in (labels, labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.fit(odd_documents, table)
        rows = toxicity.score(odd_documents, *model).select("severity", "grade", "toxic").collect()
        assert len(rows) == 9 and all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in rows)
        assert toxicity.score(no_documents, *model).count() == 0


def test_cumulative_link_recovers_shared_weights():
    rng = np.random.default_rng(1)
    n, true, cuts = 6000, np.array([2.0, -1.0, 0.5]), np.array([0.5, 2.5])
    x = rng.integers(0, 3, (n, 3)).astype(float)
    latent = x @ true + rng.logistic(size=n)
    grades = (latent[:, None] > cuts).sum(1)
    row_of, at = np.nonzero(x)
    w, theta = toxicity.fit_cumulative(row_of, at, x[row_of, at], grades, np.full(n, 1 / n), 3, steps=1500)
    assert w == pytest.approx(true, abs=0.2) and theta == pytest.approx(cuts, abs=0.25)


def test_severity_is_the_sum_over_thresholds(spark):
    df = spark.createDataFrame([(1, "bad bad word")], "doc_id long, text string")
    row = toxicity.score(df, {"bad": 2.0}, [1.0, 3.0]).first()
    eta = 2.0 * np.log1p(2)
    above = [1 / (1 + np.exp(t - eta)) for t in (1.0, 3.0)]
    assert row.severity == pytest.approx(sum(above), abs=1e-8) and row.p_toxic == pytest.approx(above[0], abs=1e-8)
