"""Labelled documents to fit a classifier on: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.joins import broadcast_if_small
from driftline.llm.tables import written


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def agreed_labels(labels: DataFrame, label: str, hold_out: bool) -> DataFrame:
    """(doc_id, label) once for each id whose labels agree on 0 or 1, without the held-out fold if asked."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        "doc_id is not null and label in (0, 1)")
    if hold_out:
        known = known.filter(fold(F.col("doc_id")) != 2)
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter(
        "label = most").drop("most")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int,
                    hold_out: bool) -> DataFrame:
    """(doc_id, label, text) of at most ``max_per_class`` documents of each class 0 and 1.

    Ids are chosen by hash order among those whose labels agree, so the sample
    does not depend on the partitioning. The chosen ids, a table of fixed
    size, are broadcast to one scan of the documents. Of rows that share an id
    the smallest text is taken; ids without a document give no row.
    """
    agreed = agreed_labels(labels, label, hold_out)
    order = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id"]
    chosen = agreed.filter("label = 0").orderBy(*order).limit(max_per_class).unionByName(
        agreed.filter("label = 1").orderBy(*order).limit(max_per_class))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(written(chosen, "chosen")), "doc_id")
    return written(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, hold_out: bool) -> DataFrame:
    """(doc_id, label, text) of every document whose labels agree on 0 or 1.

    Of rows that share an id the smallest text is taken; ids without a document give no
    row. Only the texts of ids that repeat are shuffled.
    """
    agreed = broadcast_if_small(written(agreed_labels(labels, label, hold_out), "agreed"))
    repeated = written(docs.select("doc_id").join(agreed, "doc_id").groupBy("doc_id").count().where("count > 1").select(
        "doc_id"), "repeated")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(agreed, "doc_id").select(
        "doc_id", "label", "text")
    if repeated.isEmpty():
        return found
    several = broadcast_if_small(repeated)
    smallest = found.join(several, "doc_id", "left_semi").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.join(several, "doc_id", "left_anti").unionByName(smallest)


def labelled_share(docs: DataFrame, labels: DataFrame, label: str, hold_out: bool) -> float | None:
    """Share of label 1 among all documents whose labels may be learned from; null if there are none."""
    agreed = broadcast_if_small(written(agreed_labels(labels, label, hold_out), "agreed"))
    used = docs.select("doc_id").join(agreed, "doc_id").distinct()
    return used.agg(F.avg(F.col("label").cast("double"))).first()[0]
