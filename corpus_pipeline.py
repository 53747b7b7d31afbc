"""The corpus pipeline: documents in, encoded documents out, one operator per stage.

Every stage takes all that its predecessor kept and returns the columns of
documents, except the last one. Rows are told apart by nothing but their
content, so repeated rows go the same way; near-duplicate removal keeps one of
them. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import byte_bpe, host_rules, mixing, quality, weighted_minhash
from driftline.llm.tables import read, unpacked, written

#: Trained models and the classes of near duplicates have no form in SQL.
ORACLE_SQL = None
RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    return unpacked(host_rules.host_rules(docs).filter("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents ranked above the cut by a model learned from the labelled documents."""
    weights, cut = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return unpacked(quality.score(docs, weights, cut).filter("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return weighted_minhash.first_of_each(weighted_minhash.near_duplicates(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixture(mixing.mix(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and digests of the ids and of what they decode to."""
    path, pattern = byte_bpe.public_vocabulary(RANKS)
    decoded = byte_bpe.round_trip(docs, path, pattern, keep=["doc_id", "source"], digest=True)
    return byte_bpe.digests(decoded.withColumn("row", F.struct("row.doc_id", "row.source", "ids")),
                            "doc_id", "source", "ids")


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier),
          ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
