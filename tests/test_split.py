import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.operators import split as S


@pytest.fixture(scope="module")
def seasons(spark):
    rows = [(f"S{i}", 1990 + i % 34) for i in range(340)]
    return spark.createDataFrame(rows + [("S24", 2020)], "SID string, SEASON int")


def counts(df):
    return {r.split: r.n for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}


def test_season_split(seasons):
    got = S.season_split(seasons)
    assert got.count() == 340  # a storm is never divided
    assert counts(got) == {"train": 250, "val": 40, "test": 50}
    assert S.validate_split(seasons, got).where("n > 0").count() == 0


def test_storm_split_has_exact_sizes(seasons):
    got = S.storm_split(seasons)
    assert counts(got) == {"train": int(340 * 0.7), "val": 34, "test": 340 - int(340 * 0.7) - 34}
    again = S.storm_split(seasons.repartition(7))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in again.collect()}


def test_problems_are_found(spark, seasons):
    bad = spark.createDataFrame([("S1", "train"), ("S1", "val"), ("S2", "train")], "SID string, split string")
    found = {r.check: r.n for r in S.validate_split(seasons, bad).collect()}
    assert found == {"overlap_train_val": 1, "overlap_train_test": 0, "overlap_val_test": 0,
                     "coverage": 338, "size_train": 0, "size_test": 1}


def test_stored_split_is_reused_or_replaced(spark, seasons, tmp_path):
    path = str(tmp_path / "splits")
    config = K.split_config("season")
    assert S.load_split(spark, path, config) is None
    first = S.resolve_split(seasons, path)
    moved = first.withColumn("split", F.when(F.col("SID") == "S1", "val").otherwise(F.col("split")))
    S.save_split(moved.cache(), path, config)
    assert S.resolve_split(seasons, path).where("SID = 'S1'").first().split == "val"  # still sound: reused
    more = seasons.unionByName(spark.createDataFrame([("NEW", 2001)], "SID string, SEASON int"))
    assert S.resolve_split(more, path).count() == 341  # no longer covers the table: made again
    S.save_split(S.storm_split(seasons), path, K.split_config("storm"))
    assert S.stored_split_counts(spark, path).select("fingerprint").distinct().count() == 2


def test_fingerprint_is_short_and_stable():
    a, b = K.split_config("season"), dict(reversed(list(K.split_config("season").items())))
    assert K.fingerprint(a) == K.fingerprint(b) and len(K.fingerprint(a)) == 8
    assert K.fingerprint(a) != K.fingerprint(K.split_config("storm"))


def test_subsample_keeps_other_partitions(spark):
    pdf = pd.DataFrame({"SID": [f"S{i}" for i in range(2000)], "split": ["train", "val"] * 1000,
                        "ISO_TIME": pd.Timestamp("2000-01-01")})
    got = counts(S.subsample_train(spark.createDataFrame(pdf), 0.3))
    assert got["val"] == 1000 and 230 < got["train"] < 370
