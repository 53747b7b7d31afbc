"""Tiled windows give the same rows as windows over the whole key."""

import numpy as np
import pandas as pd
import pytest
from helpers import SCHEMA, storm
from pandas.testing import assert_frame_equal

from driftline.functions.order_stats import ordered_rank
from driftline.operators import clean as C
from driftline.operators import features as E
from driftline.operators.tiles import with_halo


@pytest.fixture(scope="module")
def hot(spark):
    """One storm with most of the rows, with irregular gaps and missing values."""
    rng = np.random.default_rng(11)
    big = storm(rng, "HOT", "WP", (0, 0), (0.0, 0.3), n=1500, begin="2001-01-01")
    big["LAT"] = 20 * np.sin(np.arange(1500) / 40)
    big = big.drop(index=rng.choice(1500, 60, replace=False))
    big.loc[rng.random(len(big)) < 0.2, "WMO_WIND"] = np.nan
    big.loc[rng.random(len(big)) < 0.1, "STORM_DIR"] = np.nan
    rest = [storm(rng, f"S{i}", "NA", (10, -50), (0.2, -0.3), n=30) for i in range(3)]
    pdf = pd.concat([big, *rest]).drop(columns="SEGMENT_ID")
    schema = ", ".join(c for c in SCHEMA.split(", ") if not c.startswith("SEGMENT_ID"))
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema).persist()


def ordered(df):
    pdf = df.toPandas()
    return pdf[sorted(pdf.columns)].sort_values(["SID", "ISO_TIME"]).reset_index(drop=True)


@pytest.mark.parametrize("hours", [6, 30, 240])
def test_cleaning(hot, hours):
    assert_frame_equal(ordered(C.clean(hot, min_rows=3, tile_hours=hours)), ordered(C.clean(hot, min_rows=3)))


@pytest.mark.parametrize("hours", [12, 240])
def test_features(hot, hours):
    cleaned = C.clean(hot, min_rows=3).persist()
    assert_frame_equal(ordered(E.build_features(cleaned, tile_hours=hours)),
                       ordered(E.build_features(cleaned)), check_exact=False, rtol=1e-12)


def test_no_task_needs_more_than_a_tile(hot):
    rows = with_halo(C.filter_synoptic(hot), 4, 12, 240)
    assert rows.groupBy("SID", "TILE").count().agg({"count": "max"}).first()[0] <= 40 + 16
    assert rows.where("NOT IS_HALO").count() == hot.count()


def test_ordered_rank(spark):
    df = spark.createDataFrame([(f"k{i:05d}", i % 7) for i in range(3000)], "k string, n int").repartition(6)
    got = ordered_rank(df, "n", "k").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(3000))
    assert [(r.n, r.k) for r in got] == sorted((r.n, r.k) for r in got)
