"""The stage tables of the registered queries, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline import constants as K
from driftline.operators import baselines as B
from driftline.operators import clean as C
from driftline.operators import features as E
from driftline.operators import metrics as M
from driftline.operators import split as S
from driftline.plans.stages import stage
from driftline.sources.synthetic import raw_tracks


def with_basin(df):
    """Blank basins are the North Atlantic (see ``recover_basin``)."""
    return df.withColumn("BASIN", F.coalesce("BASIN", F.lit("NA")))


def clean_table(spark, sf):
    return stage(spark, sf, "clean", lambda: C.clean(with_basin(raw_tracks(spark, sf))))


def feature_table(spark, sf):
    return stage(spark, sf, "features", lambda: E.build_features(clean_table(spark, sf)))


def split_table(spark, sf):
    """Season split of the storms that have complete rows at the shortest horizon."""
    return stage(spark, sf, "split", lambda: S.season_split(
        S.prepare_training(feature_table(spark, sf), min(K.HORIZONS))))


def split_forecast_rows(spark, sf, keep=()):
    """``forecast_rows`` with their partition. It is joined before a row becomes one a horizon:
    where the list is too large to broadcast, each observation is shuffled once, not five times."""
    out = S.forecast_rows(S.assign_split_rows(feature_table(spark, sf), split_table(spark, sf)), keep=(*keep, "split"))
    return out.select(*[c for c in out.columns if c != "split"], "split")


def forecast_row_table(spark, sf):
    return stage(spark, sf, "forecast_rows", lambda: split_forecast_rows(spark, sf))


def baseline_table(spark, sf):
    """Scored predictions of the three closed-form baselines, all horizons."""
    return stage(spark, sf, "baselines", lambda: M.score(
        B.run_baselines(forecast_row_table(spark, sf), names=B.CLOSED_FORM)).withColumn("LEAD_HOURS", F.col("horizon")),
        partition_by=("LEAD_HOURS",))


def all_baseline_table(spark, sf):
    """Scored predictions of all four baselines, all horizons; the regression reads all features."""
    rows = split_forecast_rows(spark, sf, K.FEATURES)
    return stage(spark, sf, "all_baselines", lambda: M.score(B.run_baselines(rows)).drop(
        *[c for c in K.FEATURES if c not in (*K.META_COLUMNS, "DELTA_LAT", "DELTA_LON", "INTENSITY_CATEGORY")]))
