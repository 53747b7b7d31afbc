import math

import numpy as np
import pytest
from helpers import SCHEMA, storm
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.operators import analysis as A
from driftline.operators import clean as C
from driftline.operators import features as E
from driftline.operators import validate as V


@pytest.fixture(scope="module")
def built(tables):
    return {k: E.build_features(tables[k]).orderBy("SID", "ISO_TIME").toPandas()
            for k in ("clean", "gapped", "single", "dateline")}


def test_shape_and_no_infinities(built):
    df = built["clean"]
    assert len(df) == 104 and set(K.FEATURES) <= set(df.columns)
    assert not np.isinf(df[list(K.FEATURES)].astype(float)).any().any()


def test_lags_and_targets_stay_in_their_segment(built):
    for name in ("clean", "gapped"):
        for _, seg in built[name].groupby("SEGMENT_ID"):
            for k in (1, 2, 3):
                assert np.allclose(seg[f"LAT_LAG_{k}"], seg["LAT"].shift(k), equal_nan=True)
            for h in K.HORIZONS:
                assert np.allclose(seg[f"TARGET_LAT_{h}H"], seg["LAT"].shift(-K.steps(h)), equal_nan=True)
                assert seg[f"TARGET_DLON_{h}H"].isna().sum() == min(len(seg), K.steps(h))


def test_heads_are_null_not_zero(built):
    heads = built["gapped"].groupby("SEGMENT_ID").head(1)
    for c in ("DELTA_LAT", "DELTA_LON", "MOVEMENT_DISTANCE", "BEARING", "BEARING_SIN", "VELOCITY_U"):
        assert heads[c].isna().all()
    second = built["gapped"].groupby("SEGMENT_ID").nth(2)
    assert second["BEARING_CHANGE_2"].isna().all()


def test_dateline_steps_are_small(built):
    df = built["dateline"]
    assert df["DELTA_LON"].abs().max() < 3 and df["LON"].diff().abs().max() > 300
    assert df["MOVEMENT_DISTANCE"].max() < 250


def test_straight_track_does_not_turn(built):
    df = built["single"]
    assert df["TURN_MAGNITUDE"].max() < 0.5 and (df["VELOCITY_V"].dropna() > 0).all()


def test_rolling_means_need_full_windows(built):
    for _, seg in built["gapped"].groupby("SEGMENT_ID"):
        want = seg["DELTA_LAT"].rolling(4, min_periods=4).mean()
        assert np.allclose(seg["DELTA_LAT_MEAN_24H"], want, equal_nan=True)


def test_age_is_of_the_storm(built):
    df = built["gapped"]
    assert df[df.SEGMENT_ID == "G_S02"]["STORM_AGE"].min() == 14 * 6


def test_december_is_near_january(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2019-12-15', timestamp_ntz'2020-01-15', "
                   "timestamp_ntz'2019-06-15')) AS ISO_TIME")
    rows = {r.MONTH: (r.MONTH_SIN, r.MONTH_COS) for r in E.temporal_features(df).collect()}
    assert math.dist(rows[12], rows[1]) < math.dist(rows[12], rows[6])


def test_group_selection(tables):
    df = E.build_features(tables["single"])
    assert "ACCEL_LAT" not in E.feature_group_select(df, "acceleration").columns
    with pytest.raises(ValueError):
        E.feature_group_select(df, "nonsense")


def test_validation_passes_and_finds_damage(tables):
    good = E.build_features(tables["gapped"].unionByName(tables["clean"]))
    levels = {r.check: r.level for r in V.findings(good).collect()}
    assert "error" not in levels.values()
    bad = good.withColumns({
        "LAT_LAG_2": F.coalesce("LAT_LAG_2", F.lit(1.0)),
        "TARGET_DLAT_24H": F.col("TARGET_DLAT_24H") + 0.5,
        "WMO_PRES": F.when(F.col("SID") == "A", 3.0).otherwise(F.col("WMO_PRES")),
        "VELOCITY_U": F.lit(float("inf"))})
    bad = bad.unionByName(bad.limit(1))
    found = {r.check: r.level for r in V.findings(bad).collect()}
    for check in ("duplicates", "lag_LAT_LAG_2", "target_24h", "range_WMO_PRES", "infinite_VELOCITY_U"):
        assert found[check] == "error", check
    with pytest.raises(ValueError, match="duplicates"):
        V.validate(bad)
    gap = {r.check: r.level for r in V.findings(good.drop("SEGMENT_ID")).collect()}
    assert gap["group_key"] == "warn" and gap["spacing"] == "error"


def test_validation_of_one_long_segment_by_tiles(spark, tables):
    """Tiles of a day give what one window over the whole segment gives, damage at their edges included."""
    long = E.build_features(C.clean(spark.createDataFrame(
        storm(np.random.default_rng(3), "L", "WP", (12, 150), (0.001, 0.001), n=400), SCHEMA).drop("SEGMENT_ID")))
    both = long.unionByName(E.build_features(tables["gapped"]), allowMissingColumns=True)
    hour = F.dayofyear("ISO_TIME") * 24 + F.hour("ISO_TIME")
    bad = both.withColumns({
        "LAT_LAG_3": F.when(hour % 42 == 0, F.lit(None)).when(hour % 54 == 0, 1.0).otherwise(F.col("LAT_LAG_3")),
        "TARGET_DLON_72H": F.when(hour % 66 != 0, F.col("TARGET_DLON_72H"))}).where(hour % 78 != 0)
    whole, tiled = ({(r.check, r.level, r.message, r.n) for r in V.findings(bad, tile_hours=h).collect()}
                    for h in (24 * 10000, 24))
    assert whole == tiled
    n = {check: n for check, _, _, n in whole}
    assert n["spacing"] > 0 and n["lag_LAT_LAG_3"] > 0 and n["missing_LAT_LAG_3"] > 0 and n["missing_TARGET_DLON_72H"] > 0


def test_leakage_is_the_plain_correlation(tables):
    df = E.build_features(tables["clean"]).withColumns({
        "VELOCITY_U": F.col("TARGET_DLAT_72H") * 2 - 1, "WMO_PRES": F.lit(1000.0)})
    found = {(r.feature, r.target): r.r for r in V.check_leakage(df).collect()}
    rows = df.select(*K.FEATURES, *K.target_columns(72)).na.drop().toPandas().astype(float)
    for (x, y), r in found.items():
        want = np.corrcoef(rows[x], rows[y])[0, 1] if rows[x].std() else None
        assert (r is None) if want is None else r == pytest.approx(want, abs=1e-9), (x, y)
    assert found["VELOCITY_U", "TARGET_DLAT_72H"] == pytest.approx(1.0)
    assert V.check_leakage(df.where("false")).count() == 0


def test_missing_column_is_an_error(tables):
    df = E.build_features(tables["single"]).drop("BEARING_SIN")
    assert {r.check: r.n for r in V.check_schema(df).collect()}["schema_features"] == 1


def test_antimeridian_parts(tables):
    got = A.split_at_antimeridian(tables["dateline"]).groupBy("PART").agg(
        F.min("LON").alias("lo"), F.max("LON").alias("hi")).collect()
    assert len(got) == 2 and all(r.hi - r.lo < 180 for r in got)


def requests(spark):
    five = [(13.8, 83.4, 50.0, 990.0), (14.1, 83.9, 53.0, 988.0), (14.4, 84.4, 55.0, 985.0),
            (14.7, 84.8, 58.0, 982.0), (15.0, 85.2, 60.0, 980.0)]
    bad = lambda i, v: [tuple(v if j == i else x for j, x in enumerate(five[0]))]
    rows = [("ok", five, 24, "random_forest"), ("short", five[:1], 24, "random_forest"),
            ("lat", bad(0, 100.0), 24, "xgboost"), ("lon", bad(1, 200.0), 24, "xgboost"),
            ("wind", bad(2, -10.0), 24, "xgboost"), ("pres", bad(3, -5.0), 24, "xgboost"),
            ("missing", bad(3, None), 24, "xgboost"), ("horizon", five, 7, "xgboost"),
            ("empty", [], 24, "xgboost"), ("model", five, 24, "other"), ("null", None, 24, "xgboost")]
    return spark.createDataFrame(
        rows, "request_id string, observations array<struct<latitude:double,longitude:double,"
              "wind_speed:double,pressure:double>>, forecast_horizon int, model string")


def test_requests(spark):
    got = {r.request_id: r for r in V.validate_requests(requests(spark)).collect()}
    assert [k for k, r in got.items() if r.accepted] == ["ok", "short"]
    assert got["short"].short_history and not got["ok"].short_history
    assert got["horizon"].reasons == "forecast_horizon" and got["pres"].reasons == "pressure"
    live = {r.request_id: r for r in E.live_features(
        requests(spark).where("request_id IN ('ok', 'short')"),
        F.lit("2024-09-01").cast("timestamp_ntz")).collect()}
    assert live["ok"].LAT_LAG_3 == 14.1 and live["ok"].DELTA_LAT_MEAN_24H == pytest.approx(0.3)
    assert live["ok"].STORM_AGE == 24 and live["ok"].BASIN_CODE is None
    assert live["short"].LAT == 13.8 and live["short"].DELTA_LAT is None
