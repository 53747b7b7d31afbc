"""Registered queries of the scalar functions and the feature operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions import geo
from driftline.operators import features as E
from driftline.plans.registry import query, rounded
from driftline.plans.sql import (bearing, clamp_lat, columns, diff, hav, r, with_clean,
                                 with_features, with_raw, wrap)
from driftline.plans.tables import clean_table, feature_table
from driftline.sources.synthetic import raw_tracks

KEYS = ("SID", "SEGMENT_ID", "ISO_TIME")
ABS24 = K.target_columns(24, "absolute")
MOVE24 = ("LAT", "LON", *ABS24)
TARGETS = tuple(c for h in K.HORIZONS for mode in ("absolute", "displacement")
                for c in K.target_columns(h, mode))
CLEAN_COLUMNS = {*K.REQUIRED_COLUMNS, "SEGMENT_ID"}


def scalar(spark, sf, **columns_):
    df = feature_table(spark, sf)
    return rounded(df.select("SID", "ISO_TIME", *[c.alias(n) for n, c in columns_.items()]))


def scalar_sql(**exprs):
    plain = ("category", "code")
    return with_features("SELECT SID, ISO_TIME, " + ", ".join(
        f"{e} AS {n}" if n in plain else f"{r(e)} AS {n}" for n, e in exprs.items())
        + " FROM features")


# ------------------------------------------------------------ scalar functions
@query("haversine_km", scalar_sql(km=hav(*MOVE24)))
def _(spark, sf):
    return scalar(spark, sf, km=geo.haversine_km(*MOVE24))


@query("bearing_deg", scalar_sql(deg=bearing(*MOVE24), deg_or_zero=bearing(*MOVE24, null=False)))
def _(spark, sf):
    return scalar(spark, sf, deg=geo.bearing_deg(*MOVE24),
                  deg_or_zero=geo.bearing_deg(*MOVE24, undefined_as_null=False))


@query("angular_difference", scalar_sql(turn=diff("STORM_DIR", "BEARING")))
def _(spark, sf):
    return scalar(spark, sf, turn=geo.angular_difference("STORM_DIR", "BEARING"))


@query("wrapped_degree_diff", scalar_sql(dlon=diff(ABS24[1], "LON")))
def _(spark, sf):
    return scalar(spark, sf, dlon=geo.angular_difference(ABS24[1], "LON"))


@query("encode_direction", scalar_sql(dir_sin="sin(radians(STORM_DIR))",
                                      dir_cos="cos(radians(STORM_DIR))"))
def _(spark, sf):
    return scalar(spark, sf, dir_sin=geo.direction_sin("STORM_DIR"),
                  dir_cos=geo.direction_cos("STORM_DIR"))


# Twelve steps ahead with a large factor, so that both limits are reached.
@query("offset_position", scalar_sql(new_lat=clamp_lat("(LAT + 60 * DELTA_LAT)"),
                                     new_lon=wrap("LON + 60 * DELTA_LON")))
def _(spark, sf):
    lat, lon = geo.offset_position("LAT", "LON", F.col("DELTA_LAT") * 60,
                                   F.col("DELTA_LON") * 60)
    return scalar(spark, sf, new_lat=lat, new_lon=lon)


_PRED = (clamp_lat("(LAT + 4 * DELTA_LAT)"), wrap("LON + 4 * DELTA_LON"))
_ERR = hav(*ABS24, *_PRED)
_THETA = f"radians({diff(bearing(*ABS24, *_PRED, null=False), bearing(*MOVE24))})"


@query("along_cross_track", scalar_sql(along=f"{_ERR} * cos({_THETA})", cross=f"{_ERR} * sin({_THETA})",
                                       total=_ERR, motion=bearing(*MOVE24)))
def _(spark, sf):
    pred = geo.offset_position("LAT", "LON", F.col("DELTA_LAT") * 4, F.col("DELTA_LON") * 4)
    parts = geo.along_cross_track(*MOVE24, *pred)
    return scalar(spark, sf, along=parts["along_track_km"], cross=parts["cross_track_km"],
                  total=parts["total_km"], motion=parts["motion_bearing_deg"])


@query("track_error_km", scalar_sql(error_km=_ERR))
def _(spark, sf):
    pred = geo.offset_position("LAT", "LON", F.col("DELTA_LAT") * 4, F.col("DELTA_LON") * 4)
    return scalar(spark, sf, error_km=geo.track_error_km(*ABS24, *pred))


@query("cyclic_encode", scalar_sql(
    month_sin="sin(2 * pi() * MONTH / 12)", month_cos="cos(2 * pi() * MONTH / 12)",
    doy_sin="sin(2 * pi() * DAY_OF_YEAR / CAST(365.25 AS DOUBLE))",
    doy_cos="cos(2 * pi() * DAY_OF_YEAR / CAST(365.25 AS DOUBLE))"))
def _(spark, sf):
    month, doy = geo.cyclic("MONTH", 12), geo.cyclic("DAY_OF_YEAR", 365.25)
    return scalar(spark, sf, month_sin=month[0], month_cos=month[1],
                  doy_sin=doy[0], doy_cos=doy[1])


@query("intensity_category", scalar_sql(category="INTENSITY_CATEGORY"))
def _(spark, sf):
    return scalar(spark, sf, category=geo.intensity_category("WMO_WIND"))


@query("basin_code", with_raw(
    """SELECT BASIN, CAST(list_position(['NA','EP','WP','NI','SI','SP','SA'], upper(trim(BASIN))) - 1
    AS INTEGER) AS code, count(*) AS n FROM raw GROUP BY ALL"""))
def _(spark, sf):
    return (raw_tracks(spark, sf).groupBy("BASIN", geo.basin_code("BASIN").alias("code"))
            .agg(F.count("*").alias("n")))


@query("storm_kinematics", scalar_sql(
    STORM_SPEED="MOVEMENT_DISTANCE / 6 / CAST(1.852 AS DOUBLE)", STORM_DIR="BEARING"))
def _(spark, sf):
    df = E.storm_kinematics(clean_table(spark, sf))
    return rounded(df.select("SID", "ISO_TIME", "STORM_SPEED", "STORM_DIR"))


# ------------------------------------------------------------- feature operators
def feature_query(name, build, out):
    names = (*KEYS, *out)

    @query(name, with_features(f"SELECT {columns(names)} FROM features"))
    def _(spark, sf):
        return rounded(build(clean_table(spark, sf)).select(*names))


def _motion(df):
    return E.motion_features(E.lag_features(df))


def _velocity(df):
    return E.velocity_features(_motion(df))


feature_query("temporal_features", E.temporal_features,
              K.FEATURE_GROUPS["temporal"] + K.FEATURE_GROUPS["cyclic"])
feature_query("lag_features", E.lag_features,
              K.FEATURE_GROUPS["lag_position"] + K.FEATURE_GROUPS["lag_intensity"])
feature_query("motion_features", _motion, (*K.FEATURE_GROUPS["motion"], "BEARING"))
feature_query("velocity_features", _velocity, K.FEATURE_GROUPS["velocity"])
feature_query("turning_features", lambda df: E.turning_features(_motion(df)),
              K.FEATURE_GROUPS["turning"])
feature_query("rolling_features", lambda df: E.rolling_features(_velocity(df)),
              K.FEATURE_GROUPS["rolling"])
feature_query("acceleration_features", lambda df: E.acceleration_features(_motion(df)),
              K.FEATURE_GROUPS["acceleration"])
feature_query("storm_age", E.storm_age, ("STORM_AGE",))
feature_query("context_features", E.context_features, K.FEATURE_GROUPS["context"])
feature_query("targets", E.targets, TARGETS)
_ALL = (*[c for c in K.ID_COLUMNS if c not in KEYS], *K.FEATURES, "BEARING", *TARGETS)
feature_query("build_features", E.build_features, _ALL)
# tiles of four days, so that most segments span several
feature_query("build_features_tiled", lambda df: E.build_features(df, tile_hours=24 * 4), _ALL)


@query("target_counts", with_features("\nUNION ALL ".join(
    f"SELECT {h} AS horizon, count(TARGET_LAT_{h}H) AS n_targets FROM features"
    for h in K.HORIZONS)))
def _(spark, sf):
    return E.target_counts(E.targets(clean_table(spark, sf)))


@query("feature_summary", with_features(
    f"""SELECT count(*) AS n_rows, {len(CLEAN_COLUMNS | set(K.FEATURES) | {'BEARING'} | set(TARGETS))} AS n_columns, count(DISTINCT SID) AS storms,
    count(DISTINCT SEGMENT_ID) AS segments, 12 AS lag_columns, 20 AS target_columns FROM features"""))
def _(spark, sf):
    return E.feature_summary(feature_table(spark, sf))


@query("feature_basin_rows", with_features("SELECT BASIN, count(*) AS n FROM features GROUP BY 1"))
def _(spark, sf):
    return E.basin_rows(feature_table(spark, sf))


_KEPT = (*K.ID_COLUMNS, *E.columns_outside(("acceleration", "cyclic")))


@query("feature_group_select", with_features(f"SELECT {columns(_KEPT)} FROM features"))
def _(spark, sf):
    return rounded(E.feature_group_select(feature_table(spark, sf), "acceleration", "cyclic"))


@query("row_position", with_clean(
    """SELECT SID, SEGMENT_ID, ISO_TIME,
    CAST(row_number() OVER (PARTITION BY SEGMENT_ID ORDER BY ISO_TIME) - 1 AS INTEGER) AS POSITION,
    CAST(row_number() OVER (PARTITION BY SEGMENT_ID ORDER BY ISO_TIME DESC) - 1 AS INTEGER) AS FROM_END
    FROM clean"""))
def _(spark, sf):
    return E.row_position(clean_table(spark, sf)).select(*KEYS, "POSITION", "FROM_END")


def requests_table(spark, sf):
    """One request per observation: it and up to six before it in its segment, oldest first."""
    df = E.row_position(clean_table(spark, sf))
    point = F.struct(F.col("LAT").alias("latitude"), F.col("LON").alias("longitude"),
                     F.col("WMO_WIND").alias("wind_speed"), F.col("WMO_PRES").alias("pressure"))
    history = Window.partitionBy("SID", "SEGMENT_ID").orderBy("ISO_TIME").rowsBetween(-6, 0)
    return df.select(F.concat_ws("@", "SEGMENT_ID", "POSITION").alias("request_id"),
                     F.collect_list(point).over(history).alias("observations"))


REFERENCE_TIME = "2024-09-01 12:00:00"

REQUESTS_SQL = """
q_pos AS (SELECT *, row_number() OVER (PARTITION BY SEGMENT_ID ORDER BY ISO_TIME) - 1 AS p FROM clean),
q_rows AS (SELECT e.SEGMENT_ID || '@' || e.p AS request_id, r.p - greatest(e.p - 6, 0) AS p, least(e.p + 1, 7) AS n,
  r.LAT, r.LON, r.WMO_WIND, r.WMO_PRES FROM q_pos e JOIN q_pos r
  ON e.SEGMENT_ID = r.SEGMENT_ID AND r.p BETWEEN e.p - 6 AND e.p)"""

_W = "OVER (PARTITION BY request_id ORDER BY p)"
LIVE_SQL = f""",
q_lag AS (SELECT *, lag(LAT) {_W} AS LAT_LAG_1, lag(LON) {_W} AS LON_LAG_1, lag(LAT, 3) {_W} AS LAT_LAG_3,
  lag(WMO_PRES) {_W} AS PRESSURE_LAG_1 FROM q_rows),
q_move AS (SELECT *, LAT - LAT_LAG_1 AS DELTA_LAT, {diff('LON', 'LON_LAG_1')} AS DELTA_LON,
  {hav('LAT_LAG_1', 'LON_LAG_1', 'LAT', 'LON')} AS MOVEMENT_DISTANCE,
  {bearing('LAT_LAG_1', 'LON_LAG_1', 'LAT', 'LON')} AS b FROM q_lag),
q_feat AS (SELECT *, {diff('b', f'lag(b, 2) {_W}')} AS BEARING_CHANGE_2,
  CASE WHEN count(DELTA_LAT) OVER r4 = 4 THEN avg(DELTA_LAT) OVER r4 END AS DELTA_LAT_MEAN_24H
  FROM q_move WINDOW r4 AS (PARTITION BY request_id ORDER BY p ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""
LIVE_COLUMNS = ("LAT", "LON", "WMO_WIND", "WMO_PRES", "LAT_LAG_3", "PRESSURE_LAG_1", "DELTA_LAT",
                "DELTA_LON", "MOVEMENT_DISTANCE", "BEARING_CHANGE_2", "DELTA_LAT_MEAN_24H")


@query("live_features", with_clean(
    f"""SELECT request_id, {', '.join(f'{r(c)} AS {c}' for c in LIVE_COLUMNS)},
    {r('MOVEMENT_DISTANCE / 6 / CAST(1.852 AS DOUBLE)')} AS STORM_SPEED, {r('sin(radians(b))')} AS STORM_DIR_SIN,
    {r('CAST((n - 1) * 6 AS DOUBLE)')} AS STORM_AGE, 9 AS MONTH, 12 AS HOUR, CAST(NULL AS DOUBLE) AS DIST2LAND,
    CAST(NULL AS DOUBLE) AS BASIN_CODE FROM q_feat WHERE p = n - 1""", REQUESTS_SQL + LIVE_SQL))
def _(spark, sf):
    now = F.lit(REFERENCE_TIME).cast("timestamp_ntz")
    return rounded(E.live_features(requests_table(spark, sf), now).select(
        "request_id", *LIVE_COLUMNS, "STORM_SPEED", "STORM_DIR_SIN", "STORM_AGE", "MONTH", "HOUR",
        "DIST2LAND", "BASIN_CODE"))
