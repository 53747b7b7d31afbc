"""Per-segment features and targets, all as window expressions.

``build_features`` needs one hash by SID: the storm-age window comes first, and
every later window partitions by (SID, SEGMENT_ID), which that hash satisfies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions import geo
from driftline.functions.times import hours_between, plus_hours
from driftline.operators.tiles import carried, drop_halo, with_halo
from driftline.operators.windows import by_segment, whole_segment


# Each layer is a dict of columns that depend on earlier layers only. The public
# operators attach one layer; ``build_features`` merges the layers that share a
# window, so the whole table needs three Window nodes.


def _temporal() -> dict[str, Column]:
    t = F.col("ISO_TIME")
    month, hour, doy = F.month(t), F.hour(t), F.dayofyear(t)
    month_sin, month_cos = geo.cyclic(month, 12)
    hour_sin, hour_cos = geo.cyclic(hour, 24)
    doy_sin, doy_cos = geo.cyclic(doy, 365.25)
    return {"MONTH": month, "DAY": F.dayofmonth(t), "HOUR": hour, "DAY_OF_YEAR": doy,
            "MONTH_SIN": month_sin, "MONTH_COS": month_cos,
            "HOUR_SIN": hour_sin, "HOUR_COS": hour_cos,
            "DOY_SIN": doy_sin, "DOY_COS": doy_cos}


def _lags(w, n_lags: int = K.N_LAGS) -> dict[str, Column]:
    return {f"{prefix}_LAG_{k}": F.lag(source, k).over(w)
            for source, prefix in K.LAG_SOURCES.items() for k in range(1, n_lags + 1)}


def _motion() -> dict[str, Column]:
    step = ("LAT_LAG_1", "LON_LAG_1", "LAT", "LON")
    known = F.col("LAT_LAG_1").isNotNull() & F.col("LON_LAG_1").isNotNull()
    return {"DELTA_LAT": F.when(known, F.col("LAT") - F.col("LAT_LAG_1")),
            "DELTA_LON": F.when(known, geo.angular_difference("LON", "LON_LAG_1")),
            "DELTA_WIND": F.col("WMO_WIND") - F.col("WIND_LAG_1"),
            "DELTA_PRESSURE": F.col("WMO_PRES") - F.col("PRESSURE_LAG_1"),
            "MOVEMENT_DISTANCE": geo.haversine_km(*step),
            "BEARING": geo.bearing_deg(*step)}


def _bearing_parts() -> dict[str, Column]:
    return {"BEARING_SIN": geo.direction_sin("BEARING"), "BEARING_COS": geo.direction_cos("BEARING")}


def _velocity(columns) -> dict[str, Column]:
    hours, per_degree = F.lit(float(K.CADENCE_HOURS)), F.lit(K.KM_PER_DEGREE_LAT)
    out = {"VELOCITY_U": F.col("DELTA_LON") * per_degree * F.cos(F.radians("LAT")) / hours,
           "VELOCITY_V": F.col("DELTA_LAT") * per_degree / hours,
           "TRANSLATION_SPEED": F.col("MOVEMENT_DISTANCE") / hours}
    if "STORM_DIR" in columns:
        out.update(STORM_DIR_SIN=geo.direction_sin("STORM_DIR"),
                   STORM_DIR_COS=geo.direction_cos("STORM_DIR"))
    return out


def _turning(w) -> dict[str, Column]:
    return {f"BEARING_CHANGE_{k}": geo.angular_difference("BEARING", F.lag("BEARING", k).over(w))
            for k in (1, 2)}


ROLLING = {"DELTA_LAT": "DELTA_LAT_MEAN", "DELTA_LON": "DELTA_LON_MEAN",
           "DELTA_WIND": "DELTA_WIND_MEAN", "TRANSLATION_SPEED": "SPEED_MEAN"}


def _rolling(w, rows: int = K.ROLLING_ROWS) -> dict[str, Column]:
    frame = w.rowsBetween(-(rows - 1), 0)
    hours = rows * K.CADENCE_HOURS
    return {f"{stem}_{hours}H": F.when(F.count(c).over(frame) == rows, F.avg(c).over(frame))
            for c, stem in ROLLING.items()}


def _acceleration(w) -> dict[str, Column]:
    return {out: F.col(c) - F.lag(c).over(w)
            for out, c in {"ACCEL_LAT": "DELTA_LAT", "ACCEL_LON": "DELTA_LON",
                           "WIND_TREND": "DELTA_WIND"}.items()}


def _context(columns, w) -> dict[str, Column]:
    out = {"INTENSITY_CATEGORY": geo.intensity_category("WMO_WIND"),
           "ABS_LAT": F.abs("LAT"), "CORIOLIS_SIN_LAT": F.sin(F.radians("LAT"))}
    if "BASIN" in columns:
        out["BASIN_CODE"] = geo.basin_code("BASIN")
    if "DIST2LAND" in columns:
        out["DELTA_DIST2LAND"] = F.col("DIST2LAND") - F.lag("DIST2LAND").over(w)
    return out


def _future(w) -> dict[str, Column]:
    return {c: F.lead(source, K.steps(h)).over(w) for h in K.HORIZONS
            for source, c in zip(("LAT", "LON"), K.target_columns(h, "absolute"))}


def _moves() -> dict[str, Column]:
    out = {}
    for h in K.HORIZONS:
        (lat, lon), (dlat, dlon) = (K.target_columns(h, m) for m in ("absolute", "displacement"))
        out[dlat] = F.col(lat) - F.col("LAT")
        out[dlon] = geo.angular_difference(lon, "LON")
    return out


# --------------------------------------------------------------------- operators
def temporal_features(df: DataFrame) -> DataFrame:
    """Calendar parts and their cyclic encodings."""
    return df.withColumns(_temporal())


def lag_features(df: DataFrame, n_lags: int = K.N_LAGS) -> DataFrame:
    """Position, wind and pressure of the rows before, inside the segment."""
    return df.withColumns(_lags(by_segment(), n_lags))


def motion_features(df: DataFrame) -> DataFrame:
    """First differences, distance and heading. NULL, not 0, at a segment head."""
    return df.withColumns(_motion()).withColumns(_bearing_parts())


def velocity_features(df: DataFrame) -> DataFrame:
    """Eastward and northward speed in km/h, and the reported direction as sin/cos."""
    return df.withColumns(_velocity(df.columns))


def turning_features(df: DataFrame) -> DataFrame:
    """Change of heading against one and two rows before, wrapped."""
    return _with_turn(df.withColumns(_turning(by_segment())))


def _with_turn(df: DataFrame) -> DataFrame:
    return df.withColumn("TURN_MAGNITUDE", F.abs("BEARING_CHANGE_1"))


def rolling_features(df: DataFrame, rows: int = K.ROLLING_ROWS) -> DataFrame:
    """Trailing means over complete frames of ``rows`` values."""
    return df.withColumns(_rolling(by_segment(), rows))


def acceleration_features(df: DataFrame) -> DataFrame:
    """Second differences; the longitude one is a plain difference of wrapped steps."""
    return df.withColumns(_acceleration(by_segment()))


def storm_age(df: DataFrame) -> DataFrame:
    """Hours since the first observation of the storm (not of the segment)."""
    genesis = F.min("ISO_TIME").over(Window.partitionBy("SID"))
    return df.withColumn("STORM_AGE", hours_between(genesis, F.col("ISO_TIME")))


def context_features(df: DataFrame) -> DataFrame:
    """Age, intensity class, latitude terms, basin code, change of land distance."""
    if "STORM_AGE" not in df.columns:
        df = storm_age(df)
    return df.withColumns(_context(df.columns, by_segment()))


def targets(df: DataFrame) -> DataFrame:
    """Future position and displacement at every horizon."""
    return df.withColumns(_future(by_segment())).withColumns(_moves())


# Deepest look back: the rolling mean of 4 differences needs 4 earlier rows.
ROWS_BACK = K.ROLLING_ROWS
ROWS_AHEAD = max(K.steps(h) for h in K.HORIZONS)


def _all_features(df: DataFrame, with_targets: bool, tiled: bool = False) -> DataFrame:
    w = by_segment(tiled)
    first = {**_temporal(), **_lags(w), **_context(df.columns, w)}
    df = df.withColumns({**first, **_future(w)} if with_targets else first)
    df = df.withColumns({**_motion(), **_moves()} if with_targets else _motion())
    df = df.withColumns({**_bearing_parts(), **_velocity(df.columns)})
    return _with_turn(df.withColumns({**_turning(w), **_rolling(w), **_acceleration(w)}))


def build_features(cleaned: DataFrame, tile_hours: int | None = None) -> DataFrame:
    """All feature and target columns; the number of rows does not change.

    ``tile_hours`` cuts long storms into tiles with a halo of 4 rows back and 12
    ahead; the result is the same.
    """
    if tile_hours is None:
        return _all_features(storm_age(cleaned), with_targets=True)
    rows = with_halo(cleaned, ROWS_BACK, ROWS_AHEAD, tile_hours)
    rows = carried(rows, F.col("ISO_TIME"), F.min, "_genesis", before_only=False)
    rows = rows.withColumn("STORM_AGE", hours_between(F.col("_genesis"), F.col("ISO_TIME")))
    return drop_halo(_all_features(rows.drop("_genesis"), with_targets=True, tiled=True))


def unmapped_basins(df: DataFrame) -> DataFrame:
    """Rows whose basin has no code, by basin value."""
    return (df.where(geo.basin_code("BASIN").isNull())
              .groupBy("BASIN").agg(F.count("*").alias("n")))


def target_counts(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count(K.target_columns(h, "absolute")[0]).alias(str(h))
                      for h in K.HORIZONS])
    long = counts.unpivot([], [str(h) for h in K.HORIZONS], "h", "n_targets")
    return long.select(F.col("h").cast("int").alias("horizon"), "n_targets")


def feature_summary(df: DataFrame) -> DataFrame:
    """Size of the feature table in one row."""
    per_segment = df.groupBy("SID", "SEGMENT_ID").agg(F.count("*").alias("n"))
    return per_segment.agg(
        F.sum("n").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.count_distinct("SID").alias("storms"),
        F.count("*").alias("segments"),
        F.lit(sum("_LAG_" in c for c in df.columns)).alias("lag_columns"),
        F.lit(sum(c.startswith("TARGET_") for c in df.columns)).alias("target_columns"))


def basin_rows(df: DataFrame) -> DataFrame:
    return df.groupBy("BASIN").agg(F.count("*").alias("n"))


def columns_outside(dropped) -> list[str]:
    """The feature columns, in table order, that belong to none of the dropped groups."""
    for group in dropped:
        if group not in K.FEATURE_GROUPS:
            raise ValueError(f"no feature group {group!r}")
    gone = {column for group in dropped for column in K.FEATURE_GROUPS[group]}
    return [column for column in K.FEATURES if column not in gone]


def feature_group_select(df: DataFrame, *without: str, keep=K.ID_COLUMNS) -> DataFrame:
    """Ids plus the columns of all feature groups but the named ones."""
    columns = columns_outside(without)
    ids = [c for c in keep if c in df.columns and c not in columns]
    return df.select(*ids, *columns)


def row_position(df: DataFrame) -> DataFrame:
    """Row index counted from the head and from the tail of the segment."""
    position = F.row_number().over(by_segment()) - 1
    df = df.withColumns({"POSITION": position, "_n": F.count("*").over(whole_segment())})
    return df.withColumn("FROM_END", (F.col("_n") - F.col("POSITION") - 1).cast("int")).drop("_n")


# ------------------------------------------------------------------- requests
def storm_kinematics(df: DataFrame) -> DataFrame:
    """Speed in knots and heading from the previous row, where none is reported."""
    w = by_segment()
    step = (F.lag("LAT").over(w), F.lag("LON").over(w), F.col("LAT"), F.col("LON"))
    knots = geo.haversine_km(*step) / float(K.CADENCE_HOURS) * F.lit(1.0 / K.KM_PER_KNOT_HOUR)
    return df.withColumns({"STORM_SPEED": knots, "STORM_DIR": geo.bearing_deg(*step)})


def request_observations(requests: DataFrame, reference_time: Column) -> DataFrame:
    """Array of observations per request to one row per observation.

    Times are 6-hourly and end at ``reference_time``. The request id plays the
    part of the storm, so the feature code below is the one for tables.
    """
    rows = requests.select("request_id", F.size("observations").alias("_n"),
                           F.posexplode("observations").alias("_i", "o"))
    return rows.select(
        "request_id",
        F.col("request_id").cast("string").alias("SID"),
        F.concat(F.col("request_id").cast("string"), F.lit("_S01")).alias("SEGMENT_ID"),
        plus_hours(reference_time, (F.col("_i") - F.col("_n") + 1) * K.CADENCE_HOURS)
        .alias("ISO_TIME"),
        F.col("o.latitude").alias("LAT"), F.col("o.longitude").alias("LON"),
        F.col("o.wind_speed").alias("WMO_WIND"), F.col("o.pressure").alias("WMO_PRES"),
        (F.col("_i") == F.col("_n") - 1).alias("_latest"))


def live_features(requests: DataFrame, reference_time: Column) -> DataFrame:
    """One feature row per request: the latest observation, missing inputs NULL.

    ``requests`` holds ``request_id`` and ``observations``, an array of structs
    (latitude, longitude, wind_speed, pressure), oldest first.
    """
    observed = storm_kinematics(request_observations(requests, reference_time))
    df = _all_features(storm_age(observed), with_targets=False).where("_latest")
    missing = [c for c in K.FEATURES if c not in df.columns]
    return df.select("request_id", *[F.lit(None).cast("double").alias(c) if c in missing
                                     else F.col(c) for c in K.FEATURES])
