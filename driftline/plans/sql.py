"""SQL fragments for the oracle queries: the same tables, written as CTEs."""

from __future__ import annotations

from driftline import constants as K


def r(expr: str, digits: int = 6) -> str:
    """Rounded value without a negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN CAST(0 AS DOUBLE) " \
           f"ELSE round(CAST({expr} AS DOUBLE), {digits}) END"


def rs(columns, digits: int = 6, prefix: str = "") -> str:
    """A select list of rounded columns under their own names."""
    return ", ".join(f"{r(prefix + c, digits)} AS {c}" for c in columns)


def wrap(x: str) -> str:
    return f"(({x}) + 180 - 360 * floor((({x}) + 180) / 360) - 180)"


def wrap360(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360))"


def diff(a: str, b: str) -> str:
    return wrap(f"({a}) - ({b})")


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    s1 = f"sin((radians({lat2}) - radians({lat1})) / 2)"
    s2 = f"sin((radians({lon2}) - radians({lon1})) / 2)"
    a = f"({s1} * {s1} + cos(radians({lat1})) * cos(radians({lat2})) * ({s2} * {s2}))"
    clipped = f"(CASE WHEN {a} > 1 THEN 1 WHEN {a} < 0 THEN 0 ELSE {a} END)"
    return f"(CAST(12742 AS DOUBLE) * asin(sqrt({clipped})))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str, null: bool = True) -> str:
    dlon = f"(radians({lon2}) - radians({lon1}))"
    x = f"(sin{dlon} * cos(radians({lat2})))"
    y = (f"(cos(radians({lat1})) * sin(radians({lat2})) - "
         f"sin(radians({lat1})) * cos(radians({lat2})) * cos{dlon})")
    b = wrap360(f"degrees(atan2({x}, {y}))")
    if not null:
        return b
    return f"(CASE WHEN abs({x}) <= 1e-12 AND abs({y}) <= 1e-12 THEN NULL ELSE {b} END)"


def clamp_lat(x: str) -> str:
    return f"(CASE WHEN {x} > 90 THEN 90 WHEN {x} < -90 THEN -90 ELSE {x} END)"


RAW = """
ev AS (SELECT event_id AS id, event_id // 60 AS g, event_id % 60 AS step,
  CAST(round(value * 100) AS BIGINT) AS c FROM events),
walk AS (SELECT *,
  CAST((g * 1379) % 40000 - 15000 + sum((c * 7) % 700 - 150) OVER w AS DOUBLE) / 1000 AS lat,
  CAST((g * 9973) % 360000 - 180000
    + CASE WHEN g % 2 = 0 THEN -1 ELSE 1 END * sum((c * 13) % 900 - 250) OVER w AS DOUBLE) / 1000 AS lon
  FROM ev WINDOW w AS (PARTITION BY g ORDER BY step ROWS UNBOUNDED PRECEDING)),
copies AS (
  SELECT *, 0 AS off, 'main' AS kind, false AS dup FROM walk
  UNION ALL SELECT *, 3, 'main', false FROM walk WHERE id % 11 = 3
  UNION ALL SELECT *, 0, 'spur', false FROM walk WHERE id % 29 = 4
  UNION ALL SELECT *, 0, 'main', true FROM walk WHERE id % 37 = 5),
timed AS (SELECT *, TIMESTAMP '1980-01-01 00:00:00' + to_days(CAST((g * 3571) % 16425 AS INTEGER))
    + to_hours(CAST(step * 6 + off AS INTEGER)) AS t
  FROM copies WHERE NOT (g % 5 = 2 AND step IN (28, 29))),
raw AS MATERIALIZED (SELECT 'T' || CAST(g AS VARCHAR) AS SID, CAST(year(t) AS VARCHAR) AS SEASON,
  CASE WHEN g % 14 <> 0 THEN list_extract(['NA','EP','WP','NI','SI','SP','SA'], CAST(g % 7 AS INTEGER) + 1) END AS BASIN,
  'MM' AS SUBBASIN, t AS ISO_TIME, lat AS LAT, lon AS LON,
  CASE WHEN id % 13 = 6 OR (g % 7 = 3 AND step BETWEEN 33 AND 36) OR dup THEN ' '
    ELSE CAST(25 + c % 120 AS VARCHAR) END AS WMO_WIND,
  CAST(1010 - c % 110 AS VARCHAR) AS WMO_PRES, CAST(c % 25 AS VARCHAR) AS STORM_SPEED,
  CASE WHEN id % 101 = 50 THEN ' ' ELSE CAST(c % 360 AS VARCHAR) END AS STORM_DIR,
  CASE WHEN g % 3 = 0 AND step >= 56 THEN 'ET' WHEN g % 5 = 1 THEN ' ss' ELSE 'TS' END AS NATURE,
  CAST(c % 2000 AS VARCHAR) AS DIST2LAND, kind AS TRACK_TYPE FROM timed)"""

_TYPED_NUMBERS = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in K.NUMERIC_COLUMNS)

STEPS = f"""
s_type AS (SELECT * FROM raw WHERE lower(trim(TRACK_TYPE)) IN ('main')),
s_season AS (SELECT * REPLACE (CAST(TRY_CAST(SEASON AS DOUBLE) AS INTEGER) AS SEASON) FROM s_type
  WHERE TRY_CAST(SEASON AS DOUBLE) >= 1980),
s_typed AS (SELECT SID, SEASON, BASIN, SUBBASIN, ISO_TIME, NATURE, TRACK_TYPE, {_TYPED_NUMBERS}
  FROM s_season WHERE ISO_TIME IS NOT NULL),
s_lon AS (SELECT * REPLACE ({wrap('LON')} AS LON) FROM s_typed),
s_coord AS (SELECT * FROM s_lon WHERE LAT BETWEEN -90 AND 90 AND LON BETWEEN -180 AND 180),
s_nature AS (SELECT * FROM s_coord WHERE upper(trim(NATURE)) IN ('TS', 'SS')),
s_unique AS MATERIALIZED (SELECT * FROM s_nature QUALIFY row_number() OVER (PARTITION BY SID, ISO_TIME ORDER BY
  {' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in K.NUMERIC_COLUMNS)},
  {', '.join(c + ' NULLS FIRST' for c in K.REQUIRED_COLUMNS if c not in ('SID', 'ISO_TIME'))}) = 1),
s_syn AS (SELECT * FROM s_unique WHERE hour(ISO_TIME) IN (0, 6, 12, 18)
  AND minute(ISO_TIME) = 0 AND second(ISO_TIME) = 0),
s_fill AS MATERIALIZED (SELECT * REPLACE ({', '.join(
    f'last_value({c} IGNORE NULLS) OVER w AS {c}' for c in K.FILL_COLUMNS)})
  FROM s_syn WINDOW w AS (PARTITION BY SID ORDER BY ISO_TIME ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
s_int AS (SELECT * FROM s_fill WHERE WMO_WIND IS NOT NULL AND WMO_PRES IS NOT NULL),
s_break AS (SELECT *, CASE WHEN ISO_TIME = lag(ISO_TIME) OVER (PARTITION BY SID ORDER BY ISO_TIME)
  + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM s_int),
s_num AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY SID ORDER BY ISO_TIME ROWS UNBOUNDED PRECEDING) AS INTEGER) AS num
  FROM s_break),
s_seg AS MATERIALIZED (SELECT * EXCLUDE (brk, num), SID || '_S' || CASE WHEN num < 10 THEN '0' ELSE '' END
  || CAST(num AS VARCHAR) AS SEGMENT_ID FROM s_num),
clean AS MATERIALIZED (SELECT * FROM s_seg QUALIFY count(*) OVER (PARTITION BY SEGMENT_ID) >= 20)"""


def with_raw(select: str) -> str:
    return f"WITH {RAW}\n{select}"


def with_clean(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([RAW, STEPS, *more]) + "\n" + select


_SEG = "PARTITION BY SEGMENT_ID ORDER BY ISO_TIME"
_MOTION = ("LAT_LAG_1", "LON_LAG_1", "LAT", "LON")
_TARGETS = [(h, h // 6) for h in K.HORIZONS]

# Feature columns, layer by layer. The feature table has blank basins recovered.
FEATURES = f"""
f_base AS (SELECT * REPLACE (coalesce(BASIN, 'NA') AS BASIN) FROM clean),
f_time AS (SELECT *, CAST(month(ISO_TIME) AS INTEGER) AS MONTH, CAST(day(ISO_TIME) AS INTEGER) AS DAY,
  CAST(hour(ISO_TIME) AS INTEGER) AS HOUR, CAST(dayofyear(ISO_TIME) AS INTEGER) AS DAY_OF_YEAR,
  sin(2 * pi() * month(ISO_TIME) / 12) AS MONTH_SIN, cos(2 * pi() * month(ISO_TIME) / 12) AS MONTH_COS,
  sin(2 * pi() * hour(ISO_TIME) / 24) AS HOUR_SIN, cos(2 * pi() * hour(ISO_TIME) / 24) AS HOUR_COS,
  sin(2 * pi() * dayofyear(ISO_TIME) / CAST(365.25 AS DOUBLE)) AS DOY_SIN,
  cos(2 * pi() * dayofyear(ISO_TIME) / CAST(365.25 AS DOUBLE)) AS DOY_COS FROM f_base),
f_lag AS (SELECT *, {', '.join(f'lag({c}, {k}) OVER ({_SEG}) AS {p}_LAG_{k}'
    for c, p in K.LAG_SOURCES.items() for k in (1, 2, 3))},
  CAST(date_diff('second', min(ISO_TIME) OVER (PARTITION BY SID), ISO_TIME) AS DOUBLE) / 3600 AS STORM_AGE,
  DIST2LAND - lag(DIST2LAND) OVER ({_SEG}) AS DELTA_DIST2LAND,
  {', '.join(f'lead({c}, {n}) OVER ({_SEG}) AS TARGET_{c}_{h}H' for h, n in _TARGETS for c in ('LAT', 'LON'))}
  FROM f_time),
f_motion AS (SELECT *, LAT - LAT_LAG_1 AS DELTA_LAT, {diff('LON', 'LON_LAG_1')} AS DELTA_LON,
  WMO_WIND - WIND_LAG_1 AS DELTA_WIND, WMO_PRES - PRESSURE_LAG_1 AS DELTA_PRESSURE,
  {hav(*_MOTION)} AS MOVEMENT_DISTANCE, {bearing(*_MOTION)} AS BEARING FROM f_lag),
f_speed AS (SELECT *, sin(radians(BEARING)) AS BEARING_SIN, cos(radians(BEARING)) AS BEARING_COS,
  DELTA_LON * CAST(111.19 AS DOUBLE) * cos(radians(LAT)) / 6 AS VELOCITY_U,
  DELTA_LAT * CAST(111.19 AS DOUBLE) / 6 AS VELOCITY_V,
  MOVEMENT_DISTANCE / 6 AS TRANSLATION_SPEED, sin(radians(STORM_DIR)) AS STORM_DIR_SIN,
  cos(radians(STORM_DIR)) AS STORM_DIR_COS,
  {diff('BEARING', f'lag(BEARING, 1) OVER ({_SEG})')} AS BEARING_CHANGE_1,
  {diff('BEARING', f'lag(BEARING, 2) OVER ({_SEG})')} AS BEARING_CHANGE_2,
  DELTA_LAT - lag(DELTA_LAT) OVER ({_SEG}) AS ACCEL_LAT,
  DELTA_LON - lag(DELTA_LON) OVER ({_SEG}) AS ACCEL_LON,
  DELTA_WIND - lag(DELTA_WIND) OVER ({_SEG}) AS WIND_TREND FROM f_motion),
features AS MATERIALIZED (SELECT *, abs(BEARING_CHANGE_1) AS TURN_MAGNITUDE,
  {', '.join(f'CASE WHEN count({c}) OVER r4 = 4 THEN avg({c}) OVER r4 END AS {o}_24H' for c, o in
    (('DELTA_LAT', 'DELTA_LAT_MEAN'), ('DELTA_LON', 'DELTA_LON_MEAN'), ('DELTA_WIND', 'DELTA_WIND_MEAN'),
     ('TRANSLATION_SPEED', 'SPEED_MEAN')))},
  CAST(CASE WHEN WMO_WIND < 0 THEN NULL WHEN WMO_WIND < 34 THEN 0 WHEN WMO_WIND < 64 THEN 1 WHEN WMO_WIND < 83 THEN 2
    WHEN WMO_WIND < 96 THEN 3 WHEN WMO_WIND < 113 THEN 4 WHEN WMO_WIND < 137 THEN 5
    WHEN WMO_WIND IS NOT NULL THEN 6 END AS INTEGER) AS INTENSITY_CATEGORY,
  abs(LAT) AS ABS_LAT, sin(radians(LAT)) AS CORIOLIS_SIN_LAT,
  CAST(list_position(['NA','EP','WP','NI','SI','SP','SA'], upper(trim(BASIN))) - 1 AS INTEGER) AS BASIN_CODE,
  {', '.join(f'TARGET_LAT_{h}H - LAT AS TARGET_DLAT_{h}H, {diff(f"TARGET_LON_{h}H", "LON")} AS TARGET_DLON_{h}H'
    for h in K.HORIZONS)}
  FROM f_speed WINDOW r4 AS ({_SEG} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""

def seeded(*keys: str, seed: int = K.SEED) -> str:
    """The seeded hash of a row key (see ``order_stats.row_hash``)."""
    texts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', {texts}, '{seed}')), 1, 13) AS BIGINT)"


INT_FEATURES = ("MONTH", "DAY", "HOUR", "DAY_OF_YEAR", "INTENSITY_CATEGORY", "BASIN_CODE")


def with_features(select: str, *more: str) -> str:
    return with_clean(select, FEATURES, *more)


def columns(names, digits: int = 6) -> str:
    """Select list: whole numbers, texts and times as they are, doubles rounded."""
    plain = (*INT_FEATURES, "SID", "SEGMENT_ID", "ISO_TIME", "SEASON", "BASIN", "SUBBASIN",
             "NATURE", "TRACK_TYPE", "split", "model", "horizon", "LEAD_HOURS", "POSITION", "FROM_END")
    return ", ".join(c if c in plain else f"{r(c, digits)} AS {c}" for c in names)


_ALL_FEATURES = " AND ".join(f"{c} IS NOT NULL" for c in K.FEATURES)


def prepared(horizon: int) -> str:
    """Predicate: complete features and both targets of a horizon."""
    return _ALL_FEATURES + "".join(f" AND {c} IS NOT NULL" for c in K.target_columns(horizon))


_ROW = "SID, SEGMENT_ID, ISO_TIME, SEASON, BASIN, LAT, LON, DELTA_LAT, DELTA_LON, INTENSITY_CATEGORY"

SPLIT = f"""
split AS MATERIALIZED (SELECT SID, CASE WHEN min(SEASON) <= 2014 THEN 'train' WHEN min(SEASON) <= 2018 THEN 'val'
  ELSE 'test' END AS split FROM features WHERE {prepared(6)} GROUP BY SID)"""

ROWS = "rows_all AS MATERIALIZED (" + " UNION ALL ".join(
    f"""SELECT {_ROW}, {h} AS horizon, TARGET_DLAT_{h}H AS Y_LAT, TARGET_DLON_{h}H AS Y_LON
    FROM features WHERE {prepared(h)}""" for h in K.HORIZONS) + """),
rows_split AS MATERIALIZED (SELECT r.*, s.split FROM rows_all r JOIN split s USING (SID))"""

CLIMATOLOGY = """
clim AS (SELECT horizon, BASIN, avg(Y_LAT) AS b_lat, avg(Y_LON) AS b_lon FROM rows_split
  WHERE split = 'train' AND BASIN IS NOT NULL GROUP BY ALL),
clim_all AS (SELECT horizon, avg(Y_LAT) AS g_lat, avg(Y_LON) AS g_lon FROM rows_split
  WHERE split = 'train' GROUP BY ALL)"""

_TRUE = clamp_lat("(LAT + Y_LAT)"), wrap("LON + Y_LON")
_PRED = clamp_lat("(LAT + PRED_Y_LAT)"), wrap("LON + PRED_Y_LON")
_POS = ("TRUE_LAT", "TRUE_LON", "PRED_LAT", "PRED_LON")
_THETA = f"radians({diff('hb', 'mb')})"

BASELINES = f"""
b_test AS (SELECT t.*, coalesce(b_lat, g_lat) AS c_lat, coalesce(b_lon, g_lon) AS c_lon FROM rows_split t
  LEFT JOIN clim c ON t.horizon = c.horizon AND t.BASIN = c.BASIN
  LEFT JOIN clim_all g ON t.horizon = g.horizon WHERE split = 'test'),
b_pred AS (SELECT *, 'Persistence' AS model, CAST(0 AS DOUBLE) AS PRED_Y_LAT, CAST(0 AS DOUBLE) AS PRED_Y_LON FROM b_test
  UNION ALL SELECT *, 'Linear Extrapolation', DELTA_LAT * (horizon / 6), DELTA_LON * (horizon / 6) FROM b_test
  UNION ALL SELECT *, 'Climatology', c_lat, c_lon FROM b_test),
b_pos AS (SELECT *, {_TRUE[0]} AS TRUE_LAT, {_TRUE[1]} AS TRUE_LON, {_PRED[0]} AS PRED_LAT, {_PRED[1]} AS PRED_LON FROM b_pred),
b_err AS (SELECT *, {hav(*_POS)} AS ERROR_KM, {bearing(*_POS, null=False)} AS hb,
  {bearing('LAT', 'LON', 'TRUE_LAT', 'TRUE_LON')} AS mb FROM b_pos),
scored AS MATERIALIZED (SELECT * EXCLUDE (hb, mb, c_lat, c_lon), ERROR_KM * cos({_THETA}) AS ALONG_TRACK_KM,
  ERROR_KM * sin({_THETA}) AS CROSS_TRACK_KM FROM b_err)"""


def with_split(select: str, *more: str) -> str:
    return with_features(select, SPLIT, ROWS, *more)


def with_scored(select: str, *more: str) -> str:
    return with_split(select, CLIMATOLOGY, BASELINES, *more)
