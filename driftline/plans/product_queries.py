"""Registered queries of the forecast products and the analysis tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions.joins import broadcast_if_small
from driftline.operators import analysis as A
from driftline.operators import forecast as T
from driftline.operators import metrics as M
from driftline.plans.metric_queries import PAIRED, evaluation, with_evaluation, with_weights
from driftline.plans.registry import query, rounded
from driftline.plans.sql import columns, diff, hav, r, seeded, with_clean, with_features, with_scored, wrap
from driftline.plans.stages import stage
from driftline.plans.tables import baseline_table, clean_table, feature_table, forecast_row_table

PROD = """
prod AS (SELECT model, SID, ISO_TIME, horizon AS LEAD_HOURS, BASIN, LAT AS CURRENT_LAT, LON AS CURRENT_LON,
  PRED_LAT, PRED_LON, TRUE_LAT, TRUE_LON, ERROR_KM, ALONG_TRACK_KM, CROSS_TRACK_KM FROM scored)"""
COLS = ("model", *T.PRODUCT)


def with_products(select, *more):
    return with_scored(select, PROD, *more)


def products(spark, sf):
    return T.product_columns(baseline_table(spark, sf))


# ------------------------------------------------------------- forecast products
@query("score_split_head", with_products(
    f"SELECT {columns(COLS, 5)} FROM prod ORDER BY SID, ISO_TIME, LEAD_HOURS, model LIMIT 500"))
def _(spark, sf):
    return rounded(T.score_split(baseline_table(spark, sf), 500), 5)


TRACK = """
track AS (SELECT *, avg(ERROR_KM) OVER (PARTITION BY model, SID) AS MEAN_ERROR_KM FROM (SELECT * FROM prod
  QUALIFY row_number() OVER (PARTITION BY model, SID, LEAD_HOURS ORDER BY ISO_TIME) = 1))"""


@query("forecast_track", with_products(
    f"SELECT {columns((*COLS, 'MEAN_ERROR_KM'), 5)} FROM track", TRACK))
def _(spark, sf):
    return rounded(T.forecast_track(products(spark, sf)), 5)


@query("storm_lead_path", with_products(
    f"""SELECT model, SID, path, LEAD_HOURS, {r('LAT')} AS LAT, {r('LON')} AS LON FROM (
    SELECT model, SID, 'observed' AS path, LEAD_HOURS, TRUE_LAT AS LAT, TRUE_LON AS LON FROM track
    UNION ALL SELECT model, SID, 'forecast', LEAD_HOURS, PRED_LAT, PRED_LON FROM track
    UNION ALL SELECT model, SID, p.path, 0, CURRENT_LAT, CURRENT_LON FROM (SELECT * FROM track
      QUALIFY row_number() OVER (PARTITION BY model, SID ORDER BY LEAD_HOURS) = 1),
      (VALUES ('observed'), ('forecast')) p(path))""", TRACK))
def _(spark, sf):
    return rounded(T.storm_lead_path(T.forecast_track(products(spark, sf))))


@query("list_storms", with_scored(
    """SELECT SID, count(*) AS observations, min(ISO_TIME) AS first_time, arg_min(BASIN, ISO_TIME) AS basin
    FROM rows_split WHERE horizon = 24 AND split = 'test' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def _(spark, sf):
    return T.list_storms(forecast_row_table(spark, sf).where("horizon = 24 AND split = 'test'"))


_ADV = ("LAT", "LON", "ABS_LAT", "DELTA_LAT", "DELTA_LON", "STORM_AGE", "LAT_LAG_1", "LAT_LAG_2",
        "LAT_LAG_3", "LON_LAG_1", "LON_LAG_2", "LON_LAG_3", "WMO_WIND")


@query("advance_features", with_features(
    f"""SELECT SID, ISO_TIME, {', '.join(f'{r(e)} AS {c}' for c, e in {
        'LAT': 'n_lat', 'LON': 'n_lon', 'ABS_LAT': 'abs(n_lat)', 'DELTA_LAT': 'n_lat - LAT',
        'DELTA_LON': diff('n_lon', 'LON'), 'STORM_AGE': 'STORM_AGE + 6', 'LAT_LAG_1': 'LAT',
        'LAT_LAG_2': 'LAT_LAG_1', 'LAT_LAG_3': 'LAT_LAG_2', 'LON_LAG_1': 'LON', 'LON_LAG_2': 'LON_LAG_1',
        'LON_LAG_3': 'LON_LAG_2', 'WMO_WIND': 'WMO_WIND'}.items())}
    FROM (SELECT *, LAT + DELTA_LAT AS n_lat, {wrap('LON + DELTA_LON')} AS n_lon FROM features)"""))
def _(spark, sf):
    from driftline.functions.geo import wrap_degrees
    df = feature_table(spark, sf)
    moved = T.advance_features(df, F.col("LAT") + F.col("DELTA_LAT"),
                               wrap_degrees(F.col("LON") + F.col("DELTA_LON")))
    return rounded(moved.select("SID", "ISO_TIME", *_ADV))


def constant_motion(df):
    return df.withColumns({"PRED_Y_LAT": F.col("DELTA_LAT"), "PRED_Y_LON": F.col("DELTA_LON")})


# The roll-out of constant motion is known in closed form: k steps are k deltas.
@query("verify_forecast", with_scored(
    f"""SELECT s.SID, VALID_TIME, LEAD_HOURS, {r('p_lat')} AS PRED_LAT, {r('p_lon')} AS PRED_LON, {r('f.LAT')} AS TRUE_LAT,
    {r('f.LON')} AS TRUE_LON, {r(hav('f.LAT', 'f.LON', 'p_lat', 'p_lon'), 5)} AS ERROR_KM
    FROM (SELECT SID, ISO_TIME + to_hours(CAST(k * 6 AS INTEGER)) AS VALID_TIME, CAST(k * 6 AS INTEGER) AS LEAD_HOURS,
      LAT + k * DELTA_LAT AS p_lat, {wrap('LON + k * DELTA_LON')} AS p_lon FROM (
        SELECT * FROM rows_split WHERE split = 'test' AND horizon = 6
        QUALIFY row_number() OVER (PARTITION BY SID ORDER BY ISO_TIME) = 1), range(1, 13) t(k)) s
    LEFT JOIN features f ON f.SID = s.SID AND f.ISO_TIME = s.VALID_TIME"""))
def _(spark, sf):
    out = T.forecast_recursive(start_rows(spark, sf), feature_table(spark, sf), constant_motion)
    digits = {"ERROR_KM": 5}
    return out.select("SID", "VALID_TIME", "LEAD_HOURS", *[
        F.round(c, digits.get(c, 6)).alias(c)
        for c in ("PRED_LAT", "PRED_LON", "TRUE_LAT", "TRUE_LON", "ERROR_KM")])


def start_rows(spark, sf):
    """The first complete test row of every storm, with all features."""
    keys = stage(spark, sf, "start_keys", lambda: T.first_usable_rows(
        forecast_row_table(spark, sf).where("split = 'test' AND horizon = 6").select("SID", "ISO_TIME")))
    return feature_table(spark, sf).join(broadcast_if_small(keys), ["SID", "ISO_TIME"])


# ------------------------------------------------------------------ the data set
@query("dataset_summary", with_features(
    """SELECT CAST(sum(n) AS BIGINT) AS observations, count(DISTINCT SID) AS storms, count(*) AS segments,
    CAST(floor(median(n)) AS INTEGER) AS median_track_rows, CAST(floor(median(n) * 6) AS INTEGER) AS median_track_hours,
    min(lo) AS season_min, max(hi) AS season_max FROM (SELECT SID, SEGMENT_ID, count(*) AS n, min(SEASON) AS lo,
    max(SEASON) AS hi FROM features GROUP BY ALL)"""))
def _(spark, sf):
    return A.dataset_summary(feature_table(spark, sf))


@query("storms_per_season", with_features(
    "SELECT SEASON, count(DISTINCT SID) AS storms FROM features GROUP BY 1 ORDER BY 1"))
def _(spark, sf):
    return A.storms_per_season(feature_table(spark, sf))


@query("storms_per_basin", with_features(
    "SELECT BASIN, count(DISTINCT SID) AS storms FROM features GROUP BY 1 ORDER BY 2, 1"))
def _(spark, sf):
    return A.storms_per_basin(feature_table(spark, sf))


NAMES = "['TD','TS','Cat 1','Cat 2','Cat 3','Cat 4','Cat 5']"


@query("intensity_distribution", with_features(
    f"""SELECT INTENSITY_CATEGORY, count(*) AS n, {NAMES}[INTENSITY_CATEGORY + 1] AS name
    FROM features WHERE INTENSITY_CATEGORY IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    return A.intensity_distribution(feature_table(spark, sf))


def histogram_sql(source, value, bins, groups=(), digits=6):
    """CTE text ``hist`` over (groups, value) of a source."""
    g = "".join(f"{c}, " for c in groups)
    on = " AND ".join(f"h.{c} = s.{c}" for c in groups) or "true"
    by = f"GROUP BY {', '.join(groups)}" if groups else ""
    return f"""
hist AS (SELECT {g}bin, {r('lo + bin * w', digits)} AS left_edge, {r('lo + (bin + 1) * w', digits)} AS right_edge,
  count(*) AS n FROM (SELECT {''.join(f'h.{c}, ' for c in groups)}lo, w, CAST(CASE WHEN w > 0
    THEN least(floor(({value} - lo) / w), {bins - 1}) ELSE 0 END AS INTEGER) AS bin
    FROM {source} h JOIN (SELECT {g}min({value}) AS lo, (max({value}) - min({value})) / {bins} AS w FROM {source} {by}) s
    ON {on} WHERE {value} IS NOT NULL) GROUP BY ALL)"""


LENGTHS = """
lengths AS (SELECT SEGMENT_ID, CAST(count(*) AS DOUBLE) AS len FROM features GROUP BY 1)"""


@query("segment_length_distribution", with_features(
    "SELECT *, (SELECT median(len) FROM lengths) AS median_length FROM hist", LENGTHS,
    histogram_sql("lengths", "len", 40)))
def _(spark, sf):
    return rounded(A.segment_length_distribution(feature_table(spark, sf)))


MOVED = "\nmoved AS (" + " UNION ALL ".join(
    f"""SELECT SID, ISO_TIME, {h} AS horizon, {hav('LAT', 'LON', f'(LAT + TARGET_DLAT_{h}H)', f'(LON + TARGET_DLON_{h}H)')} AS km
    FROM features WHERE TARGET_DLAT_{h}H IS NOT NULL AND TARGET_DLON_{h}H IS NOT NULL""" for h in K.HORIZONS) + ")"


@query("displacement_by_lead", with_features(
    f"""SELECT horizon, count(*) AS n, {r('median(km)')} AS median_km, {r('quantile_cont(km, 0.9)')} AS p90_km
    FROM moved GROUP BY 1""", MOVED))
def _(spark, sf):
    return rounded(A.displacement_by_lead(feature_table(spark, sf)))


@query("displacement_density", with_features(
    f"""SELECT horizon, bin, left_edge, right_edge, n,
    {r('n / sum(n) OVER (PARTITION BY horizon) / (right_edge - left_edge)', 5)} AS density FROM hist""",
    MOVED, histogram_sql("moved", "km", 60, ["horizon"])))
def _(spark, sf):
    out = A.displacement_density(feature_table(spark, sf))
    return out.select("horizon", "bin", F.round("left_edge", 6).alias("left_edge"),
                      F.round("right_edge", 6).alias("right_edge"), "n",
                      F.round("density", 5).alias("density"))


MIDDLE = K.HORIZONS[len(K.HORIZONS) // 2]
_MIDDLE = ", ".join(f"{r(c)} AS {c}" for c in K.target_columns(MIDDLE))


@query("displacement_sample", with_features(
    f"""SELECT SID, ISO_TIME, {_MIDDLE} FROM features WHERE {K.target_columns(MIDDLE)[0]} IS NOT NULL
    AND {K.target_columns(MIDDLE)[1]} IS NOT NULL ORDER BY {seeded('SID', 'ISO_TIME')}, SID, ISO_TIME LIMIT 400"""))
def _(spark, sf):
    return rounded(A.displacement_sample(feature_table(spark, sf), 400))


@query("track_sample", with_features(
    f"""SELECT SID, SEGMENT_ID, ISO_TIME, BASIN, {r('LAT')} AS LAT, {r('LON')} AS LON, PART FROM (
      SELECT *, CAST(sum(jump) OVER (PARTITION BY SEGMENT_ID ORDER BY ISO_TIME ROWS UNBOUNDED PRECEDING) AS INTEGER) AS PART
      FROM (SELECT *, CASE WHEN abs(LON - lag(LON) OVER (PARTITION BY SEGMENT_ID ORDER BY ISO_TIME)) > 180 THEN 1 ELSE 0
      END AS jump FROM features WHERE (SID, SEGMENT_ID) IN (SELECT (SID, SEGMENT_ID) FROM (
        SELECT DISTINCT SID, SEGMENT_ID FROM features) ORDER BY {seeded('SID', 'SEGMENT_ID')}, SID, SEGMENT_ID LIMIT 30)))
    QUALIFY count(*) OVER (PARTITION BY SEGMENT_ID, PART) > 1"""))
def _(spark, sf):
    return rounded(A.track_sample(feature_table(spark, sf), 30).select(
        "SID", "SEGMENT_ID", "ISO_TIME", "BASIN", "LAT", "LON", "PART"))


@query("split_at_antimeridian", with_clean(
    f"""SELECT SID, SEGMENT_ID, ISO_TIME, {r('LON')} AS LON, PART FROM (SELECT *, CAST(sum(jump) OVER (
      PARTITION BY SEGMENT_ID ORDER BY ISO_TIME ROWS UNBOUNDED PRECEDING) AS INTEGER) AS PART FROM (SELECT *,
      CASE WHEN abs(LON - lag(LON) OVER (PARTITION BY SEGMENT_ID ORDER BY ISO_TIME)) > 180 THEN 1 ELSE 0 END AS jump
      FROM clean)) QUALIFY count(*) OVER (PARTITION BY SEGMENT_ID, PART) > 1"""))
def _(spark, sf):
    return rounded(A.split_at_antimeridian(clean_table(spark, sf)).select(
        "SID", "SEGMENT_ID", "ISO_TIME", "LON", "PART"))


# ------------------------------------------------------------------ error tables
G = "model, LEAD_HOURS"


@query("error_distribution", with_products(
    f"""SELECT h.*, {r('m')} AS mean_km, {r('md')} AS median_km, {r('p')} AS p90_km FROM hist h JOIN (SELECT {G},
    avg(ERROR_KM) AS m, median(ERROR_KM) AS md, quantile_cont(ERROR_KM, 0.9) AS p FROM prod GROUP BY {G}) s
    ON h.model = s.model AND h.LEAD_HOURS = s.LEAD_HOURS""",
    histogram_sql("prod", "ERROR_KM", 60, ["model", "LEAD_HOURS"])))
def _(spark, sf):
    return rounded(A.error_distribution(products(spark, sf)))


@query("cumulative_within", with_products("\nUNION ALL ".join(
    f"""SELECT model, {t} AS threshold_km, {r(f'avg(CAST(ERROR_KM <= {t} AS DOUBLE)) * 100')} AS within_pct
    FROM prod WHERE LEAD_HOURS = 24 GROUP BY 1""" for t in K.THRESHOLDS_KM)))
def _(spark, sf):
    return rounded(A.cumulative_within(products(spark, sf)))


CLASSED = """
classed AS (SELECT p.model, p.SID, p.ISO_TIME, LEAD_HOURS, ERROR_KM, INTENSITY_CATEGORY AS category FROM prod p
  JOIN features f ON p.SID = f.SID AND p.ISO_TIME = f.ISO_TIME WHERE INTENSITY_CATEGORY IS NOT NULL)"""
BOX = f"""count(*) AS n, {r('avg(ERROR_KM)')} AS mean_km, {r('quantile_cont(ERROR_KM, 0.25)')} AS q1_km,
  {r('median(ERROR_KM)')} AS median_km, {r('quantile_cont(ERROR_KM, 0.75)')} AS q3_km"""


@query("align_intensity", with_products(
    f"SELECT model, SID, ISO_TIME, LEAD_HOURS, {r('ERROR_KM', 5)} AS ERROR_KM, category FROM classed", CLASSED))
def _(spark, sf):
    return rounded(A.align_intensity(products(spark, sf), feature_table(spark, sf)), 5)


@query("error_by_intensity", with_products(
    f"SELECT {G}, category, {NAMES}[category + 1] AS name, {BOX} FROM classed GROUP BY {G}, category", CLASSED))
def _(spark, sf):
    return rounded(A.error_by_intensity(baseline_table(spark, sf)))


@query("residuals", with_products(
    f"""SELECT h.*, {r('m')} AS mean_residual FROM hist h JOIN (SELECT {G}, axis, avg(residual) AS m FROM res
    GROUP BY ALL) s ON h.model = s.model AND h.LEAD_HOURS = s.LEAD_HOURS AND h.axis = s.axis""",
    f"""res AS (SELECT {G}, 'lat' AS axis, round(TRUE_LAT - PRED_LAT, 9) AS residual FROM prod
    UNION ALL SELECT {G}, 'lon', round(TRUE_LON - PRED_LON, 9) FROM prod)""",
    histogram_sql("res", "residual", 60, ["model", "LEAD_HOURS", "axis"])))
def _(spark, sf):
    return rounded(A.residuals(products(spark, sf)))


@query("error_by_basin_box", with_products(
    f"""SELECT * FROM (SELECT {G}, BASIN, {BOX} FROM prod WHERE BASIN IS NOT NULL GROUP BY {G}, BASIN
    HAVING count(*) >= 50) QUALIFY count(*) OVER (PARTITION BY {G}) >= 2"""))
def _(spark, sf):
    return rounded(A.error_by_basin_box(products(spark, sf)))


@query("storm_lifecycle", with_products(
    f"""SELECT SID, ISO_TIME, CAST(date_diff('second', min(ISO_TIME) OVER (), ISO_TIME) AS DOUBLE) / 3600 AS hours_since_first,
    {r('CURRENT_LAT')} AS CURRENT_LAT, {r('CURRENT_LON')} AS CURRENT_LON, {r('ERROR_KM', 5)} AS ERROR_KM,
    {r('abs(CROSS_TRACK_KM)', 5)} AS ABS_CROSS_TRACK_KM FROM one WHERE SID = (SELECT SID FROM
    (SELECT SID, row_number() OVER (ORDER BY n DESC, SID) - 1 AS k, count(*) OVER () AS total FROM
      (SELECT SID, count(*) AS n FROM one GROUP BY 1 HAVING count(*) >= 8)) WHERE k = total // 2)""",
    "one AS (SELECT * FROM prod WHERE model = 'Linear Extrapolation' AND LEAD_HOURS = 24)"))
def _(spark, sf):
    rows = products(spark, sf).where("model = 'Linear Extrapolation' AND LEAD_HOURS = 24")
    out = A.storm_lifecycle(rows)
    digits = {"ERROR_KM": 5, "ABS_CROSS_TRACK_KM": 5}
    return out.select("SID", "ISO_TIME", "hours_since_first", *[
        F.round(c, digits.get(c, 6)).alias(c)
        for c in ("CURRENT_LAT", "CURRENT_LON", "ERROR_KM", "ABS_CROSS_TRACK_KM")])


# -------------------------------------------------------------------------- maps
@query("choose_storms", with_products(
    f"""SELECT SID, count(*) AS n FROM prod WHERE model = 'Persistence' AND LEAD_HOURS = 24 GROUP BY SID
    HAVING count(*) >= 10 ORDER BY {seeded('SID')}, SID LIMIT 6"""))
def _(spark, sf):
    return A.choose_storms(products(spark, sf).where("model = 'Persistence' AND LEAD_HOURS = 24"))


# The six storms with most rows stand in for the sample, so that SQL can name them.
STORMS = """
six AS (SELECT SID FROM rows_split WHERE horizon = 24 AND split = 'test' GROUP BY 1 ORDER BY count(*) DESC, SID LIMIT 6)"""


@query("observed_vs_forecast", with_products(
    f"""SELECT {columns(COLS, 5)}, abs(PRED_LON - TRUE_LON) <= 180 AS CONNECT,
    ISO_TIME = min(ISO_TIME) OVER (PARTITION BY model, SID, LEAD_HOURS) AS IS_START
    FROM prod WHERE SID IN (SELECT SID FROM six)""", STORMS))
def _(spark, sf):
    storms = T.list_storms(forecast_row_table(spark, sf).where("horizon = 24 AND split = 'test'"), 6)
    return rounded(A.observed_vs_forecast(products(spark, sf), storms).select(
        *COLS, "CONNECT", "IS_START"), 5)


@query("map_extent", with_products(
    f"""SELECT *, lon_max - lon_min > 200 AS IS_GLOBAL FROM (SELECT {G}, count(DISTINCT SID) AS storms,
    {r('avg(ERROR_KM)')} AS mean_km, {r('least(min(CURRENT_LON), min(PRED_LON), min(TRUE_LON)) - 8')} AS lon_min,
    {r('greatest(max(CURRENT_LON), max(PRED_LON), max(TRUE_LON)) + 8')} AS lon_max,
    {r('least(min(CURRENT_LAT), min(PRED_LAT), min(TRUE_LAT)) - 8')} AS lat_min,
    {r('greatest(max(CURRENT_LAT), max(PRED_LAT), max(TRUE_LAT)) + 8')} AS lat_max
    FROM prod WHERE SID IN (SELECT SID FROM six) GROUP BY {G})""", STORMS))
def _(spark, sf):
    storms = T.list_storms(forecast_row_table(spark, sf).where("horizon = 24 AND split = 'test'"), 6)
    return rounded(A.map_extent(A.observed_vs_forecast(products(spark, sf), storms)))


def map_sql(where):
    return with_products(
        f"""SELECT {G}, SID, ISO_TIME, {r('TRUE_LAT')} AS TRUE_LAT, {r('TRUE_LON')} AS TRUE_LON,
        {r('ERROR_KM', 5)} AS ERROR_KM, {r('VMAX', 5)} AS VMAX, {r('least(ERROR_KM, VMAX)', 5)} AS CLIPPED_KM
        FROM (SELECT p.*, VMAX FROM prod p JOIN (SELECT {G}, quantile_cont(ERROR_KM, 0.95) AS VMAX FROM prod
        GROUP BY {G}) s ON p.model = s.model AND p.LEAD_HOURS = s.LEAD_HOURS) WHERE {where}""")


def map_points(df):
    return df.select("model", "LEAD_HOURS", "SID", "ISO_TIME", F.round("TRUE_LAT", 6).alias("TRUE_LAT"),
                     F.round("TRUE_LON", 6).alias("TRUE_LON"), *[
                         F.round(c, 5).alias(c) for c in ("ERROR_KM", "VMAX", "CLIPPED_KM")])


@query("error_map", map_sql("LEAD_HOURS = 24"))
def _(spark, sf):
    return map_points(A.error_map(products(spark, sf)))


@query("error_map_by_lead", map_sql("true"))
def _(spark, sf):
    return map_points(A.error_map_by_lead(products(spark, sf)))


@query("error_map_sample", with_products(
    f"""SELECT {G}, SID, ISO_TIME, {r('TRUE_LAT')} AS TRUE_LAT, {r('TRUE_LON')} AS TRUE_LON, {r('ERROR_KM')} AS ERROR_KM,
    {r('v')} AS VMAX, {r('least(ERROR_KM, v)')} AS CLIPPED_KM FROM thinned JOIN (SELECT {G}, quantile_cont(ERROR_KM, 0.95) AS v
    FROM thinned GROUP BY {G}) USING ({G})""",
    f"""thinned AS MATERIALIZED (SELECT * FROM prod WHERE TRUE_LAT IS NOT NULL AND TRUE_LON IS NOT NULL AND ERROR_KM IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY {seeded('SID', 'ISO_TIME')}, SID, ISO_TIME) <= 100)"""))
def _(spark, sf):
    return rounded(A.error_map_by_lead(products(spark, sf), max_points=100))


@query("error_map_stats", with_products(
    f"""SELECT {G}, count(ERROR_KM) AS n, {r('avg(ERROR_KM)')} AS mean_km, {r('median(ERROR_KM)')} AS median_km
    FROM prod GROUP BY {G}"""))
def _(spark, sf):
    return rounded(A.error_map_stats(products(spark, sf)))


@query("error_grid", with_products(
    f"""SELECT {G}, CAST(floor(TRUE_LAT / 5) * 5 AS DOUBLE) AS cell_lat, CAST(floor(TRUE_LON / 5) * 5 AS DOUBLE) AS cell_lon,
    count(*) AS n, {r('avg(ERROR_KM)')} AS mean_km FROM prod GROUP BY ALL"""))
def _(spark, sf):
    return rounded(A.error_grid(products(spark, sf)))


# ------------------------------------------------------------- growth with lead
@query("error_growth", with_evaluation("SELECT model, horizon, mean_km FROM evaluation"))
def _(spark, sf):
    return rounded(A.error_growth(evaluation(spark, sf)))


@query("alongcross_growth", with_evaluation(
    """SELECT horizon, model, cross_track_mae_km, along_track_mae_km, abs(along_track_bias_km) AS abs_along_track_bias_km
    FROM evaluation QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY mean_km, model) = 1"""))
def _(spark, sf):
    return rounded(A.alongcross_growth(M.best_per_horizon(evaluation(spark, sf))))


@query("alongcross_sample", with_products(
    f"""SELECT model, LEAD_HOURS, SID, ISO_TIME, {r('ALONG_TRACK_KM')} AS ALONG_TRACK_KM,
    {r('CROSS_TRACK_KM')} AS CROSS_TRACK_KM FROM prod WHERE model = 'Linear Extrapolation' AND LEAD_HOURS = 24
    AND ALONG_TRACK_KM IS NOT NULL AND CROSS_TRACK_KM IS NOT NULL
    ORDER BY {seeded('SID', 'ISO_TIME', 'LEAD_HOURS', 'model')}, SID, ISO_TIME LIMIT 100"""))
def _(spark, sf):
    rows = products(spark, sf).where("model = 'Linear Extrapolation' AND LEAD_HOURS = 24")
    return rounded(A.alongcross_sample(rows, 100))


@query("skill_by_lead", with_weights(
    f"""SELECT model, horizon, skill_pct, {r('abs(skill_pct - skill_ci_lower)', 4)} AS arm_lower,
    {r('abs(skill_ci_upper - skill_pct)', 4)} AS arm_upper FROM paired WHERE skill_pct IS NOT NULL""", PAIRED))
def _(spark, sf):
    pairs = M.with_reference_error(baseline_table(spark, sf)).where("model <> 'Persistence'")
    arms = A.skill_by_lead(rounded(M.paired_bootstrap(pairs)))
    return arms.withColumns({c: F.round(c, 4) for c in ("arm_lower", "arm_upper")})
