"""Registered queries of validation, preparation, splits and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline import constants as K
from driftline.operators import split as S
from driftline.operators import validate as V
from driftline.plans.feature_queries import REQUESTS_SQL, requests_table
from driftline.plans.registry import query, rounded
from driftline.plans.sql import columns, diff, prepared, r, seeded, with_clean, with_features, with_split
from driftline.plans.stages import stage_path
from driftline.plans.tables import feature_table, forecast_row_table, split_table

_SEG = "PARTITION BY SEGMENT_ID ORDER BY ISO_TIME"
_LAGS = [(s, p, k) for s, p in K.LAG_SOURCES.items() for k in (1, 2, 3)]


def union(parts):
    return "\nUNION ALL ".join(parts)


@query("check_schema")
def _(spark, sf):
    return V.check_schema(feature_table(spark, sf))


@query("check_duplicates", with_features(
    "SELECT count(*) - count(DISTINCT (SID, ISO_TIME)) AS n_duplicates FROM features"))
def _(spark, sf):
    return V.check_duplicates(feature_table(spark, sf))


# By storm: the segments themselves have no gaps.
@query("check_segment_spacing", with_features(
    """SELECT CAST(date_diff('second', p, ISO_TIME) AS DOUBLE) / 3600 AS gap_hours, count(*) AS n FROM (
      SELECT ISO_TIME, lag(ISO_TIME) OVER (PARTITION BY SID ORDER BY ISO_TIME) AS p FROM features)
    WHERE ISO_TIME <> p + INTERVAL 6 HOUR GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def _(spark, sf):
    return V.check_segment_spacing(feature_table(spark, sf).drop("SEGMENT_ID"))


_LAG_EXPECTED = f"""chk AS (SELECT *, {', '.join(
    f'lag({s}, {k}) OVER ({_SEG}) AS e_{p}_{k}' for s, p, k in _LAGS)} FROM features)"""


@query("check_lags", with_features(union(
    f"""SELECT '{p}_LAG_{k}' AS column_name,
    count(*) FILTER (WHERE abs({p}_LAG_{k} - e_{p}_{k}) > 1e-6) AS n_mismatched,
    count(*) FILTER (WHERE {p}_LAG_{k} IS NOT NULL AND e_{p}_{k} IS NULL) AS n_crossed FROM chk"""
    for _, p, k in _LAGS), _LAG_EXPECTED))
def _(spark, sf):
    return V.check_lags(feature_table(spark, sf))


ALIGNED = f"""probe AS ({union(
    f'''SELECT SID, ISO_TIME, {h} AS horizon, LAT + TARGET_DLAT_{h}H AS e_lat, LON + TARGET_DLON_{h}H AS e_lon
    FROM features WHERE TARGET_DLAT_{h}H IS NOT NULL AND TARGET_DLON_{h}H IS NOT NULL''' for h in K.HORIZONS)}),
joined AS (SELECT p.*, f.LAT AS t_lat, f.LON AS t_lon, abs(e_lat - f.LAT) AS d_lat,
  abs({diff('e_lon', 'f.LON')}) AS d_lon FROM probe p
  LEFT JOIN features f ON p.SID = f.SID AND f.ISO_TIME = p.ISO_TIME + to_hours(p.horizon))"""


@query("verify_targets", with_features(
    f"""SELECT SID, ISO_TIME, horizon, {r('t_lat')} AS TRUE_LAT, {r('t_lon')} AS TRUE_LON,
    {r('d_lat')} AS LAT_ERROR, {r('d_lon')} AS LON_ERROR FROM joined""", ALIGNED))
def _(spark, sf):
    return rounded(V.verify_targets(feature_table(spark, sf)).select(
        "SID", "ISO_TIME", "horizon", "TRUE_LAT", "TRUE_LON", "LAT_ERROR", "LON_ERROR"))


@query("check_target_alignment", with_features(
    f"""SELECT horizon, count(*) AS n_targets, count(*) FILTER (WHERE t_lat IS NULL) AS n_unmatched,
    count(*) FILTER (WHERE d_lat > 1e-6 OR d_lon > 1e-6) AS n_mismatched,
    {r('greatest(max(d_lat), max(d_lon))')} AS max_error FROM joined GROUP BY 1""", ALIGNED))
def _(spark, sf):
    return rounded(V.check_target_alignment(feature_table(spark, sf)))


_PLACED = """placed AS (SELECT *, row_number() OVER (PARTITION BY SEGMENT_ID ORDER BY ISO_TIME) - 1 AS pos,
  row_number() OVER (PARTITION BY SEGMENT_ID ORDER BY ISO_TIME DESC) - 1 AS tail FROM features)"""
_MISSING = ([(c, "true") for c in ("LAT", "LON", "WMO_WIND", "WMO_PRES")]
            + [(f"{p}_LAG_{k}", f"pos >= {k}") for _, p, k in _LAGS]
            + [(c, f"tail >= {K.steps(h)}") for h in K.HORIZONS for c in K.target_columns(h)])


@query("check_missing", with_features(union(
    f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL AND {w}) AS n_unexpected
    FROM placed""" for c, w in _MISSING), _PLACED))
def _(spark, sf):
    return V.check_missing(feature_table(spark, sf))


_DOUBLES = [c for c in (*K.FEATURES, "STORM_DIR", "BEARING",
                        *[c for h in K.HORIZONS for m in K.TARGET_MODES
                          for c in K.target_columns(h, m)])
            if c not in ("MONTH", "DAY", "HOUR", "DAY_OF_YEAR", "INTENSITY_CATEGORY", "BASIN_CODE")]


@query("check_infinite", with_features(union(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE isinf({c})) AS n_infinite FROM features"
    for c in _DOUBLES)))
def _(spark, sf):
    return V.check_infinite(feature_table(spark, sf))


@query("check_ranges", with_features(union(
    f"""SELECT '{c}' AS column_name, '{level}' AS severity, CAST({low} AS DOUBLE) AS low,
    CAST({high} AS DOUBLE) AS high, count(*) FILTER (WHERE {c} < {low} OR {c} > {high}) AS n_outside,
    {r(f'min({c})')} AS min_value, {r(f'max({c})')} AS max_value FROM features"""
    for c, (low, high), level in V.RANGES)))
def _(spark, sf):
    return rounded(V.check_ranges(feature_table(spark, sf)))


@query("check_leakage", with_features(union(
    f"""SELECT '{f}' AS feature, '{t}' AS target, count(*) AS n, {r(f'corr({f}, {t})')} AS r FROM complete"""
    for f in K.FEATURES for t in K.target_columns(72)),
    f"complete AS MATERIALIZED (SELECT * FROM features WHERE {prepared(72)})"))
def _(spark, sf):
    return rounded(V.check_leakage(feature_table(spark, sf)))


@query("usable_samples", with_features(union(
    f"""SELECT {h} AS horizon, count(*) AS usable_rows, count(DISTINCT SID) AS storms,
    {r('count(*) / (SELECT count(*) FROM features) * 100')} AS pct_of_total FROM features WHERE {prepared(h)}"""
    for h in K.HORIZONS)))
def _(spark, sf):
    return rounded(V.usable_samples(feature_table(spark, sf)))


def _ok(check, message, n="0", bad="false", level="error"):
    return (f"SELECT {check} AS check, CASE WHEN {bad} THEN '{level}' ELSE 'ok' END AS level, "
            f"{message} AS message, CAST({n} AS BIGINT) AS n")


VALIDATION = union([
    *[_ok(f"'schema_{k}'", f"'all {k} present'") for k in ("features", "targets", "ids")],
    _ok("'schema_overlap'", "'features that are targets: none'"),
    _ok("'schema_time'", "'ISO_TIME is timestamp_ntz'"),
    "SELECT 'duplicates', CASE WHEN n > 0 THEN 'error' ELSE 'ok' END, n || ' duplicate (SID, ISO_TIME) rows', n FROM "
    "(SELECT count(*) - count(DISTINCT (SID, ISO_TIME)) AS n FROM features)",
    "SELECT 'spacing', CASE WHEN n > 0 THEN 'error' ELSE 'ok' END, n || ' gaps inside SEGMENT_ID other than 6 h', n FROM "
    f"(SELECT count(*) AS n FROM (SELECT ISO_TIME, lag(ISO_TIME) OVER ({_SEG}) AS p FROM features) "
    "WHERE ISO_TIME <> p + INTERVAL 6 HOUR)",
    *[f"""SELECT 'lag_{p}_LAG_{k}', CASE WHEN a + b > 0 THEN 'error' ELSE 'ok' END,
      a || ' mismatches, ' || b || ' values across a boundary', a + b FROM (SELECT
      count(*) FILTER (WHERE abs({p}_LAG_{k} - e_{p}_{k}) > 1e-6) AS a,
      count(*) FILTER (WHERE {p}_LAG_{k} IS NOT NULL AND e_{p}_{k} IS NULL) AS b FROM chk)""" for _, p, k in _LAGS],
    """SELECT 'target_' || horizon || 'h', CASE WHEN a + b > 0 THEN 'error' ELSE 'ok' END,
      a || ' of ' || n || ' targets without observation, ' || b || ' mismatched', a + b FROM (SELECT horizon,
      count(*) AS n, count(*) FILTER (WHERE t_lat IS NULL) AS a,
      count(*) FILTER (WHERE d_lat > 1e-6 OR d_lon > 1e-6) AS b FROM joined GROUP BY 1)""",
    *[f"""SELECT 'missing_{c}', CASE WHEN n > 0 THEN 'error' ELSE 'ok' END, n || ' unexpected missing values', n
      FROM (SELECT count(*) FILTER (WHERE {c} IS NULL AND {w}) AS n FROM placed)""" for c, w in _MISSING],
    *[f"""SELECT 'infinite_{c}', CASE WHEN n > 0 THEN 'error' ELSE 'ok' END, n || ' infinite values', n
      FROM (SELECT count(*) FILTER (WHERE isinf({c})) AS n FROM features)""" for c in _DOUBLES],
    *[f"""SELECT {"'range_" + c + "'" if level == 'error' else "'range_tropical'"},
      CASE WHEN n > 0 THEN '{level}' ELSE 'ok' END,
      n || '{' values out of bounds' if level == 'error' else ' rows outside the tropical band'}', n
      FROM (SELECT count(*) FILTER (WHERE {c} < {low} OR {c} > {high}) AS n FROM features)"""
      for c, (low, high), level in V.RANGES],
    f"""SELECT 'leakage', CASE WHEN n < 100 THEN 'warn' WHEN hits > 0 THEN 'error' ELSE 'ok' END,
      CASE WHEN n < 100 THEN 'too few complete rows' ELSE hits || ' correlations above 0.99' END,
      CASE WHEN n < 100 THEN 0 ELSE hits END FROM (SELECT count(*) AS n, CAST({' + '.join(
          f'coalesce(CAST(abs(corr({f}, {t})) > 0.99 AS INTEGER), 0)' for f in K.FEATURES
          for t in K.target_columns(72))} AS BIGINT) AS hits FROM features WHERE {prepared(72)})""",
    *[f"""SELECT 'usable_{h}h', CASE WHEN n = 0 THEN 'error' ELSE 'ok' END, n || ' usable rows of ' || s || ' storms',
      CAST(n = 0 AS BIGINT) FROM (SELECT count(*) AS n, count(DISTINCT SID) AS s FROM features WHERE {prepared(h)})"""
      for h in K.HORIZONS]])


@query("validate", with_features(VALIDATION, _LAG_EXPECTED, ALIGNED, _PLACED))
def _(spark, sf):
    return V.validate(feature_table(spark, sf), strict=False)


# ------------------------------------------------------------------ preparation
@query("prepare_training", with_features(
    f"SELECT {columns((*K.ID_COLUMNS, *K.FEATURES, *K.target_columns(24)))} FROM features WHERE {prepared(24)}"))
def _(spark, sf):
    return rounded(S.prepare_training(feature_table(spark, sf)).select(
        *K.ID_COLUMNS, *K.FEATURES, *K.target_columns(24)))


@query("preparation_report", with_features(
    f"""SELECT 24 AS horizon, count(*) AS n_rows, count(*) FILTER (WHERE {prepared(24)}) AS usable_rows,
    {r(f'count(*) FILTER (WHERE {prepared(24)}) / count(*) * 100')} AS kept_pct FROM features"""))
def _(spark, sf):
    return rounded(S.preparation_report(feature_table(spark, sf)))


@query("season_split", with_split("SELECT SID, split FROM split"))
def _(spark, sf):
    return S.season_split(S.prepare_training(feature_table(spark, sf), 6))


@query("storm_split", with_features(
    f"""SELECT SID, CASE WHEN p < floor(n * CAST({K.TRAIN_RATIO} AS DOUBLE)) THEN 'train'
    WHEN p < floor(n * CAST({K.TRAIN_RATIO} AS DOUBLE)) + floor(n * CAST({K.VAL_RATIO} AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT SID, row_number() OVER (ORDER BY {seeded('SID')}, SID) - 1 AS p, count(*) OVER () AS n
      FROM (SELECT DISTINCT SID FROM features))"""))
def _(spark, sf):
    return S.storm_split(feature_table(spark, sf))


@query("split_overlap", with_split(union(
    f"""SELECT '{a}_{b}' AS pair, count(*) AS n_storms FROM (SELECT SID FROM split WHERE split = '{a}'
    INTERSECT SELECT SID FROM split WHERE split = '{b}')"""
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")))))
def _(spark, sf):
    return S.split_overlap(split_table(spark, sf))


# A stored split without its test storms: these belong to no partition then.
@query("split_coverage", with_split(
    "SELECT SID FROM features EXCEPT SELECT SID FROM split WHERE split <> 'test'"))
def _(spark, sf):
    stale = split_table(spark, sf).where("split <> 'test'")
    return S.split_coverage(feature_table(spark, sf), stale)


@query("validate_split", with_split(union([
    *[f"""SELECT 'overlap_{a}_{b}' AS check, CASE WHEN n > 0 THEN 'error' ELSE 'ok' END AS level,
      n || ' storms in both' AS message, n FROM (SELECT count(*) AS n FROM (SELECT SID FROM split WHERE split = '{a}'
      INTERSECT SELECT SID FROM split WHERE split = '{b}'))"""
      for a, b in (("train", "val"), ("train", "test"), ("val", "test"))],
    """SELECT 'coverage', CASE WHEN n > 0 THEN 'error' ELSE 'ok' END, n || ' storms in no partition', n FROM
      (SELECT count(*) AS n FROM (SELECT SID FROM features EXCEPT SELECT SID FROM split))""",
    *[f"""SELECT 'size_{s}', CASE WHEN c = 0 THEN 'error' ELSE 'ok' END, c || ' storms', CAST(c = 0 AS BIGINT)
      FROM (SELECT count(*) AS c FROM split WHERE split = '{s}')""" for s in ("train", "test")]])))
def _(spark, sf):
    return S.validate_split(feature_table(spark, sf), split_table(spark, sf))


@query("save_split", with_split(
    f"""SELECT '{K.fingerprint(K.split_config())}' AS fingerprint, split, count(*) AS n_storms
    FROM split GROUP BY ALL"""))
def _(spark, sf):
    path = stage_path(spark, sf, "split_store")
    S.save_split(split_table(spark, sf), path, K.split_config())
    return S.stored_split_counts(spark, path)


@query("load_split", with_split("SELECT SID, split FROM split"))
def _(spark, sf):
    path = stage_path(spark, sf, "split_store_2")
    S.save_split(split_table(spark, sf), path, K.split_config())
    return S.load_split(spark, path, K.split_config())


@query("resolve_split", with_split("SELECT SID, split FROM split"))
def _(spark, sf):
    path = stage_path(spark, sf, "split_store_3")
    rows = S.prepare_training(feature_table(spark, sf), 6)
    S.resolve_split(rows, path)
    return S.resolve_split(rows, path)


@query("assign_split_rows", with_split(
    "SELECT f.SID, SEGMENT_ID, ISO_TIME, split FROM features f JOIN split USING (SID)"))
def _(spark, sf):
    return S.assign_split_rows(feature_table(spark, sf), split_table(spark, sf)).select(
        "SID", "SEGMENT_ID", "ISO_TIME", "split")


@query("split_summary", with_split(
    f"""SELECT split, count(*) AS n_rows, count(DISTINCT SID) AS storms, min(SEASON) AS season_min,
    max(SEASON) AS season_max, {r('count(*) / sum(count(*)) OVER () * 100')} AS share_pct,
    split = 'test' AND count(DISTINCT SID) < 50 AS few_storms
    FROM rows_split WHERE horizon = 24 GROUP BY split"""))
def _(spark, sf):
    return rounded(S.split_summary(S.prepare_data(feature_table(spark, sf), 24,
                                                  split_table(spark, sf))))


@query("prepare_data", with_split(
    f"""SELECT {columns(K.META_COLUMNS)}, split, {r('Y_LAT')} AS TARGET_DLAT_24H, {r('Y_LON')} AS TARGET_DLON_24H
    FROM rows_split WHERE horizon = 24"""))
def _(spark, sf):
    return rounded(S.prepare_data(feature_table(spark, sf)).select(
        *K.META_COLUMNS, "split", *K.target_columns(24)))


@query("forecast_rows", with_split(
    f"SELECT {columns(K.META_COLUMNS)}, horizon, {r('Y_LAT')} AS Y_LAT, {r('Y_LON')} AS Y_LON FROM rows_all"))
def _(spark, sf):
    return rounded(S.forecast_rows(feature_table(spark, sf)).select(
        *K.META_COLUMNS, "horizon", "Y_LAT", "Y_LON"))


@query("subsample_train", with_split(
    f"""SELECT horizon, split, count(*) AS n FROM rows_split
    WHERE split <> 'train' OR {seeded('SID', 'ISO_TIME')} < {1 << 51} GROUP BY ALL"""))
def _(spark, sf):
    kept = S.subsample_train(forecast_row_table(spark, sf), 0.5)
    return kept.groupBy("horizon", "split").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------- requests
REQUEST_CHECKS_SQL = """
q_req AS (SELECT request_id, max(n) AS n, max(CAST(WMO_PRES < 905 AS INTEGER)) AS low,
  CASE WHEN length(request_id) % 4 = 1 THEN 7 ELSE 24 END AS h FROM q_rows GROUP BY 1)"""


@query("validate_requests", with_clean(
    """SELECT request_id, CAST(n AS INTEGER) AS n_observations,
    concat_ws(',', CASE WHEN low = 1 THEN 'pressure' END, CASE WHEN h = 7 THEN 'forecast_horizon' END) AS reasons,
    low = 0 AND h <> 7 AS accepted, n < 5 AS short_history FROM q_req""",
    REQUESTS_SQL,
    REQUEST_CHECKS_SQL))
def _(spark, sf):
    broken = F.transform("observations", lambda o: F.struct(
        o["latitude"].alias("latitude"), o["longitude"].alias("longitude"),
        o["wind_speed"].alias("wind_speed"),
        F.when(o["pressure"] < 905, F.lit(-5.0)).otherwise(o["pressure"]).alias("pressure")))
    requests = requests_table(spark, sf).withColumns({
        "observations": broken, "model": F.lit("random_forest"),
        "forecast_horizon": F.when(F.length("request_id") % 4 == 1, 7).otherwise(24)})
    return V.validate_requests(requests).select(
        "request_id", "n_observations", "reasons", "accepted", "short_history")
