"""Registered queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline import constants as K
from driftline.operators import clean as C
from driftline.plans.registry import query, rounded
from driftline.plans.sql import r, rs, with_clean, with_raw
from driftline.plans.stages import stage
from driftline.sources.synthetic import raw_tracks

RAW_TEXT = ("WMO_WIND", "WMO_PRES", "STORM_SPEED", "STORM_DIR", "DIST2LAND")
RAW_SELECT = f"""SELECT SID, SEASON, BASIN, SUBBASIN, ISO_TIME, {rs(['LAT', 'LON'])},
  {', '.join(RAW_TEXT)}, NATURE, TRACK_TYPE"""
TYPED_SELECT = f"""SELECT SID, SEASON, BASIN, SUBBASIN, ISO_TIME, {rs(K.NUMERIC_COLUMNS)},
  NATURE, TRACK_TYPE"""


def typed(spark, sf):
    df = C.filter_season(C.filter_track_type(raw_tracks(spark, sf)))
    return C.coerce_types(C.select_columns(df))


def located(spark, sf):
    return C.drop_invalid_coordinates(C.normalize_longitude(typed(spark, sf)))


def unique(spark, sf):
    return C.dedupe_most_complete(C.filter_nature(located(spark, sf)))


def synoptic(spark, sf):
    return C.filter_synoptic(unique(spark, sf))


def filled(spark, sf):
    return C.ffill_causal(synoptic(spark, sf))


def segmented(spark, sf):
    return C.assign_segments(C.drop_missing_intensity(filled(spark, sf)))


def cleaned(spark, sf):
    return C.clean(raw_tracks(spark, sf))


def screened(spark, sf):
    return stage(spark, sf, "screened", lambda: C.screen(raw_tracks(spark, sf)))


@query("raw_tracks", with_raw(f"{RAW_SELECT} FROM raw"))
def _(spark, sf):
    return rounded(raw_tracks(spark, sf))


@query("filter_track_type", with_clean(f"{RAW_SELECT} FROM s_type"))
def _(spark, sf):
    return rounded(C.filter_track_type(raw_tracks(spark, sf)))


@query("filter_season", with_clean(f"{RAW_SELECT} FROM s_season"))
def _(spark, sf):
    return rounded(C.filter_season(C.filter_track_type(raw_tracks(spark, sf))))


@query("select_columns", with_raw(f"{RAW_SELECT} FROM raw"))
def _(spark, sf):
    wide = raw_tracks(spark, sf).withColumn("USA_WIND", F.lit(None).cast("string"))
    return rounded(C.select_columns(wide))


@query("coerce_types", with_clean(f"{TYPED_SELECT} FROM s_typed"))
def _(spark, sf):
    return rounded(typed(spark, sf))


@query("coercion_report", with_raw("\nUNION ALL ".join(
    [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NOT NULL AND "
     f"TRY_CAST({c} AS DOUBLE) IS NULL) AS n_coerced FROM raw" for c in K.NUMERIC_COLUMNS]
    + ["SELECT 'ISO_TIME', count(*) FILTER (WHERE false) FROM raw"])))
def _(spark, sf):
    return C.coercion_report(raw_tracks(spark, sf))


@query("normalize_longitude", with_clean(f"{TYPED_SELECT} FROM s_lon"))
def _(spark, sf):
    return rounded(C.normalize_longitude(typed(spark, sf)))


@query("drop_invalid_coordinates", with_clean(f"{TYPED_SELECT} FROM s_coord"))
def _(spark, sf):
    return rounded(located(spark, sf))


@query("filter_nature", with_clean(f"{TYPED_SELECT} FROM s_nature"))
def _(spark, sf):
    return rounded(C.filter_nature(located(spark, sf)))


@query("nature_distribution", with_clean(
    "SELECT upper(trim(NATURE)) AS nature, count(*) AS n FROM s_coord GROUP BY 1"))
def _(spark, sf):
    return C.nature_distribution(located(spark, sf))


@query("sort_storms", with_clean(f"{TYPED_SELECT} FROM s_nature"))
def _(spark, sf):
    return rounded(C.sort_storms(C.filter_nature(located(spark, sf))))


@query("dedupe_most_complete", with_clean(f"{TYPED_SELECT} FROM s_unique"))
def _(spark, sf):
    return rounded(unique(spark, sf))


@query("filter_synoptic", with_clean(f"{TYPED_SELECT} FROM s_syn"))
def _(spark, sf):
    return rounded(synoptic(spark, sf))


@query("hour_distribution", with_clean(
    """SELECT CAST(hour(ISO_TIME) AS INTEGER) AS hour, count(*) AS n,
    count(*) FILTER (WHERE minute(ISO_TIME) <> 0 OR second(ISO_TIME) <> 0) AS n_off_grid
    FROM s_unique GROUP BY 1"""))
def _(spark, sf):
    return C.hour_distribution(unique(spark, sf))


@query("ffill_causal", with_clean(f"{TYPED_SELECT} FROM s_fill"))
def _(spark, sf):
    return rounded(filled(spark, sf))


@query("fill_report", with_clean("\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, (SELECT count(*) - count({c}) FROM s_syn) AS n_before,
    (SELECT count(*) - count({c}) FROM s_fill) AS n_after,
    (SELECT count({c}) FROM s_fill) - (SELECT count({c}) FROM s_syn) AS n_filled"""
    for c in K.FILL_COLUMNS)))
def _(spark, sf):
    return C.fill_report(synoptic(spark, sf))


@query("drop_missing_intensity", with_clean(f"{TYPED_SELECT} FROM s_int"))
def _(spark, sf):
    return rounded(C.drop_missing_intensity(filled(spark, sf)))


@query("assign_segments", with_clean(f"{TYPED_SELECT}, SEGMENT_ID FROM s_seg"))
def _(spark, sf):
    return rounded(segmented(spark, sf))


@query("segment_counts", with_clean(
    """SELECT count(DISTINCT SID) AS storms, count(DISTINCT SEGMENT_ID) AS segments,
    count(DISTINCT SEGMENT_ID) - count(DISTINCT SID) AS fragmented FROM s_seg"""))
def _(spark, sf):
    return C.segment_counts(segmented(spark, sf))


# On storms instead of segments, so that there are gaps to report.
@query("check_spacing_strict", with_clean(
    """SELECT CAST(date_diff('second', p, ISO_TIME) AS DOUBLE) / 3600 AS gap_hours, count(*) AS n FROM (
      SELECT ISO_TIME, lag(ISO_TIME) OVER (PARTITION BY SID ORDER BY ISO_TIME) AS p FROM s_seg)
    WHERE ISO_TIME <> p + INTERVAL 6 HOUR GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def _(spark, sf):
    by_storm = segmented(spark, sf).withColumn("SEGMENT_ID", F.col("SID"))
    return C.spacing_gaps(by_storm).orderBy(F.desc("n"), "gap_hours").limit(5)


@query("filter_short_segments", with_clean(f"{TYPED_SELECT}, SEGMENT_ID FROM clean"))
def _(spark, sf):
    return rounded(C.filter_short_segments(segmented(spark, sf)))


@query("cleaning_summary", with_clean(
    f"""SELECT (SELECT count(*) FROM raw) AS raw_rows, CAST(sum(n) AS BIGINT) AS clean_rows,
    {r('sum(n) / (SELECT count(*) FROM raw) * 100', 2)} AS retention_pct,
    count(DISTINCT SID) AS storms, count(*) AS segments,
    CAST(floor(median(n)) AS INTEGER) AS median_segment_length,
    min(lo) AS season_min, max(hi) AS season_max
    FROM (SELECT SID, SEGMENT_ID, count(*) AS n, min(SEASON) AS lo, max(SEASON) AS hi
      FROM clean GROUP BY ALL)"""))
def _(spark, sf):
    rows = screened(spark, sf)
    return C.cleaning_summary(C.clean_screened(rows), rows)


@query("retention_funnel", with_clean(
    f"""SELECT stage, stage_no, n_rows, coalesce(p - n_rows, 0) AS n_removed,
      {r('coalesce((p - n_rows) / p * 100, 0)', 4)} AS removed_pct,
      {r('n_rows / f * 100', 4)} AS kept_pct
    FROM (SELECT *, lag(n_rows) OVER (ORDER BY stage_no) AS p, first(n_rows) OVER (ORDER BY stage_no) AS f FROM ("""
    + "\nUNION ALL ".join(
        f"SELECT '{s}' AS stage, {i} AS stage_no, count(*) AS n_rows FROM {t}"
        for i, (s, t) in enumerate(zip(
            C.FUNNEL_STAGES, ("raw", "s_type", "s_season", "s_typed", "s_coord", "s_nature",
                              "s_unique", "s_syn", "s_seg", "clean")), 1)) + "))"))
def _(spark, sf):
    return C.retention_funnel(screened(spark, sf))


@query("clean", with_clean(f"{TYPED_SELECT}, SEGMENT_ID FROM clean"))
def _(spark, sf):
    return rounded(cleaned(spark, sf))


@query("clean_tiled", with_clean(f"{TYPED_SELECT}, SEGMENT_ID FROM clean"))
def _(spark, sf):
    return rounded(C.clean(raw_tracks(spark, sf), tile_hours=24 * 4))


@query("missing_counts", with_clean(
    "SELECT * FROM (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM s_typed"
        for c in K.REQUIRED_COLUMNS) + ") WHERE n_missing > 0"))
def _(spark, sf):
    return C.missing_counts(typed(spark, sf)).orderBy(F.desc("n_missing"), "column_name")


@query("all_missing_entities", with_clean("\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE n = 0) AS n_storms
    FROM (SELECT SID, count({c}) AS n FROM s_typed GROUP BY SID)"""
    for c in ("WMO_WIND", "WMO_PRES"))))
def _(spark, sf):
    return C.all_missing_entities(typed(spark, sf))


@query("fill_simulation", with_clean(
    """SELECT count(*) - count(WMO_WIND) AS wind_missing_before,
    count(*) - count(WMO_PRES) AS pressure_missing_before,
    count(*) - count(fw) AS wind_missing_after, count(*) - count(fp) AS pressure_missing_after,
    count(*) FILTER (WHERE fw IS NULL OR fp IS NULL) AS rows_still_missing
    FROM (SELECT *, coalesce(last_value(WMO_WIND IGNORE NULLS) OVER f, first_value(WMO_WIND IGNORE NULLS) OVER b) AS fw,
      coalesce(last_value(WMO_PRES IGNORE NULLS) OVER f, first_value(WMO_PRES IGNORE NULLS) OVER b) AS fp
      FROM s_typed WINDOW f AS (PARTITION BY SID ORDER BY ISO_TIME ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      b AS (PARTITION BY SID ORDER BY ISO_TIME ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""))
def _(spark, sf):
    return C.fill_simulation(typed(spark, sf))
