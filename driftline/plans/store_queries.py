"""Registered queries of the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline import constants as K
from driftline.operators import metrics as M
from driftline.plans.metric_queries import evaluation
from driftline.plans.product_queries import COLS, PROD, products
from driftline.plans.registry import query, rounded
from driftline.plans.sql import columns, r, with_clean, with_raw, with_scored
from driftline.plans.stages import stage_path
from driftline.plans.tables import clean_table
from driftline.sources import tables as R
from driftline.sources.synthetic import raw_tracks


def raw_csv(spark, sf) -> str:
    """The raw table as CSV with missing-value tokens put in."""
    path = stage_path(spark, sf, "raw.csv")
    df = raw_tracks(spark, sf)
    marked = df.withColumns({
        "ISO_TIME": F.col("ISO_TIME").cast("string"),
        "STORM_SPEED": F.when(F.col("STORM_SPEED") == "7", "#N/A").when(F.col("STORM_SPEED") == "8", "null")
                        .otherwise(F.col("STORM_SPEED")),
        "SUBBASIN": F.when(F.col("STORM_SPEED") == "9", "N/A").otherwise(F.col("SUBBASIN"))})
    R.write_csv(marked, path)
    return path


@query("read_raw", with_raw(
    f"""SELECT SID, SEASON, BASIN, CASE WHEN STORM_SPEED = '9' THEN 'N/A' ELSE SUBBASIN END AS SUBBASIN,
    strftime(ISO_TIME, '%Y-%m-%d %H:%M:%S') AS ISO_TIME, {r('LAT')} AS LAT, {r('LON')} AS LON, WMO_WIND, WMO_PRES,
    CASE WHEN STORM_SPEED NOT IN ('7', '8') THEN STORM_SPEED END AS STORM_SPEED, STORM_DIR, DIST2LAND, NATURE,
    TRACK_TYPE FROM raw"""))
def _(spark, sf):
    df = R.read_raw(spark, raw_csv(spark, sf))
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("LAT", "LON")})


@query("recover_basin", with_raw("SELECT SID, ISO_TIME, coalesce(BASIN, 'NA') AS BASIN, TRACK_TYPE FROM raw"))
def _(spark, sf):
    return R.recover_basin(raw_tracks(spark, sf)).select("SID", "ISO_TIME", "BASIN", "TRACK_TYPE")


@query("recovered_basins", with_raw("SELECT count(*) - count(BASIN) AS n_recovered FROM raw"))
def _(spark, sf):
    return R.recovered_basins(raw_tracks(spark, sf))


@query("require_columns", with_raw("SELECT SID, ISO_TIME, TRACK_TYPE FROM raw"))
def _(spark, sf):
    return R.require_columns(raw_tracks(spark, sf)).select("SID", "ISO_TIME", "TRACK_TYPE")


@query("raw_summary", with_raw(
    """SELECT count(*) AS n_rows, 14 AS n_columns, count(DISTINCT SID) AS storms, min(CAST(SEASON AS INTEGER)) AS season_min,
    max(CAST(SEASON AS INTEGER)) AS season_max, count(DISTINCT BASIN) AS basins FROM raw"""))
def _(spark, sf):
    return R.raw_summary(raw_tracks(spark, sf))


CLEAN_SQL = f"""SELECT SID, SEGMENT_ID, ISO_TIME, SEASON, coalesce(BASIN, 'NA') AS BASIN,
  {', '.join(f'{r(c)} AS {c}' for c in K.NUMERIC_COLUMNS)} FROM clean"""
CLEAN_COLUMNS = ("SID", "SEGMENT_ID", "ISO_TIME", "SEASON", "BASIN", *K.NUMERIC_COLUMNS)


# The CSV twin alone, so that the text rules are used.
@query("read_table", with_clean(CLEAN_SQL))
def _(spark, sf):
    base = stage_path(spark, sf, "clean_text")
    R.write_csv(clean_table(spark, sf), f"{base}.csv")
    return rounded(R.read_table(spark, base).select(*CLEAN_COLUMNS))


@query("write_table", with_clean(CLEAN_SQL))
def _(spark, sf):
    base = stage_path(spark, sf, "clean_copy")
    R.write_table(clean_table(spark, sf), base)
    return rounded(R.read_table(spark, base).select(*CLEAN_COLUMNS))


@query("export_predictions", with_scored(
    f"SELECT LEAD_HOURS, model, count(*) AS n, {r('avg(ERROR_KM)')} AS mean_km FROM prod GROUP BY ALL", PROD))
def _(spark, sf):
    path = stage_path(spark, sf, "exported")
    R.export_predictions(products(spark, sf), path)
    return rounded(spark.read.parquet(path).groupBy("LEAD_HOURS", "model").agg(
        F.count("*").alias("n"), F.avg("ERROR_KM").alias("mean_km")))


@query("read_predictions", with_scored(f"SELECT {columns(COLS, 5)} FROM prod WHERE LEAD_HOURS = 24", PROD))
def _(spark, sf):
    path = stage_path(spark, sf, "exported_on_demand")
    return rounded(R.read_predictions(spark, path, 24, lambda: products(spark, sf)).select(*COLS), 5)


@query("write_metrics")
def _(spark, sf):
    folder = stage_path(spark, sf, "metrics")
    table = evaluation(spark, sf)
    R.write_metrics(M.comparison_table(table), table, folder)
    return spark.read.json(f"{folder}/evaluation")
