"""Summary tables behind the diagnostic figures.

Random samples are the rows with the smallest seeded hash of their key: a
distributed top-k, repeatable under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions import geo
from driftline.functions.joins import broadcast_if_small
from driftline.functions.order_stats import (BIN_WIDTH, bins_of_ranks, exact_percentiles, fine_bin, fine_bins,
                                             hash_order, ordered_rank, row_hash, same_keys)
from driftline.functions.times import hours_between
from driftline.operators.metrics import with_percentiles
from driftline.session import cut_lineage

THIN_BUCKETS = 1024


# ------------------------------------------------------------------- histogram
def histogram(df: DataFrame, value: str, bins: int, groups=()) -> DataFrame:
    """Equal-width bins from minimum to maximum per group; the last bin is closed.

    Rows are counted per (group, value bucket) after one min/max aggregate.
    """
    groups = list(groups)
    keys = groups or ["_all"]
    rows = df.select(*groups, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    rows = rows if groups else rows.withColumn("_all", F.lit(1))
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    both = rows.alias("r").join(F.broadcast(span).alias("s"), same_keys("r", "s", keys)) \
               .select("r.*", "s._lo", "s._hi")
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width),
                                      F.lit(bins - 1))).otherwise(0).cast("int")
    counted = both.groupBy(*keys, index.alias("bin"), "_lo", width.alias("_w")).agg(
        F.count("*").alias("n"))
    return counted.select(*groups, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"),
                          (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("right_edge"), "n")


# ---------------------------------------------------------------- the data set
def dataset_summary(df: DataFrame) -> DataFrame:
    """Headline numbers in one row; segments are aggregated first."""
    segments = df.groupBy("SID", "SEGMENT_ID").agg(
        F.count("*").alias("n"), F.min("SEASON").alias("lo"), F.max("SEASON").alias("hi"))
    median = F.median("n")  # of whole numbers, one entry per distinct length
    return segments.agg(
        F.sum("n").alias("observations"), F.count_distinct("SID").alias("storms"),
        F.count("*").alias("segments"), F.floor(median).cast("int").alias("median_track_rows"),
        F.floor(median * K.CADENCE_HOURS).cast("int").alias("median_track_hours"),
        F.min("lo").alias("season_min"), F.max("hi").alias("season_max"))


def storms_per(df: DataFrame, column: str) -> DataFrame:
    """Distinct storms per season or basin."""
    return df.select(column, "SID").distinct().groupBy(column).agg(F.count("*").alias("storms"))


def storms_per_season(df: DataFrame) -> DataFrame:
    return storms_per(df, "SEASON").orderBy("SEASON")


def storms_per_basin(df: DataFrame) -> DataFrame:
    return storms_per(df, "BASIN").orderBy("storms", "BASIN")


def intensity_distribution(df: DataFrame) -> DataFrame:
    return (df.where("INTENSITY_CATEGORY IS NOT NULL").groupBy("INTENSITY_CATEGORY")
              .agg(F.count("*").alias("n"))
              .withColumn("name", geo.intensity_name("INTENSITY_CATEGORY")))


def segment_length_distribution(df: DataFrame, bins: int = 40) -> DataFrame:
    """Histogram of rows per segment, with the median length on every row."""
    lengths = df.groupBy("SID", "SEGMENT_ID").agg(F.count("*").alias("length"))
    median = lengths.agg(F.median("length")).scalar()
    return histogram(lengths, "length", bins).withColumn("median_length", median)


def displacements_by_lead(df: DataFrame, horizons=K.HORIZONS) -> DataFrame:
    """Distance travelled per row and horizon (one scan, horizons melted)."""
    moves = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(lat).alias("dlat"),
                               F.col(lon).alias("dlon"))
                      for h in horizons for lat, lon in [K.target_columns(h)]])
    melted = df.select("SID", "ISO_TIME", "LAT", "LON", F.explode(moves).alias("m")) \
               .where("m.dlat IS NOT NULL AND m.dlon IS NOT NULL")
    # one distance expression after the melt: five of them in one method would not be compiled
    km = geo.haversine_km("LAT", "LON", F.col("LAT") + F.col("m.dlat"), F.col("LON") + F.col("m.dlon"))
    return melted.select("SID", "ISO_TIME", "m.horizon", km.alias("km"))


def displacement_by_lead(df: DataFrame, horizons=K.HORIZONS) -> DataFrame:
    """Rows, median and 90th percentile of the distance per horizon."""
    moved = displacements_by_lead(df, horizons)
    return with_percentiles(moved.groupBy("horizon").agg(F.count("*").alias("n")), moved, ["horizon"],
                            {"median_km": 0.5, "p90_km": 0.9}, "km")


def displacement_density(df: DataFrame, horizons=K.HORIZONS, bins: int = 60) -> DataFrame:
    """Histogram per horizon as a probability density."""
    counted = histogram(displacements_by_lead(df, horizons), "km", bins, ["horizon"])
    total = F.sum("n").over(Window.partitionBy("horizon"))  # bins only
    return counted.withColumn("density", F.col("n") / total
                              / (F.col("right_edge") - F.col("left_edge")))


def displacement_sample(df: DataFrame, n: int = 6000, seed: int = K.SEED,
                        horizons=K.HORIZONS) -> DataFrame:
    """A seeded sample of displacements at the middle horizon."""
    lat, lon = K.target_columns(horizons[len(horizons) // 2])
    rows = df.select("SID", "ISO_TIME", lat, lon).na.drop(subset=[lat, lon])
    return rows.orderBy(*hash_order(["SID", "ISO_TIME"], seed)).limit(n)


# ---------------------------------------------------------------------- tracks
def track_sample(df: DataFrame, n: int = 300, seed: int = K.SEED) -> DataFrame:
    """All points of a seeded sample of segments, split at the date line."""
    ids = df.select("SID", "SEGMENT_ID").distinct() \
            .orderBy(*hash_order(["SID", "SEGMENT_ID"], seed)).limit(n)
    rows = df.join(F.broadcast(ids), ["SID", "SEGMENT_ID"], "left_semi")  # n ids at most
    return split_at_antimeridian(rows.select("SID", "SEGMENT_ID", "ISO_TIME", "BASIN", "LAT", "LON"))


def split_at_antimeridian(df: DataFrame, lat: str = "LAT", lon: str = "LON",
                          key=("SID", "SEGMENT_ID")) -> DataFrame:
    """PART counts up where the longitude jumps by more than 180 degrees; parts of one
    point are dropped."""
    w = Window.partitionBy(*key).orderBy("ISO_TIME")
    jump = F.when(F.abs(F.col(lon) - F.lag(lon).over(w)) > 180, 1).otherwise(0)
    parted = df.withColumn("_jump", jump).withColumn(
        "PART", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    size = F.count("*").over(Window.partitionBy(*key, "PART"))
    return parted.withColumn("_n", size).where("_n > 1").drop("_n", "_jump")


# ---------------------------------------------------------------- error tables
def box_stats(rows: DataFrame, groups, min_rows: int = 1) -> DataFrame:
    """n, quartiles and mean of ERROR_KM per group."""
    stats = rows.where("ERROR_KM IS NOT NULL").groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg("ERROR_KM").alias("mean_km")).where(F.col("n") >= min_rows)
    return with_percentiles(stats, rows, groups, {"q1_km": 0.25, "median_km": 0.5, "q3_km": 0.75})


def error_distribution(rows: DataFrame, groups=("model", "LEAD_HOURS"), bins: int = 60) -> DataFrame:
    """Histogram of the error per group, with mean, median and 90th percentile.

    Two scans. The first counts bins of 50 m, which give the mean, the range and all
    bins of the figure but those that an edge of the figure cuts. The second takes the
    values of the cut bins and of the bins that hold a wanted percentile: at most
    ``bins`` + 3 small bins per group.
    """
    groups = list(groups)
    quantiles = {"median_km": 0.5, "p90_km": 0.9}
    fine = cut_lineage(fine_bins(rows, groups, "ERROR_KM"))
    stats = fine.groupBy(*groups).agg((F.sum("_sum") / F.sum("_n")).alias("mean_km"),
                                      F.min("_lo").alias("_from"), F.max("_hi").alias("_to"))
    scale = F.broadcast(stats).alias("s")  # one row per group of the report

    def placed(df: DataFrame) -> DataFrame:
        """With the limits of the group."""
        return df.alias("d").join(scale, same_keys("d", "s", groups)).select("d.*", "s._from", "s._to")

    width = (F.col("_to") - F.col("_from")) / bins

    def index(value: str) -> Column:
        inside = F.least(F.floor((F.col(value) - F.col("_from")) / width), F.lit(bins - 1))
        return F.when(width > 0, inside).otherwise(0).cast("int")

    # the place in the figure grows with the value, so equal ends mean a whole bin
    ends = cut_lineage(placed(fine).withColumns({"bin": index("_lo"), "_last": index("_hi")}))
    cut = F.col("bin") != F.col("_last")
    wanted = ends.where(cut).select(*groups, "_bin").unionByName(
        bins_of_ranks(fine, groups, quantiles.values()).select(*groups, "_bin")).distinct()
    error = F.col("ERROR_KM").cast("double")
    values = rows.where(error.isNotNull()).select(*groups, error.alias("_v"), fine_bin(error, BIN_WIDTH).alias("_bin"))
    few = broadcast_if_small(cut_lineage(wanted)).alias("w")
    values = cut_lineage(values.alias("d").join(few, same_keys("d", "w", [*groups, "_bin"]), "left_semi")
                         .groupBy(*groups, "_bin", "_v").agg(F.count("*").alias("_n")))
    cut_bins = ends.where(cut).select(*groups, "_bin").alias("c")
    of_cut = values.alias("v").join(cut_bins, same_keys("v", "c", [*groups, "_bin"]), "left_semi")
    counted = ends.where(~cut).select(*groups, "bin", "_n").unionByName(
        placed(of_cut).select(*groups, index("_v").alias("bin"), "_n")).groupBy(*groups, "bin").agg(F.sum("_n").alias("n"))
    found = exact_percentiles(values, groups, "_v", quantiles, bins=fine, weight="_n")
    out = placed(counted).select(
        *groups, "bin", (F.col("_from") + F.col("bin") * width).alias("left_edge"),
        (F.col("_from") + (F.col("bin") + 1) * width).alias("right_edge"), "n")
    report = stats.select(*groups, "mean_km").join(F.broadcast(found), groups)
    return out.join(F.broadcast(report), groups)


def cumulative_within(rows: DataFrame, horizon: int = K.DEFAULT_HORIZON,
                      thresholds=K.THRESHOLDS_KM) -> DataFrame:
    """Share of forecasts within each distance, one row per model and threshold."""
    at = rows.where(F.col("LEAD_HOURS") == horizon)
    wide = at.groupBy("model").agg(*[
        (F.avg((F.col("ERROR_KM") <= t).cast("double")) * 100).alias(str(t)) for t in thresholds])
    long = wide.unpivot(["model"], [str(t) for t in thresholds], "t", "within_pct")
    return long.select("model", F.col("t").cast("int").alias("threshold_km"), "within_pct")


def align_intensity(rows: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Errors with the intensity class of their issue row.

    Scored forecasts carry the class; only tables without it are joined to
    ``features`` by key.
    """
    if features is None:
        lead = F.col("LEAD_HOURS") if "LEAD_HOURS" in rows.columns else F.col("horizon")
        return rows.select("model", "SID", "ISO_TIME", lead.alias("LEAD_HOURS"), "ERROR_KM",
                           F.col("INTENSITY_CATEGORY").alias("category")).where(
            "category IS NOT NULL AND ERROR_KM IS NOT NULL")
    classes = features.select("SID", "ISO_TIME", F.col("INTENSITY_CATEGORY").alias("category"))
    return rows.select("model", "SID", "ISO_TIME", "LEAD_HOURS", "ERROR_KM") \
               .join(classes, ["SID", "ISO_TIME"]).where("category IS NOT NULL AND ERROR_KM IS NOT NULL")


def error_by_intensity(rows: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Quartiles per intensity class."""
    out = box_stats(align_intensity(rows, features), ["model", "LEAD_HOURS", "category"])
    return out.withColumn("name", geo.intensity_name("category"))


def error_by_basin_box(rows: DataFrame, min_rows: int = K.BASIN_BOX_MIN_ROWS) -> DataFrame:
    """Quartiles per basin with enough rows; nothing when fewer than two basins have them."""
    groups = ["model", "LEAD_HOURS", "BASIN"]
    out = box_stats(rows.where("BASIN IS NOT NULL"), groups, min_rows)
    basins = F.count("*").over(Window.partitionBy("model", "LEAD_HOURS"))  # report rows only
    return out.withColumn("_b", basins).where("_b >= 2").drop("_b")


def residual_rows(rows: DataFrame) -> DataFrame:
    """True minus predicted coordinates; the longitude difference is not wrapped."""
    return rows.select("model", "LEAD_HOURS", "SID", "ISO_TIME", "PRED_LAT", "PRED_LON",
                       (F.col("TRUE_LAT") - F.col("PRED_LAT")).alias("RESIDUAL_LAT"),
                       (F.col("TRUE_LON") - F.col("PRED_LON")).alias("RESIDUAL_LON"))


def residuals(rows: DataFrame, bins: int = 60) -> DataFrame:
    """Histogram of both residuals per model and lead time, with their means.

    Residuals are rounded to 9 digits first: means over rows differ in their last
    bits with the order of summation, and a value on a bin edge must not.
    """
    melted = residual_rows(rows).select("model", "LEAD_HOURS", F.explode(F.array(
        F.struct(F.lit("lat").alias("axis"), F.col("RESIDUAL_LAT").alias("v")),
        F.struct(F.lit("lon").alias("axis"), F.col("RESIDUAL_LON").alias("v")))).alias("m")) \
        .select("model", "LEAD_HOURS", "m.axis", F.round("m.v", 9).alias("residual"))
    groups = ["model", "LEAD_HOURS", "axis"]
    means = melted.groupBy(*groups).agg(F.avg("residual").alias("mean_residual"))
    return histogram(melted, "residual", bins, groups).join(means, groups)


def middle_storm(rows: DataFrame, min_rows: int = 8) -> DataFrame:
    """The storm in the middle of those with enough rows, by row count, then SID."""
    counts = rows.groupBy("SID").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    ranked = ordered_rank(counts, F.desc("n"), F.col("SID"))
    middle = F.floor(ranked.agg(F.count("*")).scalar() / 2)
    return ranked.where(F.col("rank") == middle).select("SID")


def storm_lifecycle(rows: DataFrame, sid: str | None = None, min_rows: int = 8) -> DataFrame:
    """Error along the life of one storm, by default the middle one."""
    if sid is not None:
        storm = rows.where(F.col("SID") == sid)
    else:
        storm = rows.join(F.broadcast(middle_storm(rows, min_rows)), "SID", "left_semi")  # one row
    first = F.min("ISO_TIME").over(Window.partitionBy("SID"))
    return storm.select("SID", "ISO_TIME", hours_between(first, F.col("ISO_TIME"))
                        .alias("hours_since_first"), "CURRENT_LAT", "CURRENT_LON", "ERROR_KM",
                        F.abs("CROSS_TRACK_KM").alias("ABS_CROSS_TRACK_KM"))


# ------------------------------------------------------------------------ maps
def choose_storms(rows: DataFrame, n: int = 6, min_rows: int = 10, seed: int = K.SEED) -> DataFrame:
    """A seeded sample of storms with enough rows, to be reused at all horizons."""
    return (rows.groupBy("SID").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
            .orderBy(*hash_order(["SID"], seed)).limit(n))


def observed_vs_forecast(rows: DataFrame, storms: DataFrame) -> DataFrame:
    """Rows of chosen storms; CONNECT is false where a connector would span the date line."""
    chosen = rows.join(storms.select("SID"), "SID", "left_semi")
    first = F.min("ISO_TIME").over(Window.partitionBy("model", "SID", "LEAD_HOURS"))
    return chosen.withColumns({
        "CONNECT": F.abs(F.col("PRED_LON") - F.col("TRUE_LON")) <= 180,
        "IS_START": F.col("ISO_TIME") == first})


def map_extent(rows: DataFrame, pad: float = 8.0, widest: float = 200.0) -> DataFrame:
    """Bounding box of all positions plus a margin, and the mean error, per lead time.

    A box wider than ``widest`` degrees means a global map (IS_GLOBAL).
    """
    def edge(fn, pick, axis):
        return pick(*[fn(f"{kind}_{axis}") for kind in ("CURRENT", "PRED", "TRUE")])

    out = rows.groupBy("model", "LEAD_HOURS").agg(
        F.count_distinct("SID").alias("storms"), F.avg("ERROR_KM").alias("mean_km"),
        (edge(F.min, F.least, "LON") - pad).alias("lon_min"),
        (edge(F.max, F.greatest, "LON") + pad).alias("lon_max"),
        (edge(F.min, F.least, "LAT") - pad).alias("lat_min"),
        (edge(F.max, F.greatest, "LAT") + pad).alias("lat_max"))
    return out.withColumn("IS_GLOBAL", F.col("lon_max") - F.col("lon_min") > widest)


def error_map_by_lead(rows: DataFrame, max_points: int | None = None,
                      seed: int = K.SEED) -> DataFrame:
    """Errors at their verifying position, clipped at the 95th percentile of the group.

    Each (model, lead) has its own scale. With ``max_points`` a group is thinned
    by a seeded hash before the scale is taken, as a plot would be.
    """
    groups = ["model", "LEAD_HOURS"]
    points = rows.na.drop(subset=["TRUE_LAT", "TRUE_LON", "ERROR_KM"])
    if max_points is not None:
        points = thin(points, groups, max_points, seed)
    scale = exact_percentiles(points, groups, "ERROR_KM", {"VMAX": 0.95})
    both = points.alias("r").join(F.broadcast(scale).alias("s"), same_keys("r", "s", groups)) \
                 .select("r.model", "r.LEAD_HOURS", "SID", "ISO_TIME", "TRUE_LAT", "TRUE_LON",
                         "ERROR_KM", "VMAX")
    return both.withColumn("CLIPPED_KM", F.least("ERROR_KM", "VMAX"))


def thin(rows: DataFrame, groups, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of each group with the smallest seeded hash (all if fewer).

    Exact in two steps: the ``n`` smallest of each (group, hash bucket), where a
    bucket holds a small part of the group, then the ``n`` smallest of those.
    """
    h = row_hash(["SID", "ISO_TIME"], seed)
    order = ["_h", "SID", "ISO_TIME"]
    hashed = rows.withColumn("_h", h).withColumn("_bucket", F.pmod("_h", F.lit(THIN_BUCKETS)))
    for keys in ([*groups, "_bucket"], list(groups)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        hashed = hashed.withColumn("_rn", place).where(F.col("_rn") <= n).drop("_rn")
    return hashed.drop("_h", "_bucket")


def error_map(rows: DataFrame, horizon: int = K.DEFAULT_HORIZON,
              max_points: int | None = None) -> DataFrame:
    return error_map_by_lead(rows.where(F.col("LEAD_HOURS") == horizon), max_points)


def error_map_stats(rows: DataFrame) -> DataFrame:
    groups = ["model", "LEAD_HOURS"]
    stats = rows.groupBy(*groups).agg(F.count("ERROR_KM").alias("n"), F.avg("ERROR_KM").alias("mean_km"))
    return with_percentiles(stats, rows, groups, {"median_km": 0.5})


def error_grid(rows: DataFrame, cell_degrees: float = 5.0) -> DataFrame:
    """The map as a grid: forecasts and mean error per cell, whatever the row count."""
    def cell(c) -> Column:
        return (F.floor(F.col(c) / cell_degrees) * cell_degrees).cast("double")

    return rows.na.drop(subset=["TRUE_LAT", "TRUE_LON", "ERROR_KM"]).groupBy(
        "model", "LEAD_HOURS", cell("TRUE_LAT").alias("cell_lat"), cell("TRUE_LON").alias("cell_lon")) \
        .agg(F.count("*").alias("n"), F.avg("ERROR_KM").alias("mean_km"))


# --------------------------------------------------------- growth with the lead
def error_growth(evaluation: DataFrame) -> DataFrame:
    """Mean error by model and lead, with its interval if there is one; nothing for a
    single horizon."""
    ci = [c for c in ("mean_ci_lower", "mean_ci_upper") if c in evaluation.columns]
    horizons = F.size(F.collect_set("horizon").over(Window.partitionBy(F.lit(0))))  # report rows
    return evaluation.withColumn("_h", horizons).where("_h >= 2").select("model", "horizon", "mean_km", *ci)


def alongcross_growth(best: DataFrame) -> DataFrame:
    """Error components of the best model of each horizon."""
    return best.select("horizon", "model", "cross_track_mae_km", "along_track_mae_km",
                       F.abs("along_track_bias_km").alias("abs_along_track_bias_km"))


def alongcross_sample(rows: DataFrame, n: int = 5000, seed: int = K.SEED) -> DataFrame:
    """A seeded sample of (along, cross) points of one table."""
    return (rows.select("model", "LEAD_HOURS", "SID", "ISO_TIME", "ALONG_TRACK_KM", "CROSS_TRACK_KM")
            .na.drop(subset=["ALONG_TRACK_KM", "CROSS_TRACK_KM"])
            .orderBy(*hash_order(["SID", "ISO_TIME", "LEAD_HOURS", "model"], seed)).limit(n))


def skill_by_lead(skill: DataFrame) -> DataFrame:
    """Skill with the lengths of its interval arms; models without skill are left out."""
    return skill.where("skill_pct IS NOT NULL").select(
        "model", "horizon", "skill_pct",
        F.abs(F.col("skill_pct") - F.col("skill_ci_lower")).alias("arm_lower"),
        F.abs(F.col("skill_ci_upper") - F.col("skill_pct")).alias("arm_upper"))
