"""Complete rows, holdout by storm, and the persisted split table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from driftline import constants as K
from driftline.functions.order_stats import hash_fraction, hash_rank


def prepare_training(df: DataFrame, horizon: int = K.DEFAULT_HORIZON, mode: str = K.TARGET_MODE,
                     features=K.FEATURES) -> DataFrame:
    """Rows with every feature and both targets of one horizon."""
    needed = [*features, *K.target_columns(horizon, mode)]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}")
    return df.where(complete(df, needed))


def complete(df: DataFrame, columns) -> Column:
    """Whether no column is null or NaN, as ``na.drop``; as plain conditions, which scans take over."""
    dtypes = dict(df.dtypes)
    number = [c for c in columns if dtypes[c] in ("double", "float")]
    return reduce(lambda a, b: a & b, [*[F.col(c).isNotNull() for c in columns], *[~F.isnan(F.col(c)) for c in number]])


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when nothing is left."""
    if df.isEmpty():
        raise ValueError(f"no rows left: {what}")
    return df


def preparation_report(df: DataFrame, horizon: int = K.DEFAULT_HORIZON) -> DataFrame:
    """Rows before and after, in one pass."""
    needed = [*K.FEATURES, *K.target_columns(horizon)]
    usable = F.count(F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in needed]) == 0, 1))
    return df.agg(F.lit(horizon).alias("horizon"), F.count("*").alias("n_rows"),
                  usable.alias("usable_rows"),
                  (usable / F.count("*") * 100).alias("kept_pct"))


# ---------------------------------------------------------------------- splits
def season_split(df: DataFrame, train_end: int = K.TRAIN_END_SEASON,
                 val_end: int = K.VAL_END_SEASON) -> DataFrame:
    """(SID, split) by the first season of the storm; a storm is never divided."""
    season = F.min("SEASON")
    return df.groupBy("SID").agg(
        F.when(season <= train_end, "train").when(season <= val_end, "val")
         .when(season.isNotNull(), "test").alias("split")).where("split IS NOT NULL")


def storm_split(df: DataFrame, train_ratio: float = K.TRAIN_RATIO,
                val_ratio: float = K.VAL_RATIO, seed: int = K.SEED) -> DataFrame:
    """(SID, split) at random with exact sizes, whatever the partitioning."""
    ranked = hash_rank(df.select("SID").distinct(), ["SID"], seed)
    n = ranked.agg(F.count("*")).scalar()
    n_train = F.floor(n * F.lit(train_ratio))
    n_val = F.floor(n * F.lit(val_ratio))
    return ranked.select("SID", F.when(F.col("hash_rank") < n_train, "train")
                         .when(F.col("hash_rank") < n_train + n_val, "val")
                         .otherwise("test").alias("split"))


def generate_split(df: DataFrame, strategy: str = "season") -> DataFrame:
    if strategy == "season":
        return season_split(df)
    if strategy == "storm":
        return storm_split(df)
    raise ValueError(f"unknown split strategy {strategy!r}")


def split_overlap(assignments: DataFrame) -> DataFrame:
    """Storms that sit in two partitions, per pair."""
    per_storm = assignments.groupBy("SID").agg(*[
        F.max((F.col("split") == s).cast("int")).alias(s) for s in K.SPLITS])
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    counts = per_storm.agg(*[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_{b}")
                             for a, b in pairs])
    return counts.unpivot([], [f"{a}_{b}" for a, b in pairs], "pair", "n_storms")


def split_coverage(df: DataFrame, assignments: DataFrame) -> DataFrame:
    """Storms of the table that no partition holds."""
    return df.select("SID").distinct().join(assignments.select("SID"), "SID", "left_anti")


def validate_split(df: DataFrame, assignments: DataFrame) -> DataFrame:
    """Overlap, coverage and empty partitions as rows (check, level, message, n)."""
    overlap = split_overlap(assignments).select(
        F.concat(F.lit("overlap_"), "pair").alias("check"), F.col("n_storms").alias("n"),
        F.format_string("%d storms in both", "n_storms").alias("message"))
    left_out = split_coverage(df, assignments).agg(F.count("*").alias("n")).select(
        F.lit("coverage").alias("check"), "n",
        F.format_string("%d storms in no partition", "n").alias("message"))
    sizes = assignments.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "test")])
    empty = sizes.unpivot([], ["train", "test"], "split", "c").select(
        F.concat(F.lit("size_"), "split").alias("check"),
        F.when(F.col("c") == 0, 1).otherwise(0).cast("bigint").alias("n"),
        F.format_string("%d storms", "c").alias("message"))
    out = overlap.unionByName(left_out).unionByName(empty)
    return out.select("check", F.when(F.col("n") > 0, "error").otherwise("ok").alias("level"),
                      "message", "n")


def save_split(assignments: DataFrame, path: str, config: dict) -> None:
    """Replace the partition of this configuration in the split table."""
    (assignments.select("SID", "split", F.lit(K.fingerprint(config)).alias("fingerprint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("fingerprint").parquet(path))


def load_split(spark, path: str, config: dict) -> DataFrame | None:
    """The stored split of a configuration, or None."""
    try:
        stored = spark.read.schema("SID string, split string, fingerprint string").parquet(path)
    except AnalysisException:
        return None
    stored = stored.where(F.col("fingerprint") == K.fingerprint(config)).select("SID", "split")
    return None if stored.isEmpty() else stored


def stored_split_counts(spark, path: str) -> DataFrame:
    return (spark.read.schema("SID string, split string, fingerprint string").parquet(path)
            .groupBy("fingerprint", "split").agg(F.count("*").alias("n_storms")))


def resolve_split(df: DataFrame, path: str, strategy: str = "season",
                  regenerate: bool = False) -> DataFrame:
    """Reuse the stored split when it still fits the table, else make and store one."""
    config = K.split_config(strategy)
    stored = None if regenerate else load_split(df.sparkSession, path, config)
    if stored is not None and validate_split(df, stored).where("n > 0").isEmpty():
        return stored
    fresh = generate_split(df, strategy)
    problems = validate_split(df, fresh).where("n > 0").collect()  # one row per check
    if problems:
        raise ValueError("; ".join(f"{p['check']}: {p['message']}" for p in problems))
    save_split(fresh, path, config)
    return load_split(df.sparkSession, path, config)


def assign_split_rows(df: DataFrame, assignments: DataFrame) -> DataFrame:
    """Rows with their partition. Spark broadcasts the list when it is small enough."""
    return df.join(assignments, "SID")


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, storms, seasons and share per partition of a table with ``split``."""
    per_storm = df.groupBy("split", "SID").agg(
        F.count("*").alias("n"), F.min("SEASON").alias("lo"), F.max("SEASON").alias("hi"))
    out = per_storm.groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("storms"),
        F.min("lo").alias("season_min"), F.max("hi").alias("season_max"))
    total = df.agg(F.count("*")).scalar()
    return out.withColumns({
        "share_pct": F.col("n_rows") / total * 100,
        "few_storms": (F.col("split") == "test") & (F.col("storms") < K.MIN_TEST_STORMS)})


def prepare_data(features: DataFrame, horizon: int = K.DEFAULT_HORIZON,
                 assignments: DataFrame | None = None, strategy: str = "season") -> DataFrame:
    """Complete rows of one horizon with their partition, in one table."""
    rows = prepare_training(features, horizon)
    return assign_split_rows(rows, assignments if assignments is not None
                             else generate_split(rows, strategy))


def subsample_train(df: DataFrame, fraction: float, seed: int = K.SEED) -> DataFrame:
    """Keep a fraction of the training rows; the same rows under any partitioning."""
    keep = hash_fraction(["SID", "ISO_TIME"], seed) < fraction
    return df.where((F.col("split") != "train") | keep)


# ------------------------------------------------------------- all lead times
def forecast_rows(features: DataFrame, horizons=K.HORIZONS, mode: str = K.TARGET_MODE, keep=()) -> DataFrame:
    """One row per complete observation and horizon, from a single scan.

    Y_LAT / Y_LON hold the targets of that horizon in the given mode. ``keep`` names further
    columns, such as the features that a fitted baseline reads.
    """
    whole = features.where(complete(features, list(K.FEATURES)))
    per_horizon = F.array_compact(F.array(*[
        F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(
            F.lit(h).alias("horizon"), F.col(lat).alias("Y_LAT"), F.col(lon).alias("Y_LON")))
        for h in horizons for lat, lon in [K.target_columns(h, mode)]]))
    kept = dict.fromkeys([*K.META_COLUMNS, "DELTA_LAT", "DELTA_LON", "INTENSITY_CATEGORY", *keep])
    return whole.select(*kept, F.explode(per_horizon).alias("_t")) \
                   .select("*", "_t.horizon", "_t.Y_LAT", "_t.Y_LON").drop("_t")
