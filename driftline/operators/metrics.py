"""Scoring of long prediction tables: errors, statistics, skill, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions import geo
from driftline.functions.order_stats import exact_percentiles, row_hash, same_keys

KEYS = ("SID", "ISO_TIME", "horizon")
REPORT = ("model", "horizon")


def reconstruct_positions(df: DataFrame, mode: str = K.TARGET_MODE) -> DataFrame:
    """Predicted and true coordinates from the target-space columns."""
    if mode == "displacement":
        pred = geo.offset_position("LAT", "LON", "PRED_Y_LAT", "PRED_Y_LON")
        true = geo.offset_position("LAT", "LON", "Y_LAT", "Y_LON")
    else:
        pred = F.col("PRED_Y_LAT"), F.col("PRED_Y_LON")
        true = F.col("Y_LAT"), F.col("Y_LON")
    return df.withColumns(dict(zip(("PRED_LAT", "PRED_LON", "TRUE_LAT", "TRUE_LON"), pred + true)))


def score(df: DataFrame, mode: str = K.TARGET_MODE) -> DataFrame:
    """Positions, track error and its along/cross components for each prediction."""
    df = reconstruct_positions(df, mode)
    parts = geo.along_cross_track("LAT", "LON", "TRUE_LAT", "TRUE_LON", "PRED_LAT", "PRED_LON")
    return df.withColumns({"ERROR_KM": parts["total_km"],
                           "ALONG_TRACK_KM": parts["along_track_km"],
                           "CROSS_TRACK_KM": parts["cross_track_km"]})


# ------------------------------------------------------------------ statistics
def _error_columns():
    n = F.count("ERROR_KM")
    out = {"n_samples": n, "n_dropped": F.count("*") - n, "mean_km": F.avg("ERROR_KM"),
           "std_km": F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp("ERROR_KM")),
           "min_km": F.min("ERROR_KM"), "max_km": F.max("ERROR_KM")}
    return [e.alias(c) for c, e in out.items()]


def _within_columns(thresholds=K.THRESHOLDS_KM):
    return [(F.avg((F.col("ERROR_KM") <= t).cast("double")) * 100).alias(f"within_{t}km_pct")
            for t in thresholds]


def _component_columns():
    return [F.avg("ALONG_TRACK_KM").alias("along_track_bias_km"),
            F.avg("CROSS_TRACK_KM").alias("cross_track_bias_km"),
            F.avg(F.abs("ALONG_TRACK_KM")).alias("along_track_mae_km"),
            F.avg(F.abs("CROSS_TRACK_KM")).alias("cross_track_mae_km")]


def _r2(actual: str, predicted: str):
    """1 - SSE/SST of one output; this is not the squared correlation."""
    sse = F.avg((F.col(actual) - F.col(predicted)) * (F.col(actual) - F.col(predicted)))
    sst = F.var_pop(actual)
    return F.when(sst > 0, 1 - sse / sst).when(sse == 0, 1.0).otherwise(0.0)


def _target_columns():
    mae = (F.avg(F.abs(F.col("Y_LAT") - F.col("PRED_Y_LAT")))
           + F.avg(F.abs(F.col("Y_LON") - F.col("PRED_Y_LON")))) / 2
    return [mae.alias("mae_target_units"),
            ((_r2("Y_LAT", "PRED_Y_LAT") + _r2("Y_LON", "PRED_Y_LON")) / 2).alias("r2")]


QUANTILES = {"median_km": 0.5, "p90_km": 0.9, "p95_km": 0.95}


def with_percentiles(stats: DataFrame, scored: DataFrame, groups, quantiles=QUANTILES,
                     value: str = "ERROR_KM") -> DataFrame:
    """Exact percentiles next to a statistics table with one row per group."""
    found = exact_percentiles(scored, groups, value, quantiles)
    names = list(quantiles)
    return stats.alias("s").join(F.broadcast(found).alias("p"), same_keys("s", "p", groups), "left") \
                .select("s.*", *[f"p.{c}" for c in names])


def track_error_stats(scored: DataFrame, groups=REPORT) -> DataFrame:
    """n, dropped, mean, median, std, p90, p95, min, max per group."""
    return with_percentiles(scored.groupBy(*groups).agg(*_error_columns()), scored, groups)


def within_threshold_pct(scored: DataFrame, groups=REPORT, thresholds=K.THRESHOLDS_KM) -> DataFrame:
    return scored.groupBy(*groups).agg(*_within_columns(thresholds))


def along_cross_stats(scored: DataFrame, groups=REPORT) -> DataFrame:
    """Bias and mean absolute size of both components, where the motion is defined."""
    return scored.groupBy(*groups).agg(*_component_columns())


def target_mae_r2(scored: DataFrame, groups=REPORT) -> DataFrame:
    return scored.groupBy(*groups).agg(*_target_columns())


# ----------------------------------------------------------------------- skill
def with_reference_error(scored: DataFrame, reference: str = K.REFERENCE_BASELINE) -> DataFrame:
    """REF_ERROR_KM: the error of the reference forecast for the same row.

    Persistence follows from the row itself; any other reference is picked among
    the forecasts of the same row, which are one per model, so nothing is joined.
    """
    if reference == "Persistence":
        stay = geo.offset_position("LAT", "LON", F.lit(0.0), F.lit(0.0))
        return scored.withColumn("REF_ERROR_KM",
                                 geo.track_error_km("TRUE_LAT", "TRUE_LON", *stay))
    same_row = Window.partitionBy(*KEYS)
    return scored.withColumn("REF_ERROR_KM", F.max(
        F.when(F.col("model") == reference, F.col("ERROR_KM"))).over(same_row))


def _skill_column():
    both = F.col("ERROR_KM").isNotNull() & F.col("REF_ERROR_KM").isNotNull()
    ref = F.avg(F.when(both, F.col("REF_ERROR_KM")))
    return F.when(ref > 0, (ref - F.avg(F.when(both, F.col("ERROR_KM")))) / ref * 100)


def skill_score(scored: DataFrame, reference: str = K.REFERENCE_BASELINE, groups=REPORT) -> DataFrame:
    """Percent reduction of the mean error against the reference, on rows both have."""
    rows = with_reference_error(scored, reference).where(F.col("model") != reference)
    return rows.groupBy(*groups).agg(_skill_column().alias("skill_pct"))


skill_vs_reference = skill_score


# ------------------------------------------------------------------- bootstrap
# Cumulative Poisson(1) probabilities: a resampling weight is how many of them
# a uniform number exceeds. Twelve entries: a weight above 12 has a chance of 6e-11.
_POISSON_CDF = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320,
                                                  362880, 3628800, 39916800], dtype=float))


def _weights(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, rows x replicates, from a counter hash of row key and replicate."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] ^ np.uint64(seed * 0x9E3779B1)
        z = z + (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    uniform = (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_POISSON_CDF, uniform, side="right").astype(np.float64)


def _partial_sums(groups, replicates: int, seed: int, block: int = 2000):
    """Task function: weighted sums per group and replicate of one partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(list(groups), dropna=False):
                total = sums.setdefault(key if isinstance(key, tuple) else (key,),
                                        np.zeros((3, replicates)))
                values = part[["_key", "_m", "_r"]]
                for start in range(0, len(values), block):
                    rows = values.iloc[start:start + block]
                    w = _weights(rows["_key"].to_numpy(), replicates, seed)
                    total[0] += w.sum(axis=0)
                    total[1] += rows["_m"].to_numpy() @ w
                    total[2] += rows["_r"].to_numpy() @ w
        for key, total in sums.items():
            out = pd.DataFrame({"replicate": np.arange(replicates, dtype=np.int32),
                                "w": total[0], "wm": total[1], "wr": total[2]})
            for name, value in zip(groups, key):
                out[name] = value
            yield out[[*groups, "replicate", "w", "wm", "wr"]]

    return run


def replicate_sums(pairs: DataFrame, groups=REPORT, replicates: int = K.BOOTSTRAP_REPLICATES,
                   seed: int = K.SEED) -> DataFrame:
    """Poisson bootstrap sums per group and replicate.

    Each partition returns ``replicates`` rows per group, so the shuffle does
    not depend on the number of predictions. A weight depends on the row key and
    the replicate only, hence not on the partitioning, and both errors of a row
    share it (the resampling is paired).
    """
    types = dict(pairs.dtypes)
    schema = ", ".join(f"`{g}` {types[g]}" for g in groups) \
        + ", replicate int, w double, wm double, wr double"
    keyed = pairs.select(*groups, row_hash(KEYS, seed).alias("_key"),
                         F.col("ERROR_KM").alias("_m"), F.col("REF_ERROR_KM").alias("_r"))
    partial = keyed.mapInPandas(_partial_sums(groups, replicates, seed), schema)
    return partial.groupBy(*groups, "replicate").agg(
        F.sum("w").alias("w"), F.sum("wm").alias("wm"), F.sum("wr").alias("wr"))


def _interval(value, alpha: float, name: str):
    """Percentile interval over the replicates of a group (a fixed number of rows)."""
    return [F.percentile(value, F.lit(q)).alias(f"{name}_{side}") for side, q in
            (("lower", alpha / 2), ("upper", 1 - alpha / 2))]


def bootstrap_ci(scored: DataFrame, groups=REPORT, replicates: int = K.BOOTSTRAP_REPLICATES,
                 alpha: float = K.BOOTSTRAP_ALPHA, seed: int = K.SEED) -> DataFrame:
    """Percentile interval of the mean error."""
    rows = scored.where(F.col("ERROR_KM").isNotNull()).withColumn("REF_ERROR_KM", F.lit(0.0))
    sums = replicate_sums(rows, groups, replicates, seed).where("w > 0")
    return sums.groupBy(*groups).agg(*_mean_interval(alpha))


def _mean_interval(alpha: float):
    return _interval(F.col("wm") / F.col("w"), alpha, "mean_ci")


def _skill_intervals(alpha: float):
    change = (F.col("wr") - F.col("wm")) / F.col("w")
    skill = F.when(F.col("wr") > 0, (F.col("wr") - F.col("wm")) / F.col("wr") * 100)
    return [*_interval(change, alpha, "ci"), *_interval(skill, alpha, "skill_ci"),
            F.avg((change <= 0).cast("double")).alias("p_value")]


def pair_errors(model: DataFrame, reference: DataFrame) -> DataFrame:
    """Errors of two forecasts row by row. Rows that only one of them has are an error."""
    m = model.select(*KEYS, "model", "ERROR_KM")
    ref = reference.select(*KEYS, F.col("ERROR_KM").alias("REF_ERROR_KM"), F.lit(1).alias("_ref"))
    both = m.withColumn("_model", F.lit(1)).join(ref, list(KEYS), "full")
    single = both.where("_ref IS NULL OR _model IS NULL").limit(1).count()
    if single:
        raise ValueError("paired comparison needs the same rows on both sides")
    return both.drop("_ref", "_model")


def paired_bootstrap(pairs: DataFrame, groups=REPORT, replicates: int = K.BOOTSTRAP_REPLICATES,
                     alpha: float = K.BOOTSTRAP_ALPHA, seed: int = K.SEED) -> DataFrame:
    """Difference of means and skill with intervals; p is the share of replicates
    in which the model is not better. ``pairs`` has ERROR_KM and REF_ERROR_KM."""
    rows = pairs.where("ERROR_KM IS NOT NULL AND REF_ERROR_KM IS NOT NULL")
    model, ref = F.avg("ERROR_KM"), F.avg("REF_ERROR_KM")
    observed = rows.groupBy(*groups).agg(
        F.count("*").alias("n_samples"), (ref - model).alias("mean_difference_km"),
        F.when(ref > 0, (ref - model) / ref * 100).alias("skill_pct"))
    sums = replicate_sums(rows, groups, replicates, seed).where("w > 0")
    spread = sums.groupBy(*groups).agg(*_skill_intervals(alpha))
    return observed.join(spread, list(groups))


# ------------------------------------------------------------------ evaluation
def evaluate_models(scored: DataFrame, groups=REPORT) -> DataFrame:
    """All deterministic metrics per model and horizon: one aggregate plus percentiles."""
    rows = with_reference_error(scored)
    stats = rows.groupBy(*groups).agg(
        *_error_columns(), *_within_columns(), *_component_columns(), *_target_columns(),
        F.when(F.first("model") != K.REFERENCE_BASELINE, _skill_column()).alias("skill_pct"))
    return with_percentiles(stats, scored, groups)


def evaluate_with_intervals(scored: DataFrame, replicates: int = K.BOOTSTRAP_REPLICATES,
                            seed: int = K.SEED) -> DataFrame:
    """``evaluate_models`` plus bootstrap intervals and p values, from one draw of the weights.

    The reference error is missing only where the observation is, hence with the
    error itself, so both intervals are over the same rows.
    """
    pairs = with_reference_error(scored).where("ERROR_KM IS NOT NULL AND REF_ERROR_KM IS NOT NULL")
    sums = replicate_sums(pairs, REPORT, replicates, seed).where("w > 0")
    spread = sums.groupBy(*REPORT).agg(*_mean_interval(K.BOOTSTRAP_ALPHA), *_skill_intervals(K.BOOTSTRAP_ALPHA))
    other = F.col("model") != K.REFERENCE_BASELINE
    spread = spread.select(*REPORT, "mean_ci_lower", "mean_ci_upper", *[
        F.when(other, F.col(c)).alias(name) for c, name in (
            ("skill_ci_lower", "skill_ci_lower"), ("skill_ci_upper", "skill_ci_upper"), ("p_value", "skill_p_value"))])
    return evaluate_models(scored).join(spread, list(REPORT), "left")


def evaluate_by_basin(scored: DataFrame, min_rows: int = K.BASIN_MIN_ROWS) -> DataFrame:
    """The breakdown per basin, for basins with enough rows."""
    groups = (*REPORT, "BASIN")
    stats = scored.groupBy(*groups).agg(
        F.count("*").alias("_rows"), *_error_columns(), *_component_columns()) \
        .where(F.col("_rows") >= min_rows)
    out = with_percentiles(stats, scored, groups, {"median_km": 0.5})
    return out.select(*groups, "n_samples", *[F.round(c, 1).alias(c) for c in (
        "mean_km", "median_km", "cross_track_mae_km", "along_track_bias_km")])


TABLE_DIGITS = {"mean_km": 1, "median_km": 1, "p90_km": 1, "within_100km_pct": 1, "r2": 3,
                "cross_track_mae_km": 1, "along_track_mae_km": 1, "along_track_bias_km": 1,
                "skill_pct": 1}


def comparison_table(evaluation: DataFrame) -> DataFrame:
    """Headline columns, rounded, ordered by horizon and mean error."""
    extra = {c: d for c, d in {"mean_ci_lower": 0, "mean_ci_upper": 0, "skill_ci_lower": 1,
                               "skill_ci_upper": 1, "skill_p_value": 4}.items()
             if c in evaluation.columns}
    return evaluation.select(*REPORT, *[F.round(c, d).alias(c)
                                        for c, d in {**TABLE_DIGITS, **extra}.items()],
                             "n_samples").orderBy("horizon", "mean_km", "model")


def error_by_lead_pivot(evaluation: DataFrame, horizons=K.HORIZONS) -> DataFrame:
    """Models down, horizons across, mean error in the cells."""
    wide = evaluation.groupBy("model").pivot("horizon", list(horizons)).agg(F.first("mean_km"))
    return wide.select("model", *[F.col(str(h)).alias(f"h{h}") for h in horizons])


def rank_models(evaluation: DataFrame) -> DataFrame:
    """Rank by mean error within a horizon, with the error split."""
    order = Window.partitionBy("horizon").orderBy("mean_km", "model")
    return evaluation.select("horizon", F.row_number().over(order).alias("rank"), "model", "mean_km",
                             "median_km", "p90_km", "cross_track_mae_km", "along_track_bias_km")


def best_per_horizon(evaluation: DataFrame, baselines=K.BASELINES) -> DataFrame:
    """The best model of each horizon; baselines only count when there is nothing else."""
    is_model = ~F.col("model").isin(*baselines)
    has_model = F.max(is_model.cast("int")).over(Window.partitionBy())  # report rows only
    pool = evaluation.withColumn("_any", has_model).where((F.col("_any") == 0) | is_model)
    order = Window.partitionBy("horizon").orderBy("mean_km", "model")
    return pool.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_any")
