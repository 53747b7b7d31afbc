"""Distributed models of the two displacement components, on MLlib.

One estimator per output component (MLlib trees and linear models have a single
output). Fits and scoring run on the executors; the driver holds a fitted model
and tables of a few rows.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.operators import grown_trees, tree_tables
from driftline.operators import least_squares as Q
from driftline.operators import metrics as M
from driftline.operators import split as S
from driftline.session import shared_dir, tasks_for

OUTPUTS = ("LAT", "LON")


@dataclass
class PairModel:
    """Two fitted regressors and what is needed to apply them safely."""

    model: str
    horizon: int
    features: tuple[str, ...]
    lat: object
    lon: object
    means: dict[str, float] = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    def assemble(self, df: DataFrame, impute: bool = False) -> DataFrame:
        """The feature vector. MLlib sends missing values to one side of a split
        silently, so they are an error unless ``impute`` fills in training means."""
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"{self.model} at {self.horizon} h needs columns {missing}")
        if impute:
            df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.means[c]))
                                 for c in self.features})
        return VectorAssembler(inputCols=list(self.features), outputCol="_x",
                               handleInvalid="error").transform(df)

    def predict_vectors(self, df: DataFrame) -> DataFrame:
        """Both predictions for a table with the vector ``_x``."""
        for fitted, out in ((self.lat, "PRED_Y_LAT"), (self.lon, "PRED_Y_LON")):
            df = fitted.copy().setFeaturesCol("_x").setPredictionCol(out).transform(df)
        return df

    def predict(self, df: DataFrame, impute: bool = False) -> DataFrame:
        kept = [c for c in df.columns if c not in ("PRED_Y_LAT", "PRED_Y_LON")]
        scored = self.predict_vectors(self.assemble(df.select(*kept), impute))
        return scored.drop("_x") if not impute else scored.select(
            *[c for c in kept if c not in self.features], *self.features, "PRED_Y_LAT", "PRED_Y_LON")


def predict_positions(model: PairModel, df: DataFrame, mode: str = K.TARGET_MODE) -> DataFrame:
    """Predicted coordinates of each row (issue position plus displacement)."""
    from driftline.functions import geo
    scored = model.predict(df)
    if mode == "displacement":
        pair = geo.offset_position("LAT", "LON", "PRED_Y_LAT", "PRED_Y_LON")
    else:
        pair = F.col("PRED_Y_LAT"), F.col("PRED_Y_LON")
    return scored.withColumns({"PRED_LAT": pair[0], "PRED_LON": pair[1]})


# ------------------------------------------------------------------------ fits
def _subset_strategy(value) -> str:
    if value in ("sqrt", "log2", "all", "auto"):
        return value
    return "all" if float(value) >= 1.0 else str(float(value))


#: Parameters each estimator honours; any other is an error.
HONOURED = {
    "random_forest": {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "max_features"},
    "xgboost": {"n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree",
                "min_child_weight", "gamma", "reg_alpha", "reg_lambda"},
    "linear_regression": set()}
MAX_DEPTH = 30  # of MLlib


def check_params(model: str, params: dict) -> None:
    """Raise for parameters that the estimator would ignore or cut."""
    unknown = sorted(set(params) - HONOURED[model])
    if unknown:
        raise ValueError(f"{model} has no parameters {unknown}")
    if int(params.get("max_depth", 1)) > MAX_DEPTH:
        raise ValueError(f"max_depth is at most {MAX_DEPTH}")


def _forest(params: dict, seed: int) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=int(params["n_estimators"]), maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
        featureSubsetStrategy=_subset_strategy(params.get("max_features", "sqrt")),
        maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10, seed=seed)


def _boosted(params: dict, seed: int) -> GBTRegressor:
    return GBTRegressor(
        maxIter=int(params["n_estimators"]), maxDepth=int(params["max_depth"]),
        stepSize=float(params.get("learning_rate", 0.1)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy=_subset_strategy(params.get("colsample_bytree", 1.0)),
        minInstancesPerNode=max(1, int(params.get("min_child_weight", 1))),
        minInfoGain=float(params.get("gamma", 0.0)),
        # walking one shallow tree costs less than keeping and zipping node ids at every level
        maxMemoryInMB=1024, cacheNodeIds=int(params["max_depth"]) > 6, checkpointInterval=10, seed=seed)


ESTIMATORS = {"random_forest": _forest, "xgboost": _boosted}


#: Passes over the rows (levels of a forest, levels times rounds of boosted trees) beyond which trees are grown
#: in tasks: MLlib runs a job a pass, and sums a histogram for every node of a level over the network.
MLLIB_PASSES = {"random_forest": 8, "xgboost": 200}

#: Rows from which a fit deals them out anew, and the most that one of its tasks then reads.
DEALT_ROWS = 100_000
ROWS_PER_TASK = 100_000


def evenly_dealt(rows: DataFrame, n: int, columns, at_once: int = 1) -> DataFrame:
    """The partition and the given columns in tasks of bounded, even size.

    Every level of every tree is a pass over the rows. As files come, their row groups are the
    tasks: few and large ones, which leave cores idle and grow with the table. Fits that run at
    the same time, ``at_once``, fill the cores together, so each needs fewer tasks a pass: a task
    costs about as much for its start as for 15,000 rows.
    """
    keys = [c for c in ("SID", "ISO_TIME") if c in rows.columns]
    given = rows.select("split", *columns, *[c for c in keys if c not in columns])
    if n < DEALT_ROWS:
        return given
    return given.repartition(tasks_for(rows.sparkSession, n, ROWS_PER_TASK, at_once), *keys)


def best_round(losses: list[float], patience: int = K.PATIENCE) -> int:
    """Index of the best round before ``patience`` rounds without gain."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def fit(rows: DataFrame, model: str, horizon: int = K.DEFAULT_HORIZON, params: dict | None = None,
        features=K.FEATURES, early_stopping: bool = True, seed: int = K.SEED,
        mode: str = K.TARGET_MODE, at_once: int = 1) -> PairModel:
    """Fit one model on the training rows of ``prepare_data``.

    Boosted trees stop at the best validation round (mean squared error over both outputs,
    patience 30): the losses of all rounds come from one pass over the validation rows, and
    the ensemble is cut in its node table. ``reg_alpha`` and ``reg_lambda`` set the leaf values of
    the grown trees, ``min_samples_split`` of a forest collapses nodes of fewer rows. ``at_once``
    says how many ensembles are grown at the same time by the caller. Ensembles of more than
    ``MLLIB_PASSES``, or several of ``DEALT_ROWS`` at the same time, are grown in tasks (``grown_trees``)
    where a task can hold the rows.
    """
    if model == "linear_regression":
        check_params(model, params or {})
        return linear_regression(rows, horizon, features, mode)
    if model not in ESTIMATORS:
        raise ValueError(f"unknown model {model!r}")
    params = dict(params if params is not None else K.DEFAULT_PARAMS.get(model, {}))
    check_params(model, params)
    shared_dir(rows.sparkSession)  # MLlib checkpoints node ids there
    targets = K.target_columns(horizon, mode)
    started = time.time()
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error")
    fitted_on = rows.where("split IN ('train', 'val')")
    sizes = {r["split"]: r["n"] for r in fitted_on.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if not sizes.get("train"):
        raise ValueError("no training rows")
    n = sum(sizes.values())
    in_tasks = passes(model, params) > MLLIB_PASSES[model] or (at_once > 1 and n >= DEALT_ROWS)
    if in_tasks and n <= grown_trees.MAX_ROWS:
        return grown(fitted_on, model, horizon, params, features, early_stopping and sizes.get("val"), seed, mode, sizes, started)
    used = assembler.transform(evenly_dealt(fitted_on, n, [*features, *targets], at_once)).select(
        "split", "_x", *targets).persist()
    train, val = used.where("split = 'train'"), used.where("split = 'val'")
    try:
        spark, best = rows.sparkSession, None

        def one(target):
            fitted = ESTIMATORS[model](params, seed).setFeaturesCol("_x").setLabelCol(target).setPredictionCol("_p").fit(train)
            if model == "random_forest" and int(params.get("min_samples_split", 2)) > 2:
                return tree_tables.collapsed(spark, fitted, int(params["min_samples_split"]))
            alpha, penalty = (float(params.get(name, 0)) for name in ("reg_alpha", "reg_lambda"))
            if model != "xgboost" or not (alpha or penalty):
                return fitted
            shapes = [len(v) for v in tree_tables.leaf_values(spark, fitted)]
            reached = tree_tables.reached_leaves(spark, fitted, train, target)
            return tree_tables.with_leaf_values(
                spark, fitted, tree_tables.penalised_values(reached, fitted, shapes, alpha, penalty))

        def losses(fitted, target):
            reached = tree_tables.reached_leaves(spark, fitted, val, target)
            return tree_tables.staged_losses(reached, tree_tables.leaf_values(spark, fitted), list(fitted.treeWeights))

        with ThreadPoolExecutor(2) as pool:  # both outputs at the same time
            pair = list(pool.map(one, targets))
            if model == "xgboost" and early_stopping and sizes.get("val"):
                best = best_round([(a + b) / 2 for a, b in zip(*pool.map(losses, pair, targets))])
                pair = list(pool.map(lambda m: tree_tables.first_trees(spark, m, best + 1), pair))
        means = train.select(Summarizer.mean(F.col("_x")).alias("m")).first()["m"].toArray()
    finally:
        used.unpersist()
    return PairModel(model, horizon, tuple(features), pair[0], pair[1], dict(zip(features, map(float, means))),
                     fit_info(model, horizon, mode, sizes, features, targets, params, best, started))


def grown(fitted_on: DataFrame, model: str, horizon: int, params: dict, features, stops, seed: int, mode: str,
          sizes: dict[str, int], started: float) -> PairModel:
    """The fit by trees grown in tasks."""
    targets, best = K.target_columns(horizon, mode), None

    def stop(losses):
        found = best_round(losses)
        return found, len(losses) - found > K.PATIENCE

    spark, n_features = fitted_on.sparkSession, len(features)
    base = grown_trees.binned(fitted_on if model == "xgboost" else fitted_on.where("split = 'train'"), features, targets)
    if model == "random_forest":
        pair = grown_trees.fit_forest(spark, base, n_features, params, seed)
    else:
        pair, best = grown_trees.fit_boosted(spark, base, n_features, params, seed, stop if stops else None)
    info = fit_info(model, horizon, mode, sizes, features, targets, params, best, started)
    return PairModel(model, horizon, tuple(features), *pair, grown_trees.means(spark, base, features), info | {"trees": "grown"})


def training_means(rows: DataFrame, features) -> dict[str, float]:
    means = rows.where("split = 'train'").agg(*[F.avg(F.col(c)).alias(c) for c in features]).first()
    return {c: float(means[c]) for c in features}


def fit_info(model, horizon, mode, sizes, features, targets, params, best, started) -> dict:
    return {"model": model, "horizon": horizon, "target_mode": mode,
            "n_train_rows": sizes["train"], "n_val_rows": sizes.get("val", 0),
            "n_features": len(features), "feature_names": list(features), "target_names": list(targets),
            "params": {k: str(v) for k, v in params.items()}, "best_iteration": best,
            "split_fingerprint": K.fingerprint(K.split_config()),
            "fit_seconds": round(time.time() - started, 2),
            "trained_at": datetime.now().isoformat(timespec="seconds")}


def as_predictions(model: PairModel, rows: DataFrame, label: str | None = None,
                   mode: str = K.TARGET_MODE) -> DataFrame:
    """Predictions in the long form of the baselines, ready for ``metrics.score``."""
    lat, lon = K.target_columns(model.horizon, mode)
    names = {**K.MODEL_LABELS, "linear_regression": "Linear Regression"}
    kept = [c for c in (*K.META_COLUMNS, "split") if c in rows.columns]
    return model.predict(rows).select(
        *kept, F.lit(model.horizon).alias("horizon"), F.col(lat).alias("Y_LAT"),
        F.col(lon).alias("Y_LON"), F.lit(label or names.get(model.model, model.model)).alias("model"),
        "PRED_Y_LAT", "PRED_Y_LON")


def linear_regression(rows: DataFrame, horizon: int = K.DEFAULT_HORIZON, features=K.FEATURES,
                      mode: str = K.TARGET_MODE) -> PairModel:
    """Least squares on all features, both outputs: the minimum-norm solution by tall-skinny QR."""
    started, targets = time.time(), K.target_columns(horizon, mode)
    train = rows.where("split = 'train'").select(*features, *targets, F.lit(horizon).alias("_h"))
    found = Q.fit_groups(train, features, targets, "_h")
    if not found:
        raise ValueError("no training rows")
    solved = found[horizon]
    lat, lon = (Q.LinearFit(tuple(map(float, solved.weights[:, k])), float(solved.intercepts[k])) for k in (0, 1))
    counts = rows.groupBy("split").count().collect()
    return PairModel("linear_regression", horizon, tuple(features), lat, lon, training_means(rows, features), fit_info(
        "linear_regression", horizon, mode, {r["split"]: r["count"] for r in counts}, features, targets, {}, None, started)
        | {"rank": solved.rank})


def passes(model: str, params: dict) -> int:
    """About how many passes over the rows, one after the other, a fit takes: a level of a tree is one,
    and the trees of a forest grow together."""
    depth = int(params.get("max_depth", 1))
    return depth * int(params.get("n_estimators", 1)) if model == "xgboost" else depth


def train_grid(features: DataFrame, assignments: DataFrame, models=("random_forest", "xgboost"),
               horizons=K.HORIZONS, params: dict[str, dict] | None = None,
               threads: int = 5, rows_of=None, then: Callable[[PairModel], object] | None = None) -> list[PairModel]:
    """Every model at every horizon on one feature table, a few fits at a time.

    The threads only submit Spark jobs, which share the cluster. The fits of most passes start
    first, so that no long one is left to run alone. ``rows_of(horizon)`` may give the prepared
    rows, if they are written already; ``then`` is called with each fit, beside the others.
    """
    rows_of = rows_of or (lambda horizon: S.prepare_data(features, horizon, assignments))
    jobs = [(m, h) for h in horizons for m in models]
    at_once = min(threads, len(jobs)) * len(OUTPUTS)

    def one(job):
        model, horizon = job
        rows = rows_of(horizon)
        fitted = fit(rows, model, horizon, (params or {}).get(model), at_once=at_once)
        fitted.info["diagnostics"] = {
            f"{r['split']}_rmse_deg": r["rmse_deg"]
            for r in training_diagnostics(as_predictions(fitted, rows)).collect()}
        if then is not None:
            then(fitted)
        return fitted

    def long_first(job):
        return -passes(job[0], (params or {}).get(job[0]) or K.DEFAULT_PARAMS.get(job[0], {}))

    with ThreadPoolExecutor(threads) as pool:
        made = {job: pool.submit(one, job) for job in sorted(jobs, key=long_first)}
        return [made[job].result() for job in jobs]


# ----------------------------------------------------------------- diagnostics
def training_diagnostics(predictions: DataFrame) -> DataFrame:
    """RMSE in degrees over both outputs per model, horizon and partition.

    OVERFIT marks a model whose test error is more than twice its training error.
    """
    e = [F.col(f"PRED_Y_{o}") - F.col(f"Y_{o}") for o in OUTPUTS]
    rmse = F.sqrt((F.avg(e[0] * e[0]) + F.avg(e[1] * e[1])) / 2)
    groups = ["model", "horizon"]
    per_split = predictions.groupBy(*groups, "split").agg(F.round(rmse, 5).alias("rmse_deg"))
    ratio = per_split.groupBy(*groups).agg(
        (F.max(F.when(F.col("split") == "test", F.col("rmse_deg")))
         / F.max(F.when(F.col("split") == "train", F.col("rmse_deg")))).alias("test_train_ratio"))
    return per_split.join(F.broadcast(ratio), groups) \
                    .withColumn("overfit", F.coalesce(F.col("test_train_ratio") > 2, F.lit(False)))


OVERVIEW = ("model string, horizon int, n_train_rows bigint, n_features int, fit_seconds double, "
            "best_iteration int, train_rmse_deg double, test_rmse_deg double")


def training_overview(spark: SparkSession, fits: list[PairModel]) -> DataFrame:
    """One row per fit: rows, seconds, errors."""
    rows = []
    for f in fits:
        d = f.info.get("diagnostics", {})
        rows.append((f.model, f.horizon, int(f.info["n_train_rows"]), f.info["n_features"],
                     f.info["fit_seconds"], f.info["best_iteration"],
                     d.get("train_rmse_deg"), d.get("test_rmse_deg")))
    return spark.createDataFrame(rows, OVERVIEW)


# ---------------------------------------------------------------------- tuning
def mean_error_km(model: PairModel, rows: DataFrame) -> float:
    """Mean track error over a table, one distributed aggregate."""
    return M.score(as_predictions(model, rows)).agg(F.avg("ERROR_KM")).first()[0]


def _log_int(rng, low, high):
    return int(round(math.exp(rng.uniform(math.log(low), math.log(high)))))


def _log_float(rng, low, high):
    return math.exp(rng.uniform(math.log(low), math.log(high)))


def candidates(model: str, n: int, seed: int = K.SEED) -> list[dict]:
    """Seeded random parameter sets from fixed ranges."""
    rng = random.Random(f"{model}-{seed}")
    out = []
    for _ in range(n):
        if model == "random_forest":
            out.append({"n_estimators": rng.randrange(100, 501, 50), "max_depth": rng.randint(6, 30),
                        "min_samples_leaf": _log_int(rng, 1, 20),
                        "max_features": rng.choice(["sqrt", "log2", 0.3, 0.5, 1.0])})
        elif model == "xgboost":
            out.append({"n_estimators": K.BOOSTED_TUNING_CEILING, "max_depth": rng.randint(3, 12),
                        "learning_rate": _log_float(rng, 0.01, 0.3),
                        "subsample": rng.uniform(0.5, 1.0), "colsample_bytree": rng.uniform(0.5, 1.0),
                        "min_child_weight": _log_int(rng, 1, 50), "gamma": _log_float(rng, 1e-4, 5.0)})
        else:
            raise ValueError(f"unknown model {model!r}")
    return out


TRIALS = ("model string, horizon int, trial int, params map<string,string>, val_error_km double, "
          "is_best boolean")


def tuning_sweep(rows: DataFrame, model: str, horizon: int = K.DEFAULT_HORIZON, n_trials: int = 50,
                 subsample: float = 1.0, limits: dict | None = None, seed: int = K.SEED,
                 threads: int = 2) -> tuple[DataFrame, dict]:
    """Fit every candidate on train, compare mean validation error, keep the best.

    All candidates are fitted in full; ``halving`` spends that on the promising ones only.
    ``limits`` overrides parameters of all candidates (a smaller ensemble, say).
    Returns the table of trials and the result for ``upsert_params``.
    """
    val = rows.where("split = 'val'")
    if val.isEmpty():
        raise ValueError("tuning needs a validation partition")
    data = S.subsample_train(rows, subsample, seed) if subsample < 1.0 else rows

    def one(params):
        fitted = fit(data, model, horizon, params, seed=seed)
        kept = dict(params)
        if fitted.info["best_iteration"] is not None:
            kept["n_estimators"] = fitted.info["best_iteration"] + 1
        return kept, mean_error_km(fitted, val)

    with ThreadPoolExecutor(threads) as pool:
        done = list(pool.map(one, [{**c, **(limits or {})} for c in candidates(model, n_trials, seed)]))
    best = min(range(len(done)), key=lambda i: done[i][1])
    table = rows.sparkSession.createDataFrame(
        [(model, horizon, i, {k: str(v) for k, v in p.items()}, e, i == best)
         for i, (p, e) in enumerate(done)], TRIALS)
    result = {"model": model, "horizon": horizon, "params": done[best][0],
              "best_val_error_km": round(done[best][1], 2), "n_trials": len(done),
              "tuned_at": datetime.now().isoformat(timespec="seconds")}
    return table, result
