"""Registered queries of the models, on all rows and horizons.

``fit_random_forest``, ``fit_boosted`` and the sweep run with the operators' own parameters.
The other queries, which need some fitted model, still take the small ensembles below.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import functions as F

from driftline import constants as K
from driftline.operators import features as E
from driftline.operators import forecast as T
from driftline.operators import halving as H
from driftline.operators import importance as I
from driftline.operators import metrics as M
from driftline.operators import models as L
from driftline.operators import split as S
from driftline.operators import validate as V
from driftline.plans.feature_queries import REFERENCE_TIME, REQUESTS_SQL, requests_table
from driftline.plans.metric_queries import evaluation
from driftline.plans.product_queries import start_rows
from driftline.plans.registry import query
from driftline.plans.sql import prepared, r, with_clean, with_features, with_scored
from driftline.plans.stages import once, stage, stage_path
from driftline.plans.tables import all_baseline_table, baseline_table, feature_table, split_table
from driftline.sources import models as store
from driftline.sources import tables as R

FOREST = {"n_estimators": 20, "max_depth": 8, "min_samples_split": 9, "min_samples_leaf": 2, "max_features": "sqrt"}
BOOSTED = {"n_estimators": 45, "max_depth": 4, "learning_rate": 0.2, "subsample": 0.9, "reg_alpha": 0.01, "reg_lambda": 1.0}


def prepared_rows(spark, sf, horizon=24):
    columns = dict.fromkeys([*K.ID_COLUMNS, *K.META_COLUMNS, *K.FEATURES, *K.target_columns(horizon)])
    return stage(spark, sf, f"prepared_{horizon}", lambda: S.prepare_data(
        feature_table(spark, sf).select(*columns), horizon, split_table(spark, sf)))


def test_rows(spark, sf, horizon=24):
    return prepared_rows(spark, sf, horizon).where("split = 'test'")


def forest(spark, sf, horizon=24):
    """The forest with the operator's parameters."""
    return once(spark, sf, f"whole_forest_{horizon}", lambda: L.fit(
        prepared_rows(spark, sf, horizon), "random_forest", horizon))


def small_forest(spark, sf, horizon=24):
    return once(spark, sf, f"forest_{horizon}", lambda: L.fit(
        prepared_rows(spark, sf, horizon), "random_forest", horizon, FOREST))


def boosted(spark, sf):
    """The boosted ensemble with the operator's parameters."""
    return once(spark, sf, "whole_boosted_24", lambda: L.fit(prepared_rows(spark, sf), "xgboost", 24))


def small_boosted(spark, sf):
    return once(spark, sf, "boosted_24", lambda: L.fit(
        prepared_rows(spark, sf), "xgboost", 24, BOOSTED))


def linear(spark, sf, horizon=24):
    return once(spark, sf, f"linear_{horizon}", lambda: L.linear_regression(
        prepared_rows(spark, sf, horizon), horizon))


@query("linear_regression")
def _(spark, sf):
    return M.score(L.as_predictions(linear(spark, sf), test_rows(spark, sf)))


@query("run_all_baselines")
def _(spark, sf):
    """The predictions of all four baselines at every horizon, scored."""
    return all_baseline_table(spark, sf)


@query("evaluate_all_baselines")
def _(spark, sf):
    """All four baselines at every horizon, with intervals and skill."""
    return M.comparison_table(M.evaluate_with_intervals(all_baseline_table(spark, sf)))


@query("fit_random_forest")
def _(spark, sf):
    return M.score(L.as_predictions(forest(spark, sf), test_rows(spark, sf)))


@query("fit_boosted")
def _(spark, sf):
    return M.score(L.as_predictions(boosted(spark, sf), test_rows(spark, sf)))


@query("resolve_params")
def _(spark, sf):
    """What a sweep stored for a horizon, next to the parameters that apply to it."""
    path = stage_path(spark, sf, "params_resolve")
    R.upsert_params(spark, path, sweep(spark, sf)[1])
    rows = [(m, h, {k: str(v) for k, v in R.resolve_params(spark, path, m, h).items()})
            for m in K.MODEL_LABELS for h in K.HORIZONS]
    applied = spark.createDataFrame(rows, "model string, horizon int, params map<string,string>")
    stored = R.read_params(spark, path).withColumnRenamed("params", "stored_params")
    return applied.join(stored, ["model", "horizon"], "left")


def grid(spark, sf, then=None):
    return once(spark, sf, "grid", lambda: L.train_grid(
        feature_table(spark, sf), split_table(spark, sf), ("random_forest", "xgboost"), K.HORIZONS,
        {"random_forest": FOREST, "xgboost": BOOSTED}, rows_of=lambda horizon: prepared_rows(spark, sf, horizon),
        then=then))


@query("train_grid")
def _(spark, sf):
    fits = grid(spark, sf)
    out = None
    for f in fits:
        part = M.score(L.as_predictions(f, test_rows(spark, sf, f.horizon)))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("model", "horizon").agg(F.count("*").alias("n"), F.avg("ERROR_KM").alias("mean_km"))


# Exact for given predictions: constant motion takes the place of a fitted model.
@query("training_diagnostics", with_scored(
    f"""SELECT s.*, {r('ratio')} AS test_train_ratio, coalesce(ratio > 2, false) AS overfit FROM per s
    JOIN (SELECT horizon, max(rmse_deg) FILTER (WHERE split = 'test') / max(rmse_deg) FILTER (WHERE split = 'train')
    AS ratio FROM per GROUP BY 1) q USING (horizon)""",
    f"""per AS (SELECT 'constant motion' AS model, horizon, split, {r('''sqrt((avg((DELTA_LAT * (horizon / 6) - Y_LAT)
    * (DELTA_LAT * (horizon / 6) - Y_LAT)) + avg((DELTA_LON * (horizon / 6) - Y_LON)
    * (DELTA_LON * (horizon / 6) - Y_LON))) / 2)''', 5)} AS rmse_deg FROM rows_split GROUP BY horizon, split)"""))
def _(spark, sf):
    from driftline.operators.baselines import linear_extrapolation
    from driftline.plans.tables import forecast_row_table
    lat, lon = linear_extrapolation()
    made = forecast_row_table(spark, sf).withColumns(
        {"PRED_Y_LAT": lat, "PRED_Y_LON": lon, "model": F.lit("constant motion")})
    out = L.training_diagnostics(made)
    return out.withColumn("test_train_ratio", F.round("test_train_ratio", 6))


@query("training_overview")
def _(spark, sf):
    return L.training_overview(spark, grid(spark, sf))


@query("predict_positions")
def _(spark, sf):
    return L.predict_positions(small_forest(spark, sf), test_rows(spark, sf)).select(
        "SID", "ISO_TIME", "LAT", "LON", "PRED_LAT", "PRED_LON")


def sweep(spark, sf):
    """Both models at all horizons, with the candidates and rungs of the operator; nothing searched is overridden."""
    return once(spark, sf, "sweep", lambda: H.sweep_all(
        spark, lambda horizon: prepared_rows(spark, sf, horizon)))


@query("tuning_sweep")
def _(spark, sf):
    return sweep(spark, sf)[0]


@query("upsert_params")
def _(spark, sf):
    path = stage_path(spark, sf, "params")
    results = sweep(spark, sf)[1]
    R.upsert_params(spark, path, [{**x, "best_val_error_km": 1e9} for x in results])
    R.upsert_params(spark, path, [x for x in results if x["horizon"] != 72])  # 72 h keeps the first
    return R.read_params(spark, path)


# Stored results: the constant-motion error of every horizon, written as tuning results.
@query("tuning_summary", with_scored(
    f"""SELECT 'random_forest' AS model, horizon, {r('avg(ERROR_KM)', 2)} AS val_error_km,
    CAST(count(*) AS INTEGER) AS trials, 'n/a' AS tuned_at FROM scored WHERE model = 'Linear Extrapolation' GROUP BY horizon"""))
def _(spark, sf):
    path = stage_path(spark, sf, "params_summary")
    stats = baseline_table(spark, sf).where("model = 'Linear Extrapolation'").groupBy("horizon").agg(
        F.round(F.avg("ERROR_KM"), 2).alias("km"), F.count("*").alias("n"))
    R.upsert_params(spark, path, [
        {"model": "random_forest", "horizon": x["horizon"], "params": {"max_depth": 8},
         "best_val_error_km": x["km"], "n_trials": x["n"], "tuned_at": "n/a"} for x in stats.collect()])
    return R.tuning_summary(spark, path)


@query("model_store")
def _(spark, sf):
    root = stage_path(spark, sf, "models")
    store.save_model(spark, small_forest(spark, sf), root, {"note": "registered query"})
    again = store.load_model(spark, root, "random_forest", 24, features=K.FEATURES)
    return M.score(L.as_predictions(again, test_rows(spark, sf)))


@query("list_models")
def _(spark, sf):
    root = stage_path(spark, sf, "models_listed")
    for fitted in (small_forest(spark, sf), small_boosted(spark, sf)):
        store.save_model(spark, fitted, root)
    return store.list_models(spark, root)


# ----------------------------------------------------------------------- products
@query("forecast_recursive")
def _(spark, sf):
    model = small_forest(spark, sf, 6)
    return T.forecast_recursive(start_rows(spark, sf), feature_table(spark, sf), model.predict)


def asked_requests(spark, sf):
    """Checked requests over both models and all horizons (and one that is refused), and their features."""
    place = F.split_part("request_id", F.lit("@"), F.lit(2)).cast("int")
    asked = F.array(*map(F.lit, (*K.HORIZONS, 7)))
    requests = requests_table(spark, sf).withColumns({
        "model": F.when(place % 2 == 0, "random_forest").otherwise("xgboost"),
        "forecast_horizon": F.get(asked, F.floor(place / 2).cast("int") % 6)})
    checked = V.validate_requests(requests)
    return checked, E.live_features(checked.where("accepted"), F.lit(REFERENCE_TIME).cast("timestamp_ntz"))


def answering(fits):
    return {(f.model, f.horizon): lambda df, f=f: f.predict(df, impute=True) for f in fits}


def measured_error(spark, sf, fit):
    """One row: the mean test error of a fit."""
    def build():
        scored = M.score(L.as_predictions(fit, test_rows(spark, sf, fit.horizon)))
        return scored.groupBy("model", "horizon").agg(F.avg("ERROR_KM").alias("mean_km")).collect()

    return once(spark, sf, f"error_{fit.model}_{fit.horizon}", build)


@query("score_requests")
def _(spark, sf):
    def asked():
        checked, features = asked_requests(spark, sf)
        return checked, features, T.written_request_rows(checked, features)

    with ThreadPoolExecutor(5) as pool:
        made = pool.submit(asked)  # the features of requests do not wait for the models
        fits = grid(spark, sf, then=lambda f: measured_error(spark, sf, f))  # beside the fits that still run
        errors = [r for own in pool.map(lambda f: measured_error(spark, sf, f), fits) for r in own]
        checked, features, rows = made.result()
    measured = spark.createDataFrame(errors, "model string, horizon int, mean_km double")
    return T.score_requests(checked, features, answering(fits), measured, rows)


# One model of ten is fitted here: the other requests must come back as unanswered.
@query("score_requests_status", with_clean(
    """SELECT request_id, model_key, CAST(h AS INTEGER) AS forecast_horizon, CAST(n AS INTEGER) AS n_observations,
    CASE WHEN n < 5 THEN 'only ' || n || ' of 5 observations: missing features were left unset' END AS warning,
    CASE WHEN model_key = 'random_forest' AND h = 24 THEN 'ok' ELSE 'no model' END AS status FROM (
      SELECT request_id, n, CASE WHEN place % 2 = 0 THEN 'random_forest' ELSE 'xgboost' END AS model_key,
        [6, 12, 24, 48, 72, 7][place // 2 % 6 + 1] AS h FROM (
        SELECT request_id, max(n) AS n, CAST(split_part(request_id, '@', 2) AS INTEGER) AS place FROM q_rows GROUP BY 1))
    WHERE h <> 7""", REQUESTS_SQL))
def _(spark, sf):
    return T.score_requests(*asked_requests(spark, sf), answering([small_forest(spark, sf)])).select(
        "request_id", "model_key", "forecast_horizon", "n_observations", "warning", "status")


@query("evaluate_trained_models")
def _(spark, sf):
    """Four baselines and both models at all horizons, with intervals and skill."""
    return M.comparison_table(M.evaluate_with_intervals(all_forecasts(spark, sf)))


def all_forecasts(spark, sf):
    """Scored test forecasts of every baseline and model at every horizon, written once."""
    def build():
        fits = grid(spark, sf)
        parts = [M.score(L.as_predictions(f, test_rows(spark, sf, f.horizon))) for f in fits]
        out = reduce(lambda a, b: a.unionByName(b), parts)
        return out.unionByName(all_baseline_table(spark, sf).select(*out.columns))

    return stage(spark, sf, "all_forecasts", build)


# --------------------------------------------------------------------- importance
def permutation_table(spark, sf):
    return stage(spark, sf, "permutation", lambda: I.permutation_importance(
        small_forest(spark, sf), test_rows(spark, sf)))


@query("impurity_importance")
def _(spark, sf):
    return I.impurity_importance(spark, small_forest(spark, sf))


@query("permutation_importance")
def _(spark, sf):
    return permutation_table(spark, sf).orderBy(F.desc("importance_km"))


@query("grouped_permutation")
def _(spark, sf):
    return I.grouped_permutation(small_forest(spark, sf), test_rows(spark, sf))


@query("group_ablation")
def _(spark, sf):
    return I.group_ablation(prepared_rows(spark, sf), "random_forest", 24, FOREST)


@query("correlated_clusters")
def _(spark, sf):
    return I.correlated_clusters(test_rows(spark, sf))


_ORDER = "[" + ", ".join(f"'{c}'" for c in K.FEATURES) + "]"


@query("correlation_pairs", with_features(
    f"""SELECT a.feature AS feature_a, b.feature AS feature_b, {r('corr(a.x, b.x)')} AS r
    FROM long a JOIN long b ON a.id = b.id AND a.place < b.place GROUP BY a.feature, b.feature
    HAVING abs(corr(a.x, b.x)) > 0.95""",
    f"""complete AS MATERIALIZED (SELECT row_number() OVER () AS id, {', '.join(
        f'CAST({c} AS DOUBLE) AS {c}' for c in K.FEATURES)} FROM features WHERE {prepared(24)}),
    long AS MATERIALIZED (SELECT id, feature, x, list_position({_ORDER}, feature) AS place FROM complete
      UNPIVOT (x FOR feature IN ({', '.join(K.FEATURES)})))"""))
def _(spark, sf):
    out = I.correlation_pairs(S.prepare_training(feature_table(spark, sf), 24))
    return out.withColumn("r", F.round("r", 6))


@query("importance_compare")
def _(spark, sf):
    both = I.importance_compare(permutation_table(spark, sf), I.impurity_importance(spark, small_forest(spark, sf)))
    return I.largest_rank_gaps(both)


@query("top_importance")
def _(spark, sf):
    return I.top_importance(permutation_table(spark, sf))
