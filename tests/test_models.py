import re
import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from helpers import SMALL
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from test_features import requests

from driftline import constants as K
from driftline.operators import baselines as B
from driftline.operators import features as E
from driftline.operators import forecast as T
from driftline.operators import grown_trees as G
from driftline.operators import halving as H
from driftline.operators import importance as I
from driftline.operators import least_squares as Q
from driftline.operators import metrics as M
from driftline.operators import models as L
from driftline.operators import split as S
from driftline.operators import tree_tables as X
from driftline.operators import validate as V
from driftline.plans import model_queries as MQ
from driftline.plans import stages
from driftline.plans import tables as P
from driftline.session import cut_lineage
from driftline.sources import models as store
from driftline.sources import tables as R


@pytest.fixture(scope="module")
def rows(spark):
    return MQ.prepared_rows(spark, SMALL).persist()


@pytest.fixture(scope="module")
def forest(spark, rows):
    return L.fit(rows, "random_forest", 24, {"n_estimators": 4, "max_depth": 4})


def test_best_round_has_patience():
    assert L.best_round([5, 4, 3, 3.5, 2]) == 4
    assert L.best_round([5, 4, 3] + [3.5] * 40 + [1]) == 2


def test_boosting_stops_early(rows):
    model = L.fit(rows, "xgboost", 24, {"n_estimators": 4, "max_depth": 2, "learning_rate": 0.3})
    assert model.lat.getNumTrees == model.info["best_iteration"] + 1 <= 4


@pytest.fixture(scope="module")
def vectors(rows):
    train = rows.where("split = 'train'")
    return VectorAssembler(inputCols=list(K.FEATURES), outputCol="_x").transform(train).select("_x", "TARGET_DLAT_24H").persist()


def test_leaf_values_without_penalty_are_the_ensembles_own(spark, rows, vectors):
    fitted = L.fit(rows, "xgboost", 24, {"n_estimators": 3, "max_depth": 2}, early_stopping=False).lat
    own = X.leaf_values(spark, fitted)
    reached = X.reached_leaves(spark, fitted, vectors, "TARGET_DLAT_24H")
    again = X.penalised_values(reached, fitted, [len(v) for v in own], 0.0, 0.0)
    assert all(a == pytest.approx(b, abs=1e-9) for a, b in zip(own, again))
    alpha, penalty = 3.0, 50.0
    first = X.penalised_values(reached, fitted, [len(v) for v in own], alpha, penalty)[0]
    table = reached.toPandas()
    for leaf, value in enumerate(first):
        y = table.y[table.leaves.str[0] == leaf]
        assert value == pytest.approx(np.sign(y.sum()) * max(abs(y.sum()) - alpha, 0) / (len(y) + penalty))
    changed = X.with_leaf_values(spark, fitted, [first, *own[1:]])
    assert all(a == pytest.approx(b) for a, b in zip(X.leaf_values(spark, changed), [first, *own[1:]]))
    large = L.fit(rows, "xgboost", 24, {"n_estimators": 2, "max_depth": 2, "reg_alpha": 1e9}, early_stopping=False)
    assert large.predict(rows).agg(F.max(F.abs("PRED_Y_LAT"))).first()[0] == 0


def test_penalised_values_of_one_pass_equal_those_of_a_pass_a_round(spark, rows, vectors, monkeypatch):
    fitted = L.fit(rows, "xgboost", 24, {"n_estimators": 5, "max_depth": 3}, early_stopping=False).lat
    shapes = [len(v) for v in X.leaf_values(spark, fitted)]
    reached = X.reached_leaves(spark, fitted, vectors, "TARGET_DLAT_24H").repartition(5).persist()
    passes, one = [], X.residual_sums
    monkeypatch.setattr(X, "residual_sums", lambda *a: (passes.append(1), one(*a))[1])
    found = X.penalised_values(reached, fitted, shapes, 0.5, 4.0)
    assert not passes
    monkeypatch.setattr(X, "MAX_SHARED", 0)
    rounds = X.penalised_values(reached, fitted, shapes, 0.5, 4.0)
    assert len(passes) == 5 and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(found, rounds))


def test_a_fit_deals_its_rows_out_evenly(rows, monkeypatch):
    given = rows.coalesce(1)
    n = given.count()
    assert L.evenly_dealt(given, n, K.FEATURES).rdd.getNumPartitions() == 1  # small tables stay as they are
    monkeypatch.setattr(L, "DEALT_ROWS", 10)
    monkeypatch.setattr(L, "ROWS_PER_TASK", n // 20)
    dealt = L.evenly_dealt(given, n, K.FEATURES)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 20 and sum(r["count"] for r in sizes) == n and max(r["count"] for r in sizes) < n / 5


def test_fits_at_the_same_time_share_the_cores(rows, monkeypatch):
    n = rows.count()
    monkeypatch.setattr(L, "DEALT_ROWS", 10)
    tasks = [L.evenly_dealt(rows, n, K.FEATURES, at_once).rdd.getNumPartitions() for at_once in (1, 4, 100)]
    assert tasks == [8, 2, 1]  # of 8 cores
    monkeypatch.setattr(L, "ROWS_PER_TASK", n // 6)
    assert L.evenly_dealt(rows, n, K.FEATURES, 100).rdd.getNumPartitions() >= 6


def test_long_fits_start_first_and_come_back_in_order(spark, rows, monkeypatch):
    begun, done = [], []

    def fit(rows, model, horizon, params, at_once):
        begun.append((model, horizon, at_once))
        return L.PairModel(model, horizon, (), None, None)

    diagnosed = spark.createDataFrame([("train", 0.5)], "split string, rmse_deg double")
    monkeypatch.setattr(L, "fit", fit)
    monkeypatch.setattr(L, "as_predictions", lambda model, rows: diagnosed)
    monkeypatch.setattr(L, "training_diagnostics", lambda made: made)
    fits = L.train_grid(rows, None, horizons=(6, 24), params={"random_forest": MQ.FOREST, "xgboost": MQ.BOOSTED},
                        threads=1, rows_of=lambda horizon: rows, then=done.append)
    assert [(m, h) for m, h, _ in begun] == [(m, h) for m in ("xgboost", "random_forest") for h in (6, 24)]
    assert {n for *_, n in begun} == {2}  # one fit at a time, two outputs
    assert [(f.model, f.horizon) for f in fits] == [(m, h) for h in (6, 24) for m in ("random_forest", "xgboost")]
    assert sorted(map(id, done)) == sorted(map(id, fits)) and fits[0].info["diagnostics"] == {"train_rmse_deg": 0.5}


def test_changed_node_tables_start_no_python_worker(spark, rows, monkeypatch):
    fitted = L.fit(rows, "xgboost", 24, {"n_estimators": 3, "max_depth": 2}, early_stopping=False).lat
    values = [v + 0.5 for v in X.leaf_values(spark, fitted)]

    def refused(*args, **kwargs):
        raise AssertionError("rows of the driver went through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    changed = X.first_trees(spark, X.with_leaf_values(spark, fitted, values), 2)
    assert [list(v) for v in X.leaf_values(spark, changed)] == [list(v) for v in values[:2]]


def test_complete_rows_are_those_of_na_drop(spark):
    df = spark.createDataFrame([(1.0, 2, "a"), (None, 2, "a"), (float("nan"), 2, "a"), (1.0, None, "a"),
                                (float("inf"), 2, "a"), (1.0, 2, None)], "a double, b int, c string")
    assert sorted(df.where(S.complete(df, ["a", "b", "c"])).collect()) == sorted(df.na.drop().collect())
    assert df.where(S.complete(df, ["a", "b"])).count() == 3


def test_ensembles_are_cut_not_fitted_again(spark, rows, vectors):
    fitted = L.fit(rows, "xgboost", 24, {"n_estimators": 4, "max_depth": 2}, early_stopping=False).lat
    short = X.first_trees(spark, fitted, 2)
    assert short.getNumTrees == 2 and list(short.treeWeights) == list(fitted.treeWeights)[:2]
    reached = X.reached_leaves(spark, fitted, vectors, "TARGET_DLAT_24H")
    losses = X.staged_losses(reached, X.leaf_values(spark, fitted), list(fitted.treeWeights))
    made = short.copy().setPredictionCol("p").transform(vectors)
    assert losses[1] == pytest.approx(made.agg(F.avg((F.col("p") - F.col("TARGET_DLAT_24H")) ** 2)).first()[0])


def test_node_tables_are_stored_once(spark, rows):
    fitted = L.fit(rows, "xgboost", 24, {"n_estimators": 3, "max_depth": 2}, early_stopping=False).lat
    path, values = X.saved(spark, fitted), X.leaf_values(spark, fitted)
    short = X.first_trees(spark, fitted, 2)
    assert X.saved(spark, fitted) == path != X.saved(spark, short)
    assert [list(v) for v in X.leaf_values(spark, short)] == [list(v) for v in values[:2]]


def test_rows_that_leaves_share_are_counted_by_pairs_of_trees(spark):
    rng, shapes = np.random.default_rng(1), [3, 1, 4]
    at = np.stack([rng.integers(0, n, 500) for n in shapes], 1)
    y = rng.normal(size=500).round(3)
    table = spark.createDataFrame([(float(v), row.tolist()) for v, row in zip(y, at)], "y double, leaves array<int>").repartition(3)
    ones = np.zeros((500, 8))
    np.put_along_axis(ones, at + [0, 3, 4], 1, axis=1)
    y_sum, both = X.shared_rows(table, shapes)
    assert (both == ones.T @ ones).all() and y_sum == pytest.approx(y @ ones)


def test_nodes_of_few_rows_are_collapsed(spark, rows, vectors):
    params = {"n_estimators": 2, "max_depth": 5, "max_features": "all"}
    whole = L.fit(rows, "random_forest", 24, params).lat
    small = X.collapsed(spark, whole, 200)
    again = L.fit(rows, "random_forest", 24, {**params, "min_samples_split": 200}).lat
    assert small.toDebugString.splitlines()[1:] == again.toDebugString.splitlines()[1:]
    path = X.folder(spark, "test")
    small.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    assert nodes.where("leftChild >= 0 AND rawCount < 200").isEmpty() and 4 < nodes.count() < whole.totalNumNodes
    assert nodes.groupBy("treeID").agg((F.max("id") + 1 == F.count("*")).alias("ok")).where("NOT ok").isEmpty()
    root = nodes.where("id = 0").select("prediction").collect()
    bare = X.collapsed(spark, whole, 10**9).copy().setPredictionCol("p").transform(vectors).first().p
    assert bare == pytest.approx(sum(r[0] for r in root) / 2)


def test_saved_model_predicts_the_same(spark, rows, forest, tmp_path):
    root = str(tmp_path)
    store.save_model(spark, forest, root, {"note": "x"})
    again = store.load_model(spark, root, "random_forest", 24, features=K.FEATURES)
    assert again.info["note"] == "x" and again.info["version_mismatches"] == []
    assert L.mean_error_km(forest, rows) == pytest.approx(L.mean_error_km(again, rows))
    listed = store.list_models(spark, root).first()
    assert listed.model == "random_forest" and listed.size_mb > 0
    with pytest.raises(ValueError, match="other features"):
        store.load_model(spark, root, "random_forest", 24, features=K.FEATURES[1:])
    assert store.version_mismatches({"pyspark": "1.0"})[0].startswith("pyspark: saved with 1.0")


def test_shuffling_keeps_every_value_once(rows):
    base = rows.select("SID", "ISO_TIME", F.array("LAT").alias("_xa"))
    got = I.shuffled_copies(base, 2, 42, 4000).toPandas()  # two buckets
    for _, part in got.groupby("repeat"):
        assert sorted(x[0] for x in part["_xa"]) == sorted(x[0] for x in part["_xs"])
        assert (part["_xa"].str[0] != part["_xs"].str[0]).mean() > 0.5


def test_more_shuffled_copies_are_more_tasks(rows, monkeypatch):
    base = rows.select("SID", "ISO_TIME", F.array("LAT").alias("_xa"))
    monkeypatch.setattr(I, "ROWS_PER_TASK", 400)
    plan = I.shuffled_copies(base, 2, 42, 4000)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(repeat" in plan and ", 20)" in plan and plan.count("Exchange hash") == 1


def test_importance_finds_the_used_feature(spark, rows):
    easy = rows.withColumns({"TARGET_DLAT_24H": F.col("WMO_WIND") / 20, "TARGET_DLON_24H": F.lit(0.0)})
    model = L.fit(easy, "random_forest", 24, {"n_estimators": 10, "max_depth": 5, "max_features": "all"})
    found = I.permutation_importance(model, easy, repeats=2)
    assert found.first().feature == "WMO_WIND" and found.count() == len(K.FEATURES)
    assert I.grouped_permutation(model, easy, repeats=2).first().group == "intensity"
    impurity = I.impurity_importance(spark, model)
    assert impurity.first().feature == "WMO_WIND"
    ranks = I.importance_compare(found, impurity)
    assert ranks.agg(F.sum("rank_impurity")).first()[0] == 56 * 57 / 2  # ties share their ranks


def test_clusters(spark):
    df = spark.range(100).select(*[(F.rand(i) if i > 2 else F.col("id") * (i + 1.0)).alias(c)
                                   for i, c in enumerate(K.FEATURES)])
    got = I.correlated_clusters(df).collect()
    assert [r.members for r in got] == [list(K.FEATURES[:3])]


def test_parameters_are_stored_per_model_and_horizon(spark, tmp_path):
    path = str(tmp_path / "params")
    assert R.resolve_params(spark, path, "xgboost", 24) == K.BOOSTED_PARAMS
    one = {"model": "xgboost", "horizon": 24, "params": {"max_depth": 3, "learning_rate": 0.1},
           "best_val_error_km": 9.0, "n_trials": 5}
    R.upsert_params(spark, path, [one, {**one, "horizon": 72}])
    R.upsert_params(spark, path, [{**one, "params": {"max_depth": 4}}])
    assert R.resolve_params(spark, path, "xgboost", 24)["max_depth"] == 4
    assert R.resolve_params(spark, path, "xgboost", 72)["learning_rate"] == 0.1
    assert R.resolve_params(spark, path, "xgboost", 6) == K.BOOSTED_PARAMS
    assert R.tuning_summary(spark, path).count() == 2


def test_rollout_of_constant_motion_is_a_straight_line(spark, tables):
    df = E.build_features(tables["single"])
    start = T.first_usable_rows(df.na.drop(subset=["BEARING_CHANGE_2", "DELTA_LAT_MEAN_24H"]))
    got = T.forecast_recursive(start, df, lambda d: d.withColumns(
        {"PRED_Y_LAT": F.col("DELTA_LAT"), "PRED_Y_LON": F.col("DELTA_LON")})).collect()
    assert len(got) == 12 and max(r.ERROR_KM for r in got) < 1e-6


@pytest.mark.parametrize("n_steps", [12, 4])
def test_rollout_predicts_each_step_once(spark, tables, n_steps):
    df = E.build_features(tables["clean"])
    start = cut_lineage(T.first_usable_rows(df.na.drop(subset=["BEARING_CHANGE_2", "DELTA_LAT_MEAN_24H"])))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    predict = lambda d: d.withColumns({"PRED_Y_LAT": counted("DELTA_LAT"), "PRED_Y_LON": F.col("DELTA_LON")})
    got = T.forecast_recursive(start, df, predict, n_steps)
    assert got.count() == got.count() == 4 * n_steps and seen.value == 4 * n_steps
    steps = {r.SID: r.s for r in got.groupBy("SID").agg(F.sort_array(F.collect_list("LEAD_HOURS")).alias("s")).collect()}
    assert all(s == [6 * k for k in range(1, n_steps + 1)] for s in steps.values()) and len(steps) == 4


def test_requests_are_scored(spark, forest):
    checked = V.validate_requests(requests(spark))
    live = E.live_features(checked.where("accepted"), F.lit("2024-09-01").cast("timestamp_ntz"))
    published = spark.createDataFrame([("Random Forest", 24, 123.456)], "model string, horizon int, mean_km double")
    predict = {("random_forest", 24): lambda d: forest.predict(d, impute=True)}
    got = {r.request_id: r for r in T.score_requests(checked, live, predict, published).collect()}
    assert set(got) == {"ok", "short"} and got["ok"].warning is None and got["short"].warning
    assert got["ok"].track_error_km == 123.5
    assert abs(got["ok"].predicted_lat - 15.0) < 15 and -180 <= got["ok"].predicted_lon < 180


def test_no_accepted_request_is_lost(spark, forest):
    asked = [(model, h) for model in ("random_forest", "xgboost") for h in (24, 48, 72)]
    made = requests(spark).where("request_id = 'ok'").drop("request_id", "model", "forecast_horizon").crossJoin(
        spark.createDataFrame([(f"r{i}", m, h) for i, (m, h) in enumerate(asked)],
                              "request_id string, model string, forecast_horizon int"))
    checked = V.validate_requests(made)
    live = E.live_features(checked.where("request_id <> 'r4'"), F.lit("2024-09-01").cast("timestamp_ntz"))
    for predict in ({("random_forest", 24): lambda d: forest.predict(d, impute=True)}, {}):
        got = {r.request_id: r for r in T.score_requests(checked, live, predict).collect()}
        assert set(got) == {f"r{i}" for i in range(6)}
        assert got["r0"].status == ("ok" if predict else "no model") and got["r4"].status == "no features"
        assert all(got[f"r{i}"].status == "no model" and got[f"r{i}"].predicted_lat is None for i in (1, 2, 3, 5))


def test_features_of_requests_are_computed_once_for_all_models(spark, forest):
    checked = V.validate_requests(requests(spark))
    live = E.live_features(checked.where("accepted"), F.lit("2024-09-01").cast("timestamp_ntz"))
    answer = lambda d: forest.predict(d, impute=True)
    one = T.score_requests(checked, live, {("random_forest", 24): answer})
    several = T.score_requests(checked, live, {("random_forest", 24): answer, ("xgboost", 48): answer})
    assert "Window" not in several._jdf.queryExecution().executedPlan().toString()
    assert sorted(several.collect()) == sorted(one.collect())


def test_each_model_reads_its_own_requests(spark, forest):
    checked = V.validate_requests(requests(spark))
    live = E.live_features(checked.where("accepted"), F.lit("2024-09-01").cast("timestamp_ntz"))
    predict = {(m, h): lambda d: forest.predict(d, impute=True) for m in ("random_forest", "xgboost") for h in (24, 48)}
    rows = T.written_request_rows(checked, live)
    got = T.score_requests(checked, live, predict, rows=rows)
    filters = re.findall(r"PartitionFilters: (.*)", got._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert len(filters) == 4 and sum("= xgboost" in f for f in filters) == sum("= random_forest" in f for f in filters) == 2
    assert sorted(got.collect()) == sorted(T.score_requests(checked, live, predict).collect())
    assert got.count() == checked.where("accepted").count()


def test_different_tables_are_built_at_the_same_time(spark):
    meet = threading.Barrier(2, timeout=30)
    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(lambda name: stages.once(spark, "together", name, meet.wait), ("a", "b"))) == [0, 1]
        assert len({*pool.map(lambda _: stages.once(spark, "together", "c", object), range(4))}) == 1


def test_start_rows_do_not_shuffle_the_features(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = MQ.start_rows(spark, SMALL)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == found.select("SID").distinct().count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parameters_without_effect_are_refused(rows):
    for params in ({**K.FOREST_PARAMS, "max_leaf_nodes": 9}, {**K.FOREST_PARAMS, "max_depth": 31}):
        with pytest.raises(ValueError):
            L.fit(rows, "random_forest", 24, params)


def test_linear_model_solves_the_normal_equations(rows):
    """Residuals of the training rows sum to zero, also when weighted by any feature.

    Some features are sums of others, so the normal matrix is singular.
    """
    predicted = cut_lineage(L.linear_regression(rows).predict(rows.where("split = 'train'")))
    for side in ("LAT", "LON"):
        residual = F.col(f"TARGET_D{side}_24H") - F.col(f"PRED_Y_{side}")
        parts = [residual, *[residual * F.col(c) for c in K.FEATURES]]
        ratios = predicted.agg(*[F.coalesce(F.abs(F.sum(p)) / F.sum(F.abs(p)), F.lit(0.0)) for p in parts]).first()
        assert max(ratios) < 1e-9


def test_least_squares_does_not_depend_on_the_partitions(rows, monkeypatch):
    train = rows.where("split = 'train'").withColumn("h", F.lit(24))
    targets = K.target_columns(24)
    one = Q.fit_groups(train.coalesce(1), K.FEATURES, targets, "h")[24]
    monkeypatch.setattr(Q, "FAN_IN", 3)  # so that factors meet in several levels
    many = Q.fit_groups(train.repartition(50), K.FEATURES, targets, "h")[24]
    assert one.rank == many.rank < len(K.FEATURES) and one.n == many.n == train.count()
    assert many.weights == pytest.approx(one.weights, rel=1e-6, abs=1e-9)


def test_least_norm_among_equal_fits(spark):
    df = spark.range(50).selectExpr("id * 1.0 AS a", "id * 1.0 AS b", "5.0 AS c", "id * 3.0 + 2 AS y", "1 AS h")
    got = Q.fit_groups(df, ["a", "b", "c"], ["y"], "h")[1]
    assert got.rank == 1 and got.weights[:, 0] == pytest.approx([1.5, 1.5, 0], abs=1e-9)
    assert got.intercepts[0] == pytest.approx(2)


def test_saved_regression_predicts_the_same(spark, rows, tmp_path):
    fitted = L.fit(rows, "linear_regression", 24)
    store.save_model(spark, fitted, str(tmp_path))
    again = store.load_model(spark, str(tmp_path), "linear_regression", 24, features=K.FEATURES)
    assert L.mean_error_km(fitted, rows) == pytest.approx(L.mean_error_km(again, rows))


def test_four_baselines_by_default(spark, rows):
    long = S.forecast_rows(P.feature_table(spark, SMALL), keep=K.FEATURES)
    made = B.run_baselines(S.assign_split_rows(long, P.split_table(spark, SMALL)), "train")
    assert {r.model for r in made.select("model").distinct().collect()} == set(K.BASELINES)
    same = made.where("model = 'Linear Regression' AND horizon = 24").agg(F.avg("PRED_Y_LAT")).first()[0]
    wide = L.linear_regression(rows).predict(rows.where("split = 'train'")).agg(F.avg("PRED_Y_LAT")).first()[0]
    assert same == pytest.approx(wide)


def test_a_sweep_keeps_the_best(rows):
    train = rows.withColumn("split", F.when(F.col("SEASON") % 2 == 0, "val").otherwise("train"))
    table, best = L.tuning_sweep(train, "random_forest", 24, 2, limits={"n_estimators": 2, "max_depth": 2})
    errors = [r.val_error_km for r in table.collect()]
    assert best["best_val_error_km"] == pytest.approx(min(errors), abs=0.01)
    assert L.candidates("xgboost", 3) == L.candidates("xgboost", 3)


def test_halving_keeps_the_better_half_on_nested_samples(rows, monkeypatch):
    assert H.schedule(9) == [(9, 1 / 9), (3, 1 / 3), (1, 1.0)]
    assert H.schedule(1) == [(1, 1.0)] and H.schedule(9, rungs=1) == [(9, 1.0)]
    assert [n for n, _ in H.schedule(10)] == [10, 4, 2]
    few = {r.sid for r in S.subsample_train(rows, 1 / 9).where("split = 'train'").selectExpr("SID || ISO_TIME AS sid").collect()}
    more = {r.sid for r in S.subsample_train(rows, 1 / 3).where("split = 'train'").selectExpr("SID || ISO_TIME AS sid").collect()}
    assert few < more

    seen = []
    drawn = [{"n_estimators": 9, "max_depth": d} for d in (5, 1, 4, 2, 3, 9, 8, 7, 6)]
    monkeypatch.setattr(L, "candidates", lambda model, n, seed: drawn[:n])
    monkeypatch.setattr(L, "mean_error_km", lambda fitted, val: float(fitted.params["max_depth"]))

    class Fitted:
        def __init__(self, data, params):
            seen.append((params["max_depth"], params["n_estimators"]))
            self.params, self.info = params, {"best_iteration": None, "n_train_rows": 1, "fit_seconds": 0.0}

    monkeypatch.setattr(L, "fit", lambda data, model, horizon, params, seed: Fitted(data, params))
    held = rows.withColumn("split", F.when(F.col("SEASON") % 2 == 0, "val").otherwise("train"))
    table, best = H.halving_sweep(held, "random_forest", 24, 9)
    assert len(table) == 13 and best["params"] == {"n_estimators": 9, "max_depth": 1}
    assert sorted(seen[9:12]) == [(1, 3), (2, 3), (3, 3)] and {n for _, n in seen[:9]} == {1}
    assert [t[-1] for t in table] == [False] * 12 + [True]


def test_halving_fits_both_models(spark, rows):
    held = rows.withColumn("split", F.when(F.col("SEASON") % 2 == 0, "val").otherwise("train"))
    table, results = H.sweep_all(spark, lambda h: held, horizons=(24,), n_trials=2, eta=2, rungs=2,
                                 limits={m: {"n_estimators": 4, "max_depth": 3} for m in K.MODEL_LABELS})
    found = table.collect()
    assert len(found) == 6 and len(results) == 2
    for r in results:
        last = [t for t in found if t.model == r["model"] and t.rung == 1]
        assert len(last) == 1 and last[0].is_best and last[0].train_share == 1.0
        assert last[0].val_error_km == pytest.approx(r["best_val_error_km"], abs=0.01)
        assert all(t.n_train_rows < last[0].n_train_rows for t in found if t.model == r["model"] and t.rung == 0)


def test_linear_model_is_at_least_as_good_as_the_mean(rows):
    fitted = L.linear_regression(rows)
    train = L.as_predictions(fitted, rows.where("split = 'train'"))
    assert M.target_mae_r2(M.score(train)).first().r2 > 0


def test_the_forest_query_fits_the_whole_forest(spark, rows, monkeypatch):
    asked = []
    monkeypatch.setattr(MQ, "prepared_rows", lambda spark, sf, horizon=24: rows)
    monkeypatch.setattr(L, "fit", lambda rows, model, horizon, params=None, **options: asked.append(
        {**K.DEFAULT_PARAMS[model], **(params or {})} | options) or "fitted")
    assert MQ.forest(spark, "whole forest of a test") == "fitted"
    assert asked == [K.FOREST_PARAMS]


def test_the_boosted_query_fits_the_whole_ensemble(spark, rows, monkeypatch):
    asked = []
    monkeypatch.setattr(MQ, "prepared_rows", lambda spark, sf, horizon=24: rows)
    monkeypatch.setattr(L, "fit", lambda rows, model, horizon, params=None, **options: asked.append(
        {**K.DEFAULT_PARAMS[model], **(params or {})} | options) or "fitted")
    assert MQ.boosted(spark, "whole boosting of a test") == "fitted"
    assert asked == [K.BOOSTED_PARAMS]


def test_the_sweep_query_searches_all_candidates(spark, rows, monkeypatch):
    fitted = []

    class Fitted:
        def __init__(self, params):
            fitted.append(params)
            self.info = {"best_iteration": None, "n_train_rows": 1, "fit_seconds": 0.0}

    held = rows.withColumn("split", F.when(F.col("SEASON") % 2 == 0, "val").otherwise("train"))
    monkeypatch.setattr(MQ, "prepared_rows", lambda spark, sf, horizon=24: held)
    monkeypatch.setattr(L, "fit", lambda data, model, horizon, params, **options: Fitted(params))
    monkeypatch.setattr(L, "mean_error_km", lambda fitted, val: 1.0)
    trials = MQ.sweep(spark, "sweep of a test")[0].collect()
    n = len(L.candidates("xgboost", 27))
    assert len(trials) == 10 * (n + n // 3 + n // 9) == len(fitted)
    whole = {(t.model, t.params["n_estimators"]) for t in trials if t.train_share == 1.0}
    assert ("xgboost", str(K.BOOSTED_TUNING_CEILING)) in whole
    assert {int(trees) for model, trees in whole if model == "random_forest"} <= set(range(100, 501, 50))


def by_hand(x, y, w, rows, depth, min_leaf):
    """Predictions of a tree grown on all cuts, node by node."""
    mean, best = np.average(y[rows], weights=w[rows]), (1e-9, None)
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[rows, f])[:-1]:
            sides = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
            if min(w[s].sum() for s in sides) >= min_leaf:
                gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in sides) - (w[rows] * y[rows]).sum() ** 2 / w[rows].sum()
                if gain > best[0] + 1e-9:
                    best = gain, sides
    if best[1] is None:
        return dict.fromkeys(rows.tolist(), mean)
    return {k: v for s in best[1] for k, v in by_hand(x, y, w, s, depth - 1, min_leaf).items()}


@pytest.mark.parametrize("by_row", [True, False])
@pytest.mark.parametrize("subtracted", [0, 2, 512])
def test_a_grown_tree_is_that_of_an_exhaustive_search(by_row, subtracted, monkeypatch):
    rng = np.random.default_rng(3)
    x, w = rng.integers(0, 9, (80, 3)).astype(float), rng.integers(0, 3, 80).astype(float)
    y = x[:, 0] * x[:, 1] + rng.normal(size=80)
    cuts = [np.unique(c)[:-1] for c in x.T]
    bins = np.column_stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)]).astype(np.uint8)
    monkeypatch.setattr(G, "SUBTRACTED", subtracted)
    monkeypatch.setattr(G, "NODES_AT_ONCE", 3)
    held = G.Bins(bins if by_row else np.ascontiguousarray(bins.T), by_row)
    tree = G.grow(held, y, w, cuts, rng, max_depth=4, min_leaf=2)
    at = tree.leaves(x)
    assert (at == tree.binned_leaves(held, cuts)).all() and 10 < len(tree.value) <= 31
    for row, value in by_hand(x, y, w, np.flatnonzero(w > 0), 4, 2).items():
        assert tree.value[at[row]] == pytest.approx(value)


def test_long_fits_are_grown_in_tasks(spark, rows, monkeypatch, tmp_path):
    def refused(*args, **kwargs):
        raise AssertionError("a job a level")

    monkeypatch.setitem(L.ESTIMATORS, "random_forest", refused)
    monkeypatch.setitem(L.ESTIMATORS, "xgboost", refused)
    held = rows.withColumn("split", F.when(F.col("SEASON") % 2 == 0, "val").otherwise("train"))
    n = held.where("split = 'train'").count()
    train = held.where("split = 'train'")
    spread = train.agg(F.stddev_pop("TARGET_DLAT_24H")).first()[0]
    forest = L.fit(held, "random_forest", 24, {**K.FOREST_PARAMS, "n_estimators": 6})
    assert (forest.lat.getNumTrees, forest.info["n_train_rows"], forest.info["best_iteration"]) == (6, n, None)
    boosted = L.fit(held, "xgboost", 24, {**K.BOOSTED_PARAMS, "learning_rate": 0.2})
    assert boosted.lat.getNumTrees == boosted.lon.getNumTrees == boosted.info["best_iteration"] + 1
    means = L.training_means(held, K.FEATURES)
    for fitted in (forest, boosted):
        assert fitted.means == pytest.approx(means)
        assert fitted.lon.featureImportances.toArray().sum() == pytest.approx(1)
        made = fitted.predict(train).agg(F.avg((F.col("PRED_Y_LAT") - F.col("TARGET_DLAT_24H")) ** 2)).first()[0]
        assert made < 0.8 * spread ** 2
        again = L.fit(held.repartition(3), fitted.model, 24, {**K.DEFAULT_PARAMS[fitted.model], **(
            {"n_estimators": 6} if fitted is forest else {"learning_rate": 0.2})})
        store.save_model(spark, again, str(tmp_path))
        loaded = store.load_model(spark, str(tmp_path), fitted.model, 24)
        assert loaded.lat.getNumTrees == fitted.lat.getNumTrees

        def predictions(model):
            out = model.predict(held.select("SID", "ISO_TIME", *K.FEATURES)).orderBy("SID", "ISO_TIME").toPandas()
            return out[["PRED_Y_LAT", "PRED_Y_LON"]].to_numpy()

        assert predictions(loaded) == pytest.approx(predictions(fitted), abs=1e-9)  # whatever the partitions


def test_rounds_go_on_where_the_last_job_ended(spark, rows, monkeypatch):
    held = rows.withColumn("split", F.when(F.col("SEASON") % 2 == 0, "val").otherwise("train"))
    base = G.binned(held, K.FEATURES, K.target_columns(24))
    params = {**K.BOOSTED_PARAMS, "n_estimators": 5, "max_depth": 3}
    whole, _ = G.fit_boosted(spark, base, len(K.FEATURES), params, 1, None)
    monkeypatch.setattr(G, "ROUNDS_A_JOB", 2)
    parts, _ = G.fit_boosted(spark, base, len(K.FEATURES), params, 1, None)
    for a, b in zip(whole, parts):
        one, other = ([t.value.tolist() for t in sorted(G.trees(m.path), key=lambda t: t.value.tolist())] for m in (a, b))
        assert len(one) == 5 and one == other


def test_large_fits_at_the_same_time_are_grown_in_tasks(spark, rows, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("a job a level")

    monkeypatch.setattr(L, "DEALT_ROWS", 10)
    monkeypatch.setitem(L.ESTIMATORS, "random_forest", refused)
    monkeypatch.setitem(L.ESTIMATORS, "xgboost", refused)
    small = {"random_forest": {**MQ.FOREST, "n_estimators": 2}, "xgboost": {**MQ.BOOSTED, "n_estimators": 2}}
    fits = L.train_grid(rows, None, horizons=(24,), params=small, rows_of=lambda horizon: rows)
    assert [f.model for f in fits] == ["random_forest", "xgboost"] and all("train_rmse_deg" in f.info["diagnostics"] for f in fits)
    gaps = rows.limit(20).withColumn("LAT_LAG_1", F.lit(None).cast("double"))
    assert all(f.predict(gaps, impute=True).where("PRED_Y_LAT IS NOT NULL").count() == 20 for f in fits)
    table = I.group_ablation(rows, "random_forest", 24, small["random_forest"], groups=("turning",)).collect()
    assert {(r.removed_group, r.n_features) for r in table} == {("(none)", len(K.FEATURES)), ("turning", len(K.FEATURES) - 3)}
    with pytest.raises(AssertionError, match="a job a level"):
        L.fit(rows, "random_forest", 24, small["random_forest"])  # a small ensemble alone stays with MLlib
