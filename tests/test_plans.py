"""The physical plans stay as designed."""

from helpers import SMALL

from driftline.operators import clean as C
from driftline.operators import features as E
from driftline.operators import metrics as M
from driftline.operators import validate as V
from driftline.plans import tables as stages
from driftline.plans.catalog import QUERIES
from driftline.sources import tables as R
from driftline.sources.synthetic import raw_tracks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_needs_two_shuffles(tables):
    p = plan(C.clean(tables["clean"].drop("SEGMENT_ID")))
    assert p.count("Exchange ") == 2
    assert p.index("Exchange hashpartitioning(SID") < p.index("partial_min")  # printed top down


def test_synoptic_filter_runs_below_the_aggregate(spark):
    p = plan(C.to_segments(raw_tracks(spark, SMALL)))
    assert "hour(" in p[p.rindex("partial_min"):]


def test_features_need_one_shuffle_and_three_windows(spark):
    p = plan(E.build_features(stages.clean_table(spark, SMALL)))
    assert p.count("Exchange ") == 1 and p.count("Window [") == 3
    assert "Python" not in p


def test_features_after_cleaning_add_no_shuffle(tables):
    cleaned = C.clean(tables["clean"].drop("SEGMENT_ID"))
    assert plan(E.build_features(cleaned)).count("Exchange ") == 2


def test_metrics_stay_on_the_jvm_and_read_few_columns(spark):
    p = plan(M.within_threshold_pct(stages.baseline_table(spark, SMALL)))
    assert "Python" not in p and "ReadSchema: struct<model:string,ERROR_KM:double" in p.replace(
        "horizon:int,", "")


def test_validation_reads_the_table_six_times(spark):
    df = stages.feature_table(spark, SMALL)
    profile = plan(V.profile(df))
    assert profile.count("FileScan") == 2 and profile.count("BatchEvalPython") == 0  # rows and halo
    assert plan(V.findings(df)).count("FileScan") == 6


def test_one_lead_time_reads_one_partition(spark, tmp_path):
    from driftline.operators.forecast import product_columns
    path = str(tmp_path / "pred")
    R.export_predictions(product_columns(stages.baseline_table(spark, SMALL)), path)
    p = plan(R.read_predictions(spark, path, 24))
    assert "PartitionFilters: [isnotnull(LEAD_HOURS" in p


def test_no_cross_joins_on_data(spark):
    for name in ("evaluate_models", "error_map_by_lead", "displacement_density", "cleaning_summary",
                 "check_target_alignment", "storm_lifecycle"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SMALL)), name
        assert "BroadcastNestedLoopJoin" not in plan(QUERIES[name](spark, SMALL)), name


def test_partition_is_joined_before_a_row_becomes_one_a_horizon(spark):
    from driftline.operators import split as S
    from driftline.plans import tables as P
    found = P.split_forecast_rows(spark, SMALL)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")  # from the top down
    after = S.assign_split_rows(S.forecast_rows(P.feature_table(spark, SMALL)), P.split_table(spark, SMALL))
    assert found.dtypes == after.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, after.collect()))
