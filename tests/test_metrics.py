import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.functions.order_stats import exact_percentiles, hash_rank
from driftline.operators import analysis as A
from driftline.operators import metrics as M


def scored(spark, errors, model="m", reference=None, parts=4):
    pdf = pd.DataFrame({"ISO_TIME": pd.date_range("2000-01-01", periods=len(errors), freq="6h"),
                        "ERROR_KM": errors})
    pdf["SID"], pdf["horizon"], pdf["model"] = "A", 24, model
    pdf["REF_ERROR_KM"] = reference if reference is not None else 0.0
    return spark.createDataFrame(pdf).repartition(parts)


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"gamma": rng.gamma(2, 60, 5001), "ties": np.round(rng.gamma(1, 2, 4000)),
              "one": np.array([7.25]), "same": np.full(50, 3.0), "negative": rng.normal(0, 40, 777)}
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in groups.items()])
    pdf = pd.concat([pdf, pd.DataFrame({"g": [None] * 3, "v": [1.0, 2.0, 4.0]})])
    qs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = exact_percentiles(spark.createDataFrame(pdf, "g string, v double").repartition(5), ["g"], "v", qs)
    rows = {r.g: r for r in got.collect()}
    for name, values in [*groups.items(), (None, np.array([1.0, 2.0, 4.0]))]:
        for c, q in qs.items():
            assert rows[name][c] == pytest.approx(np.percentile(values, 100 * q), abs=1e-9), (name, c)


def test_percentiles_of_one_bin(spark):
    """All values in one bin are cut again until no bin has more than ten different rows."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.uniform(0.001, 0.002, 3000), np.full(500, 0.0015), rng.uniform(0, 1e-9, 300)])
    pdf = pd.DataFrame({"g": ["a"] * len(values), "v": values})
    qs = {"p10": 0.1, "p50": 0.5, "p55": 0.55, "p95": 0.95}
    df = spark.createDataFrame(pdf).repartition(3)
    got = exact_percentiles(df, ["g"], "v", qs, max_bin_rows=10).first()
    for c, q in qs.items():
        assert got[c] == pytest.approx(np.percentile(values, 100 * q), abs=1e-15)
    assert exact_percentiles(df.limit(0), ["g"], "v", qs).count() == 0


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    one = {r.k: r.hash_rank for r in hash_rank(df.repartition(3), ["k"], 42).collect()}
    two = {r.k: r.hash_rank for r in hash_rank(df.repartition(7), ["k"], 42).collect()}
    assert one == two and sorted(one.values()) == list(range(5000))


def test_statistics(spark):
    df = scored(spark, [111.0, 222.0, 333.0, 444.0, None])
    got = M.track_error_stats(df).first()
    assert (got.n_samples, got.n_dropped, got.mean_km) == (4, 1, 277.5)
    assert got.std_km == pytest.approx(np.std([111, 222, 333, 444], ddof=1))
    within = M.within_threshold_pct(df).first()
    assert (within.within_200km_pct, within.within_300km_pct) == (25, 50)
    assert M.track_error_stats(scored(spark, [5.0])).first().std_km == 0.0


def test_bootstrap_matches_theory_and_partitioning(spark):
    errors = np.random.default_rng(5).gamma(2, 60, 2000)
    a, b = (M.bootstrap_ci(scored(spark, errors, parts=p)).first() for p in (1, 6))
    assert a.mean_ci_lower == pytest.approx(b.mean_ci_lower)
    half = 1.96 * errors.std(ddof=1) / np.sqrt(len(errors))
    assert a.mean_ci_lower == pytest.approx(errors.mean() - half, abs=0.8)
    assert a.mean_ci_upper == pytest.approx(errors.mean() + half, abs=0.8)


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(6)
    ref = rng.gamma(2, 60, 2000)
    better = M.paired_bootstrap(scored(spark, 0.8 * ref, reference=ref)).first()
    assert better.skill_pct == pytest.approx(20) and better.p_value < 0.05
    assert better.ci_lower > 0 and 19 < better.skill_ci_lower <= better.skill_ci_upper < 21
    noise = M.paired_bootstrap(scored(spark, rng.gamma(2, 60, 2000), reference=ref)).first()
    assert noise.p_value > 0.01


def test_pairs_must_match(spark):
    long, short = scored(spark, [1.0, 2.0, 3.0]), scored(spark, [1.0, 2.0])
    assert M.pair_errors(long, long).count() == 3
    with pytest.raises(ValueError):
        M.pair_errors(long, short)


def test_skill_and_r2(spark):
    pdf = pd.DataFrame({"Y_LAT": [1.0, 2, 3, 5], "Y_LON": [0.0, 1, 2, 2], "PRED_Y_LAT": [1.5, 2, 2, 4],
                        "PRED_Y_LON": [0.5, 1, 1, 3]})
    pdf["model"], pdf["horizon"] = "m", 6
    got = M.target_mae_r2(spark.createDataFrame(pdf)).first()

    def r2(y, p):
        return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert got.r2 == pytest.approx((r2(pdf.Y_LAT, pdf.PRED_Y_LAT) + r2(pdf.Y_LON, pdf.PRED_Y_LON)) / 2)
    model, ref = scored(spark, [50.0] * 4), scored(spark, [100.0] * 4, "ref")
    assert M.skill_score(model.drop("REF_ERROR_KM").unionByName(ref.drop("REF_ERROR_KM")), "ref") \
        .first().skill_pct == pytest.approx(50)


def test_histogram_equals_numpy(spark):
    values = np.random.default_rng(8).gamma(2, 60, 3000)
    got = A.histogram(spark.createDataFrame(pd.DataFrame({"v": values})), "v", 60).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=60)
    assert {r.bin: r.n for r in got} == {i: c for i, c in enumerate(counts) if c}
    assert all(r.left_edge == pytest.approx(edges[r.bin]) for r in got)


def test_thinning_keeps_exactly_n(spark):
    df = scored(spark, np.arange(9000.0)).withColumn("LEAD_HOURS", F.lit(24))
    assert A.thin(df, ["model"], 500, 42).count() == 500
    assert A.thin(df, ["model"], 50000, 42).count() == 9000


def test_error_distribution_equals_numpy_in_two_scans(spark):
    rng = np.random.default_rng(12)
    groups = {"gamma": rng.gamma(2, 60, 3001), "edges": np.arange(0, 61, 0.5), "same": np.full(40, 3.0),
              "hot": np.append(np.full(2000, 10.0), [0.0, 60.0])}
    pdf = pd.concat([pd.DataFrame({"model": k, "LEAD_HOURS": 24, "e": v}) for k, v in groups.items()])
    pdf = pd.concat([pdf, pd.DataFrame({"model": ["same"], "LEAD_HOURS": [24], "e": [None]})])
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(pdf, "model string, LEAD_HOURS int, e double").repartition(5).select(
        "model", "LEAD_HOURS", counted.asNondeterministic()("e").alias("ERROR_KM"))
    rows = A.error_distribution(df).collect()
    assert seen.value == 2 * len(pdf)
    for name, values in groups.items():
        got = sorted((r for r in rows if r.model == name), key=lambda r: r.bin)
        if name == "same":
            assert [(r.bin, r.n, r.left_edge, r.right_edge) for r in got] == [(0, 40, 3.0, 3.0)]
        else:
            want, edges = np.histogram(values, 60)
            assert {r.bin: r.n for r in got} == {i: n for i, n in enumerate(want) if n}
            assert all(r.left_edge == pytest.approx(edges[r.bin]) for r in got)
        assert got[0].mean_km == pytest.approx(values.mean())
        assert got[0].median_km == pytest.approx(np.median(values))
        assert got[0].p90_km == pytest.approx(np.percentile(values, 90))
    assert A.error_distribution(df.limit(0)).count() == 0
