"""Registered queries of the baselines and the metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline import constants as K
from driftline.operators import baselines as B
from driftline.operators import metrics as M
from driftline.plans.registry import query, rounded
from driftline.plans.sql import columns, diff, hav, r, rs, seeded, with_scored, with_split, wrap
from driftline.plans.tables import baseline_table, forecast_row_table

KEYS = ("SID", "ISO_TIME", "horizon")


def test_rows(spark, sf):
    return forecast_row_table(spark, sf).where("split = 'test'")


def baseline(name, pair, lat, lon):
    @query(name, with_scored(f"SELECT {columns(KEYS)}, {r(lat)} AS PRED_DLAT, {r(lon)} AS PRED_DLON FROM b_test"))
    def _(spark, sf):
        dlat, dlon = pair()
        return rounded(test_rows(spark, sf).select(*KEYS, dlat.alias("PRED_DLAT"), dlon.alias("PRED_DLON")))


baseline("persistence", B.persistence, "0", "0")
baseline("linear_extrapolation", B.linear_extrapolation, "DELTA_LAT * (horizon / 6)",
         "DELTA_LON * (horizon / 6)")


@query("basin_lookup", with_scored(
    f"SELECT {columns(KEYS)}, BASIN, {r('c_lat')} AS CLIM_DLAT, {r('c_lon')} AS CLIM_DLON FROM b_test"))
def _(spark, sf):
    means = B.fit_climatology(forecast_row_table(spark, sf).where("split = 'train'"))
    return rounded(B.basin_lookup(test_rows(spark, sf), means).select(
        *KEYS, "BASIN", "CLIM_DLAT", "CLIM_DLON"))


@query("climatology", with_split(
    f"""SELECT horizon, BASIN, false AS overall, {r('avg(Y_LAT)')} AS CLIM_DLAT, {r('avg(Y_LON)')} AS CLIM_DLON
    FROM rows_split WHERE split = 'train' AND BASIN IS NOT NULL GROUP BY ALL UNION ALL
    SELECT horizon, NULL, true, {r('avg(Y_LAT)')}, {r('avg(Y_LON)')} FROM rows_split WHERE split = 'train'
    GROUP BY ALL"""))
def _(spark, sf):
    return rounded(B.fit_climatology(forecast_row_table(spark, sf).where("split = 'train'")))


@query("to_target_space", with_split(
    f"""SELECT {columns(KEYS)}, {r('LAT + DELTA_LAT * (horizon / 6)')} AS ABS_LAT,
    {r(wrap('LON + DELTA_LON * (horizon / 6)'))} AS ABS_LON, {r('DELTA_LAT * (horizon / 6)')} AS BACK_DLAT,
    {r(diff(wrap('LON + DELTA_LON * (horizon / 6)'), 'LON'))} AS BACK_DLON FROM rows_split WHERE split = 'test'"""))
def _(spark, sf):
    lat, lon = B.to_target_space(*B.linear_extrapolation(), mode="absolute")
    rows = test_rows(spark, sf).withColumns({"ABS_LAT": lat, "ABS_LON": lon})
    dlat, dlon = B.displacements("ABS_LAT", "ABS_LON", mode="absolute")
    return rounded(rows.select(*KEYS, "ABS_LAT", "ABS_LON", dlat.alias("BACK_DLAT"),
                               dlon.alias("BACK_DLON")))


_PRED = (*KEYS, "model", "PRED_Y_LAT", "PRED_Y_LON")


@query("run_baselines", with_scored(f"SELECT {columns(_PRED)} FROM scored"))
def _(spark, sf):
    return rounded(B.run_baselines(forecast_row_table(spark, sf), names=B.CLOSED_FORM).select(*_PRED))


@query("union_forecasts", with_scored(f"SELECT {columns(_PRED)} FROM scored"))
def _(spark, sf):
    df = baseline_table(spark, sf)
    return rounded(B.union_forecasts(*[df.where(F.col("LEAD_HOURS") == h) for h in K.HORIZONS])
                   .select(*_PRED))


_SCORED = (*KEYS, "model", "BASIN", "LAT", "LON", "TRUE_LAT", "TRUE_LON", "PRED_LAT", "PRED_LON",
           "ERROR_KM", "ALONG_TRACK_KM", "CROSS_TRACK_KM")


@query("reconstruct_positions", with_scored(f"SELECT {columns(_SCORED[:10])} FROM scored"))
def _(spark, sf):
    return rounded(M.reconstruct_positions(B.run_baselines(forecast_row_table(spark, sf), names=B.CLOSED_FORM))
                   .select(*_SCORED[:10]))


@query("score_split", with_scored(f"SELECT {columns(_SCORED, 5)} FROM scored"))
def _(spark, sf):
    return rounded(M.score(B.run_baselines(forecast_row_table(spark, sf), names=B.CLOSED_FORM)).select(*_SCORED), 5)


# ------------------------------------------------------------------- statistics
ERRORS_SQL = f"""count(ERROR_KM) AS n_samples, count(*) - count(ERROR_KM) AS n_dropped, {r('avg(ERROR_KM)')} AS mean_km,
  {r('stddev_samp(ERROR_KM)')} AS std_km, {r('min(ERROR_KM)')} AS min_km, {r('max(ERROR_KM)')} AS max_km"""
QUANT_SQL = ", ".join(f"{r(f'quantile_cont(ERROR_KM, {q})')} AS {c}" for c, q in M.QUANTILES.items())
WITHIN_SQL = ", ".join(f"{r(f'avg(CAST(ERROR_KM <= {t} AS DOUBLE)) * 100')} AS within_{t}km_pct"
                       for t in K.THRESHOLDS_KM)
PARTS_SQL = f"""{r('avg(ALONG_TRACK_KM)')} AS along_track_bias_km, {r('avg(CROSS_TRACK_KM)')} AS cross_track_bias_km,
  {r('avg(abs(ALONG_TRACK_KM))')} AS along_track_mae_km, {r('avg(abs(CROSS_TRACK_KM))')} AS cross_track_mae_km"""


def _r2(y, p):
    return f"(1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count({y})))"


TARGET_SQL = f"""{r('(avg(abs(Y_LAT - PRED_Y_LAT)) + avg(abs(Y_LON - PRED_Y_LON))) / 2')} AS mae_target_units,
  {r(f"({_r2('Y_LAT', 'PRED_Y_LAT')} + {_r2('Y_LON', 'PRED_Y_LON')}) / 2")} AS r2"""
REF = f"""
ref AS (SELECT *, {hav('TRUE_LAT', 'TRUE_LON', 'LAT', wrap('LON'))} AS REF_ERROR_KM FROM scored)"""
SKILL = "(avg(REF_ERROR_KM) - avg(ERROR_KM)) / avg(REF_ERROR_KM) * 100"


@query("track_error_stats", with_scored(
    f"SELECT model, horizon, {ERRORS_SQL}, {QUANT_SQL} FROM scored GROUP BY ALL"))
def _(spark, sf):
    return rounded(M.track_error_stats(baseline_table(spark, sf)))


@query("within_threshold_pct", with_scored(f"SELECT model, horizon, {WITHIN_SQL} FROM scored GROUP BY ALL"))
def _(spark, sf):
    return rounded(M.within_threshold_pct(baseline_table(spark, sf)))


@query("along_cross_stats", with_scored(f"SELECT model, horizon, {PARTS_SQL} FROM scored GROUP BY ALL"))
def _(spark, sf):
    return rounded(M.along_cross_stats(baseline_table(spark, sf)))


@query("target_mae_r2", with_scored(f"SELECT model, horizon, {TARGET_SQL} FROM scored GROUP BY ALL"))
def _(spark, sf):
    return rounded(M.target_mae_r2(baseline_table(spark, sf)))


@query("skill_score", with_scored(
    f"""SELECT model, horizon, {r(SKILL)} AS skill_pct FROM ref WHERE model <> 'Persistence' GROUP BY ALL""", REF))
def _(spark, sf):
    return rounded(M.skill_score(baseline_table(spark, sf)))


@query("skill_vs_reference", with_scored(
    f"""SELECT model, horizon, {r(SKILL)} AS skill_pct FROM (SELECT s.*, e.ERROR_KM AS REF_ERROR_KM FROM scored s
    JOIN scored e ON s.SID = e.SID AND s.ISO_TIME = e.ISO_TIME AND s.horizon = e.horizon
    AND e.model = 'Linear Extrapolation') WHERE model <> 'Linear Extrapolation' GROUP BY ALL"""))
def _(spark, sf):
    return rounded(M.skill_vs_reference(baseline_table(spark, sf), "Linear Extrapolation"))


EVALUATION = f"""
evaluation AS (SELECT model, horizon, {ERRORS_SQL}, {WITHIN_SQL}, {PARTS_SQL}, {TARGET_SQL},
  CASE WHEN model <> 'Persistence' THEN {r(SKILL)} END AS skill_pct, {QUANT_SQL} FROM ref GROUP BY model, horizon)"""


def with_evaluation(select, *more):
    return with_scored(select, REF, EVALUATION, *more)


def evaluation(spark, sf):
    return M.evaluate_models(baseline_table(spark, sf))


@query("evaluate_models", with_evaluation("SELECT * FROM evaluation"))
def _(spark, sf):
    return rounded(evaluation(spark, sf))


@query("evaluate_by_basin", with_scored(
    f"""SELECT model, horizon, BASIN, count(ERROR_KM) AS n_samples, {r('avg(ERROR_KM)', 1)} AS mean_km,
    {r('median(ERROR_KM)', 1)} AS median_km, {r('avg(abs(CROSS_TRACK_KM))', 1)} AS cross_track_mae_km,
    {r('avg(ALONG_TRACK_KM)', 1)} AS along_track_bias_km FROM scored GROUP BY ALL HAVING count(*) >= 200"""))
def _(spark, sf):
    return M.evaluate_by_basin(baseline_table(spark, sf))


@query("comparison_table", with_evaluation(
    "SELECT model, horizon, " + ", ".join(f"{r(c, d)} AS {c}" for c, d in M.TABLE_DIGITS.items())
    + ", n_samples FROM evaluation ORDER BY horizon, mean_km, model"))
def _(spark, sf):
    return M.comparison_table(evaluation(spark, sf))


@query("error_by_lead_pivot", with_evaluation("SELECT model, " + ", ".join(
    f"max(mean_km) FILTER (WHERE horizon = {h}) AS h{h}" for h in K.HORIZONS) + " FROM evaluation GROUP BY 1"))
def _(spark, sf):
    return rounded(M.error_by_lead_pivot(evaluation(spark, sf)))


@query("rank_models", with_evaluation(
    """SELECT horizon, CAST(row_number() OVER (PARTITION BY horizon ORDER BY mean_km, model) AS INTEGER) AS rank,
    model, mean_km, median_km, p90_km, cross_track_mae_km, along_track_bias_km FROM evaluation"""))
def _(spark, sf):
    return rounded(M.rank_models(evaluation(spark, sf)))


@query("best_per_horizon", with_evaluation(
    """SELECT * FROM evaluation QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY mean_km, model) = 1"""))
def _(spark, sf):
    return rounded(M.best_per_horizon(evaluation(spark, sf)))


# -------------------------------------------------------------------- bootstrap
# The weights of the bootstrap: a counter hash modulo 2^64 of row key and replicate, then
# the number of cumulative Poisson probabilities that its uniform number reaches.
def _times(value: str, factor: int) -> str:
    return f"CAST((CAST({value} AS UHUGEINT) * {factor}::UHUGEINT) & 18446744073709551615::UHUGEINT AS UBIGINT)"


_KEY = f"xor(CAST({seeded(*M.KEYS)} AS UBIGINT), {K.SEED * 0x9E3779B1}::UBIGINT)"
WEIGHTS = f"""
keyed AS MATERIALIZED (SELECT model, horizon, ERROR_KM AS m, REF_ERROR_KM AS e, {_KEY} AS k FROM ref
  WHERE ERROR_KM IS NOT NULL AND REF_ERROR_KM IS NOT NULL),
z_add AS (SELECT model, horizon, m, e, replicate, CAST((CAST(k AS UHUGEINT) + CAST(replicate AS UHUGEINT)
  * {0x9E3779B97F4A7C15}::UHUGEINT) & 18446744073709551615::UHUGEINT AS UBIGINT) AS z
  FROM keyed, range(1, {K.BOOTSTRAP_REPLICATES + 1}) t(replicate)),
z_one AS (SELECT * REPLACE ({_times('xor(z, z >> 30)', 0xBF58476D1CE4E5B9)} AS z) FROM z_add),
z_two AS (SELECT * REPLACE ({_times('xor(z, z >> 27)', 0x94D049BB133111EB)} AS z) FROM z_one),
uniform AS (SELECT * EXCLUDE (z), CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / {1 << 53}::DOUBLE AS u FROM z_two),
sums AS MATERIALIZED (SELECT model, horizon, replicate, sum(w) AS w, sum(w * m) AS wm, sum(w * e) AS wr FROM (
  SELECT *, {' + '.join(f'CAST(u >= {float(c)!r}::DOUBLE AS INTEGER)' for c in M._POISSON_CDF)} AS w FROM uniform)
  GROUP BY ALL HAVING sum(w) > 0)"""


def _ci(value: str, name: str) -> str:
    return ", ".join(f"{r(f'quantile_cont({value}, {q})')} AS {name}_{side}"
                     for side, q in (("lower", K.BOOTSTRAP_ALPHA / 2), ("upper", 1 - K.BOOTSTRAP_ALPHA / 2)))


_CHANGE, _GAIN = "(wr - wm) / w", "CASE WHEN wr > 0 THEN (wr - wm) / wr * 100 END"
PAIRED = f"""
paired AS (SELECT * FROM (SELECT model, horizon, count(*) AS n_samples, {r('avg(e) - avg(m)')} AS mean_difference_km,
    {r('(avg(e) - avg(m)) / avg(e) * 100')} AS skill_pct FROM keyed WHERE model <> 'Persistence' GROUP BY ALL)
  JOIN (SELECT model, horizon, {_ci(_CHANGE, 'ci')}, {_ci(_GAIN, 'skill_ci')},
    {r(f'avg(CAST({_CHANGE} <= 0 AS DOUBLE))')} AS p_value FROM sums GROUP BY ALL) USING (model, horizon))"""


def with_weights(select: str, *more: str) -> str:
    return with_scored(select, REF, WEIGHTS, *more)


@query("bootstrap_ci", with_weights(
    f"SELECT model, horizon, {_ci('wm / w', 'mean_ci')} FROM sums GROUP BY ALL"))
def _(spark, sf):
    return rounded(M.bootstrap_ci(baseline_table(spark, sf)))


@query("paired_bootstrap", with_weights("SELECT * FROM paired", PAIRED))
def _(spark, sf):
    df = M.with_reference_error(baseline_table(spark, sf)).where("model <> 'Persistence'")
    return rounded(M.paired_bootstrap(df))


@query("evaluate_with_intervals")
def _(spark, sf):
    return M.comparison_table(M.evaluate_with_intervals(baseline_table(spark, sf)))
