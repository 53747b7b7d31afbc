"""Forecast products: tracks, recursive roll-out, storm lists, request batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions import geo
from driftline.functions.times import plus_hours
from driftline.session import cut_lineage, written

PRODUCT = ("SID", "ISO_TIME", "LEAD_HOURS", "BASIN", "CURRENT_LAT", "CURRENT_LON", "PRED_LAT",
           "PRED_LON", "TRUE_LAT", "TRUE_LON", "ERROR_KM", "ALONG_TRACK_KM", "CROSS_TRACK_KM")


def product_columns(scored: DataFrame) -> DataFrame:
    """A scored table under the column names of the forecast products."""
    lead = {} if "LEAD_HOURS" in scored.columns else {"LEAD_HOURS": F.col("horizon")}
    return scored.withColumns({**lead, "CURRENT_LAT": F.col("LAT"), "CURRENT_LON": F.col("LON")}) \
                 .select("model", *PRODUCT)


def score_split(scored: DataFrame, n: int | None = None) -> DataFrame:
    """Forecast, observation and error of each row; optionally the first ``n``."""
    out = product_columns(scored)
    return out if n is None else out.orderBy("SID", "ISO_TIME", "LEAD_HOURS", "model").limit(n)


def forecast_track(products: DataFrame, sid: str | None = None, issue_time=None) -> DataFrame:
    """One row per lead time from one issue time, for one storm or for all.

    The default issue time is the earliest usable one, per horizon, so lead
    times can start at different rows; ISO_TIME shows it. MEAN_ERROR_KM is the
    mean over the lead times.
    """
    rows = products if sid is None else products.where(F.col("SID") == sid)
    keys = ["model", "SID", "LEAD_HOURS"]
    if issue_time is not None:
        rows = rows.where(F.col("ISO_TIME") == F.lit(issue_time).cast("timestamp_ntz"))
    values = [c for c in products.columns if c not in keys]
    # the earliest row by an aggregate that is combined map-side
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), "ISO_TIME").alias("_r"))
    track = first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in values])
    leads = Window.partitionBy("model", "SID")  # one row per horizon
    return track.withColumn("MEAN_ERROR_KM", F.avg("ERROR_KM").over(leads))


def storm_lead_path(track: DataFrame) -> DataFrame:
    """Observed and forecast path points; both begin at the issue point (lead 0)."""
    first = track.groupBy("model", "SID").agg(
        F.min_by(F.struct("CURRENT_LAT", "CURRENT_LON"), "LEAD_HOURS").alias("p"))
    start = first.select("model", "SID", F.explode(F.array(F.lit("observed"), F.lit("forecast")))
                         .alias("path"), F.lit(0).alias("LEAD_HOURS"),
                         F.col("p.CURRENT_LAT").alias("LAT"), F.col("p.CURRENT_LON").alias("LON"))

    def points(name, lat, lon):
        return F.struct(F.lit(name).alias("path"), F.col(lat).alias("LAT"), F.col(lon).alias("LON"))

    leads = track.select("model", "SID", "LEAD_HOURS", F.explode(F.array(
        points("observed", "TRUE_LAT", "TRUE_LON"),
        points("forecast", "PRED_LAT", "PRED_LON"))).alias("p"))
    return start.unionByName(leads.select("model", "SID", "p.path", "LEAD_HOURS", "p.LAT", "p.LON"))


def list_storms(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Storms with the most rows, with first time and basin."""
    return (rows.groupBy("SID").agg(F.count("*").alias("observations"),
                                    F.min("ISO_TIME").alias("first_time"),
                                    F.min_by("BASIN", "ISO_TIME").alias("basin"))
            .orderBy(F.desc("observations"), "SID").limit(limit))


# -------------------------------------------------------------------- roll-out
def advance_features(df: DataFrame, new_lat: Column, new_lon: Column) -> DataFrame:
    """Move the position features one step on; all other features stay frozen."""
    moved = {"LAT": new_lat, "LON": new_lon, "ABS_LAT": F.abs(new_lat),
             "DELTA_LAT": new_lat - F.col("LAT"),
             "DELTA_LON": geo.angular_difference(new_lon, "LON"),
             "STORM_AGE": F.col("STORM_AGE") + float(K.CADENCE_HOURS)}
    for prefix in ("LAT", "LON"):
        moved[f"{prefix}_LAG_1"] = F.col(prefix)
        for k in range(2, K.N_LAGS + 1):
            moved[f"{prefix}_LAG_{k}"] = F.col(f"{prefix}_LAG_{k - 1}")
    return df.withColumns({c: e for c, e in moved.items() if c in df.columns})


def forecast_recursive(starts: DataFrame, observed: DataFrame,
                       predict: Callable[[DataFrame], DataFrame], n_steps: int = 12,
                       checkpoint_every: int = 3) -> DataFrame:
    """Feed a 6-hour forecast back ``n_steps`` times, for all start rows at once.

    ``predict`` adds PRED_Y_LAT / PRED_Y_LON (displacements) and keeps the other
    columns. The state is one row per start: its features and the track so far as
    an array, which is exploded once at the end, so every step is predicted once.
    It is checkpointed in the shared folder every few steps and after the last, so
    the plan stays short and a lost executor does not restart the roll-out.
    """
    point = "struct<LEAD_HOURS: int, PRED_LAT: double, PRED_LON: double>"
    state = starts.select("SID", F.col("ISO_TIME").alias("ISSUE_TIME"), *K.FEATURES,
                          F.array().cast(f"array<{point}>").alias("TRACK"))
    for step in range(1, n_steps + 1):
        lat, lon = geo.offset_position("LAT", "LON", "PRED_Y_LAT", "PRED_Y_LON")
        moved = predict(state).withColumns({"_lat": lat, "_lon": lon})
        here = F.struct(F.lit(step * K.CADENCE_HOURS), "_lat", "_lon").cast(point)
        moved = moved.withColumn("TRACK", F.array_append("TRACK", here))
        state = advance_features(moved, F.col("_lat"), F.col("_lon")) \
            .select("SID", "ISSUE_TIME", *K.FEATURES, "TRACK")
        if step % checkpoint_every == 0 or step == n_steps:
            state = cut_lineage(state)
    out = state.select("SID", "ISSUE_TIME", F.inline("TRACK"))
    out = out.withColumn("VALID_TIME", plus_hours("ISSUE_TIME", F.col("LEAD_HOURS")))
    return verify_forecast(out, observed)


def verify_forecast(forecast: DataFrame, observed: DataFrame) -> DataFrame:
    """Left join to the observation at (SID, VALID_TIME), then the error where there is one."""
    truth = observed.select("SID", F.col("ISO_TIME").alias("VALID_TIME"),
                            F.col("LAT").alias("TRUE_LAT"), F.col("LON").alias("TRUE_LON"))
    joined = forecast.join(truth, ["SID", "VALID_TIME"], "left")
    return joined.withColumn("ERROR_KM", geo.track_error_km("TRUE_LAT", "TRUE_LON",
                                                            "PRED_LAT", "PRED_LON"))


def first_usable_rows(rows: DataFrame) -> DataFrame:
    """The earliest row of each storm."""
    values = [c for c in rows.columns if c != "SID"]
    first = rows.groupBy("SID").agg(F.min_by(F.struct(*values), "ISO_TIME").alias("_r"))
    return first.select("SID", *[F.col(f"_r.{c}").alias(c) for c in values])


# -------------------------------------------------------------------- requests
def request_rows(checked: DataFrame, features: DataFrame) -> DataFrame:
    """Accepted requests with their feature row, if there is one (``_found``)."""
    accepted = checked.where("accepted").select(
        "request_id", "n_observations", "short_history", "forecast_horizon",
        F.col("model").alias("model_key"))
    return accepted.join(features.withColumn("_found", F.lit(True)), "request_id", "left")


def written_request_rows(checked: DataFrame, features: DataFrame) -> DataFrame:
    """``request_rows`` as a table in which each model and horizon finds its own rows."""
    return written(request_rows(checked, features), "request_rows", ("model_key", "forecast_horizon"))


def score_requests(checked: DataFrame, features: DataFrame,
                   predict: dict[tuple[str, int], Callable[[DataFrame], DataFrame]],
                   published: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Forecast positions for a batch of accepted requests, one row for each.

    ``checked`` comes from ``validate_requests``, ``features`` from
    ``live_features``. Missing inputs stay missing; the prediction functions say
    how they treat them. ``status`` is ``ok``, ``no features`` for a request
    without a feature row, or ``no model`` where ``predict`` has none for its
    model and horizon; positions are null then. ``published`` (model, horizon,
    mean_km) adds the measured error of the model that answered. ``rows`` takes
    ``written_request_rows`` that were made before, while models were fitted, say.
    """
    if rows is None:  # every model scans its own requests; else each scan would compute the features again
        rows = (written_request_rows if len(predict) > 1 else request_rows)(checked, features)
    wanted = F.concat_ws("@", "model_key", F.col("forecast_horizon").cast("string"))
    answered = wanted.isin([f"{model}@{horizon}" for model, horizon in predict]) & F.col("_found").isNotNull()
    warning = F.when(F.col("short_history"), F.format_string(
        f"only %d of {K.FULL_HISTORY} observations: missing features were left unset", "n_observations"))
    kept = ["request_id", "model_key", "forecast_horizon", "n_observations", warning.alias("warning")]
    status = F.when(F.col("_found").isNull(), "no features").otherwise("no model")
    nothing = F.lit(None).cast("double")
    out = rows.where(~answered).select(*kept, status.alias("status"), nothing.alias("predicted_lat"),
                                       nothing.alias("predicted_lon"))
    lat, lon = geo.offset_position("LAT", "LON", "PRED_Y_LAT", "PRED_Y_LON")
    for (model, horizon), fn in predict.items():
        part = rows.where(answered & (F.col("model_key") == model) & (F.col("forecast_horizon") == horizon))
        out = out.unionByName(fn(part.drop("_found")).select(
            *kept, F.lit("ok").alias("status"), lat.alias("predicted_lat"), lon.alias("predicted_lon")))
    if published is None:
        return out.withColumn("track_error_km", F.lit(None).cast("double"))
    names = F.create_map(*[F.lit(x) for kv in K.MODEL_LABELS.items() for x in kv])
    table = published.select(F.col("model").alias("_label"), F.col("horizon").alias("forecast_horizon"),
                             F.round("mean_km", 1).alias("track_error_km"))
    return out.withColumn("_label", names[F.col("model_key")]) \
              .join(table, ["_label", "forecast_horizon"], "left").drop("_label")
