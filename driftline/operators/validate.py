"""Checks of a feature table. Each returns a table; none reads rows to the driver.

Detail checks return counts per column or horizon. ``findings`` turns them into
rows (check, level, message, n), level being ok, warn or error. ``findings`` reads the table
six times for all checks together: rows and halo of the profile, which one window and one
aggregate serve, the moments, the counts by (SID, ISO_TIME), and both sides of the target join.

What a row's neighbours must be is looked up inside time tiles of its segment (module
``tiles``), so a segment that holds most rows of a wrong table is still many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions.order_stats import hash_fraction
from driftline.functions import geo
from driftline.functions.times import epoch_seconds, plus_hours
from driftline.operators import tiles

FINDING = "check string, level string, message string, n bigint"


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _finding(df: DataFrame, check: Column, n: Column, message: Column,
             level: str = "error") -> DataFrame:
    """Rows of counts to findings: 0 is ok, anything else has ``level``."""
    bad = n > 0
    return df.select(check.alias("check"),
                     F.when(bad, F.lit(level)).otherwise(F.lit("ok")).alias("level"),
                     message.alias("message"), n.cast("bigint").alias("n"))


def group_key(df: DataFrame) -> tuple[str, DataFrame]:
    """Key of time-relative checks: the segment, or the storm with a warning."""
    spark = df.sparkSession
    if "SEGMENT_ID" in df.columns:
        return "SEGMENT_ID", spark.createDataFrame([], FINDING)
    text = "no SEGMENT_ID: checks by SID cannot see gaps left by filters"
    return "SID", spark.createDataFrame([("group_key", "warn", text, 1)], FINDING)


def _with_segment(df: DataFrame) -> DataFrame:
    return df if "SEGMENT_ID" in df.columns else df.withColumn("SEGMENT_ID", F.col("SID"))


def with_neighbours(df: DataFrame, columns, made: Callable[[object], dict[str, Column]],
                    back: int, ahead: int, tile_hours: int) -> DataFrame:
    """``columns`` of every row and the window columns ``made`` computes over its segment.

    Exact for windows of at most ``back`` rows before and ``ahead`` rows after a row.
    """
    rows = _with_segment(df).select(F.struct("SID", "SEGMENT_ID").alias("SID"), "ISO_TIME", *columns)
    near = tiles.with_halo(rows, back, ahead, tile_hours)
    return tiles.drop_halo(near.withColumns(made(Window.partitionBy("SID", "TILE").orderBy("ISO_TIME"))))


# ------------------------------------------------------------------- structure
def check_schema(df: DataFrame, mode: str = K.TARGET_MODE) -> DataFrame:
    """Declared features, targets and ids exist; no column is both."""
    have, types = set(df.columns), dict(df.dtypes)
    wanted = [c for h in K.HORIZONS for c in K.target_columns(h, mode)]
    missing = {"features": [c for c in K.FEATURES if c not in have],
               "targets": [c for c in wanted if c not in have],
               "ids": [c for c in ("SID", "ISO_TIME") if c not in have]}
    rows = [(f"schema_{kind}", "error" if cols else "ok",
             f"missing {kind}: {', '.join(cols)}" if cols else f"all {kind} present", len(cols))
            for kind, cols in missing.items()]
    both = sorted(set(K.FEATURES) & set(wanted))
    rows.append(("schema_overlap", "error" if both else "ok",
                 f"features that are targets: {', '.join(both) or 'none'}", len(both)))
    timed = types.get("ISO_TIME", "").startswith("timestamp")
    rows.append(("schema_time", "ok" if timed else "error",
                 f"ISO_TIME is {types.get('ISO_TIME', 'missing')}", 0 if timed else 1))
    return df.sparkSession.createDataFrame(rows, FINDING)


def check_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each (SID, ISO_TIME); counted map-side first."""
    return (df.groupBy("SID", "ISO_TIME").agg(F.count("*").alias("n"))
              .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates")))


def _previous(w) -> dict[str, Column]:
    return {"_prev": F.lag("ISO_TIME").over(w)}


def _off_cadence(cadence_hours: int = K.CADENCE_HOURS) -> Column:
    return F.col("ISO_TIME") != plus_hours("_prev", cadence_hours)


def check_segment_spacing(df: DataFrame, cadence_hours: int = K.CADENCE_HOURS,
                          tile_hours: int = tiles.TILE_HOURS) -> DataFrame:
    """The five most common in-segment gaps other than the cadence."""
    gap = (epoch_seconds(F.col("ISO_TIME")) - epoch_seconds(F.col("_prev"))) / F.lit(3600.0)
    gaps = with_neighbours(df, [], _previous, 1, 0, tile_hours).where(_off_cadence(cadence_hours)).groupBy(
        gap.alias("gap_hours")).agg(F.count("*").alias("n"))
    return gaps.orderBy(F.desc("n"), "gap_hours").limit(5)


# ------------------------------------------------------------------------ lags
def _lag_pairs(df: DataFrame, n_lags: int = K.N_LAGS) -> dict[str, tuple[str, int]]:
    return {f"{p}_LAG_{k}": (s, k) for s, p in K.LAG_SOURCES.items() for k in range(1, n_lags + 1)
            if f"{p}_LAG_{k}" in df.columns and s in df.columns}


def _lags_again(pairs):
    return lambda w: {f"_{c}": F.lag(s, k).over(w) for c, (s, k) in pairs.items()}


def _lag_counts(pairs) -> Column:
    return F.array(*[F.struct(
        F.lit(c).alias("column_name"),
        F.count_if(F.abs(F.col(c) - F.col(f"_{c}")) > K.POSITION_TOLERANCE).alias("n_mismatched"),
        F.count_if(F.col(c).isNotNull() & F.col(f"_{c}").isNull()).alias("n_crossed")) for c in pairs])


def check_lags(df: DataFrame, n_lags: int = K.N_LAGS, tile_hours: int = tiles.TILE_HOURS) -> DataFrame:
    """Per lag column: values that differ from the recomputed lag, and values
    present where the segment has no such row. One window and one aggregate."""
    pairs = _lag_pairs(df, n_lags)
    columns = dict.fromkeys([*pairs, *[s for s, _ in pairs.values()]])
    again = with_neighbours(df, columns, _lags_again(pairs), n_lags, 0, tile_hours)
    return again.agg(_lag_counts(pairs).alias("found")).select(F.inline("found"))


# --------------------------------------------------------------------- targets
def verify_targets(df: DataFrame, mode: str = K.TARGET_MODE,
                   sample_fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Each non-null target next to the position observed at ISO_TIME + h.

    A left join on (SID, VALID_TIME), all horizons at once. It tests the outcome
    instead of repeating the shift.
    """
    probe = df if sample_fraction is None else df.where(
        hash_fraction(["SID", "ISO_TIME"], seed) < sample_fraction)
    per_horizon = []
    for h in K.HORIZONS:
        lat, lon = (F.col(c) for c in K.target_columns(h, mode))
        base = (F.col("LAT"), F.col("LON")) if mode == "displacement" else (F.lit(0.0), F.lit(0.0))
        per_horizon.append(F.when(lat.isNotNull() & lon.isNotNull(), F.struct(
            F.lit(h).alias("horizon"), (base[0] + lat).alias("lat"), (base[1] + lon).alias("lon"))))
    probe = probe.select("SID", "ISO_TIME",
                         F.explode(F.array_compact(F.array(*per_horizon))).alias("t"))
    probe = probe.select("SID", "ISO_TIME", "t.horizon", F.col("t.lat").alias("EXPECTED_LAT"),
                         F.col("t.lon").alias("EXPECTED_LON"),
                         plus_hours("ISO_TIME", F.col("t.horizon")).alias("VALID_TIME"))
    observed = df.select("SID", F.col("ISO_TIME").alias("VALID_TIME"),
                         F.col("LAT").alias("TRUE_LAT"), F.col("LON").alias("TRUE_LON"))
    joined = probe.join(observed, ["SID", "VALID_TIME"], "left")
    return joined.withColumns({
        "LAT_ERROR": F.abs(F.col("EXPECTED_LAT") - F.col("TRUE_LAT")),
        "LON_ERROR": F.abs(geo.angular_difference("EXPECTED_LON", "TRUE_LON"))})


def check_target_alignment(df: DataFrame, mode: str = K.TARGET_MODE) -> DataFrame:
    """Per horizon: targets checked, without observation, and off by more than 1e-6."""
    tolerance = F.lit(K.POSITION_TOLERANCE)
    return verify_targets(df, mode).groupBy("horizon").agg(
        F.count("*").alias("n_targets"),
        F.count_if(F.col("TRUE_LAT").isNull()).alias("n_unmatched"),
        F.count_if((F.col("LAT_ERROR") > tolerance) | (F.col("LON_ERROR") > tolerance))
         .alias("n_mismatched"),
        F.greatest(F.max("LAT_ERROR"), F.max("LON_ERROR")).alias("max_error"))


# ---------------------------------------------------------------------- values
def _expected(df: DataFrame, mode: str) -> dict[str, str | None]:
    """Columns that may not be missing, each with the neighbour that says where (None: anywhere)."""
    where = {c: None for c in ("LAT", "LON", "WMO_WIND", "WMO_PRES") if c in df.columns}
    where |= {c: f"_back_{k}" for k in range(1, K.N_LAGS + 1) for c in df.columns if c.endswith(f"_LAG_{k}")}
    return where | {c: f"_ahead_{K.steps(h)}" for h in K.HORIZONS for c in K.target_columns(h, mode)
                    if c in df.columns}


def _neighbour_exists(w) -> dict[str, Column]:
    found = {f"_back_{k}": F.lag(F.lit(True), k) for k in range(1, K.N_LAGS + 1)}
    found |= {f"_ahead_{K.steps(h)}": F.lead(F.lit(True), K.steps(h)) for h in K.HORIZONS}
    return {name: e.over(w) for name, e in found.items()}


def _missing_counts(where: dict[str, str | None]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(
        F.col(c).isNull() & (F.lit(True) if near is None else F.col(near).isNotNull())).alias("n_unexpected"))
        for c, near in where.items()])


def check_missing(df: DataFrame, mode: str = K.TARGET_MODE, tile_hours: int = tiles.TILE_HOURS) -> DataFrame:
    """Missing values where none may be: core columns anywhere, lag k outside the
    first k rows of a segment, targets outside the last rows."""
    where = _expected(df, mode)
    placed = with_neighbours(df, where, _neighbour_exists, K.N_LAGS, K.steps(max(K.HORIZONS)), tile_hours)
    return placed.agg(_missing_counts(where).alias("found")).select(F.inline("found"))


def _doubles(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float")]


def _infinite_counts(columns) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(
        F.abs(c) == float("inf")).alias("n_infinite")) for c in columns])


def check_infinite(df: DataFrame) -> DataFrame:
    """Infinite values per double column."""
    return df.agg(_infinite_counts(_doubles(df)).alias("found")).select(F.inline("found"))


RANGES = (("LAT", K.LAT_BOUNDS, "error"), ("LON", K.LON_BOUNDS, "error"),
          ("WMO_WIND", K.WIND_BOUNDS, "error"), ("WMO_PRES", K.PRESSURE_BOUNDS, "error"),
          ("LAT", K.TROPICAL_LAT_BOUNDS, "warn"))


def _range_counts() -> Column:
    return F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit(level).alias("severity"),
        F.lit(low).alias("low"), F.lit(high).alias("high"),
        F.count_if((F.col(c) < low) | (F.col(c) > high)).alias("n_outside"),
        F.min(c).alias("min_value"), F.max(c).alias("max_value")) for c, (low, high), level in RANGES])


def check_ranges(df: DataFrame) -> DataFrame:
    """Values outside physical bounds, with the observed range; the tropical band only warns."""
    return df.agg(_range_counts().alias("found")).select(F.inline("found"))


# --------------------------------------------------------------------- leakage
def _leak_columns(df: DataFrame, mode: str) -> tuple[list[str], tuple[str, str]]:
    return [c for c in K.FEATURES if c in df.columns], K.target_columns(max(K.HORIZONS), mode)


def _with_sums(df: DataFrame, mode: str) -> DataFrame:
    """Marks rows whose features and longest targets are all numbers; ``_sums`` holds the
    features x, the targets y and all x + y of such a row, whose variances give cov(x, y)."""
    features, pair = _leak_columns(df, mode)
    x, y = ([F.col(c).cast("double") for c in names] for names in (features, pair))
    complete = reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) for v in (*x, *y)])
    values = [*x, *y, *[v + t for v in x for t in y]]
    return df.withColumn("_complete", complete).withColumn("_sums", array_to_vector(
        F.when(F.col("_complete"), F.array(*values)).otherwise(F.array_repeat(F.lit(0.0), len(values)))))


def _correlations(df: DataFrame, mode: str) -> Column:
    """Array of (feature, target, n, r) from the variances, r null where one of them is 0."""
    features, pair = _leak_columns(df, mode)
    names, targets = (F.array(*map(F.lit, c)) for c in (features, pair))
    k, width = len(features), len(pair)

    def one(place):
        i, j = F.floor(place / width).cast("int"), place % width
        x, y, both = (F.get("_v", at) for at in (i, j + k, place + k + width))
        found = (both - x - y) / 2 / F.sqrt(x * y)
        return F.struct(F.get(names, i).alias("feature"), F.get(targets, j).alias("target"), F.col("_n").alias("n"),
                        F.when((x > 0) & (y > 0) & ~F.isnan(found), found).alias("r"))

    return F.transform(F.sequence(F.lit(0), F.lit(k * width - 1)), one)


def check_leakage(df: DataFrame, mode: str = K.TARGET_MODE) -> DataFrame:
    """Correlation of every feature with both targets at the longest horizon.

    Over complete rows; the state is one vector of moments, merged map-side, no copies of rows.
    Without complete rows there is no group, hence nothing to report.
    """
    one = _with_sums(df, mode).where("_complete").groupBy("_complete").agg(
        Summarizer.variance(F.col("_sums")).alias("_variances"), F.count("*").alias("_n"))
    return one.withColumn("_v", vector_to_array("_variances")).select(
        F.inline(_correlations(df, mode)))


def _usable(df: DataFrame, mode: str) -> dict[int, Column]:
    features = [c for c in K.FEATURES if c in df.columns]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    return {h: complete & F.col(lat).isNotNull() & F.col(lon).isNotNull()
            for h in K.HORIZONS for lat, lon in [K.target_columns(h, mode)]}


def usable_samples(df: DataFrame, mode: str = K.TARGET_MODE) -> DataFrame:
    """Per horizon: complete rows, their storms, and the share of all rows."""
    per_horizon = F.array_compact(F.array(*[F.when(e, F.lit(h)) for h, e in _usable(df, mode).items()]))
    # storms are counted from one row per (storm, horizon), not by a distinct over rows
    per_storm = df.select("SID", F.explode(F.concat(per_horizon, F.array(F.lit(0)))).alias("horizon")) \
                  .groupBy("SID", "horizon").agg(F.count("*").alias("n"))
    totals = per_storm.groupBy("horizon").agg(F.sum("n").alias("usable_rows"),
                                              F.count("*").alias("storms"))
    known = F.map_from_entries(F.collect_list(F.struct("horizon", F.struct("usable_rows", "storms"))))
    one = totals.agg(known.alias("m"))  # at most one entry per horizon
    return one.select(F.explode(F.array(*[F.lit(h) for h in K.HORIZONS])).alias("horizon"), "m").select(
        "horizon",
        F.coalesce(F.col("m")[F.col("horizon")]["usable_rows"], F.lit(0)).alias("usable_rows"),
        F.coalesce(F.col("m")[F.col("horizon")]["storms"], F.lit(0)).alias("storms"),
        (F.coalesce(F.col("m")[F.col("horizon")]["usable_rows"], F.lit(0))
         / F.col("m")[F.lit(0)]["usable_rows"] * 100).alias("pct_of_total"))


# ---------------------------------------------------------------- all together
def profile(df: DataFrame, mode: str = K.TARGET_MODE, tile_hours: int = tiles.TILE_HOURS) -> DataFrame:
    """One row: gaps, lags, missing, infinite and ranges, from one window and one aggregate."""
    pairs, where, doubles = _lag_pairs(df), _expected(df, mode), _doubles(df)
    columns = dict.fromkeys([*pairs, *[s for s, _ in pairs.values()], *where, *doubles, *[c for c, _, _ in RANGES]])
    rows = with_neighbours(df, columns, lambda w: _previous(w) | _lags_again(pairs)(w) | _neighbour_exists(w),
                           K.N_LAGS, K.steps(max(K.HORIZONS)), tile_hours)
    return rows.agg(F.count_if(_off_cadence()).alias("gaps"), _lag_counts(pairs).alias("lags"),
                    _missing_counts(where).alias("missing"), _infinite_counts(doubles).alias("infinite"),
                    _range_counts().alias("ranges"))


def occurrences(df: DataFrame, mode: str = K.TARGET_MODE) -> DataFrame:
    """One row: repeated (SID, ISO_TIME) rows and, per horizon, complete rows and their storms."""
    usable = _usable(df, mode)
    per_row = df.groupBy("SID", "ISO_TIME").agg(
        F.count("*").alias("n"), *[F.count_if(e).alias(f"u{h}") for h, e in usable.items()])
    per_storm = per_row.groupBy("SID").agg(
        F.sum(F.col("n") - 1).alias("again"), *[F.sum(f"u{h}").alias(f"u{h}") for h in usable])
    return per_storm.agg(
        F.coalesce(F.sum("again"), F.lit(0)).alias("n_duplicates"),
        F.array(*[F.struct(F.lit(h).alias("horizon"), F.coalesce(F.sum(f"u{h}"), F.lit(0)).alias("usable_rows"),
                           F.count_if(F.col(f"u{h}") > 0).alias("storms")) for h in usable]).alias("usable"))


def _row(check: Column, n: Column, message: Column, level="error") -> Column:
    """A finding as a struct: a count of 0 is ok, anything else has ``level``."""
    return F.struct(check.alias("check"), F.when(n > 0, level).otherwise("ok").alias("level"),
                    message.alias("message"), n.cast("bigint").alias("n"))


def findings(df: DataFrame, mode: str = K.TARGET_MODE, tile_hours: int = tiles.TILE_HOURS) -> DataFrame:
    """Every check as rows (check, level, message, n)."""
    key, note = group_key(df)
    text = F.format_string
    aligned = check_target_alignment(df, mode)
    leaks = check_leakage(df, mode).agg(
        F.count_if(F.abs("r") > K.LEAKAGE_CORRELATION).alias("hits"), F.max("n").alias("n_rows"))
    few = F.coalesce(F.col("n_rows"), F.lit(0)) < K.LEAKAGE_MIN_ROWS
    leak_level = "warn" if mode == "absolute" else "error"
    seen = profile(df, mode, tile_hours).select(F.inline(F.concat(
        F.array(_row(F.lit("spacing"), F.col("gaps"),
                     text(f"%d gaps inside {key} other than {K.CADENCE_HOURS} h", "gaps"))),
        F.transform("lags", lambda x: _row(
            F.concat(F.lit("lag_"), x["column_name"]), x["n_mismatched"] + x["n_crossed"],
            text("%d mismatches, %d values across a boundary", x["n_mismatched"], x["n_crossed"]))),
        F.transform("missing", lambda x: _row(
            F.concat(F.lit("missing_"), x["column_name"]), x["n_unexpected"],
            text("%d unexpected missing values", x["n_unexpected"]))),
        F.transform("infinite", lambda x: _row(
            F.concat(F.lit("infinite_"), x["column_name"]), x["n_infinite"],
            text("%d infinite values", x["n_infinite"]))),
        F.transform(F.filter("ranges", lambda x: x["severity"] == "error"), lambda x: _row(
            F.concat(F.lit("range_"), x["column_name"]), x["n_outside"],
            text("%d values out of bounds", x["n_outside"]))),
        F.transform(F.filter("ranges", lambda x: x["severity"] == "warn"), lambda x: _row(
            F.lit("range_tropical"), x["n_outside"],
            text("%d rows outside the tropical band", x["n_outside"]), "warn")))))
    counted = occurrences(df, mode).select(F.inline(F.concat(
        F.array(_row(F.lit("duplicates"), F.col("n_duplicates"),
                     text("%d duplicate (SID, ISO_TIME) rows", "n_duplicates"))),
        F.transform("usable", lambda x: _row(
            text("usable_%dh", x["horizon"]), F.when(x["usable_rows"] == 0, 1).otherwise(0),
            text("%d usable rows of %d storms", x["usable_rows"], x["storms"]))))))
    return _union([
        check_schema(df, mode), note, seen, counted,
        leaks.select(
            F.lit("leakage").alias("check"),
            F.when(few, "warn").when(F.col("hits") > 0, leak_level).otherwise("ok").alias("level"),
            F.when(few, F.lit("too few complete rows")).otherwise(
                text(f"%d correlations above {K.LEAKAGE_CORRELATION}", "hits")).alias("message"),
            F.when(few, F.lit(0).cast("bigint")).otherwise(F.col("hits")).alias("n")),
        _finding(aligned, text("target_%dh", "horizon"),
                 F.col("n_unmatched") + F.col("n_mismatched"),
                 text("%d of %d targets without observation, %d mismatched",
                      "n_unmatched", "n_targets", "n_mismatched"))])


def validate(df: DataFrame, strict: bool = True, mode: str = K.TARGET_MODE) -> DataFrame:
    """All findings; with ``strict`` an error finding raises once, after all checks ran."""
    out = findings(df, mode)
    if strict:
        errors = out.where("level = 'error'").orderBy("check").collect()  # one row per check
        if errors:
            raise ValueError("feature validation failed: "
                             + "; ".join(f"{e['check']}: {e['message']}" for e in errors))
    return out


# -------------------------------------------------------------------- requests
def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with the reasons they are rejected for, and a short-history flag.

    ``requests``: request_id, observations, forecast_horizon, model.
    """
    def outside(name, bounds):
        return F.exists("observations", lambda o: o[name].isNull() | (o[name] < bounds[0])
                        | (o[name] > bounds[1]))

    n = F.coalesce(F.size("observations"), F.lit(0))
    rules = {"no_observations": n < 1,
             "latitude": outside("latitude", K.LAT_BOUNDS),
             "longitude": outside("longitude", K.LON_BOUNDS),
             "wind_speed": outside("wind_speed", K.WIND_BOUNDS),
             "pressure": outside("pressure", K.PRESSURE_BOUNDS),
             "forecast_horizon": ~F.coalesce(F.col("forecast_horizon").isin(*K.HORIZONS), F.lit(False)),
             "model": ~F.coalesce(F.col("model").isin(*K.MODEL_LABELS), F.lit(False))}
    reasons = F.concat_ws(",", *[F.when(F.coalesce(e, F.lit(False)), F.lit(name))
                                 for name, e in rules.items()])
    return requests.withColumns({"n_observations": n, "reasons": reasons,
                                 "accepted": reasons == "",
                                 "short_history": n < K.FULL_HISTORY})
