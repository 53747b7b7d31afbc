"""Cleaning: filters, typing, de-duplication, causal fill, segmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions import geo
from driftline.functions.times import epoch_seconds, plus_hours
from driftline.operators.tiles import carried, drop_halo, with_halo, with_tile
from driftline.operators.windows import by_segment, by_storm, whole_segment


# ---------------------------------------------------------------- predicates
def is_track_type(types=K.TRACK_TYPES) -> Column:
    return F.lower(F.trim("TRACK_TYPE")).isin([t.lower() for t in types])


def is_nature(natures=K.NATURES) -> Column:
    return F.upper(F.trim("NATURE")).isin([n.upper() for n in natures])


def season_number() -> Column:
    return F.col("SEASON").try_cast("double").cast("int")


def has_valid_position() -> Column:
    return (F.col("LAT").between(*K.LAT_BOUNDS) & F.col("LON").between(*K.LON_BOUNDS))


def is_synoptic() -> Column:
    return F.hour("ISO_TIME").isin(*K.SYNOPTIC_HOURS) & on_the_hour()


def on_the_hour() -> Column:
    return (F.minute("ISO_TIME") == 0) & (F.second("ISO_TIME") == 0)


def null_count(columns=K.NUMERIC_COLUMNS) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])


# ------------------------------------------------------------------- filters
def filter_track_type(df: DataFrame, types=K.TRACK_TYPES) -> DataFrame:
    """Keep primary tracks; without the column nothing is filtered."""
    return df.where(is_track_type(types)) if "TRACK_TYPE" in df.columns else df


def filter_season(df: DataFrame, start_year: int = K.START_YEAR) -> DataFrame:
    """Keep seasons from ``start_year``; a SEASON that is no number is dropped."""
    return df.withColumn("SEASON", season_number()).where(F.col("SEASON") >= start_year)


def select_columns(df: DataFrame, columns=K.REQUIRED_COLUMNS) -> DataFrame:
    """Project to the declared schema; a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    return df.select(*columns)


def _as_number(name: str, dtype) -> Column:
    number = F.col(name) if dtype == "double" else F.col(name).try_cast("double")
    return F.when(~F.isnan(number), number)


def _as_time(name: str, dtype: str) -> Column:
    return F.col(name) if dtype == "timestamp_ntz" else F.col(name).try_cast("timestamp_ntz")


def coerce_types(df: DataFrame) -> DataFrame:
    """Numbers and timestamps by ``try_cast``; bad values become NULL.

    Rows without a timestamp are dropped. NaN counts as missing.
    """
    dtypes = dict(df.dtypes)
    typed = {c: _as_number(c, dtypes[c]) for c in K.NUMERIC_COLUMNS if c in dtypes}
    typed["ISO_TIME"] = _as_time("ISO_TIME", dtypes["ISO_TIME"])
    return df.withColumns(typed).where(F.col("ISO_TIME").isNotNull())


def coercion_report(df: DataFrame) -> DataFrame:
    """Per column, how many present values could not be typed."""
    dtypes = dict(df.dtypes)
    exprs = {c: _as_number(c, dtypes[c]) for c in K.NUMERIC_COLUMNS if c in dtypes}
    exprs["ISO_TIME"] = _as_time("ISO_TIME", dtypes["ISO_TIME"])
    counts = df.agg(*[F.count_if(F.col(c).isNotNull() & e.isNull()).alias(c)
                      for c, e in exprs.items()])
    return unpivot(counts, list(exprs), "column_name", "n_coerced")


def normalize_longitude(df: DataFrame) -> DataFrame:
    return df.withColumn("LON", geo.wrap_degrees("LON"))


def drop_invalid_coordinates(df: DataFrame) -> DataFrame:
    return df.where(has_valid_position())


def filter_nature(df: DataFrame, natures=K.NATURES) -> DataFrame:
    return df.where(is_nature(natures)) if "NATURE" in df.columns else df


def nature_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(F.upper(F.trim("NATURE")).alias("nature")).agg(F.count("*").alias("n"))


def sort_storms(df: DataFrame) -> DataFrame:
    """Rows in (SID, ISO_TIME) order inside and across files.

    The range includes the time, so a long storm spreads over several partitions.
    """
    return df.repartitionByRange("SID", "ISO_TIME").sortWithinPartitions("SID", "ISO_TIME")


def most_complete(columns, input_order: str | None = None) -> Column:
    """What orders the rows of one (SID, ISO_TIME): missing numbers, then the other columns."""
    rest = [c for c in columns if c not in ("SID", "ISO_TIME")]
    first = [input_order] if input_order else []
    return F.struct(null_count().alias("_nulls"), *first, *[c for c in rest if c not in first])


def dedupe_most_complete(df: DataFrame, input_order: str | None = None) -> DataFrame:
    """One row per (SID, ISO_TIME): fewest missing numbers wins.

    A minimum over one struct is combined map-side, so a storm that holds a
    third of all rows as copies shrinks before the shuffle. Ties follow
    ``input_order`` if such a column exists, else all columns in order, which
    does not depend on the partitioning.
    """
    keys = ["SID", "ISO_TIME"]
    best = df.groupBy(*keys).agg(F.min(most_complete(df.columns, input_order)).alias("_best"))
    return best.select(*[c if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def filter_synoptic(df: DataFrame) -> DataFrame:
    return df.where(is_synoptic())


def hour_distribution(df: DataFrame) -> DataFrame:
    """Rows per hour of day, and how many of them are not on the full hour."""
    return df.groupBy(F.hour("ISO_TIME").alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(~on_the_hour()).alias("n_off_grid"))


# ---------------------------------------------------------------------- fill
def ffill_causal(df: DataFrame, limit: int = K.FILL_LIMIT,
                 tile_hours: int | None = None) -> DataFrame:
    """Forward fill by storm, at most ``limit`` rows back, never backward.

    The limit counts rows of the storm, so a value may cross a time gap.
    ``tile_hours`` cuts long storms into tiles.
    """
    tiled = tile_hours is not None
    rows = with_halo(df, limit, tile_hours=tile_hours) if tiled else df
    recent = by_storm(tiled).rowsBetween(-limit, 0)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(recent)
                               for c in K.FILL_COLUMNS if c in df.columns})
    return drop_halo(filled) if tiled else filled


def fill_report(df: DataFrame, limit: int = K.FILL_LIMIT) -> DataFrame:
    """Missing before and after the fill, per column, from one pass."""
    columns = [c for c in K.FILL_COLUMNS if c in df.columns]
    recent = by_storm().rowsBetween(-limit, 0)
    filled = df.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(recent)
                             for c in columns})
    counts = filled.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("n_before"),
                                   F.count_if(F.col(f"_f_{c}").isNull()).alias("n_after"))
                          .alias(c) for c in columns])
    return unpivot(counts, columns, "column_name", "n").select(
        "column_name", "n.n_before", "n.n_after",
        (F.col("n.n_before") - F.col("n.n_after")).alias("n_filled"))


def drop_missing_intensity(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["WMO_WIND", "WMO_PRES"])


# ------------------------------------------------------------------ segments
def assign_segments(df: DataFrame, cadence_hours: int = K.CADENCE_HOURS,
                    tile_hours: int | None = None) -> DataFrame:
    """Gaps and islands: a new segment at every gap other than the cadence.

    With ``tile_hours`` the breaks of earlier tiles are carried over as one
    number per (SID, tile).
    """
    tiled = tile_hours is not None
    rows = with_halo(df, 1, tile_hours=tile_hours) if tiled else df
    w = by_storm(tiled)
    expected = plus_hours(F.lag("ISO_TIME").over(w), cadence_hours)
    flagged = rows.withColumn("_break", F.when(F.col("ISO_TIME") == expected, 0).otherwise(1))
    if tiled:
        flagged = carried(flagged, F.col("_break"), F.sum, "_before", before_only=True) \
            .where(~F.col("IS_HALO"))
    number = F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if tiled:
        number = number + F.coalesce("_before", F.lit(0))
    named = flagged.withColumn("SEGMENT_ID", F.format_string("%s_S%02d", "SID", number))
    return named.drop("_break", "_before", "TILE", "IS_HALO")


def segment_counts(df: DataFrame) -> DataFrame:
    out = df.select("SID", "SEGMENT_ID").distinct().agg(
        F.count_distinct("SID").alias("storms"), F.count("*").alias("segments"))
    return out.withColumn("fragmented", F.col("segments") - F.col("storms"))


def spacing_gaps(df: DataFrame, cadence_hours: int = K.CADENCE_HOURS) -> DataFrame:
    """In-segment gaps that differ from the cadence, with their counts."""
    previous = F.lag("ISO_TIME").over(by_segment())
    gap = (epoch_seconds(F.col("ISO_TIME")) - epoch_seconds(F.col("_prev"))) / F.lit(3600.0)
    return (df.select("SID", "SEGMENT_ID", "ISO_TIME", previous.alias("_prev"))
              .where(F.col("ISO_TIME") != plus_hours("_prev", cadence_hours))
              .groupBy(gap.alias("gap_hours")).agg(F.count("*").alias("n")))


def check_spacing_strict(df: DataFrame, cadence_hours: int = K.CADENCE_HOURS) -> None:
    """Raise when a segment is not evenly spaced; names up to five gaps."""
    bad = spacing_gaps(df, cadence_hours).orderBy(F.desc("n"), "gap_hours").limit(5).collect()
    if bad:
        raise AssertionError(f"gaps inside segments are not {cadence_hours} h: "
                             f"{[(r.gap_hours, r.n) for r in bad]}")


def filter_short_segments(df: DataFrame, min_rows: int = K.MIN_SEGMENT_ROWS,
                          tile_hours: int | None = None) -> DataFrame:
    if tile_hours is None:
        size = F.count("*").over(whole_segment())
        return df.withColumn("_rows", size).where(F.col("_rows") >= min_rows).drop("_rows")
    # sizes per (segment, tile), summed per segment, joined back by segment and tile
    rows = with_tile(df, tile_hours)
    keys = ["SID", "SEGMENT_ID", "TILE"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    whole = sizes.select(*keys, F.sum("_n").over(whole_segment()).alias("_rows"))
    return rows.join(whole.where(F.col("_rows") >= min_rows).drop("_rows"), keys, "left_semi").drop("TILE")


# ------------------------------------------------------------------ the chain
def to_unique_observations(raw: DataFrame, start_year: int = K.START_YEAR,
                           natures=K.NATURES) -> DataFrame:
    """Row-level rules plus de-duplication, before any window."""
    df = filter_season(filter_track_type(raw), start_year)
    df = normalize_longitude(coerce_types(select_columns(df)))
    return dedupe_most_complete(filter_nature(drop_invalid_coordinates(df), natures))


def to_segments(raw: DataFrame, start_year: int = K.START_YEAR, natures=K.NATURES,
                tile_hours: int | None = None) -> DataFrame:
    """All steps up to segment ids; short segments still inside."""
    df = filter_synoptic(to_unique_observations(raw, start_year, natures))
    filled = drop_missing_intensity(ffill_causal(df, tile_hours=tile_hours))
    return assign_segments(filled, tile_hours=tile_hours)


def clean(raw: DataFrame, start_year: int = K.START_YEAR, natures=K.NATURES,
          min_rows: int = K.MIN_SEGMENT_ROWS, tile_hours: int | None = None) -> DataFrame:
    """The whole cleaning chain: raw observations to segments of >= ``min_rows``.

    Two shuffles: the de-duplicating aggregate and one hash by SID that serves
    fill, segmentation and the length filter. The synoptic filter is a
    predicate on an aggregate key, so Catalyst runs it below the aggregate.
    ``tile_hours`` keeps every task to one tile of a key, for more shuffles.
    """
    segments = to_segments(raw, start_year, natures, tile_hours)
    return filter_short_segments(segments, min_rows, tile_hours)


# the same chain with its counts: raw rows are read once and written by outcome
ROW_STAGES = ("track_type", "season", "valid_time", "coordinates", "nature")


def screen(raw: DataFrame, start_year: int = K.START_YEAR, natures=K.NATURES) -> DataFrame:
    """Raw rows by what becomes of them: (outcome, n_raw, SID, ISO_TIME, best).

    ``outcome`` is the first stage of ``ROW_STAGES`` that refuses a row. Refused rows
    are only counted, in one row per stage. Rows that pass have no outcome and are one
    row per (SID, ISO_TIME) as in ``dedupe_most_complete``. One aggregate, combined
    map-side; write its result, then ``clean_screened`` and ``retention_funnel`` read
    that table and the raw rows are read once.
    """
    dtypes = dict(raw.dtypes)
    typed = select_columns(raw.withColumn("SEASON", season_number()))
    typed = normalize_longitude(typed.withColumns({
        **{c: _as_number(c, dtypes[c]) for c in K.NUMERIC_COLUMNS},
        "ISO_TIME": _as_time("ISO_TIME", dtypes["ISO_TIME"])}))
    tests = (is_track_type(), F.col("SEASON") >= start_year, F.col("ISO_TIME").isNotNull(),
             has_valid_position(), is_nature(natures))
    refused = F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name))
                           for name, test in zip(ROW_STAGES, tests)])
    passed = F.col("outcome").isNull()
    rows = typed.withColumn("outcome", refused)
    return rows.groupBy("outcome", F.when(passed, F.col("SID")).alias("SID"),
                        F.when(passed, F.col("ISO_TIME")).alias("ISO_TIME")).agg(
        F.count("*").alias("n_raw"),
        F.min(F.when(passed, most_complete(typed.columns))).alias("best"))


def clean_screened(screened: DataFrame, min_rows: int = K.MIN_SEGMENT_ROWS,
                   tile_hours: int | None = None) -> DataFrame:
    """``clean`` from the table that ``screen`` made."""
    return filter_short_segments(segments_screened(screened, tile_hours), min_rows, tile_hours)


def segments_screened(screened: DataFrame, tile_hours: int | None = None) -> DataFrame:
    """``to_segments`` from the table that ``screen`` made."""
    unique = screened.where("outcome IS NULL").select(*[
        c if c in ("SID", "ISO_TIME") else F.col(f"best.{c}").alias(c) for c in K.REQUIRED_COLUMNS])
    filled = ffill_causal(filter_synoptic(unique), tile_hours=tile_hours)
    return assign_segments(drop_missing_intensity(filled), tile_hours=tile_hours)


# ------------------------------------------------------------------ summaries
def unpivot(one_row: DataFrame, columns, name: str, value: str) -> DataFrame:
    """One row of many columns to one row per column."""
    return one_row.unpivot([], list(columns), name, value)


def cleaning_summary(cleaned: DataFrame, screened: DataFrame) -> DataFrame:
    """Headline counts of a cleaned table and the table that ``screen`` made of the same raw rows.

    Segment lengths are aggregated first, then summarised.
    """
    segments = cleaned.groupBy("SID", "SEGMENT_ID").agg(
        F.count("*").alias("n"), F.min("SEASON").alias("lo"), F.max("SEASON").alias("hi"))
    raw_rows = screened.agg(F.coalesce(F.sum("n_raw"), F.lit(0))).scalar()
    rows = F.sum("n")
    return segments.agg(
        raw_rows.alias("raw_rows"),
        rows.alias("clean_rows"),
        F.when(raw_rows > 0, F.round(rows / raw_rows * 100, 2)).otherwise(F.lit(0.0))
         .alias("retention_pct"),
        F.count_distinct("SID").alias("storms"),
        F.count("*").alias("segments"),
        F.floor(F.median("n")).cast("int").alias("median_segment_length"),
        F.min("lo").alias("season_min"),
        F.max("hi").alias("season_max"),
    )


FUNNEL_STAGES = ("raw", *ROW_STAGES, "unique", "synoptic", "intensity", "segment_length")


def retention_funnel(screened: DataFrame, min_rows: int = K.MIN_SEGMENT_ROWS) -> DataFrame:
    """Rows left after every cleaning stage, from the table that ``screen`` made.

    Its counts give the row-level stages; unique and synoptic rows are counted
    beside them, the last stages where their window ends.
    """
    passed = F.col("outcome").isNull()
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ROW_STAGES)), F.col("outcome")),
                       F.lit(len(ROW_STAGES) + 1))

    def left(stage_no: int) -> Column:
        return F.coalesce(F.sum(F.when(place > stage_no, F.col("n_raw"))), F.lit(0))

    first = screened.agg(*[left(i).alias(name) for i, name in enumerate(("raw", *ROW_STAGES))],
                         F.count_if(passed).alias("unique"),
                         F.count_if(passed & is_synoptic()).alias("synoptic"))
    sized = segments_screened(screened).groupBy("SID", "SEGMENT_ID").agg(F.count("*").alias("n"))
    long_enough = F.when(F.col("n") >= min_rows, F.col("n"))
    ends = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("intensity"),
                     F.coalesce(F.sum(long_enough), F.lit(0)).alias("segment_length"))
    parts = [(first, FUNNEL_STAGES[:8]), (ends, FUNNEL_STAGES[8:])]
    long = reduce(DataFrame.unionByName,
                  [unpivot(df, names, "stage", "n_rows") for df, names in parts])
    position = F.array_position(F.array(*[F.lit(s) for s in FUNNEL_STAGES]), F.col("stage"))
    # ten rows, so one ordered window over all of them is bounded
    numbered = long.withColumn("stage_no", position.cast("int"))
    everything = F.collect_list(F.struct("stage_no", "n_rows"))
    stages = numbered.groupBy().agg(F.sort_array(everything).alias("s"))
    n, before, raw_rows = F.col("cur.n_rows"), F.get("s", F.col("i") - 1)["n_rows"], F.get("s", F.lit(0))["n_rows"]
    # shares of nothing: none removed, none known to be kept
    return stages.select(F.posexplode("s").alias("i", "cur"), "s").select(
        F.get(F.array(*[F.lit(s) for s in FUNNEL_STAGES]), F.col("i")).alias("stage"),
        F.col("cur.stage_no").alias("stage_no"),
        n.alias("n_rows"),
        F.coalesce(before - n, F.lit(0)).alias("n_removed"),
        F.round(F.coalesce(F.try_divide(before - n, before) * 100, F.lit(0.0)), 4).alias("removed_pct"),
        F.round(F.try_divide(n, raw_rows) * 100, 4).alias("kept_pct"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, only columns that have some."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return unpivot(counts, df.columns, "column_name", "n_missing").where("n_missing > 0")


def all_missing_entities(df: DataFrame, columns=("WMO_WIND", "WMO_PRES")) -> DataFrame:
    """How many storms have no single value of a column."""
    per_storm = df.groupBy("SID").agg(*[F.count(c).alias(c) for c in columns])
    counts = per_storm.agg(*[F.count_if(F.col(c) == 0).alias(c) for c in columns])
    return unpivot(counts, columns, "column_name", "n_storms")


def fill_simulation(df: DataFrame) -> DataFrame:
    """What an unlimited forward and backward fill by storm could not repair.

    Such a fill repairs every row of a storm that has at least one value, so
    counting per storm gives the exact answer without a window on raw keys.
    """
    wind, pres = F.count("WMO_WIND"), F.count("WMO_PRES")
    per_storm = df.groupBy("SID").agg(F.count("*").alias("n"), wind.alias("w"), pres.alias("p"))

    def left(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n")).otherwise(0)), F.lit(0))

    return per_storm.agg(
        F.sum(F.col("n") - F.col("w")).alias("wind_missing_before"),
        F.sum(F.col("n") - F.col("p")).alias("pressure_missing_before"),
        left(F.col("w") == 0).alias("wind_missing_after"),
        left(F.col("p") == 0).alias("pressure_missing_after"),
        left((F.col("w") == 0) | (F.col("p") == 0)).alias("rows_still_missing"))
