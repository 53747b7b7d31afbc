"""Exact order statistics and ranks without collecting a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.joins import broadcast_if_small
from driftline.session import cut_lineage


def same_keys(left: str, right: str, keys) -> Column:
    """Null-safe equality of key columns of two aliased tables."""
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def _ranks_in_bins(hist: DataFrame, keys, inner, bin_col: str, wanted: Column) -> DataFrame:
    """Which bin holds each wanted rank, and how many values lie below that bin.

    ``hist`` has one row per bin, so its windows hold bins, never rows of data.
    """
    ordered = Window.partitionBy(*keys, *inner).orderBy(bin_col)
    upto = F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    bins = hist.withColumn("_upto", upto).withColumn("_rank", F.explode(wanted))
    local = F.col("_rank") - F.col("_base")
    return bins.where((local >= F.col("_upto") - F.col("_n")) & (local < F.col("_upto"))) \
               .withColumn("_base", F.col("_base") + F.col("_upto") - F.col("_n"))


#: A window orders at most this many rows of one bin, and a bin is cut into so many.
MAX_BIN_ROWS = 100_000
CUTS = 1024
#: Width of the first histogram: 50 m where the values are km.
BIN_WIDTH = 0.05


def _hits(found: DataFrame, cell) -> DataFrame:
    """The bins that hold wanted ranks, one row each: range, rows, rows below, ranks."""
    return cut_lineage(found.groupBy(*cell).agg(
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n"),
        F.collect_set("_rank").alias("_wanted"), F.first("_base").alias("_base"),
        F.first("_total").alias("_total")).drop("_bin"))


def _span(weight: Column) -> list[Column]:
    return [F.sum(weight).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]


def _values(df: DataFrame, groups, value: str, weight: str | None = None) -> DataFrame:
    """The group columns, the value ``_v`` and its weight ``_w``; rows without a value are left out."""
    number = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    base = df.select(*groups, F.col(value).cast("double").alias("_v"), number.alias("_w"))
    base = base.where(F.col("_v").isNotNull())  # NaN became NULL at the scan
    return base if groups else base.withColumn("_all", F.lit(1))


def fine_bin(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width))


def fine_bins(df: DataFrame, groups, value: str, width: float = BIN_WIDTH) -> DataFrame:
    """Rows, smallest and largest value and sum per group and bin of ``width``; combined map-side."""
    rows = _values(df, list(groups), value)
    return rows.groupBy(*(list(groups) or ["_all"]), fine_bin(F.col("_v"), width).alias("_bin")).agg(
        *_span(F.col("_w")), F.sum("_v").alias("_sum"))


def bins_of_ranks(bins: DataFrame, groups, quantiles) -> DataFrame:
    """The bins that hold the ranks a linear interpolation of ``quantiles`` looks at, one row per rank."""
    keys = list(groups) or ["_all"]
    total = F.sum("_n").over(Window.partitionBy(*keys))
    positions = F.array(*[F.lit(q) * (F.col("_total") - 1) for q in quantiles])
    wanted = F.array_distinct(F.concat(F.transform(positions, lambda p: F.floor(p)),
                                       F.transform(positions, lambda p: F.ceil(p))))
    counted = bins.withColumns({"_total": total, "_base": F.lit(0).cast("bigint")})
    return _ranks_in_bins(counted, keys, [], "_bin", wanted)


def exact_percentiles(df: DataFrame, groups, value: str, quantiles: dict[str, float],
                      width: float = BIN_WIDTH, max_bin_rows: int = MAX_BIN_ROWS,
                      bins: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Linear-interpolated percentiles per group, exact at any group size.

    The built-in ``percentile`` merges all distinct values of a group in one
    task. Here a histogram with bins of ``width`` finds the bins that hold the
    wanted ranks. A bin with more than ``max_bin_rows`` rows of different values
    is cut into ``CUTS`` parts between its smallest and largest value and counted
    again, until none is left; then the distinct values of the bins are ordered.
    Every pass counts map-side, and no window holds more than a bin's rows or
    the bins of a group. With errors in km the histogram has at most 400,000
    bins per group (half the Earth's circumference / 50 m).

    The bins that were hit (at most two per group and quantile) are checkpointed
    between the passes, so jobs run while the plan is built, and ``df`` is read
    once per pass: pass a written table, and ``groups`` that are report keys
    (model, lead, basin, class), not entities. Who has the histogram of all rows
    already passes it as ``bins``; ``df`` then needs only the rows of the bins that
    were hit, and may hold each value once with its number of rows in ``weight``.
    """
    groups = list(groups)
    keys = groups or ["_all"]
    base = _values(df, groups, value, weight)
    span = _span(F.col("_w"))
    if bins is None:
        bins = fine_bins(df, groups, value, width)
    hit = _hits(bins_of_ranks(bins, groups, quantiles.values()), [*keys, "_bin"])

    def inside():
        """Rows in the range of a hit bin, with the bin; a group has a few bins."""
        bins_hit = broadcast_if_small(hit).alias("h")
        within = (F.col("d._v") >= F.col("h._lo")) & (F.col("d._v") <= F.col("h._hi"))
        return base.alias("d").join(bins_hit, same_keys("d", "h", keys) & within).select(
            "d.*", "h._lo", "h._hi", "h._wanted", "h._base", "h._total")

    while not hit.where((F.col("_n") > max_bin_rows) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        step = (F.col("_hi") - F.col("_lo")) / CUTS
        part = F.when(step > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / step), F.lit(CUTS - 1)))
        cut = inside().withColumn("_bin", F.coalesce(part, F.lit(0))).withColumnRenamed("_lo", "_from")
        bins = cut.drop("_hi").groupBy(*keys, "_from", "_bin").agg(
            *span, F.first("_wanted").alias("_wanted"), F.first("_base").alias("_base"),
            F.first("_total").alias("_total"))
        found = _ranks_in_bins(bins, keys, ["_from"], "_bin", F.col("_wanted"))
        hit = _hits(found, [*keys, "_from", "_bin"]).drop("_from")

    values = inside().groupBy(*keys, "_lo", "_v").agg(
        F.sum("_w").alias("_n"), F.first("_wanted").alias("_wanted"), F.first("_base").alias("_base"),
        F.first("_total").alias("_total"))
    at = _ranks_in_bins(values, keys, ["_lo"], "_v", F.col("_wanted"))

    table = at.groupBy(*keys).agg(
        F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"),
        F.first("_total").alias("_total"))
    out = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        out.append(F.when(low == high, F.col("_at")[low]).otherwise(
            (high - position) * F.col("_at")[low] + (position - low) * F.col("_at")[high])
            .alias(name))
    return table.select(*groups, *out)


def row_hash(keys, seed: int) -> Column:
    """A seeded hash of 52 bits per row key: the first 13 hex digits of an md5.

    The key is its columns as text and the seed, joined by ``|``, which any engine
    can compute; times are written with seconds.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def hash_rank(df: DataFrame, keys, seed: int, buckets: int = 1024) -> DataFrame:
    """Exact global rank (0-based) of rows in the order of a seeded hash of ``keys``.

    A rank over everything would be one task. The hash cuts the rows into
    ``buckets`` of nearly equal size by its leading part; the order is that of the
    hash, and the rank is the number of rows in lower buckets plus the position
    inside the bucket.
    """
    rows = df.withColumn("_h", row_hash(keys, seed))
    rows = rows.withColumn("_bucket", F.floor(F.col("_h") / F.lit((1 << 52) // buckets)))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # one row per bucket, at most ``buckets`` rows in this window
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_bucket")
                              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *keys)) - 1
    return (rows.withColumn("_inside", inside)
                .join(F.broadcast(offsets), "_bucket")
                .withColumn("hash_rank", F.col("_before") + F.col("_inside"))
                .drop("_h", "_bucket", "_inside", "_before"))


def ordered_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Exact global rank (0-based) in sort order, without one task for all rows.

    A range partitioning puts whole ranges into partitions; the partition number
    is checkpointed with the rows, so it cannot change under a retry. The rank is
    the number of rows in lower partitions plus the position inside.
    """
    rows = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")
                              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (rows.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
                .withColumn(name, F.col("_before") + F.col("_inside"))
                .drop("_part", "_inside", "_before"))


def hash_fraction(keys, seed: int) -> Column:
    """A uniform number in [0, 1) per row that depends on its key and the seed only."""
    return row_hash(keys, seed) / F.lit(float(1 << 52))


def hash_order(keys, seed: int) -> list[Column]:
    """Sort columns of a seeded random order, with the key as tie-break."""
    return [row_hash(keys, seed), *[F.col(k) for k in keys]]
