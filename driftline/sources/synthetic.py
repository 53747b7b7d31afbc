"""A raw track table computed from ``events`` with integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_TRACK = 60


def raw_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event becomes one track point; some get extra copies.

    The window groups 60 consecutive event ids, so no group can exceed 60 rows.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"),
        F.expr(f"event_id div {ROWS_PER_TRACK}").alias("g"),
        (F.col("event_id") % ROWS_PER_TRACK).alias("step"),
        F.round(F.col("value") * 100).cast("bigint").alias("c"),
    )
    walk = Window.partitionBy("g").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    north = F.sum((F.col("c") * 7) % 700 - 150).over(walk)
    east = F.sum((F.col("c") * 13) % 900 - 250).over(walk)
    side = F.when(F.col("g") % 2 == 0, F.lit(-1)).otherwise(F.lit(1))
    ev = ev.select(
        "*",
        (((F.col("g") * 1379) % 40000 - 15000 + north) / F.lit(1000.0)).alias("lat"),
        (((F.col("g") * 9973) % 360000 - 180000 + side * east) / F.lit(1000.0)).alias("lon"),
    )

    def copy(off: int, kind: str, dup: bool, condition=None):
        row = F.struct(F.lit(off).alias("off"), F.lit(kind).alias("kind"), F.lit(dup).alias("dup"))
        return row if condition is None else F.when(condition, row)

    copies = F.array_compact(F.array(
        copy(0, "main", False),
        copy(3, "main", False, F.col("id") % 11 == 3),
        copy(0, "spur", False, F.col("id") % 29 == 4),
        copy(0, "main", True, F.col("id") % 37 == 5),
    ))
    hole = (F.col("g") % 5 == 2) & F.col("step").isin(28, 29)
    rows = ev.where(~hole).withColumn("k", F.explode(copies))
    day0 = F.lit("1980-01-01 00:00:00").cast("timestamp_ntz")
    time = day0 + F.make_dt_interval(
        days=((F.col("g") * 3571) % 16425).cast("int"),
        hours=(F.col("step") * 6 + F.col("k.off")).cast("int"))
    no_wind = (F.col("id") % 13 == 6) | ((F.col("g") % 7 == 3) & F.col("step").between(33, 36)) \
        | F.col("k.dup")
    basins = F.array(*[F.lit(b) for b in ("NA", "EP", "WP", "NI", "SI", "SP", "SA")])
    return rows.select(
        F.concat(F.lit("T"), F.col("g").cast("string")).alias("SID"),
        F.year(time).cast("string").alias("SEASON"),
        F.when(F.col("g") % 14 != 0, F.get(basins, (F.col("g") % 7).cast("int"))).alias("BASIN"),
        F.lit("MM").alias("SUBBASIN"),
        time.alias("ISO_TIME"),
        F.col("lat").alias("LAT"),
        F.col("lon").alias("LON"),
        F.when(no_wind, F.lit(" ")).otherwise((25 + F.col("c") % 120).cast("string"))
         .alias("WMO_WIND"),
        (1010 - F.col("c") % 110).cast("string").alias("WMO_PRES"),
        (F.col("c") % 25).cast("string").alias("STORM_SPEED"),
        F.when(F.col("id") % 101 == 50, F.lit(" ")).otherwise((F.col("c") % 360).cast("string"))
         .alias("STORM_DIR"),
        F.when((F.col("g") % 3 == 0) & (F.col("step") >= 56), F.lit("ET"))
         .when(F.col("g") % 5 == 1, F.lit(" ss")).otherwise(F.lit("TS")).alias("NATURE"),
        (F.col("c") % 2000).cast("string").alias("DIST2LAND"),
        F.col("k.kind").alias("TRACK_TYPE"),
    )
