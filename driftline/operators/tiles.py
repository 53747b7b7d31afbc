"""Row-exact windows for keys too long for one task.

A window by storm puts the storm in one task. That is bounded after cleaning
(see ``windows``), but not for other cadences or for tables that were never
cleaned. Here the history of a key is cut into time tiles. Each tile gets copies
of the last rows before it and the first rows after it (its halo), so any window
that looks at most ``back`` rows back and ``ahead`` rows ahead gives the same
result inside the tile as over the whole key, whatever the spacing of the rows.

Rows must be unique per (SID, ISO_TIME). Only one small row per (SID, tile)
meets in a task by key, and running totals are carried over from such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.times import epoch_seconds

TILE_HOURS = 24 * 128  # 512 rows of a 6-hourly track


def with_tile(df: DataFrame, tile_hours: int = TILE_HOURS) -> DataFrame:
    return df.withColumn("TILE", F.floor(epoch_seconds("ISO_TIME") / (3600 * tile_hours)))


def with_halo(df: DataFrame, back: int, ahead: int = 0, tile_hours: int = TILE_HOURS) -> DataFrame:
    """The rows with TILE, plus halo rows marked by IS_HALO.

    The nearest ``back`` rows before a tile lie in the ``back`` non-empty tiles
    before it, since each of those has at least one row.
    """
    tiled = with_tile(df, tile_hours)
    row = F.struct("ISO_TIME", *[c for c in df.columns if c != "ISO_TIME"])
    tile = Window.partitionBy("SID", "TILE")
    ranked = tiled.select("SID", "TILE", row.alias("r"),
                          F.row_number().over(tile.orderBy("ISO_TIME")).alias("_first"),
                          F.row_number().over(tile.orderBy(F.desc("ISO_TIME"))).alias("_last"))
    edges = ranked.where((F.col("_first") <= ahead) | (F.col("_last") <= back)).groupBy("SID", "TILE").agg(
        F.sort_array(F.collect_list(F.when(F.col("_last") <= back, F.col("r")))).alias("tail"),
        F.sort_array(F.collect_list(F.when(F.col("_first") <= ahead, F.col("r")))).alias("head"))
    order = Window.partitionBy("SID").orderBy("TILE")  # one row per tile
    parts = []
    if back:
        before = F.flatten(F.collect_list("tail").over(order.rowsBetween(-back, -1)))
        parts.append(F.slice(F.reverse(before), 1, back))
    if ahead:
        after = F.flatten(F.collect_list("head").over(order.rowsBetween(1, ahead)))
        parts.append(F.slice(after, 1, ahead))
    near = edges.select("TILE", F.concat(*parts).alias("near"))
    copies = near.select("TILE", F.explode("near").alias("r")).select("r.*", "TILE")
    return tiled.withColumn("IS_HALO", F.lit(False)).unionByName(
        copies.withColumn("IS_HALO", F.lit(True)))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("IS_HALO")).drop("IS_HALO", "TILE")


def carried(df: DataFrame, value: Column, combine, name: str, before_only: bool) -> DataFrame:
    """``combine`` of ``value`` over tiles of the key, joined to every row by (SID, TILE).

    ``before_only`` takes the tiles before the own one (a running total), else all.
    ``df`` has TILE and no halo rows are counted.
    """
    per_tile = df.where(~F.col("IS_HALO")).groupBy("SID", "TILE").agg(combine(value).alias("_v"))
    w = Window.partitionBy("SID").orderBy("TILE")
    w = w.rowsBetween(Window.unboundedPreceding, -1 if before_only else Window.unboundedFollowing)
    totals = per_tile.select("SID", "TILE", combine("_v").over(w).alias(name))
    return df.join(totals, ["SID", "TILE"], "left")
