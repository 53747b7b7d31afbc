"""Mixing sources to target weights by hash-threshold histograms.

Every document has a size (its words) and a hash of its id. A source gets a
target number of words; whole copies of the source fill as much of it as they
can, and the rest is the documents whose hash is below a threshold. The
threshold is found without sorting: sum sizes by source and leading bits of
the hash, find the bucket in which the running sum passes the budget, and
split only that bucket by the next bits, until it holds one hash. A larger
budget gives a higher threshold, so a smaller mix is always part of a larger.

Defined results:

* null text: size 0; null source: a source of its own, after all others;
* null ids and repeated ids: equal hashes, so such rows are taken or left together;
* sources of size 0: target 0, nothing taken;
* empty table: empty result;
* columns of the input named like an output: kept inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.joins import broadcast_if_small
from driftline.llm.tables import packed, words, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
HASH_BITS = 48
LEVEL_BITS = 12


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row``, ``source``, ``size`` and a hash of 48 bits of the id."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return packed(df, doc_id=doc_id, text=text, source=source).select(
        "row", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: its size and its target.

    A source is full at ``MAX_COPIES`` times its size; what it cannot take goes
    to the others by weight. Ordered by how early they are full, the first
    source that is not full fixes the words per weight for all after it. The
    windows hold one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("full", MAX_COPIES * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rate = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0))
            ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    sources = sources.withColumn("rate", rate)
    open_rate = F.min(F.when(F.col("weight") * F.col("rate") <= F.col("full"), F.struct(
        (F.col("full") / F.col("weight")).alias("at"), F.col("rate").alias("rate")))).over(everything)["rate"]
    return sources.select("source", "source_size", F.least(
        F.col("full").cast("double"), F.coalesce(F.col("weight") * open_rate, F.col("full").cast("double"))
    ).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``copies`` of all documents and ``below``: hashes under it are taken once more."""
    copies = F.when(F.col("source_size") > 0, F.least(
        F.lit(MAX_COPIES), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    goals = goals.withColumn("copies", copies).withColumn(
        "rest", F.col("target") - F.col("copies") * F.col("source_size"))
    found = written(goals.filter("rest > 0").select(
        "source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("sum_before"),
        F.lit(False).alias("single"), F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("group_size")),
        "thresholds")
    for bits in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        if found.filter("not single").isEmpty():
            break
        shift = HASH_BITS - bits
        level = found.filter("not single").select(
            F.col("source").alias("goal"), "rest", "prefix", F.col("sum_before").alias("start"))
        inside = sizes.join(broadcast_if_small(level), F.col("source").eqNullSafe(F.col("goal"))
                            & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")))
        buckets = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("group_size"), F.min("hash").alias("low"), F.max("hash").alias("high"),
            F.first("rest").alias("rest"), F.first("start").alias("start"))
        up_to = F.col("start") + F.sum("group_size").over(
            Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        passed = buckets.withColumn("up_to", up_to).withColumn(
            "sum_before", F.col("up_to") - F.col("group_size")).filter(
            (F.col("sum_before") <= F.col("rest")) & (F.col("up_to") > F.col("rest")))
        found = written(found.filter("single").unionByName(passed.select(
            "source", "rest", F.col("bucket").alias("prefix"), "sum_before",
            (F.col("low") == F.col("high")).alias("single"), F.col("low").alias("hash"), "group_size")),
            "thresholds")
    nearer = F.col("rest") - F.col("sum_before") > F.col("group_size") / 2
    found = found.select(F.col("source").alias("goal"), (F.col("hash") + nearer.cast("long")).alias("below"))
    return goals.join(broadcast_if_small(found), F.col("source").eqNullSafe(F.col("goal")), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("below", F.lit(0)).alias("below"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """``row`` with its size, its source's size and target, and how often it is taken.

    Sizes and hashes are written once without the texts; the histogram steps
    read only those. The thresholds (one row per source) are broadcast only if
    they are few, else the join shuffles and a hot source is split.
    """
    sizes = written(sized(df, doc_id, text, source).drop("row"), "sizes")
    goals = written(targets(sizes, weights, share), "targets")
    limits = broadcast_if_small(written(thresholds(sizes, goals), "limits").withColumnRenamed("source", "goal"))
    taken = sized(df, doc_id, text, source).join(
        limits, F.col("source").eqNullSafe(F.col("goal")), "left")
    times = F.col("copies") + (F.col("hash") < F.col("below")).cast("long")
    return taken.select("row", "size", "source_size", "target", times.alias("times"),
                        (times * F.col("size")).alias("taken"))


def mixture(mixed: DataFrame) -> DataFrame:
    """The documents of the mix: each row as often as it is taken."""
    return mixed.filter("times > 0").select(
        F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row")).select("row.*")
