"""Which features matter: impurity, permutation, ablation, correlation."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions.order_stats import row_hash
from driftline.operators import metrics as M
from driftline.operators.features import columns_outside
from driftline.operators.models import PairModel, fit, mean_error_km
from driftline.session import tasks_for

ROWS_PER_BUCKET = 2_000
ROWS_PER_TASK = 100_000


def impurity_importance(spark: SparkSession, model: PairModel) -> DataFrame:
    """Built-in importances averaged over both outputs; empty if there are none that fit."""
    schema = "feature string, impurity double"
    pair = [getattr(m, "featureImportances", None) for m in (model.lat, model.lon)]
    if any(p is None or p.size != len(model.features) for p in pair):
        return spark.createDataFrame([], schema)
    rows = [(c, float(a + b) / 2) for c, a, b in
            zip(model.features, pair[0].toArray(), pair[1].toArray())]
    return spark.createDataFrame(rows, schema).orderBy(F.desc("impurity"), "feature")


# ----------------------------------------------------------------- permutation
def shuffled_copies(rows: DataFrame, repeats: int, seed: int, n_rows: int) -> DataFrame:
    """Each row ``repeats`` times, with the feature array of a random other row in ``_xs``.

    Rows are cut into random buckets of about 2,000 by a seeded hash. Inside a
    bucket they are put in a random order and everyone takes the array of the next
    one (the last takes the first). That permutes the table, keeps every value
    exactly once, and needs no global row number.
    """
    buckets = max(1, math.ceil(n_rows / ROWS_PER_BUCKET))
    copies = rows.withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    h = row_hash(["SID", "ISO_TIME", "repeat"], seed)
    copies = copies.withColumn("_h", h).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    tasks = tasks_for(rows.sparkSession, n_rows * repeats, ROWS_PER_TASK)  # more rows are more tasks, not larger ones
    copies = copies.repartition(tasks, "repeat", "_bucket")
    group = Window.partitionBy("repeat", "_bucket")
    order = group.orderBy("_h", "SID", "ISO_TIME")
    first = F.first("_xa").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return copies.withColumn("_xs", F.coalesce(F.lead("_xa").over(order), first)) \
                 .drop("_h", "_bucket")


def _permutation(model: PairModel, rows: DataFrame, variants: dict[str, tuple[int, int]],
                 repeats: int, seed: int) -> DataFrame:
    """Error rise per variant: the first position and the number of shuffled features.

    Variants are exploded after the shuffle, so the data moves once per repeat
    and the aggregate is combined map-side. Positions come from the row itself,
    never from shuffled features.
    """
    lat, lon = K.target_columns(model.horizon)
    array = F.array(*[F.col(c).cast("double") for c in model.features])
    base = rows.select("SID", "ISO_TIME", "LAT", "LON", F.lit(model.horizon).alias("horizon"),
                       F.col(lat).alias("Y_LAT"), F.col(lon).alias("Y_LON"), array.alias("_xa"))
    n_rows = base.count()

    def errors(df, groups):
        scored = M.score(model.predict_vectors(df.withColumn("_x", array_to_vector("_xv"))))
        return scored.groupBy(*groups).agg(F.avg("ERROR_KM").alias("km"))

    whole = errors(base.withColumn("_xv", F.col("_xa")), []).first()["km"]
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(start).alias("start"),
                               F.lit(size).alias("size")) for name, (start, size) in variants.items()])
    mixed = shuffled_copies(base, repeats, seed, n_rows).withColumn("_v", F.explode(table))
    start, size = F.col("_v.start"), F.col("_v.size")
    value = F.concat(F.slice("_xa", F.lit(1), start), F.slice("_xs", start + 1, size),
                     F.slice("_xa", start + size + 1, F.lit(len(model.features))))
    per_repeat = errors(mixed.withColumn("_xv", value).withColumn("variant", F.col("_v.name")),
                        ["variant", "repeat"])
    rise = F.col("km") - F.lit(whole)
    return per_repeat.groupBy("variant").agg(F.avg(rise).alias("importance_km"),
                                             F.stddev_pop(rise).alias("std_km"))


def permutation_importance(model: PairModel, rows: DataFrame, repeats: int = K.IMPORTANCE_REPEATS,
                           seed: int = K.SEED) -> DataFrame:
    """Rise of the mean error in km when one feature is shuffled."""
    variants = {c: (i, 1) for i, c in enumerate(model.features)}
    out = _permutation(model, rows, variants, repeats, seed)
    return out.withColumnRenamed("variant", "feature").orderBy(F.desc("importance_km"), "feature")


def grouped_permutation(model: PairModel, rows: DataFrame, repeats: int = K.IMPORTANCE_REPEATS,
                        seed: int = K.SEED) -> DataFrame:
    """The same with all features of a group moved together."""
    place = {c: i for i, c in enumerate(model.features)}
    variants = {}
    for group, columns in K.FEATURE_GROUPS.items():
        at = sorted(place[c] for c in columns if c in place)
        if at and at != list(range(at[0], at[0] + len(at))):
            raise ValueError(f"the features of group {group} are not side by side")
        if at:
            variants[group] = (at[0], len(at))
    out = _permutation(model, rows, variants, repeats, seed)
    sizes = F.create_map(*[F.lit(x) for g, (_, n) in variants.items() for x in (g, n)])
    return out.select(F.col("variant").alias("group"), sizes[F.col("variant")].alias("n_features"),
                      "importance_km", "std_km").orderBy(F.desc("importance_km"), "group")


# -------------------------------------------------------------------- ablation
def group_ablation(rows: DataFrame, model: str, horizon: int = K.DEFAULT_HORIZON,
                   params: dict | None = None, groups=tuple(K.FEATURE_GROUPS), threads: int = 4) -> DataFrame:
    """Refit without each group; error and difference to the full model on the test rows.

    The fits are independent; the threads only submit their jobs.
    """
    test = rows.where("split = 'test'")
    kept = {"(none)": K.FEATURES, **{group: columns_outside([group]) for group in groups}}

    def error(features):
        fitted = fit(rows, model, horizon, params, features, early_stopping=False, at_once=2 * threads)
        return mean_error_km(fitted, test)

    with ThreadPoolExecutor(threads) as pool:
        errors = dict(zip(kept, pool.map(error, kept.values())))
    full = errors["(none)"]
    out = [(group, len(kept[group]), round(km, 2), round(km - full, 2)) for group, km in errors.items()]
    schema = "removed_group string, n_features int, error_km double, delta_km double"
    return rows.sparkSession.createDataFrame(out, schema).orderBy(F.desc("delta_km"), "removed_group")


# ----------------------------------------------------------------- correlation
def correlation_pairs(rows: DataFrame, threshold: float = K.CLUSTER_CORRELATION,
                      features=K.FEATURES) -> DataFrame:
    """Pairs of features with |r| above the threshold; the matrix is features x features."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(
        rows.select(*features)).select("_x")
    matrix = Correlation.corr(vectors, "_x").first()[0].toArray()
    found = [(a, b, float(matrix[i, j])) for i, a in enumerate(features)
             for j, b in enumerate(features) if i < j and abs(matrix[i, j]) > threshold]
    return rows.sparkSession.createDataFrame(found, "feature_a string, feature_b string, r double")


def correlated_clusters(rows: DataFrame, threshold: float = K.CLUSTER_CORRELATION,
                        features=K.FEATURES) -> DataFrame:
    """Greedy clusters: each free feature takes all its free partners.

    A feature all of whose partners are taken still forms a cluster of its own.
    """
    partners: dict[str, list[str]] = {c: [] for c in features}
    for a, b, _ in correlation_pairs(rows, threshold, features).collect():
        partners[a].append(b)
        partners[b].append(a)
    place = {c: i for i, c in enumerate(features)}
    taken: set[str] = set()
    clusters = []
    for c in features:
        if c in taken or not partners[c]:
            continue
        members = [c] + [p for p in sorted(partners[c], key=place.get) if p not in taken]
        taken.update(members)
        clusters.append((len(clusters) + 1, members))
    return rows.sparkSession.createDataFrame(clusters, "cluster int, members array<string>")


# ------------------------------------------------------------------ comparison
def importance_compare(permutation: DataFrame, impurity: DataFrame) -> DataFrame:
    """Both rankings side by side; ties get the average rank. One row per feature."""
    def rank(column):
        order = Window.orderBy(F.desc(column))  # as many rows as features
        same = F.count("*").over(Window.partitionBy(column))
        return F.rank().over(order) + (same - 1) / 2

    both = permutation.join(impurity, "feature")
    return both.withColumns({"rank_permutation": rank("importance_km"), "rank_impurity": rank("impurity")}) \
               .withColumn("rank_gap", F.abs(F.col("rank_permutation") - F.col("rank_impurity")))


def largest_rank_gaps(compared: DataFrame, n: int = 5) -> DataFrame:
    return compared.select("feature", "rank_permutation", "rank_impurity", "rank_gap") \
                   .orderBy(F.desc("rank_gap"), "feature").limit(n)


def top_importance(table: DataFrame, n: int = 20, by: str = "importance_km") -> DataFrame:
    return table.orderBy(F.desc(by), table.columns[0]).limit(n)
