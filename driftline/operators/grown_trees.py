"""Regression trees grown in tasks, for ensembles that take MLlib too many passes.

MLlib runs a Spark job for every level of a tree, and sums a histogram of every node over the
network; deep forests and long boosted ensembles are thousands of jobs of little work. Here
the training rows are written once as bytes (a bin of each feature, as many bins as MLlib has),
and a task grows whole trees from them: some trees of a forest, or all rounds of a boosted
pair, where the rounds also end as soon as early stopping has decided. A task holds one byte a
row and feature and some numbers a row, so tables above ``MAX_ROWS`` stay with MLlib.

Trees lie in the shared folder, an array a tree. They never come to the driver, and a task
that predicts holds one tree at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions.order_stats import row_hash
from driftline.session import shared_dir

BINS = 32
#: Rows up to which a task holds all of them (by its arrays about 150 bytes a row).
MAX_ROWS = 5_000_000
#: Nodes of a level whose histograms are held at the same time, and up to which those of one child are
#: the parent's less the other's.
NODES_AT_ONCE, SUBTRACTED = 4096, 512
#: Rows that a predicting task holds while the trees pass by.
HELD_ROWS = 100_000
#: Rounds of boosting between two looks at the validation losses.
ROUNDS_A_JOB = 48


@dataclass
class Tree:
    """Nodes in the order of their levels; a leaf has feature -1. Rows with x <= cut go left, right is left + 1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of a matrix (rows by features) ends in."""
        at = np.zeros(len(x), np.int32)
        moving = np.flatnonzero(self.feature[at] >= 0)
        while len(moving):
            node = at[moving]
            node = self.left[node] + (x[moving, self.feature[node]] > self.cut[node])
            at[moving] = node
            moving = moving[self.feature[node] >= 0]
        return at

    def binned_leaves(self, bins: Bins, cuts: list[np.ndarray]) -> np.ndarray:
        """The same from the bins."""
        last = np.array([np.searchsorted(cuts[f], c) if f >= 0 else 0 for f, c in zip(self.feature, self.cut)])
        at = np.zeros(bins.n, np.int32)
        moving = np.flatnonzero(self.feature[at] >= 0)
        while len(moving):
            node = at[moving]
            node = self.left[node] + (bins.of(moving, self.feature[node]) > last[node])
            at[moving] = node
            moving = moving[self.feature[node] >= 0]
        return at


class Bins:
    """The bins of all features, rows by features (``by_row``) or features by rows."""

    def __init__(self, table: np.ndarray, by_row: bool):
        self.table, self.by_row = table, by_row
        self.n, self.width = table.shape if by_row else table.shape[::-1]

    def column(self, feature: int) -> np.ndarray:
        return self.table[:, feature] if self.by_row else self.table[feature]

    def of(self, rows, features) -> np.ndarray:
        return self.table[rows, features] if self.by_row else self.table[features, rows]


def best_splits(bins, rows, node, n_nodes, weight, y, subsets, min_leaf, total, sums):
    """The best (feature, last bin of the left side, gain) of each node; gain is the fall of the
    squared error, summed over the rows, and 0 where nothing splits. ``subsets`` is (nodes, features tried)."""
    flat, first = bins.table.reshape(-1), node * BINS
    base, step = (rows * bins.width, 1) if bins.by_row else (rows, bins.n)
    wy = weight * y
    best_gain, best_feature, best_bin = np.zeros(n_nodes), np.full(n_nodes, -1), np.zeros(n_nodes, int)
    parent = sums ** 2 / total
    every = np.arange(n_nodes)
    for k in range(subsets.shape[1]):
        tried = subsets[:, k]
        place = first + flat[base + step * tried[node]]
        n_left = np.bincount(place, weight, n_nodes * BINS).reshape(n_nodes, BINS).cumsum(1)[:, :-1]
        s_left = np.bincount(place, wy, n_nodes * BINS).reshape(n_nodes, BINS).cumsum(1)[:, :-1]
        n_right, s_right = total[:, None] - n_left, sums[:, None] - s_left
        fits = (n_left >= min_leaf) & (n_right >= min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, s_left * s_left / n_left + s_right * s_right / n_right, -np.inf)
        at = gain.argmax(1)
        found = gain[every, at] - parent
        better = found > best_gain
        best_gain[better], best_feature[better], best_bin[better] = found[better], tried[better], at[better]
    return best_feature, best_bin, best_gain


class Histograms:
    """Splits of a level on fixed columns. Of two children only the smaller is counted; the other is their parent less it."""

    def __init__(self, bins: Bins, columns: np.ndarray, min_leaf: float):
        self.bins, self.columns, self.min_leaf = bins, columns, min_leaf
        self.counts = self.sums = None

    def counted(self, rows, node, n_nodes, w, t):
        shape, unit, wt = (n_nodes, len(self.columns), BINS), bool((w == 1).all()), w * t
        counts, sums, first = np.empty(shape), np.empty(shape), node * BINS
        for k, column in enumerate(self.columns):
            place = first + self.bins.column(column)[rows]
            counts[:, k] = np.bincount(place, None if unit else w, n_nodes * BINS).reshape(n_nodes, BINS)
            sums[:, k] = np.bincount(place, wt, n_nodes * BINS).reshape(n_nodes, BINS)
        return counts, sums

    def best(self, rows, node, n_nodes, w, t, total, sums, parents):
        if self.counts is None:
            self.counts, self.sums = self.counted(rows, node, n_nodes, w, t)
        else:  # children 2j and 2j + 1 of the parent number parents[j]
            size = np.bincount(node, minlength=n_nodes).reshape(-1, 2)
            smaller = 2 * np.arange(n_nodes // 2) + size.argmin(1)
            place = np.full(n_nodes, -1)
            place[smaller] = np.arange(n_nodes // 2)
            own = place[node] >= 0
            c, s = self.counted(rows[own], place[node[own]], n_nodes // 2, w[own], t[own])
            counts, both = np.empty((n_nodes, *c.shape[1:])), np.empty((n_nodes, *c.shape[1:]))
            counts[smaller], both[smaller] = c, s
            counts[smaller ^ 1], both[smaller ^ 1] = self.counts[parents] - c, self.sums[parents] - s
            self.counts, self.sums = counts, both
        n_left, s_left = self.counts.cumsum(2)[:, :, :-1], self.sums.cumsum(2)[:, :, :-1]
        n_right, s_right = total[:, None, None] - n_left, sums[:, None, None] - s_left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((n_left >= self.min_leaf) & (n_right >= self.min_leaf),
                            s_left * s_left / n_left + s_right * s_right / n_right, -np.inf).reshape(n_nodes, -1)
        at = gain.argmax(1)
        found = gain[np.arange(n_nodes), at] - sums ** 2 / total
        return np.where(found > 0, self.columns[at // (BINS - 1)], -1), at % (BINS - 1), found


def grow(bins: Bins, y: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, *,
         max_depth: int, min_leaf: float = 1, min_split: float = 2, tried: int | None = None,
         columns: np.ndarray | None = None, min_gain: float = 0.0) -> Tree:
    """A tree on the rows of positive weight.

    ``tried`` features are drawn anew for each node; else all ``columns`` are tried. ``min_gain`` is the
    least fall of the variance of a node.
    """
    columns = np.arange(bins.width) if columns is None else columns
    whole = Histograms(bins, columns, min_leaf) if tried is None or tried >= len(columns) else None
    rows = np.flatnonzero(weight > 0)
    node, n_nodes, seen, parts, split = np.zeros(len(rows), np.int64), 1, 1, [], np.zeros(1, int)
    for depth in range(max_depth + 1):
        w, t = weight[rows], y[rows]
        total, sums = np.bincount(node, w, n_nodes), np.bincount(node, w * t, n_nodes)
        feature, last, gain = np.full(n_nodes, -1), np.zeros(n_nodes, int), np.zeros(n_nodes)
        if depth < max_depth and whole is not None and n_nodes <= SUBTRACTED:
            feature, last, gain = whole.best(rows, node, n_nodes, w, t, total, sums, split)
        elif depth < max_depth:
            ends = np.searchsorted(node, np.arange(0, n_nodes + NODES_AT_ONCE, NODES_AT_ONCE))
            for c, lo in enumerate(range(0, n_nodes, NODES_AT_ONCE)):
                hi, own = min(lo + NODES_AT_ONCE, n_nodes), slice(ends[c], ends[c + 1])
                subsets = np.broadcast_to(columns, (hi - lo, len(columns))) if whole is not None else columns[
                    rng.random((hi - lo, len(columns)), np.float32).argpartition(tried, 1)[:, :tried]]
                feature[lo:hi], last[lo:hi], gain[lo:hi] = best_splits(
                    bins, rows[own], node[own] - lo, hi - lo, w[own], t[own], subsets, min_leaf, total[lo:hi], sums[lo:hi])
        least = np.maximum(min_gain, 1e-12) * total
        feature = np.where((total >= min_split) & (gain >= least), feature, -1).astype(np.int16)
        split = np.flatnonzero(feature >= 0)
        cut, left, place = np.zeros(n_nodes), np.zeros(n_nodes, np.int32), np.zeros(n_nodes, np.int64)
        cut[split] = [cuts[f][b] for f, b in zip(feature[split], last[split])]
        place[split] = 2 * np.arange(len(split))
        left[split] = seen + place[split]
        parts.append((feature, cut, left, sums / total, np.where(feature >= 0, gain, 0)))
        if not len(split):
            break
        stays = feature[node] >= 0
        rows, node = rows[stays], node[stays]
        node = place[node] + (bins.of(rows, feature[node]) > last[node])
        n_nodes = 2 * len(split)
        seen += n_nodes
        if (whole is None or n_nodes > SUBTRACTED) and depth + 1 < max_depth:  # the nodes of a chunk side by side
            order = np.argsort(node, kind="stable")
            rows, node = rows[order], node[order]
    return Tree(*(np.concatenate(p) for p in zip(*parts)))


# ------------------------------------------------------------------ shared folder
def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def column_of(path: str, *names: str) -> list[np.ndarray]:
    where, at = opened(path)
    table = ds.dataset(at, filesystem=where, format="parquet").to_table(columns=list(names))
    return [table[c].to_numpy() for c in names]


def per_task(spark: SparkSession, n: int, made, schema: str) -> DataFrame:
    """``made(task number)`` gives the record batches of each of ``n`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                yield from made(task)

    return spark.range(0, n, 1, n).mapInArrow(run, schema)


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/driftline/{spark.sparkContext.applicationId}/grown/{name}-{uuid.uuid4().hex[:12]}"


BINNED = "feature int, mean double, cuts binary, bins binary"


def binned(rows: DataFrame, features, targets) -> str:
    """Writes the rows as bins of each feature, and returns where they lie.

    Cuts are exact quantiles of the training rows. Rows are put in the order of a hash of their key, so
    they do not depend on the tasks that wrote them.
    """
    spark, base = rows.sparkSession, folder(rows.sparkSession, "rows")
    keys = [c for c in ("SID", "ISO_TIME") if c in rows.columns] or [*features]
    rows.select(row_hash(keys, K.SEED).alias("key"), (F.col("split") == "train").alias("train"),
                *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(targets)],
                *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).write.parquet(f"{base}/numbers")
    names, n_features = tuple(features), len(features)
    tasks = min(n_features, spark.sparkContext.defaultParallelism)

    def made(task):
        order, train, *_ = ordered(base)
        for i in range(task, n_features, tasks):
            x, = column_of(f"{base}/numbers", f"x{i}")
            if np.isnan(x).any():
                raise ValueError(f"missing values in {names[i]}")
            x = x[order]
            cuts = np.unique(np.quantile(x[train], np.arange(1, BINS) / BINS, method="lower"))
            bins = np.searchsorted(cuts, x).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array([i], pa.int32()), "mean": [float(x[train].mean())],
                "cuts": pa.array([cuts.tobytes()], pa.binary()), "bins": pa.array([bins.tobytes()], pa.binary())})

    per_task(spark, tasks, made, BINNED).write.parquet(f"{base}/bins")
    return base


def means(spark: SparkSession, base: str, features) -> dict[str, float]:
    """The training mean of each feature."""
    found = spark.read.parquet(f"{base}/bins").select("feature", "mean").orderBy("feature").collect()  # a row a feature
    return {c: r["mean"] for c, r in zip(features, found)}


def ordered(base: str) -> tuple[np.ndarray, ...]:
    """The order of the rows, and which are training rows, and both targets in that order."""
    key, train, y0, y1 = column_of(f"{base}/numbers", "key", "train", "y0", "y1")
    order = np.lexsort((y1, y0, key))
    return order, train[order], y0[order], y1[order]


def loaded(base: str, n_features: int, by_row: bool) -> tuple[Bins, list[np.ndarray]]:
    """Bins and cuts, read a feature at a time."""
    where, at = opened(f"{base}/bins")
    out, cuts = None, [None] * n_features
    for batch in ds.dataset(at, filesystem=where, format="parquet").to_batches(batch_size=1):
        for i, c, b in zip(*(batch.column(k) for k in ("feature", "cuts", "bins"))):
            own = np.frombuffer(b.as_buffer(), np.uint8)
            if out is None:
                out = Bins(np.empty((len(own), n_features) if by_row else (n_features, len(own)), np.uint8), by_row)
            out.column(i.as_py())[:], cuts[i.as_py()] = own, np.frombuffer(c.as_py(), np.float64)
    return out, cuts


# ------------------------------------------------------------------------ fits
TREES = "output int, tree int, feature binary, cut binary, left binary, value binary, importance array<double>"
ROUNDS = f"{TREES}, loss double, state binary"
KINDS = {"feature": np.int16, "cut": np.float64, "left": np.int32, "value": np.float64}


def tree_row(output: int, number: int, tree: Tree, n_features: int, **more) -> pa.RecordBatch:
    gains = np.bincount(tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0], n_features)
    row = {"output": output, "tree": number, "importance": list(gains / (gains.sum() or 1.0)), **more,
           **{k: getattr(tree, k).astype(kind).tobytes() for k, kind in KINDS.items()}}
    kinds = {"output": pa.int32(), "tree": pa.int32(), "importance": pa.list_(pa.float64()), "loss": pa.float64()}
    names = [c.split()[0] for c in (ROUNDS if more else TREES).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.binary())) for c in names], names=names)


def drawn_columns(share, n_features: int) -> int:
    """How many features a subset has, counted as MLlib does."""
    if share in ("sqrt", "log2"):
        return max(1, math.ceil(math.sqrt(n_features) if share == "sqrt" else math.log2(n_features)))
    if share == "auto":
        return max(1, math.ceil(n_features / 3))
    return n_features if share == "all" else min(n_features, max(1, math.ceil(float(share) * n_features)))


def fit_forest(spark: SparkSession, base: str, n_features: int, params: dict, seed: int) -> list[GrownTrees]:
    """Two forests on ``binned`` training rows: trees of both are dealt out to the tasks."""
    n_trees, depth = int(params["n_estimators"]), int(params["max_depth"])
    leaf, least = int(params.get("min_samples_leaf", 1)), int(params.get("min_samples_split", 2))
    tried = drawn_columns(params.get("max_features", "sqrt"), n_features)
    tasks = min(2 * n_trees, 3 * spark.sparkContext.defaultParallelism)

    def made(task):
        _, _, *targets = ordered(base)
        bins, cuts = loaded(base, n_features, by_row=tried < n_features)
        for unit in range(task, 2 * n_trees, tasks):
            output, number = unit % 2, unit // 2
            rng = np.random.default_rng([seed, output, number])
            weight = rng.poisson(1.0, bins.n).astype(float)
            tree = grow(bins, targets[output], weight if weight.any() else weight + 1, cuts, rng, max_depth=depth,
                        min_leaf=leaf, min_split=least, tried=tried)
            yield tree_row(output, number, replace(tree, value=tree.value / n_trees), n_features)

    path = folder(spark, "forest")
    per_task(spark, tasks, made, TREES).write.partitionBy("output").parquet(path)
    return [GrownTrees(f"{path}/output={i}", n_trees, n_features) for i in range(2)]


def fit_boosted(spark: SparkSession, base: str, n_features: int, params: dict, seed: int,
                stop) -> tuple[list[GrownTrees], int | None]:
    """Two boosted ensembles on ``binned`` rows, a task each, and the best round.

    The first tree stands for the target, later ones for twice the residual times the learning rate, as in
    MLlib. Leaf values under penalties are those of all training rows. ``stop(losses)`` gives the best
    round of the losses so far and whether more rounds could change it; without it all rounds count.
    """
    n_rounds, depth, rate = int(params["n_estimators"]), int(params["max_depth"]), float(params.get("learning_rate", 0.1))
    share, leaf = float(params.get("subsample", 1.0)), max(1, int(params.get("min_child_weight", 1)))
    alpha, penalty = float(params.get("reg_alpha", 0)), float(params.get("reg_lambda", 0))
    gamma, drawn = float(params.get("gamma", 0.0)), drawn_columns(params.get("colsample_bytree", 1.0), n_features)
    path, parts, losses, best = folder(spark, "boosted"), [], [[], []], None

    def made(output, begin, before):
        _, train, *targets = ordered(base)
        y = targets[output]
        bins, cuts = loaded(base, n_features, by_row=False)
        known = np.zeros(len(y))
        if before:
            known = np.frombuffer(state_of(f"{before}/output={output}", begin - 1), np.float64).copy()
        end = min(begin + ROUNDS_A_JOB, n_rounds)
        for t in range(begin, end):
            rng, left = np.random.default_rng([seed, output, t]), y - known
            weight = (train & (rng.random(len(y)) < share)).astype(float)
            weight = weight if weight.any() else train.astype(float)
            tree = grow(bins, left, weight, cuts, rng, max_depth=depth, min_leaf=leaf, min_gain=gamma,
                        columns=np.sort(rng.permutation(n_features)[:drawn]))
            at = tree.binned_leaves(bins, cuts)
            if alpha or penalty:
                total, n = (np.bincount(at[train], v, len(tree.value)) for v in (left[train], None))
                tree.value = np.sign(total) * np.maximum(np.abs(total) - alpha, 0) / np.maximum(n + penalty, 1e-300)
            tree.value = tree.value * (2 * rate if t else 1)
            known += tree.value[at]
            loss = float(((y - known)[~train] ** 2).mean()) if not train.all() else math.nan
            yield tree_row(output, t, tree, n_features, loss=loss, state=known.tobytes() if t == end - 1 else None)

    for begin in range(0, n_rounds, ROUNDS_A_JOB):
        part, before = f"{path}/part={len(parts)}", parts[-1] if parts else None
        per_task(spark, 2, lambda task, b=begin, p=before: made(task, b, p), ROUNDS).write.partitionBy("output").parquet(part)
        parts.append(part)
        for r in spark.read.parquet(part).select("output", "tree", "loss").orderBy("output", "tree").collect():
            losses[r["output"]].append(r["loss"])
        if stop is not None:
            best, ended = stop([(a + b) / 2 for a, b in zip(*losses)])
            if ended:
                break
    n_trees = len(losses[0]) if best is None else best + 1
    rounds_of(spark, parts).where(F.col("tree") < n_trees) \
        .drop("loss", "state").write.partitionBy("output").parquet(f"{path}/kept")
    return [GrownTrees(f"{path}/kept/output={i}", n_trees, n_features) for i in range(2)], best


def rounds_of(spark: SparkSession, parts: list[str]) -> DataFrame:
    out = spark.read.parquet(parts[0])
    for part in parts[1:]:
        out = out.unionByName(spark.read.parquet(part))
    return out


def state_of(path: str, number: int) -> bytes:
    where, at = opened(path)
    table = ds.dataset(at, filesystem=where, format="parquet").to_table(columns=["state"], filter=ds.field("tree") == number)
    return table["state"][0].as_py()


# ----------------------------------------------------------------------- models
@dataclass(frozen=True)
class GrownTrees:
    """One output of a fit, applied to a vector column like the fitted regressors of MLlib."""

    path: str
    getNumTrees: int
    n_features: int
    features_col: str = "features"
    prediction_col: str = "prediction"

    def copy(self) -> GrownTrees:
        return self

    def setFeaturesCol(self, name: str) -> GrownTrees:
        return replace(self, features_col=name)

    def setPredictionCol(self, name: str) -> GrownTrees:
        return replace(self, prediction_col=name)

    @property
    def featureImportances(self) -> DenseVector:
        """Mean over the trees of their gains by feature, each tree's adding up to 1; normed."""
        spark = SparkSession.getActiveSession()
        rows = spark.read.parquet(self.path).select(F.posexplode("importance")).groupBy("pos").agg(
            F.sum("col").alias("s")).collect()  # a row a feature
        out = np.zeros(self.n_features)
        for r in rows:
            out[r["pos"]] = r["s"]
        return DenseVector(out / (out.sum() or 1.0))

    def transform(self, df: DataFrame) -> DataFrame:
        path = self.path

        def predicted(held: list[pa.Array]) -> Iterator[pa.Array]:
            x = np.concatenate([a.flatten().to_numpy().reshape(len(a), -1) for a in held])
            made = np.zeros(len(x))
            for tree in trees(path):
                made += tree.value[tree.leaves(x)]
            ends = np.cumsum([len(a) for a in held])
            yield from (pa.array(part) for part in np.split(made, ends[:-1]))

        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += len(batch)
                if n >= HELD_ROWS:
                    yield from predicted(held)
                    held, n = [], 0
            if held:
                yield from predicted(held)

        predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return df.withColumn(self.prediction_col, F.arrow_udf(predict, "double")(vector_to_array(self.features_col)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.read.parquet(self.path).write.parquet(path)

    @classmethod
    def load(cls, path: str) -> GrownTrees:
        spark = SparkSession.getActiveSession()
        r = spark.read.parquet(path).agg(F.count("*").alias("n"), F.max(F.size("importance")).alias("width")).first()
        return cls(path, r["n"], r["width"])


def trees(path: str) -> Iterator[Tree]:
    """The stored trees in their order, one after the other."""
    where, at = opened(path)
    found = ds.dataset(at, filesystem=where, format="parquet")
    for batch in found.to_batches(columns=list(KINDS), batch_size=1, batch_readahead=1, fragment_readahead=1):
        for row in batch.to_pylist():
            yield Tree(*(np.frombuffer(row[k], kind) for k, kind in KINDS.items()), np.zeros(0))
