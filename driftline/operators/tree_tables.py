"""Changes to fitted ensembles through their stored node tables.

A saved tree model of MLlib is a table with a row per node (tree, number in pre-order,
prediction, rows, children, split). Cutting an ensemble to its first trees, giving its leaves
other values and collapsing splits of few rows are changes of that table; the changed
table is loaded again, so nothing is fitted twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/driftline/{spark.sparkContext.applicationId}/trees/{name}-{uuid.uuid4().hex[:12]}"


def saved(spark: SparkSession, model) -> str:
    """Where the model's node table lies; written at the first call, or when it was rewritten."""
    if not hasattr(model, "_saved"):
        path = folder(spark, "saved")
        model.write().save(path)
        model._saved = path
    return model._saved


def rewritten(spark: SparkSession, model, change: Callable[[DataFrame], DataFrame], n_trees: int | None = None):
    """The model with a changed node table (treeID, nodeData), and only its first ``n_trees`` trees."""
    old, new = saved(spark, model), folder(spark, "new")
    trees = spark.read.parquet(f"{old}/treesMetadata")
    meta = json.loads(spark.read.text(f"{old}/metadata").first()["value"])
    nodes = spark.read.parquet(f"{old}/data")
    if n_trees is not None:
        trees = trees.where(F.col(trees.columns[0]) < n_trees)
        nodes = nodes.where(F.col("treeID") < n_trees)
        meta["numTrees"] = n_trees
    change(nodes).write.parquet(f"{new}/data")
    trees.write.parquet(f"{new}/treesMetadata")
    spark.range(0, 1, 1, 1).select(F.lit(json.dumps(meta)).alias("value")).write.text(f"{new}/metadata")
    made = type(model).load(new)
    made._saved = new
    return made


def first_trees(spark: SparkSession, model, n_trees: int):
    """The ensemble cut to its first trees."""
    return rewritten(spark, model, lambda nodes: nodes, n_trees) if n_trees < model.getNumTrees else model


def collapsed(spark: SparkSession, model, min_samples_split: int):
    """Forest whose nodes are split only where at least so many rows meet.

    A node's split does not depend on whether its children are split, so making leaves of
    the nodes that hold too few rows gives the trees that growing under the limit gives.
    """

    def shrink(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        nodes = {r["nodeData"]["id"]: r["nodeData"] for r in rows}
        out, stack = [], [(0, None, None)]  # (old number, new number of the parent, side)
        while stack:
            old, parent, side = stack.pop()
            node = dict(nodes[old], id=len(out))
            if parent is not None:
                out[parent][side] = node["id"]
            if node["leftChild"] >= 0 and node["rawCount"] < min_samples_split:
                node |= {"leftChild": -1, "rightChild": -1, "gain": -1.0,
                         "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
            out.append(node)
            if node["leftChild"] >= 0:  # pre-order: the left side comes off the stack first
                stack += [(node["rightChild"], node["id"], "rightChild"), (node["leftChild"], node["id"], "leftChild")]
        return pa.Table.from_pylist([{"treeID": rows[0]["treeID"], "nodeData": n} for n in out], schema=table.schema)

    return rewritten(spark, model, lambda nodes: nodes.groupBy("treeID").applyInArrow(shrink, nodes.schema))


def leaf_values(spark: SparkSession, model) -> list[np.ndarray]:
    """The values of each tree's leaves, from left to right."""
    rows = spark.read.parquet(f"{saved(spark, model)}/data").where("nodeData.leftChild < 0").select(
        "treeID", "nodeData.id", "nodeData.prediction").toArrow()
    tree, number, value = (np.asarray(c) for c in rows.columns)
    order = np.lexsort((number, tree))
    return np.split(value[order], np.flatnonzero(np.diff(tree[order])) + 1)


def with_leaf_values(spark: SparkSession, model, values: list[np.ndarray]):
    """The ensemble with other values in its leaves, given per tree from left to right."""
    sizes = [len(own) for own in values]
    table = spark.createDataFrame(pa.table({  # handed over as Arrow: needs no Python worker
        "t": pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()),
        "k": pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32()),
        "value": pa.array(np.concatenate(values), pa.float64())}))

    def change(nodes: DataFrame) -> DataFrame:
        from pyspark.sql import Window
        leaf = F.row_number().over(Window.partitionBy("treeID").orderBy("nodeData.id")) - 1  # the leaves of one tree
        numbered = nodes.where("nodeData.leftChild < 0").withColumn("leaf", leaf).join(
            table, (F.col("treeID") == F.col("t")) & (F.col("leaf") == F.col("k"))).select(
            "treeID", F.col("nodeData").withField("prediction", F.col("value")).alias("nodeData"))
        return numbered.unionByName(nodes.where("nodeData.leftChild >= 0"))

    return rewritten(spark, model, change)


def reached_leaves(spark: SparkSession, model, rows: DataFrame, target: str) -> DataFrame:
    """(y, leaves): which leaf of each tree a row reaches, written for the passes over it."""
    path = folder(spark, "leaves")
    model.copy().setLeafCol("_leaf").transform(rows).select(
        F.col(target).cast("double").alias("y"), vector_to_array("_leaf").cast("array<int>").alias("leaves")).write.parquet(path)
    return spark.read.parquet(path)


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield np.asarray(batch.column("y")), batch.column("leaves").flatten().to_numpy().reshape(batch.num_rows, -1)


def staged_losses(leaves: DataFrame, values: list[np.ndarray], weights: list[float]) -> list[float]:
    """Mean squared error after each round, in one pass: tasks sum the errors of all rounds."""

    def sums(batches):
        total, n = np.zeros(len(values)), 0
        for y, at in matrices(batches):
            made = np.cumsum([w * v[at[:, t]] for t, (v, w) in enumerate(zip(values, weights))], axis=0)
            total += ((made - y) ** 2).sum(1)
            n += len(y)
        yield pa.RecordBatch.from_pydict({"t": np.arange(len(values)), "s": total, "n": np.full(len(values), n)})

    rows = leaves.mapInArrow(sums, "t long, s double, n long").groupBy("t").agg(
        (F.sum("s") / F.sum("n")).alias("loss")).orderBy("t").collect()  # one row a round
    return [r["loss"] for r in rows]


#: Leaves of an ensemble up to which one pass counts the rows that pairs of leaves share (8 bytes a pair).
MAX_SHARED = 2048


def shared_rows(leaves: DataFrame, shapes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``y`` per leaf, and the rows that reach both of two leaves, over all leaves of the ensemble.

    One pass: a task adds up a matrix as large as the leaves, whatever its rows; the rows of
    the matrices are added by leaf. A row is counted once a pair of trees, not once a pair of leaves.
    """
    starts = np.cumsum([0, *shapes])
    size = int(starts[-1])

    def sums(batches):
        y_sum, both = np.zeros(size), np.zeros((size, size))
        for y, at in matrices(batches):
            for begin in range(0, len(y), 1 << 16):
                of = np.ascontiguousarray(at[begin:begin + (1 << 16)].T, dtype=np.int64)  # leaves by tree
                for t, (first, n) in enumerate(zip(starts, shapes)):
                    y_sum[first:first + n] += np.bincount(of[t], y[begin:begin + (1 << 16)], minlength=n)
                    for u in range(t + 1):
                        pairs = np.bincount(of[t] * shapes[u] + of[u], minlength=n * shapes[u])
                        both[first:first + n, starts[u]:starts[u] + shapes[u]] += pairs.reshape(n, shapes[u])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size)), pa.array(y_sum), pa.array(list(both), pa.list_(pa.float64()))],
            names=["leaf", "y", "n"])

    made = leaves.mapInArrow(sums, "leaf long, y double, n array<double>").select(
        "leaf", "y", F.posexplode("n").alias("other", "n")).where("n > 0 AND other <= leaf")
    found = made.groupBy("leaf", "other").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toArrow()
    y_sum, both = np.zeros(size), np.zeros((size, size))
    leaf, other = np.asarray(found["leaf"]), np.asarray(found["other"])
    both[leaf, other] = both[other, leaf] = np.asarray(found["n"])
    y_sum[leaf[leaf == other]] = np.asarray(found["y"])[leaf == other]
    return y_sum, both


def penalised_values(leaves: DataFrame, model, shapes: list[int], alpha: float, penalty: float) -> list[np.ndarray]:
    """Leaf values under L1 and L2 penalties for given trees.

    Round by round, a leaf with residual sum S over n rows gets S, moved towards 0 by
    ``alpha``, over n + ``penalty``; the residuals are those that the rounds before leave.
    Trees after the first stand for twice the residual, as they were grown; without
    penalties the values are the ensemble's own.

    What the rounds before take from S are their values times the rows that both leaves share,
    so one pass over the rows serves all rounds. Ensembles of more than ``MAX_SHARED`` leaves,
    whose pairs would not fit, sum the residuals in a pass a round (combined in the tasks).
    """
    weights, values = [float(w) for w in model.treeWeights], []
    starts = np.cumsum([0, *shapes])
    if starts[-1] <= MAX_SHARED:
        y_sum, both = shared_rows(leaves, shapes)
    for t, size in enumerate(shapes):
        if starts[-1] <= MAX_SHARED:
            own = slice(starts[t], starts[t + 1])
            known = np.concatenate([[0.0][:0], *(w * v for w, v in zip(weights, values))])
            total = y_sum[own] - both[own, :starts[t]] @ known
            n = both[own, own].diagonal()
        else:
            total, n = residual_sums(leaves, t, size, weights, values)
        shrunk = np.sign(total) * np.maximum(np.abs(total) - alpha, 0)
        values.append((2 if t else 1) * shrunk / np.maximum(n + penalty, 1e-300))
    return values


def residual_sums(leaves: DataFrame, t: int, size: int, weights: list[float], values: list[np.ndarray]):
    """Sum of the residuals that the first ``t`` trees leave, and rows, by leaf of tree ``t``."""

    def sums(batches, known=list(values)):
        total, n = np.zeros(size), np.zeros(size)
        for y, at in matrices(batches):
            left = y - sum((w * v[at[:, k]] for k, (v, w) in enumerate(zip(known, weights))), np.zeros(len(y)))
            total += np.bincount(at[:, t], left, minlength=size)
            n += np.bincount(at[:, t], minlength=size)
        yield pa.RecordBatch.from_pydict({"leaf": np.arange(size), "s": total, "n": n})

    found = leaves.mapInArrow(sums, "leaf long, s double, n double").groupBy("leaf").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("leaf").toArrow()  # one row a leaf of one tree
    return np.asarray(found["s"]), np.asarray(found["n"])
