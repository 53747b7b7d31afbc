"""Least squares by tall-skinny QR.

Every task reduces its rows to the triangular factor R of [1 | X | Y], a matrix as wide
as the features, however many rows it reads; factors are stacked and reduced again in a
tree. Working on the rows themselves, not on X'X, keeps the condition number as it is. The
last factor (one per group) is solved on the driver: its first row holds the means, the
rest is the factor of the centred columns. Columns are scaled to length 1, directions whose
singular value is negligible are left out, and among all solutions the one of least norm is
taken, so features that depend on each other share a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import cut_lineage

#: Factors that one task stacks, and as many as the driver gets per group at most.
FAN_IN = 32
#: Share of the largest singular value, and of a column's length, that counts as zero.
NEGLIGIBLE = 1e-11


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    """R of stacked blocks."""
    return np.linalg.qr(np.vstack(blocks), mode="r")


def factors(rows: DataFrame, features, targets, group: str) -> DataFrame:
    """(group, node, n, r): a factor per task and group, merged until at most ``FAN_IN`` are left per group.

    Rows with a missing feature or target are left out.
    """
    columns = [*features, *targets]
    # one array: a column each would multiply the planner's constraints on complete rows
    used = rows.where(F.col(group).isNotNull()).select(
        F.col(group).cast("int").alias("grp"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    schema = "grp int, node long, n long, r array<double>"

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, found, counts = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False)  # missing numbers become NaN
            block = np.column_stack([np.ones(batch.num_rows), values.reshape(-1, len(columns))])
            complete = np.isfinite(block).all(1)
            groups, block = batch.column("grp").to_numpy(zero_copy_only=False)[complete], block[complete]
            for g in np.unique(groups).tolist():
                part = block[groups == g]
                found[g] = triangle([found[g], part] if g in found else [part])
                counts[g] = counts.get(g, 0) + len(part)
        yield factor_batch([(g, node, counts[g], r) for g, r in found.items()])

    def merge(table: pa.Table) -> pa.Table:
        blocks = [np.array(r).reshape(-1, len(columns) + 1) for r in table.column("r").to_pylist()]
        made = (table.column("grp")[0].as_py(), table.column("node")[0].as_py(),
                sum(table.column("n").to_pylist()), triangle(blocks))
        return pa.Table.from_batches([factor_batch([made])])

    out = cut_lineage(used.mapInArrow(reduce_rows, schema))
    while (out.groupBy("grp").count().agg(F.max("count")).first()[0] or 0) > FAN_IN:
        out = cut_lineage(out.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("grp", "node").applyInArrow(
            merge, schema))
    return out


def factor_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3].ravel() for r in rows], pa.list_(pa.float64()))],
        names=["grp", "node", "n", "r"])


@dataclass(frozen=True)
class Solution:
    """Weights (features x targets), intercepts, rows and rank of one fit."""

    weights: np.ndarray
    intercepts: np.ndarray
    n: int
    rank: int


def solve(r: np.ndarray, n: int, n_targets: int) -> Solution:
    """The least-norm solution from the factor of [1 | X | Y]."""
    width = r.shape[1] - n_targets
    full = np.zeros((max(r.shape), r.shape[1]))
    full[:len(r)] = r
    means, inner, outer = full[0] / full[0, 0], full[1:, 1:width], full[1:, width:]
    length = np.linalg.norm(inner, axis=0)
    raw = np.linalg.norm(full[:, 1:width], axis=0)
    varies = length > NEGLIGIBLE * np.where(raw > 0, raw, 1)
    scale = np.where(varies, length, 1)
    u, s, vt = np.linalg.svd(np.where(varies, inner / scale, 0), full_matrices=False)
    rank = int((s > NEGLIGIBLE * s[0]).sum()) if len(s) and s[0] > 0 else 0
    weights = (vt[:rank].T @ ((u[:, :rank].T @ outer) / s[:rank, None])) / scale[:, None]
    return Solution(weights, means[width:] - means[1:width] @ weights, n, rank)


def fit_groups(rows: DataFrame, features, targets, group: str) -> dict[int, Solution]:
    """A fit for each value of the whole-number column ``group`` (a lead time, say) from one scan."""
    parts: dict[int, list] = {}
    width = len(features) + len(targets) + 1
    for row in factors(rows, features, targets, group).toArrow().to_pylist():  # at most FAN_IN a group
        parts.setdefault(row["grp"], []).append((row["node"], row["n"], np.array(row["r"]).reshape(-1, width)))
    return {g: solve(triangle([r for _, _, r in sorted(p, key=lambda x: x[0])]), sum(n for _, n, _ in p), len(targets))
            for g, p in parts.items()}


def dot(values: Column, weights: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


@dataclass(frozen=True)
class LinearFit:
    """One output of a fit, applied to a vector column like the fitted regressors of MLlib."""

    weights: tuple[float, ...]
    intercept: float
    features_col: str = "features"
    prediction_col: str = "prediction"

    def copy(self) -> LinearFit:
        return self

    def setFeaturesCol(self, name: str) -> LinearFit:
        return LinearFit(self.weights, self.intercept, name, self.prediction_col)

    def setPredictionCol(self, name: str) -> LinearFit:
        return LinearFit(self.weights, self.intercept, self.features_col, name)

    def transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*map(F.lit, self.weights))
        return df.withColumn(self.prediction_col, dot(vector_to_array(self.features_col), weights) + self.intercept)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(list(self.weights), self.intercept)], "weights array<double>, intercept double") \
             .coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, path: str) -> LinearFit:
        row = SparkSession.getActiveSession().read.parquet(path).first()
        return cls(tuple(row["weights"]), row["intercept"])
