"""Helpers shared by the operators: packed rows and tables written to the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import shared_dir

WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, keep: list[str] | None = None, **columns: str) -> DataFrame:
    """The given columns under the given names, next to ``row`` with all input columns or those to keep.

    Input columns stay inside ``row``, so none can clash with an output column.
    """
    row = F.struct("*") if keep is None else F.struct(*[F.col(f"`{c}`") for c in keep])
    return df.select(row.alias("row"), *[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The input columns alone."""
    return df.select("row.*")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of this application."""
    return (f"{shared_dir(spark)}/driftline/{spark.sparkContext.applicationId}"
            f"/llm/{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def release() -> None:
    """Give memory that a Python worker no longer uses back to the machine; workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another allocator than glibc's
