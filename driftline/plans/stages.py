"""Stage tables: cleaned observations, features, predictions.

A run hands stages over as written tables, as a nightly job would: one write,
then every later query scans only the columns it needs. The folder is the
shared one named by ``spark.checkpoint.dir``, below the application id, so a
lost executor loses nothing and two applications never meet.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.session import shared_dir

_lock = threading.Lock()
_locks: dict[tuple[str, str], threading.RLock] = {}
_written: dict[tuple[str, str], object] = {}


def building(key: tuple[str, str]) -> threading.RLock:
    """A lock of its own for each table or object: different ones are built at the same time."""
    with _lock:
        return _locks.setdefault(key, threading.RLock())


def stage_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    source = hashlib.md5(str(sf_dir).encode()).hexdigest()[:10]
    return f"{shared_dir(spark)}/driftline/{spark.sparkContext.applicationId}/{source}/{name}"


def stage(spark: SparkSession, sf_dir: str, name: str,
          build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Read a stage table; write it first if this application has not."""
    path = stage_path(spark, sf_dir, name)
    key = (path, "table")
    with building(key):
        if key not in _written:
            build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
            _written[key] = True
    return spark.read.parquet(path)


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """A driver-side object (a fitted model) built once per application and input."""
    key = (stage_path(spark, sf_dir, name), "object")
    with building(key):
        if key not in _written:
            _written[key] = build()
        return _written[key]
