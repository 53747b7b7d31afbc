"""Session helpers: where shared files go, and how lineage is cut."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "driftline",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # wide projections: smaller methods that the JVM can compile
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_choosing = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own; a cluster session without it is an error, since a machine-local
    folder would lose files with the executor. Threads that ask at once get the same one.
    """
    with _choosing:
        return _shared_dir(spark)


def _shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="driftline-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def tasks_for(spark: SparkSession, n_rows: int, rows_per_task: int, at_once: int = 1) -> int:
    """Tasks of at most about ``rows_per_task`` rows, at least one per core of those that each of
    ``at_once`` jobs that run at the same time has."""
    cores = math.ceil(spark.sparkContext.defaultParallelism / at_once)
    return max(cores, math.ceil(n_rows / rows_per_task))


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for several scans that each read some columns
    or, with ``partition_by``, some partitions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
