"""Session helpers: local session for tests, durable lineage cuts, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Largest group that one window task may hold. Beyond it the range-sorted path is used.
WIDE_GROUP_ROWS = 5_000_000

# Rows of one task of an aggregate that keeps about one row for each row it reads.
TASK_ROWS = 500_000

_counts: dict[tuple[str, str], int] = {}


def local_session(cores: str = "8", app: str = "crosswind", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's checkpoint folder.

    Only a local master may fall back to a fresh temporary folder, because there
    driver and executors share one machine.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, made)
    return made


def durable(df: DataFrame) -> DataFrame:
    """Compute once: write a table into the shared folder and read it back.

    This cuts lineage like a checkpoint, survives the loss of executors, and later readers
    get column pruning, filters and known sizes.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal rows out by key to as many tasks as their number asks for, so that the memory of one does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new table location inside the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def table_rows(spark: SparkSession, path: str) -> int:
    """Row count of a parquet table (answered from footers), remembered per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _counts:
        _counts[key] = spark.read.parquet(path).count()
    return _counts[key]
