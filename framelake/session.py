"""Session helpers: settings the library relies on and the shared folder for derived files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; sizing (shuffle partitions, memory) stays with the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: Rows of heavy work that a task takes at most, on average.
TASK_ROWS = 50_000


def use_all_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan by ``key`` over the cores, and over as many tasks as keep each at some ``TASK_ROWS`` rows.

    For work that is heavy per row, where splits by size hold too many rows. ``df`` is counted, which costs a
    parquet scan nothing. Scans that already have as many splits pass unchanged.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a scratch folder only in a local session without one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
