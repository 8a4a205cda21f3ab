"""Bounds of what travels to Python workers at once."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes per Arrow batch handed to Python; texts can be long, so batches stay small.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of long texts can hold in a Python worker, and let workers find this package.

    A lower bound that the session has already stays. The path serves workers
    that see the driver's files; clusters that ship the package with the job do not need it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    env.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    # workers outlive their tasks: what a task frees goes back to the system, not to a pool
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "1")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", "1000000")
    env.setdefault("MALLOC_MMAP_THRESHOLD_", "1000000")
