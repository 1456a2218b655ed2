"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: So long the driver's cleaner has between two collections; what the first frees may hold what the second does.
PAUSE_S = 0.2


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session; below the warehouse on local masters that name none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    else:
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it from there afterwards."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Each action inside deletes its shuffle files when it ends, not when the driver happens to collect its garbage.

    For steps that each end in ``durable``: what an action shuffled is not read again by the next one. An older Spark ignores the name.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def forget(spark: SparkSession) -> None:
    """Delete checkpoints, shuffles and broadcasts that no DataFrame refers to any more.

    A driver with small plans seldom collects its garbage, so those of finished steps would add up on all disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(PAUSE_S)
    spark.sparkContext._jvm.System.gc()
