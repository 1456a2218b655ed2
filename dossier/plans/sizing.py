"""Size checks that decide between a broadcast and a shuffle, and that find hot groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.plans.durable import durable

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_GROUP_ROWS = 1_000_000
TASK_ROWS = 200_000
#: Up to so many partitions a shuffle writes without holding rows back in memory.
MOST_PARTS = 200


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the serialised size of ``df``, computed as one aggregate."""
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16).alias("b")).first()
    return int(row["b"] or 0)


def checked_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the measured size allows it; otherwise leave the join to shuffle.

    The side is written once; the measurement and the join read what was written instead of computing it again.
    """
    written = durable(df)
    return F.broadcast(written) if measured_bytes(written) <= max_bytes else written


def hot_groups(df: DataFrame, keys: Sequence[str], bound: int = HOT_GROUP_ROWS) -> DataFrame:
    """Keys with more than ``bound`` rows. There are at most rows / bound of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > bound).select(*keys)


def split_hot(
    df: DataFrame, keys: Sequence[str], bound: int = HOT_GROUP_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None when there is no hot group)."""
    hot = hot_groups(df, keys, bound)
    if hot.isEmpty():
        return df, None
    hot = checked_broadcast(hot)
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input of fewer splits than cores over all cores. Larger inputs have enough splits and are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_by(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Partition by keys for work that costs more than its bytes suggest, into ``least`` partitions or more.

    The number of partitions is given, because adaptive execution would merge small partitions of long work.
    """
    spark = df.sparkSession
    parts = max(least, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions inside: of wide rows, Spark's own number of rows fills a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    # none or less stands for no bound
    spark.conf.set(name, str(min(rows, int(before)) if before and int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def parts_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """So many partitions that one has about ``rows`` rows; MOST_PARTS, or what shuffles have, are the most."""
    most = max(MOST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(most, -(-df.count() // rows)))
