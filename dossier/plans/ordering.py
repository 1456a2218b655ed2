"""Row numbers inside groups of any size.

A window sorts a whole group in one task, which fails for a group that holds a third of a large table.
Groups above a bound are therefore range-partitioned by their full sort key, numbered inside each
partition, and shifted by the rows that lie before the partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.plans.durable import durable
from dossier.plans.sizing import HOT_GROUP_ROWS, checked_broadcast, split_hot


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    bound: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row in its group. ``order`` must be unique inside a group."""
    ordinary, hot = split_hot(df, keys, bound)
    window = Window.partitionBy(*keys).orderBy(*order)
    result = ordinary.withColumn(name, F.row_number().over(window).cast("long"))
    if hot is None:
        return result
    return result.unionByName(_numbered_in_blocks(hot, keys, order, name))


def _numbered_in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    sort = [F.col(k) for k in keys] + list(order)
    placed = durable(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_block", F.shiftright("_id", 33)).withColumn(
        "_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One row per (group, partition): at most hot groups + partitions, so the broadcast is bounded.
    per_block = placed.groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys, "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        placed.join(checked_broadcast(offsets), [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_pos") - F.col("_first") + 1)
        .drop("_id", "_block", "_pos", "_first", "_before")
    )
