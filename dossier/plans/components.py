"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.plans.durable import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is its smallest node.

    Each round links every node to the smallest node it knows. The number of rounds grows with the logarithm
    of the component size, and a node's neighbours are only ever aggregated, never gathered.
    """
    links = durable(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    while True:
        large = _star(links, larger_only=True)
        small = durable(_star(large, larger_only=False))
        before, after = _signature(links), _signature(small)
        links = small
        if before == after:
            break
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    if larger_only:
        sides = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = sides.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    joined = sides.join(smallest, "a")
    if larger_only:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        own = smallest.select("a", F.col("_m").alias("b"))
        moved = joined.where(F.col("b") <= F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(own)
    return moved.where(F.col("a") != F.col("b")).distinct()


def _signature(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return int(row["n"]), int(row["s"] or 0)
