"""Governed tables on parquet: scans, appends, upserts, slice replacement and schema evolution.

Parquet has no MERGE or DELETE. Changed tables are computed as DataFrames and written to a folder of their own, so that
no plan overwrites files that it reads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_scan(
    spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None
) -> DataFrame:
    """Columns of a parquet table; the predicate and the column list reach the file reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing nullable columns become NULL."""
    for field in schema.fields:
        if field.name not in df.columns and not field.nullable:
            raise ValueError(f"Column {field.name} is required.")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def append(df: DataFrame, path: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> None:
    """Append rows that conform to the table schema."""
    writer = conform(df, schema).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_new(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` to a folder that must not exist yet and return it."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` replace the rows of ``target`` with equal keys; new keys are added."""
    return target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(source)


def insert_if_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose keys ``target`` lacks: the rows to append."""
    return source.join(target.select(*keys), list(keys), "left_anti").select(*source.columns)


def replace_slice(target: DataFrame, source: DataFrame, slice_: Column) -> DataFrame:
    """Drop the rows of ``target`` inside the slice and add ``source``."""
    return target.where(~F.coalesce(slice_, F.lit(False))).unionByName(source)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that occur in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def evolve_schema(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Add the columns that are missing as typed NULLs."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})
