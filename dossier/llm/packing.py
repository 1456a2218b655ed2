"""Sorted integers as short byte strings, and the blocks of documents that exchange them.

Operators that look at every window of every text exchange arrays instead of rows: a block of documents sends each
range of a hash space one row with a packed array, and a range answers each block with one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(values: np.ndarray) -> bytes:
    """Ascending integers below 2^63 as the first value and the differences in the narrowest type that holds them."""
    if not len(values):
        return b""
    values = values.astype(np.int64)
    steps = np.diff(values)
    width = 1
    most = int(steps.max()) if len(steps) else 0
    while width < 8 and most >> (8 * width):
        width *= 2
    return bytes([width]) + values[:1].tobytes() + steps.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.int64)
    steps = np.frombuffer(data, dtype=f"<u{data[0]}", offset=9)
    out = np.empty(len(steps) + 1, dtype=np.int64)
    out[0] = np.frombuffer(data, dtype="<i8", count=1, offset=1)[0]
    np.cumsum(steps, out=out[1:])
    out[1:] += out[0]
    return out


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where ascending part numbers ``keys`` change: positions of the parts 0 .. parts, in order."""
    return np.searchsorted(keys, np.arange(parts + 1))


def block_count(df: DataFrame) -> int:
    return 2 * max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text): rows dealt by a hash of id and text, so that copies and repeated ids spread."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(block_count(docs))).cast("int")
    return docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")
