"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered by (doc_id, size, checksum) over the whole table. A Feistel network permutes the numbers below the
next power of two; a result beyond the table is permuted again until it falls inside (cycle walking), which keeps the
mapping a permutation of the table. Row ``q`` of the permuted order goes to shard ``q mod n`` and slot ``q div n``, so shard and slot follow
from the row number, the key and the number of rows alone, and ``row_at`` computes the way back.

The law is ``rows``: counts differ by one at most, whatever sizes, keys or copies the rows have. Only (doc_id, size,
checksum) are shuffled, never texts. Null texts have size 8 and checksum 0; null ids come first; rows equal in all three columns are
interchangeable, so each gets one of their places. An empty table gives an empty result. Further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.words import mix
from dossier.plans.durable import durable

ROUNDS = 6
KEY = 20_240_601
OVERHEAD = 8


def _network(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    """One pass through the network: halves of ``low`` and ``high`` bits are changed in turn."""
    low = np.uint64(bits // 2)
    high = np.uint64(bits) - low
    low_mask, high_mask = (np.uint64(1) << low) - np.uint64(1), (np.uint64(1) << high) - np.uint64(1)
    left, right = x >> low, x & low_mask
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    for k in rounds:
        salt = np.uint64((key + 0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
        if k % 2:
            right = right ^ (mix(left + salt) & low_mask)
        else:
            left = left ^ (mix(right + salt) & high_mask)
    return (left << low) | right


def permuted(x: np.ndarray, rows: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The permutation of 0 .. rows - 1, or its inverse, for an array of row numbers."""
    if rows <= 1:
        return x.astype(np.int64)
    bits = max(2, (rows - 1).bit_length())
    out = _network(x.astype(np.uint64), bits, key, back)
    while (beyond := np.flatnonzero(out >= rows)).size:
        out[beyond] = _network(out[beyond], bits, key, back)
    return out.astype(np.int64)


def place(row: np.ndarray, rows: int, shards: int, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    q = permuted(row, rows, key)
    return q % shards, q // shards


def row_at(shard: np.ndarray, slot: np.ndarray, rows: int, shards: int, key: int = KEY) -> np.ndarray:
    """The row number at a shard and slot."""
    return permuted(slot * shards + shard, rows, key, back=True)


def row_numbers(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with its 0-based global position ``row`` by ``order``, and the number of rows.

    Range partitions are numbered inside and shifted by the rows before them: one small count per partition.
    """
    placed = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total, before = 0, []
    for number, n in counts:
        before.append((number, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    # one row per partition, so the broadcast is bounded by the number of partitions
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part", "left")
    row = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return numbered.withColumn("row", row).drop("_at", "_part", "_before"), total


def sharded(docs: DataFrame, shards: int, key: int = KEY) -> DataFrame:
    """(doc_id, size, text_crc32, row, shard, slot) of every row."""
    text = F.coalesce("text", F.lit(""))
    small = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, rows = row_numbers(small, ["doc_id", "size", "text_crc32"])

    @F.pandas_udf("struct<shard int, slot long>")
    def placed(row: pd.Series) -> pd.DataFrame:
        shard, slot = place(row.to_numpy(), rows, shards, key)
        return pd.DataFrame({"shard": shard.astype("int32"), "slot": slot})

    return numbered.withColumn("_place", placed("row")).select(
        "doc_id", "size", "text_crc32", "row", F.col("_place.shard").alias("shard"), F.col("_place.slot").alias("slot")
    )
