from __future__ import annotations

import zlib

import numpy as np
import pytest

from dossier.llm import sharding


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation_and_way_back(rows):
    x = np.arange(rows)
    there = sharding.permuted(x, rows)
    assert sorted(there) == list(range(rows))
    assert np.array_equal(sharding.permuted(there, rows, back=True), x)
    shard, slot = sharding.place(x, rows, 5)
    assert np.array_equal(sharding.row_at(shard, slot, rows, 5), x)


def test_permutation_mixes():
    there = sharding.permuted(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), there)[0, 1]) < 0.05
    assert (sharding.permuted(np.arange(100), 100, 1) != sharding.permuted(np.arange(100), 100, 2)).any()


def test_frame(spark):
    rows = [(i // 2, f"text é {i % 50}", "x") for i in range(2000)] + [(None, None, None)] * 3 + [(5, "", "y"), (6, "a" * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    got = sharding.sharded(docs, 24).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i is None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert (r["shard"], r["slot"]) == tuple(int(v[0]) for v in sharding.place(np.array([r["row"]]), len(rows), 24))
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r["row"], r["shard"], r["slot"]): r["doc_id"] for r in sharding.sharded(docs.repartition(3), 24).collect()}
    assert again == {(r["row"], r["shard"], r["slot"]): r["doc_id"] for r in got}


def test_empty_table(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0
