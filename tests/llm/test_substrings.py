from __future__ import annotations

import random

import numpy as np
import pytest

from dossier.llm import packing, substrings


def brute(rows, size=13):
    """(doc_id, n_words, n_removed, kept) with the smallest document of each window."""
    texts = [(i, [x.decode() for x in (t or "").encode().split()]) for i, t in rows]
    last = float("inf")
    first = {}
    for i, words in texts:
        for k in range(len(words) - size + 1):
            run = tuple(words[k : k + size])
            first[run] = min(first.get(run, last), last if i is None else i)
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < (last if i is None else i):
                gone.update(range(k, k + size))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), " ".join(kept)))
    return sorted(out, key=str)


def _got(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, kept string").repartition(5)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(docs).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    prose = lambda n: [rnd.choice("abcdefgh") + str(rnd.randint(0, 50)) for _ in range(n)]
    passages = [prose(n) for n in (12, 13, 14, 40, 60)]
    rows = []
    for i in range(150):
        words = prose(rnd.choice([0, 3, 12, 13, 30, 200]))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(words))
            words[at:at] = rnd.choice(passages)
        rows.append((rnd.randint(0, 120), rnd.choice([" ", "\n", "\t  "]).join(words)))
    common = " ".join(prose(20))
    rows += [(1000 + i, common) for i in range(60)]
    rows += [(None, common), (None, None), (5000, None), (5001, ""), (5002, " \n "), (5003, "é " * 30), (5004, "é " * 30), (4, "word a " * 40)]
    rows += [(6000, " ".join(prose(5000) + passages[4] + prose(20_000)))]
    return rows


def test_equals_brute_force(spark, rows):
    assert _got(spark, rows) == brute(rows)


def test_many_ranges_and_a_crowded_sketch_lose_nothing(spark, rows, monkeypatch):
    # few counters: nearly all windows are estimated repeated, and the exact grouping decides alone
    monkeypatch.setattr(substrings, "CELLS_PER_BYTE", 40.0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = substrings.without_repeats(docs)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in many.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert _got(spark, []) == []


def test_packing():
    rnd = np.random.default_rng(1)
    for top in (1, 200, 60_000, 1 << 20, 1 << 40):
        for n in (0, 1, 2, 100):
            values = np.sort(rnd.integers(0, top, n))
            assert np.array_equal(packing.unpack(packing.pack(values)), values)
