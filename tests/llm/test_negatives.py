from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import negatives
from dossier.llm.negatives import Packed


def anchor():
    return F.col("vec_id") % 5 == 0


def brute(rows):
    """All pairs with Python integers."""
    fit = {}
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if i not in fit or (label, vector) < fit[i]:
            fit[i] = (label, vector)
    whole = {i: [math.floor(256 * x) for x in v] for i, (_, v) in fit.items()}
    out = set()
    for a in (i for i in fit if i % 5 == 0):
        score = {b: sum(x * y for x, y in zip(whole[a], whole[b], strict=False)) for b in fit if b != a}
        same = sorted((-s, b) for b, s in score.items() if fit[b][0] == fit[a][0])[:5]
        for p, positive in same:
            fits = sorted((-s, b) for b, s in score.items() if fit[b][0] != fit[a][0] and -50 * p <= 100 * s <= -95 * p)[:3]
            out |= {(a, positive, k + 1, b, -p, -s) for k, (s, b) in enumerate(fits)}
    return out


def found(frame):
    return {tuple(r) for r in frame.collect()}


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(3), []
    centres = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    for i in range(300):
        v = [c * 0.3 + rnd.gauss(0.1, 0.12) for c in rnd.choice(centres)]
        out.append((i, i % 4, v))
    out += [(400 + i, 1, [0.25] * 12) for i in range(30)]
    out += [(500, None, [0.1] * 12), (505, 2, None), (510, 2, [0.1, None] * 6), (515, 2, [float("nan")] * 12), (520, 2, [float("inf")] * 12)]
    out += [(525, 2, []), (530, 2, [0.5, 0.5]), (535, 3, [-0.2] * 12), (None, 1, [0.3] * 12), (5, 0, [0.4] * 12), (7, 3, out[7][2])]
    return out


def test_equals_all_pairs(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, score string, rank int").repartition(5)
    expected = brute(rows)
    assert len(expected) > 500
    assert found(negatives.hard_negatives(frame, anchor())) == expected
    # several blocks of anchors
    assert found(negatives.hard_negatives(frame, anchor(), 2000)) == expected


def test_small_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema), anchor()).count() == 0
    one = [(5, 1, [0.5]), (6, 1, [0.5]), (7, 2, [0.4])]
    assert found(negatives.hard_negatives(spark.createDataFrame(one, schema), anchor())) == {(5, 6, 1, 7, 128 * 128, 102 * 128)}
    zero = [(5, 1, []), (6, 1, []), (7, 2, []), (8, 2, [1.0])]
    assert found(negatives.hard_negatives(spark.createDataFrame(zero, schema), anchor())) == {(5, 6, 1, 7, 0, 0), (5, 6, 2, 8, 0, 0)}


@pytest.mark.parametrize("largest", [1, 300, 1 << 20, 1 << 36])
def test_packed_products_are_exact(largest):
    rnd = np.random.default_rng(largest % 97)
    rows = rnd.integers(-largest, largest + 1, (100, 17))
    anchors = rnd.integers(-largest, largest + 1, (9, 17))
    packed = Packed(rows, negatives._norm(anchors))
    assert packed.wide or packed.fields * packed.bits <= 64
    exact = anchors.astype(object) @ rows.astype(object).T
    assert (packed.scores(anchors) == np.clip(exact, -(1 << 55), 1 << 55).astype(np.int64)).all()


def test_usual_vectors_share_an_integer():
    rows = np.random.default_rng(1).normal(0, 1, (50, 64))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.int64)
    assert Packed(rows, negatives._norm(rows)).fields == 3


def test_extreme_components():
    lists = pa.array([[1e300, -1.5], [], [2.0]], pa.list_(pa.float64()))
    got = negatives.components(lists, 2)
    assert got.dtype == object and got[0, 0] == int(1e300) * 256 and got[0, 1] == -384 and got[1].tolist() == [0, 0]
    assert Packed(got, negatives._norm(got)).scores(got)[0, 0] == 1 << 55
