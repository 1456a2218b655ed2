from __future__ import annotations

import numpy as np
import pytest

from dossier.llm import vectors


def brute(rows, threshold=0.9):
    """{vec_id: (links, component)} by all pairs of usable vectors."""
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v, dtype=float) / np.linalg.norm(v)
    ids = sorted(usable)
    links = {i: {j for j in ids if j != i and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= threshold} for i in ids}
    component = {}
    for i in ids:
        if i not in component:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in component:
                    component[x] = i
                    todo += links[x]
    return {i: (len(links[i]), component[i]) for i in ids}


def _got(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, row long").repartition(4)
    return vectors.near_duplicates(frame, **sizes).collect()


def _cloud(rnd, centre, spread, n):
    return [(centre + spread * rnd.normal(size=len(centre))).astype(np.float32).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(2)
    found = []
    for n, spread in ((40, 0.01), (25, 0.05), (3, 0.02), (2, 0.03)):
        found += _cloud(rnd, rnd.normal(size=16), spread, n)
    found += [rnd.normal(size=16).astype(np.float32).tolist() for _ in range(60)]
    found += [found[0]] * 30 + [[1.0, 2.0], [2.0, 4.0], [2.0, -1.0]]
    rows = [(i, v) for i, v in enumerate(found)]
    odd = [None, [], [0.0] * 16, [None, 1.0], [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)]


def test_equals_brute_force(spark, rows):
    expected = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in _got(spark, rows)}
    assert got == {i: (*expected.get(i, (0, i)), expected.get(i, (0, i))[1] == i) for i, _ in rows}


def test_groups_denser_than_a_window_count_whole(spark):
    rnd = np.random.default_rng(5)
    rows = list(enumerate(_cloud(rnd, rnd.normal(size=16), 0.01, 300) + [rnd.normal(size=16).astype(np.float32).tolist() for _ in range(40)]))
    expected = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in _got(spark, rows, window=8, segment=32)}
    assert got == expected and max(n for n, _ in expected.values()) > 250


def test_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0]), (None, None)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in _got(spark, rows)), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False), (None, 0, None, False)], key=str)


def test_recall_of_small_windows(spark):
    """Close pairs among many others, with windows that hold a fiftieth of the vectors."""
    rnd = np.random.default_rng(9)
    base = rnd.normal(size=(1000, 32))
    close = base + 0.08 * rnd.normal(size=base.shape)
    rows = list(enumerate(np.concatenate([base, close]).astype(np.float32).tolist()))
    expected = brute(rows)
    got = {r["vec_id"]: r["n_links"] for r in _got(spark, rows, window=40, segment=256)}
    assert all(got[i] <= expected[i][0] for i in got)
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in expected.values())


def test_empty_table(spark):
    assert _got(spark, []) == []


def _loose(rnd, centre, n, cosine=0.92):
    """Unit vectors around a unit centre, of about the given cosine to each other."""
    noise = rnd.normal(size=(n, len(centre)))
    return centre + np.sqrt((1 / cosine - 1) / len(centre)) * noise


def test_loose_groups_beyond_all_windows_count_whole(spark):
    """A group of cosine about 0.92, larger than 12 windows reach, and a tight clump beside its middle."""
    rnd = np.random.default_rng(11)
    centre = rnd.normal(size=64)
    centre /= np.linalg.norm(centre)
    group = _loose(rnd, centre, 500)
    clump = group[7] + 0.002 * rnd.normal(size=(150, 64))
    others = rnd.normal(size=(60, 64))
    rows = list(enumerate(np.concatenate([others, group, clump]).astype(np.float32).tolist()))
    expected = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in _got(spark, rows, window=8, segment=64)}
    assert sum(n for n, _ in got.values()) == sum(n for n, _ in expected.values())
    assert got == expected and max(n for n, _ in expected.values()) > 2 * 12 * 8


def test_recall_among_many_vectors_with_a_common_mean(spark):
    """Pairs between 0.90 and 0.92 among 750 windows of vectors that share a direction."""
    rnd = np.random.default_rng(13)
    mean = rnd.normal(size=32)
    first = rnd.normal(size=(1500, 32)) + mean
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    aside = rnd.normal(size=first.shape)
    aside -= (aside * first).sum(axis=1, keepdims=True) * first
    cosine = rnd.uniform(0.9005, 0.92, size=(1500, 1))
    second = cosine * first + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    x = np.concatenate([first, second]).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    expected = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in _got(spark, list(enumerate(x.astype(np.float32).tolist())), window=4, segment=512)}
    assert expected.sum() >= 3000
    assert sum(got.values()) >= 0.97 * expected.sum()


def test_passes_grow_with_the_number_of_vectors():
    share = lambda n: (1 - np.arccos(0.9) / np.pi) ** np.log2(n / 1024)
    for n in (10**5, 10**6, 5 * 10**6, 2 * 10**7):
        assert (1 - share(n)) ** vectors.passes_for(n, 1.0, 0.9, 1024) <= 0.0101
    assert vectors.passes_for(10**6, 0.5, 0.9, 1024) > vectors.passes_for(10**6, 1.0, 0.9, 1024)
    assert vectors.passes_for(0, 1.0, 0.9, 1024) == vectors.passes_for(1024, 0.0, 0.9, 1024) == 12
