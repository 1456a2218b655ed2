from __future__ import annotations

import os
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dossier.llm import jaccard


def brute(rows, percent=85, n=4):
    sets = {}
    for i, text in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
        words = [x.decode() for x in folded.encode().split()]
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in seen[s]:
                shared[j] += 1
            seen[s].append(i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def _got(spark, rows, percent=85):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component long, n long").repartition(5)
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.joined(docs, percent).collect()]


@pytest.fixture(scope="module")
def rows():
    rnd, rows = random.Random(5), []
    for _ in range(150):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randint(0, 60)) for _ in range(rnd.choice([1, 2, 3, 5, 7, 8, 9, 12, 20, 30, 60, 150, 400]))]
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 35))):
                kind, at = rnd.random(), rnd.randrange(len(words) + 1)
                if kind < 0.4 and at < len(words):
                    words[at] = rnd.choice("ab") + str(rnd.randint(0, 99))
                elif kind < 0.7:
                    words.insert(at, "zz" + str(rnd.randint(0, 9)))
                elif at < len(words) and len(words) > 1:
                    del words[at]
            rows.append((len(rows), " ".join(words)))
    shared = " ".join(f"com{i}" for i in range(60))
    rows += [(10_000 + i, shared + " " + " ".join(f"u{rnd.randint(0, 3000)}" for _ in range(rnd.randint(5, 60)))) for i in range(100)]
    # a chain whose ends do not link, upper case, and texts without words
    chain = [f"w{i}" for i in range(200)]
    rows += [(20_000 + k, " ".join(chain[3 * k : 3 * k + 100])) for k in range(20)]
    rows += [(30_000, "ONE two THREE four five"), (30_001, "one TWO three four five"), (30_002, ""), (30_003, " \t"), (30_004, None), (30_005, "é É"), (30_006, "é é")]
    return rows


@pytest.mark.parametrize("percent", [85, 60])
def test_components_equal_brute_force(spark, rows, percent):
    assert {i: (n, c) for i, n, c in _got(spark, rows, percent)} == brute(rows, percent)


def test_null_and_repeated_ids(spark):
    text = "one two three four five six"
    got = _got(spark, [(3, text), (3, text), (2, text), (None, text), (None, None), (9, "other words of no kin")])
    assert sorted(got, key=str) == sorted([(3, 3, 2), (3, 3, 2), (2, 3, 2), (None, 3, None), (None, 0, None), (9, 2, 9)], key=str)


def test_empty_table(spark):
    assert _got(spark, []) == []


def test_allocation_asks_enough(spark):
    """Segments left out never exceed the surplus, but for those that one-deletion questions replace."""
    rnd, rows, facts = random.Random(3), [], {}
    for owner in range(60):
        size = rnd.choice([7, 8, 12, 40, 333, 2000])
        low = jaccard.bands(85, size)
        for step in (0, 1):
            frame = np.array([np.searchsorted(low, size, side="right") - 1 + step])
            _, segments, named = (int(v[0]) for v in jaccard.frame_plan(85, low, frame))
            extra = int(jaccard.surplus(85, low, np.array([size]), frame)[0])
            assert extra >= 0 and segments - extra > 15 * (size + min(int(low[frame[0] + 1]) - 1, size * 100 // 85)) // 185
            facts[owner, step] = (segments, extra)
            for place in range(segments):
                name, n = max(place - (segments - named), -1), rnd.choice([1, 2, 5, 40, 1000])
                if n > 1:
                    rows.append((len(rows), owner, size, step, False, name, n, extra, named, 1))
                if name >= 0:
                    rows.append((len(rows), owner, size, step, True, name, 2, extra, named, 1))
    got = jaccard.asked(spark.createDataFrame(rows, jaccard.MEMBERS)).collect()
    for key, (segments, extra) in facts.items():
        own = [r for r in got if (r["owner"], r["step"]) == key]
        out = {r["bucket"]: r for r in own if not r["less"] and not r["asked"]}
        names_out = {r["name"] for r in out.values() if r["name"] >= 0}
        wider = {r["name"] for r in own if r["less"] and r["asked"]}
        assert len(out) <= extra + (len(wider - names_out) if len(out) > extra else 0)


@pytest.mark.parametrize("size", [400, 500_000, 3_000_000])
def test_codes_of_very_large_sets_are_whole(size):
    """Named segments of sets of millions of shingles do not wrap around."""
    for percent in (60, 80, 85):
        low = jaccard.bands(percent, size)
        frame = np.array([np.searchsorted(low, size, side="right")])
        _, segments, named = (int(v[0]) for v in jaccard.frame_plan(percent, low, frame))
        name = np.arange(-1, named)
        code = (1 + 2 * (name % 2 == 0) + 4 * (name + 1)).astype(np.uint32)
        back = jaccard.unpack_codes(jaccard.pack_codes(code)).astype(np.int64)
        assert (back // 4 - 1 == name).all() and (back % 4 == code % 4).all()
    assert len(jaccard.pack_codes(np.array([7], dtype=np.uint32))) == 3


def test_keys_of_a_very_large_set_name_its_segments():
    shingles = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 1_700_000).astype(np.uint64))
    low = jaccard.bands(80, len(shingles))
    frame = np.array([np.searchsorted(low, len(shingles), side="right") - 1])
    key, who, name, less = jaccard.frame_keys(shingles, np.array([0, len(shingles)]), np.array([len(shingles)]), frame, 80, low)
    batch = jaccard._dealt(key, who, np.full(len(key), len(shingles)), (2 * less + 4 * (name + 1)).astype(np.uint32), 3)
    names = np.concatenate([jaccard.unpack_codes(c.as_py()) for c in batch.column(batch.schema.names.index("code"))]).astype(np.int64) // 4 - 1
    assert name.max() > 16_382 and (np.sort(names) == np.sort(name)).all()


def _crowd(count, words, edits, seed):
    """Loose copies of one text: few of them link, all of them share parts, and some share edits."""
    rnd = random.Random(seed)
    base, shared = [f"w{i}" for i in range(words)], [(rnd.randrange(words), f"s{i}") for i in range(40)]
    for _ in range(count):
        text = list(base)
        for _ in range(rnd.randint(*edits)):
            at, word = rnd.choice(shared) if rnd.random() < 0.3 else (rnd.randrange(words), f"x{rnd.randrange(10**6)}")
            text[at] = word
        yield " ".join(text)


@pytest.mark.parametrize("sample", [256, 8])
def test_crowd_of_loose_copies(spark, monkeypatch, sample):
    """Whatever the sample says of the order, no link of a crowd without a common centre is lost."""
    monkeypatch.setattr(jaccard, "CROWD_SAMPLE", sample)
    texts = [*_crowd(700, 140, (1, 9), 3), *_crowd(150, 60, (0, 4), 4), *_crowd(200, 300, (4, 14), 5)]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert 50 < len({c for _, c in want.values()}) < len(rows) - 50
    assert {i: (n, c) for i, n, c in _got(spark, rows)} == want


def test_pairs_of_a_crowd_grow_with_its_sets(spark, monkeypatch):
    """Copies whose edits are their own are told apart without comparing all of them; small crowds may compare all of theirs."""
    asked = []
    sharing = jaccard.JaccardJoin._sharing
    monkeypatch.setattr(jaccard.JaccardJoin, "_sharing", lambda self, rows: (asked.append(sharing(self, rows).count()), sharing(self, rows))[1])
    rnd = random.Random(9)
    rows = []
    for i in range(600):
        text = [f"w{k}" for k in range(144)]
        for at in rnd.sample(range(0, 144, 4), 5):
            text[at] = f"x{i}-{at}"
        rows.append((i, " ".join(text)))
    assert {i: (n, c) for i, n, c in _got(spark, rows)} == brute(rows)
    assert asked[0] <= jaccard.LARGE_CROWD * len(rows) // 2 < len(rows) ** 2 // 30


def test_held_by_counts_sets_with_the_element_in_their_difference():
    only, missing = np.array([-7, 2, 5, 9]), np.array([False, True, False, True])
    got = jaccard.held_by(only, missing, 10, np.array([-7, 2, 8]), np.array([4, 9, 3]))
    assert got.tolist() == [4, 1, 0, 10]
    assert jaccard.held_by(only, missing, 10, np.array([], dtype=np.int64), np.array([], dtype=np.int64)).tolist() == [0, 10, 0, 10]


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("before", [None, "200", "0"])
def test_pairs_come_in_small_batches(spark, monkeypatch, before):
    """Pairs carry two texts each, so a batch of Spark's own 10,000 rows takes hundreds of MB of a worker and of its executor."""
    seen, tested = [], jaccard.JaccardJoin._tested
    monkeypatch.setattr(jaccard.JaccardJoin, "_tested", lambda self, *a: (seen.append(spark.conf.get(ARROW_ROWS)), tested(self, *a))[1])
    if before is not None:
        spark.conf.set(ARROW_ROWS, before)
    try:
        rows = list(enumerate(_crowd(60, 60, (0, 4), 4)))
        assert {i: (n, c) for i, n, c in _got(spark, rows)} == brute(rows)
        assert spark.conf.get(ARROW_ROWS, None) == before
    finally:
        spark.conf.unset(ARROW_ROWS)
    assert len(seen) > 1 and set(seen) == {"200" if before == "200" else str(jaccard.PAIR_ROWS)}


def test_pairs_are_verified_by_parts(monkeypatch):
    """The sets of a batch are not held together, and a part ends where it may within the pairs of a hub."""
    texts = list(_crowd(120, 200, (1, 9), 6))
    held = [h for _, h in jaccard._each_set(pa.array(texts), 4)]
    n = len(texts)
    columns = [
        pa.array([held[0]] * n), pa.array([*held[:-1], 5]), pa.array([197] * n), pa.array([197] * n), pa.array([texts[0]] * n), pa.array(texts), pa.array([k % 3 > 0 for k in range(n)]),
        pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.list_(pa.int64())), pa.array([None] * n, pa.list_(pa.int16())),
    ]
    batch = pa.RecordBatch.from_arrays(columns, names=["a", "b", "a_size", "b_size", "_x", "_y", "crowded", "sampled", "common", "sets"])
    monkeypatch.setattr(jaccard, "VERIFIED_BYTES", 1 << 30)
    whole = list(jaccard._verified([batch], 85, 4))
    monkeypatch.setattr(jaccard, "VERIFIED_BYTES", 5_000)
    parts = list(jaccard._verified([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)], 85, 4))
    assert len(whole) == 1 and len(parts) > 20
    assert [r for part in parts for r in part.to_pylist()] == whole[0].to_pylist()
    assert whole[0].num_rows == n - 1


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in map(os.path.basename, files.split("\n")) if f.startswith("shuffle_")}


def _left(spark, before):
    """Shuffle files besides ``before``; they go a moment after their step."""
    for _ in range(40):
        if not (now := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return now


def test_steps_leave_no_shuffle_files(spark, monkeypatch):
    """What a step shuffled is deleted before the next one starts, not when the driver happens to collect its garbage."""
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, old, seen, tested = _shuffle_files(spark), spark.conf.get(conf, None), [], jaccard.JaccardJoin._tested
    monkeypatch.setattr(jaccard.JaccardJoin, "_tested", lambda self, *a: (seen.append(_left(spark, before)), tested(self, *a))[1])
    rows = list(enumerate([*_crowd(60, 60, (0, 4), 4), *_crowd(60, 200, (6, 12), 7)]))
    links = jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string")).links()
    seen.append(_left(spark, before))
    # a stage that Spark gives up may write its files after the step
    assert len(seen) > 3 and max(map(len, seen)) <= 40, seen
    assert links.count() > 0
    assert {i: (n, c) for i, n, c in _got(spark, rows)} == brute(rows)
    assert spark.conf.get(conf, None) == old


def test_forget_deletes_what_nobody_holds(spark):
    before = _shuffle_files(spark)
    kept = jaccard.durable(spark.range(50).repartition(3).groupBy("id").count())
    assert _shuffle_files(spark) - before
    jaccard.forget(spark)
    assert not _left(spark, before) and kept.count() == 50
