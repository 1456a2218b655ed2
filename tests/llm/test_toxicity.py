from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import toxicity

PLAIN = ["the", "and", "with", "from", "there", "inner", "shore", "stone", "water", "letter", "morning", "évening", "über"]


def all_maximal(score):
    """Maximal scoring segments by their definition: the best segment (leftmost, then shortest), then both sides of it."""

    def inside(begin, stop):
        best = max(((sum(score[a:b]), -a, -(b - a)) for a in range(begin, stop) for b in range(a + 1, stop + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        first = -best[1]
        behind = first - best[2]
        return [*inside(begin, first), (first, behind, best[0]), *inside(behind, stop)]

    return inside(0, len(score))


def test_segments_equal_the_definition():
    rnd = random.Random(4)
    for _ in range(300):
        score = [rnd.uniform(-1, 1) + rnd.choice([0, -0.6]) for _ in range(rnd.randint(0, 14))]
        got, want = toxicity.segments(np.array(score)), all_maximal(score)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_long_texts_take_linear_time():
    score = np.tile([1.0, -0.4, 0.7, -2.0, -0.1], 100_000)
    assert len(toxicity.segments(score)) == 100_000
    assert len(toxicity.segments(np.tile([1.0, -0.5], 200_000))) == 1


@pytest.fixture(scope="module")
def corpus(spark):
    rnd, rows, labels = random.Random(5), [], []
    for i in range(900):
        text = [rnd.choice(PLAIN) for _ in range(rnd.randint(4, 150))]
        bad = i % 6 == 0
        if bad:
            at = rnd.randint(0, len(text))
            # a family of words that begin alike, most of them seen once
            text[at:at] = [rnd.choice(["Gronk", f"zürf{rnd.randint(0, 10**6)}"]) for _ in range(rnd.randint(2, 4))]
        rows.append((i, " ".join(text) + ".", "en", 7.0, "x"))
        labels.append((i, int(bad)))
    rows += [(None, "gronk gronk", None, None, None), (9000, None, "en", 1.0, "x"), (9001, "", "en", 1.0, "x"), (9002, "water " * 60_000, "en", 1.0, "x"), (0, rows[0][1], "en", 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, passages string").repartition(4)
    more = [(None, 1), (5, None), (99_999, 0), (7, 0)]
    return docs, spark.createDataFrame(labels + more, "doc_id long, toxic int")


def test_held_out_accuracy_and_passages(corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    known = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id < 900").collect()}
    got = toxicity.scored(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == 905 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["held"]]
    assert len(held) > 200
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) / len(held) > 0.98
    for r in held:
        words = r["text"].rstrip(".").split(" ")
        for p in r["passages"]:
            assert p["expected"] <= toxicity.EXPECTED and p["score"] > 0
            if known[r["doc_id"]]:
                assert any(w == "Gronk" or w.startswith("zürf") for w in words[p["first"] : p["last"] + 1])
    rest = {r["doc_id"]: r for r in got if r["doc_id"] is None or r["doc_id"] >= 9000}
    assert rest[None]["predicted"] == 1 and not rest[None]["held"]
    assert rest[9000]["score"] == rest[9001]["score"] < 0.5 and rest[9000]["passages"] == [] and rest[9002]["predicted"] == 0


def test_columns_are_kept_and_training_is_reproducible(corpus):
    docs, labels = corpus
    once, again = toxicity.train(docs, labels, 300), toxicity.train(docs.repartition(3), labels, 300)
    assert (once.toxic == again.toxic).all() and (once.all == again.all).all()
    assert (once.slope, once.shift, once.rate) == pytest.approx((again.slope, again.shift, again.rate))
    found = toxicity.scored(docs, once)
    assert set(found.columns) == {*docs.columns, "predicted"}
    assert dict(found.dtypes)["passages"].startswith("array")


def test_counts_of_a_text_leave_itself_out():
    model = toxicity.Model(np.zeros(toxicity.WORDS + toxicity.BEGINNINGS), np.zeros(toxicity.WORDS + toxicity.BEGINNINGS), 3, 10)
    t = toxicity.tokens(toxicity.plain(pa.array(["gronk"])), 0, 1)
    unseen = model.of_words(t)
    model.all[t.word] = model.all[t.beginning] = model.toxic[t.word] = model.toxic[t.beginning] = 1
    assert model.of_words(t)[0] > unseen[0] and model.of_words(t, np.array([1])) == pytest.approx(unseen)
    assert unseen[0] == pytest.approx(-toxicity.DRIFT)


def test_beginnings_are_characters():
    t = toxicity.tokens(toxicity.plain(pa.array(["zürf1 ZüRF22 zür zürg été étéé", "日本語文字 日本語文化"])), 0, 2)
    b = t.beginning
    assert b[0] != b[2] and b[0] != b[3] and b[4] != b[5] and b[6] == b[7]
    assert toxicity.tokens(toxicity.plain(pa.array(["zürf1 zürf22"])), 0, 1).beginning.tolist() == [b[0]] * 2


def test_extreme_value_law_is_found():
    rnd = np.random.default_rng(2)
    n = rnd.integers(10, 1000, 20_000).astype(float)
    best = (rnd.gumbel(size=len(n)) + np.log(n) - 3.0) / 1.7
    rate, log_k = toxicity._law(best, n)
    assert rate == pytest.approx(1.7, rel=0.03) and log_k == pytest.approx(-3.0, abs=0.12)


def test_one_kind_of_label_and_empty_tables(corpus):
    docs, labels = corpus
    clean = toxicity.train(docs, labels.where("toxic = 0"))
    scores = {round(r["score"], 9) for r in toxicity.scored(docs, clean).collect()}
    assert len(scores) == 1 and scores.pop() < 0.1
    nothing = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.scored(docs.limit(0), nothing).count() == 0
    assert toxicity.scored(docs, nothing).first()["score"] == pytest.approx(0.5)


def test_ids_are_no_input(corpus):
    docs, labels = corpus
    model, by_text = toxicity.train(docs, labels), {}
    for r in toxicity.scored(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 5)), model).collect():
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
