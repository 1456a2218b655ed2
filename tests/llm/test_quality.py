from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import quality


@pytest.fixture(scope="module")
def corpus(spark):
    rnd, rows, labels = random.Random(8), [], []
    words = ["the", "and", "with", "from", "there", "inner", "shore", "stone", "water", "letter", "morning"]
    for i in range(600):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 120))).capitalize() + "."
        good = i % 4 > 0
        if not good:
            text = rnd.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()), "spam " * 50, text.replace(" ", "### ")])
        rows.append((i, text, "en", 7.0, "x"))
        labels.append((i, int(good)))
    rows += [(None, "the stone", None, None, None), (9000, None, "en", 1.0, "x"), (9001, "", "en", 1.0, "x"), (9002, "water " * 60_000, "en", 1.0, "x"), (0, rows[0][1], "en", 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, bucket string").repartition(4)
    more = [(None, 1), (5, None), (99_999, 0), (7, 1)]
    return docs, spark.createDataFrame(labels + more, "doc_id long, quality int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = quality.train(docs, labels)
    known = {r["doc_id"]: r["quality"] for r in labels.where("doc_id < 600").collect()}
    got = quality.scored(docs, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(got) == 605 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held) and len(held) > 80
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) / len(held) > 0.97
    assert not next(r for r in got if r["doc_id"] is None)["held"]


def test_columns_are_kept_and_training_is_reproducible(corpus):
    docs, labels = corpus
    once, again = quality.train(docs, labels, 200), quality.train(docs.repartition(3), labels, 200)
    assert np.allclose(once.factor, again.factor) and once.bias == pytest.approx(again.bias)
    assert set(quality.scored(docs, once).columns) == {*docs.columns, "predicted"}


def test_pairwise_part_equals_all_pairs(corpus):
    docs, labels = corpus
    model = quality.train(docs, labels, 200)
    texts = quality.plain(quality.pa.array(["The stone and the water.", "a | b!!", ""]))
    d = quality.describe(texts, 0, 3)
    edges, row, index, value = model.features(d)
    for r, score in enumerate(model.score(d)):
        i, x = index[edges[r] : edges[r + 1]], value[edges[r] : edges[r + 1]]
        raw = model.bias + model.weight[i] @ x
        raw += sum(model.factor[i[a]] @ model.factor[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))


def test_one_kind_of_label_and_empty_tables(spark, corpus):
    docs, labels = corpus
    model = quality.train(docs, labels.where("quality = 1"))
    scores = {round(r["score"], 9) for r in quality.scored(docs, model).collect()}
    assert len(scores) == 1 and scores.pop() > 0.9
    nothing = quality.train(docs.limit(0), labels.limit(0))
    assert quality.scored(docs.limit(0), nothing).count() == 0
    assert quality.scored(docs, nothing).first()["score"] == pytest.approx(0.5)


def test_ids_are_no_input(corpus):
    docs, labels = corpus
    model = quality.train(docs, labels)
    by_text = {}
    for r in quality.scored(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 5)), model).collect():
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
