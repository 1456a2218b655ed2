"""Pairs scored from lists of queries in the tasks equal the joined ones."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from dossier.operators import retrieval as R

WORDS = "storm deck hull crew engine fire pump valve watch tide bridge radar".split()


def _tables(spark):
    rng = random.Random(4)
    passages = [
        (rng.choice(("d1", "d2", None)), f"p{i}", rng.choice((1, 2, None)), rng.choice(("a", "b", None)), " ".join(rng.choices(WORDS, k=rng.randint(0, 9))) + rng.choice(("", "man Ñ")))
        for i in range(300)
    ]
    queries = [(f"q{i % 6}" if i else None, " ".join(rng.choices(WORDS, k=rng.randint(0, 3)))) for i in range(9)]
    expansions = [("storm", "tide watch"), ("deck", "crewman"), ("fire pump", "valve")]
    return (
        spark.createDataFrame(passages, "document_id string, passage_id string, passage_order long, package_id string, passage_text string"),
        spark.createDataFrame(queries, "query_id string, query_text string"),
        spark.createDataFrame(expansions, "term string, expansion string"),
        spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q2", None)], "query_id string, package_id string"),
    )


def _rows(frame):
    return Counter(tuple(tuple(sorted(v)) if isinstance(v, list) else v for v in r) for r in frame.select(*sorted(frame.columns)).collect())


@pytest.mark.parametrize("which", ["none", "excluded", "within", "asked"])
def test_pairs_equal_joined_pairs(spark, which):
    passages, queries, expansions, packages = _tables(spark)
    text = R._read(passages, ("watch",), "package_id", "document_id", "passage_order")
    terms = R._query_terms(queries, expansions, ("watch",))
    some = {} if which == "none" else {which: packages} if which != "asked" else {"asked": terms.where("term > 'fire'").select("query_id", "term")}
    wanted = _rows(R._pairs(text, terms, **some, listed_bytes=0))
    assert wanted and _rows(R._pairs(text, terms, **some)) == wanted


@pytest.mark.parametrize("k", [1, 3, 200])
def test_best_passages_without_a_sort_of_all_pairs(spark, k):
    passages, queries, expansions, packages = _tables(spark)
    for excluded in (None, packages):
        wanted = _rows(R.lexical_retrieve(passages, queries, expansions, k=k, excluded=excluded, listed_bytes=0))
        assert _rows(R.lexical_retrieve(passages, queries, expansions, k=k, excluded=excluded)) == wanted
    # a task passes on the best of each query, not all pairs
    text, terms = R._read(passages.coalesce(1), (), "document_id", "passage_order"), R._query_terms(queries.limit(4), None, ())
    assert R._pairs(text, terms, best=k).groupBy("query_id").count().where(f"count > {k} * 3").isEmpty()
