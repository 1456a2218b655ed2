"""Relations and roles settled where a text lies equal brute force and the joined form, and bring no matches together."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossier.operators import retrieval as R

WORDS = ["ab", "cd", "ef", "gh", "and", "in", "then", "é", "abc"]
CUES = (("FOLLOWED_BY", "and", "FORWARD"), ("FOLLOWED_BY", "and then", "REVERSE"), ("CAUSED", "in", "REVERSE"))


def _passages(spark):
    rng = random.Random(5)
    texts = [". ".join(" ".join(rng.choices(WORDS, k=rng.randrange(9))) for _ in range(3)) for _ in range(120)]
    rows = [(f"k{i % 3}" if i % 11 else None, f"d{i % 7}" if i % 5 else None, f"p{i}", t) for i, t in enumerate(texts)]
    rows += rows[:20] + [("k0", "d1", "p1", None)]
    return rows, spark.createDataFrame(rows, "package_id string, document_id string, passage_id string, passage_text string")


def _terms():
    rng = random.Random(7)
    return [
        (f"q{q}" if q != 4 else None, rng.choice(["SUBJECT_FACTOR", "OBJECT_EVENT"]), " ".join(rng.choices(WORDS, k=rng.randrange(1, 4))).upper() if i % 4 else rng.choice(["", "ab", "AB ", "-"]))
        for q in range(6) for i in range(12)
    ]


def _norm(text):
    return re.sub(r"[^\w]+", " ", (text or "").lower()).strip()


def _places(words, run):
    return [i for i in range(len(words) - len(run) + 1) if words[i:i + len(run)] == run]


def _counted(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("listed", [None, 0])
def test_relations_equal_brute_force(spark, listed):
    rows, passages = _passages(spark)
    terms = _terms()
    relation = {f"q{q}": ["FOLLOWED_BY", "CAUSED"][q % 2] for q in range(6)}
    expected = Counter()
    for _, document, passage, text in rows:
        for n, sentence in enumerate(re.split(r"(?<=[.!?])\s+", text or "")):
            words = _norm(sentence).split(" ")
            for (kind, cue, way), query in itertools.product(CUES, relation):
                for at in _places(words, cue.split(" ")) if relation[query] == kind else ():
                    near = {}
                    for q, role, term in terms:
                        run = _norm(term).split(" ")
                        if q != query or run == [""]:
                            continue
                        for f in _places(words, run):
                            ahead = (role == "SUBJECT_FACTOR") == (way == "FORWARD")
                            d = at - (f + len(run) - 1) if ahead else f - (at + cue.count(" "))
                            if d > 0:
                                near.setdefault(role, []).append((d, -len(_norm(term)), term))
                    if len(near) == 2:
                        expected[query, kind, passage, document, n, min(near["SUBJECT_FACTOR"])[2], cue, at + 1, way, min(near["OBJECT_EVENT"])[2], sentence] += 1
    queries = spark.createDataFrame(list(relation.items()), "query_id string, relationship string")
    found = R.governed_relationship_query(passages, queries, spark.createDataFrame(terms, "query_id string, role string, term string"), CUES, listed)
    assert _counted(found, found.columns[:-1]) == expected and len(expected) > 50
    assert found.where("evidence_text_sha256 <> sha2(evidence_text, 256)").isEmpty()
    if listed is None:
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("listed", [None, 0])
def test_roles_equal_brute_force(spark, listed):
    rows, passages = _passages(spark)
    terms = [(q, role, t) for q, role, t in _terms()] + [("q1", "CONTEXT", "ab"), ("q2", "CONTEXT", "nowhere")]
    held, wanted = {}, set(terms)
    roles = {q: {r for p, r, t in wanted if p == q and _norm(t)} for q in {t[0] for t in wanted} - {None}}
    for package, document, passage, text in rows:
        words = _norm(text).split(" ")
        for q, role, term in wanted if package else ():
            if q and _norm(term) and _places(words, _norm(term).split(" ")):
                held.setdefault((q, package, document, passage), []).append((role, term))
    in_package = {}
    for (q, package, *_), hits in held.items():
        in_package.setdefault((q, package), set()).update(r for r, _ in hits)
    expected = Counter(
        (*k, len({r for r, _ in h}), {r for r, _ in h} == roles[k[0]], "; ".join(sorted("=".join(x) for x in h)))
        for k, h in held.items() if in_package[k[:2]] == roles[k[0]]
    )
    found = R.role_coverage_retrieve(passages, spark.createDataFrame(terms, "query_id string, role string, term string"), listed)
    assert _counted(found, found.columns) == expected and len(expected) > 50


def test_role_matches_are_not_brought_together(spark):
    rows, passages = _passages(spark)
    terms = spark.createDataFrame(_terms(), "query_id string, role string, term string")
    found = R.role_coverage_retrieve(passages.dropDuplicates(["passage_id"]), terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "MapInArrow" in plan


def test_a_long_sentence_keeps_all_its_hits(spark):
    text = " ".join(["ab and cd"] * 6_000)
    passages = spark.createDataFrame([("k", "d", "p", text)], "package_id string, document_id string, passage_id string, passage_text string")
    terms = spark.createDataFrame([(f"q{q}", role, t) for q in range(3) for role, t in (("SUBJECT_FACTOR", "ab"), ("OBJECT_EVENT", "cd"))], "query_id string, role string, term string")
    queries = terms.select("query_id", F.lit("FOLLOWED_BY").alias("relationship")).distinct()
    assert R.governed_relationship_query(passages, queries, terms, CUES).count() == 18_000
