from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in hit.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and _luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [(m.start(), number, m.end()) for m in re.finditer(pattern, text or "") if _holds(kind, m.group())]
    return sorted(found)


def test_base_spans_equal_brute_force(spark):
    rnd, rows = random.Random(3), []
    for i in range(3000):
        letters = ["a1@.+- ()9é😀\n_%05", "a@.-_b+", "0123456789  --.+()"][i % 3]
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        if i % 5 == 1:
            text = "x 4111 1111-11111111 y é 4111111111111111 1.2.3.4.5.6.7.8 +44 (0)20 7946 0958 " + text
        rows.append((i, text))
    long = ["1 " * 20000, "a@" + "b." * 20000 + "c", "1" * 50000, "a" * 50000 + "@b.c", "+1" * 20000, None, ""]
    rows += [(3000 + i, t) for i, t in enumerate(long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: [tuple(s) for s in r["base_spans"]] for r in pii.with_spans(docs).collect()}
    assert got == {i: brute(t) for i, t in rows}


@pytest.fixture(scope="module")
def corpus(spark):
    """One mailbox in four different lines, three of them with a word that occurs nowhere else."""
    rows = [(i, f"common words of line {chr(97 + i % 26)}{chr(97 + i // 26)} here\nand the rest") for i in range(300)]
    rows += [(1000 + i, f"first\nwrite zanzibar words {w} to ann@mail.example.com here") for i, w in enumerate(("one", "two", "three"))]
    rows += [(1003, "common words ann@mail.example.com"), (1004, "zanzibar is alone here"), (1005, "first\nwrite zanzibar words one to ann@mail.example.com here")]
    rows += [(None, None), (2000, ""), (2000, "")]
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, row string, _key string, n_chars long")


def test_terms_that_disclose_an_entity(corpus):
    got = {r["doc_id"]: r for r in pii.with_spans(corpus).collect()}
    spans = lambda i, name: [got[i]["text"][s["start"] : s["end"]] for s in got[i][name]]
    assert spans(1000, "base_spans") == ["ann@mail.example.com"]
    # three distinct lines hold both, one line of the word is without the entity: generalised or removed by its share
    assert "zanzibar" in spans(1000, "term_spans") and "zanzibar" in spans(1005, "term_spans")
    assert "words" not in spans(1000, "term_spans") and "here" not in spans(1000, "term_spans")
    assert spans(1003, "term_spans") == [] and spans(1004, "term_spans") == [] and spans(5, "term_spans") == []


def levels(kind, value):
    """A value, what it shares with others, and its kind."""
    digits = re.sub("[^0-9]", "", value)
    part = [value.split("@")[-1], ".".join(value.split(".")[:3]), digits[:6], digits[:4]][kind]
    return {(kind, value), (kind, "/" + part), (kind, None)}


def _expected_pairs(rows, support=pii.SUPPORT):
    """Disclosure by hand: distinct lines, entities by kind and value, terms as runs of letters."""
    from math import log

    lines = {line for _, text in rows for line in (text or "").split("\n")}
    held, words = {}, {}
    for line in lines:
        blank = list(line)
        values = set()
        for start, kind, end in brute(line):
            values |= levels(kind, line[start:end])
            blank[start:end] = " " * (end - start)
        terms = set(re.findall(r"[^\W\d_]+", "".join(blank).lower()))
        for value in values:
            held.setdefault(value, []).append(terms)
        for term in set(re.findall(r"[^\W\d_]+", line.lower())):
            words[term] = words.get(term, 0) + 1
    flagged = {}
    for value, found in held.items():
        if len(found) < support or len(lines) <= len(found):
            continue
        for term in set().union(*found):
            both = sum(term in f for f in found)
            share = log(len(lines) * both / (len(found) * max(words[term], both))) / log(len(lines) / len(found))
            if both >= support and share >= pii.GENERALISE:
                flagged[value, term] = share >= pii.REMOVE
    return flagged


def test_disclosing_terms_equal_brute_force(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    flagged = _expected_pairs(rows)
    assert flagged
    expected = set()
    for doc_id, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            spans = brute(line)
            blank = list(line)
            for start, _, end in spans:
                blank[start:end] = " " * (end - start)
            for m in re.finditer(r"[^\W\d_]+", "".join(blank).lower()):
                out = [flagged[v, m.group()] for a, kind, b in spans for v in levels(kind, line[a:b]) if (v, m.group()) in flagged]
                if out:
                    expected.add((doc_id, at + m.start(), 5 if any(out) else 4, at + m.end()))
            at += len(line) + 1
    got = {(r["doc_id"], s["start"], s["kind"], s["end"]) for r in pii.with_spans(corpus).collect() for s in r["term_spans"]}
    assert got == expected


def _expected_spans(rows):
    flagged, expected = _expected_pairs(rows), set()
    for doc_id, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            spans, blank = brute(line), list(line)
            for start, _, end in spans:
                blank[start:end] = " " * (end - start)
            for m in re.finditer(r"[^\W\d_]+", "".join(blank).lower()):
                out = [flagged[v, m.group()] for a, kind, b in spans for v in levels(kind, line[a:b]) if (v, m.group()) in flagged]
                if out:
                    expected.add((doc_id, at + m.start(), 5 if any(out) else 4, at + m.end()))
            at += len(line) + 1
    return expected


def test_rare_values_are_judged_by_their_parts_and_kind(spark):
    """No value stands on two lines, and yet the word that always comes with mailboxes, or with one network, is found."""
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(["stone", "water", "letter", "morning"]) + str(rnd.randint(0, 9)) for _ in range(6))) for i in range(200)]
    rows += [(300 + i, f"stone{i} reachme u{i}@h{i}.example water") for i in range(6)]
    rows += [(400 + i, f"water{i} gateway 10.1.2.{i} then") for i in range(4)] + [(500 + i, f"stone{i} 11.{i}.9.1 letter") for i in range(8)]
    expected = _expected_spans(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], s["start"], s["kind"], s["end"]) for r in pii.with_spans(docs).collect() for s in r["term_spans"]}
    words = {dict(rows)[d][a:b] for d, a, _, b in got}
    assert got == expected and {"reachme", "gateway"} <= words and "letter" not in words


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@x.example" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text.replace(" ", "\n"))], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.with_spans(docs).collect()}
    assert all([tuple(s) for s in rows[i]["base_spans"]] == brute(rows[i]["text"]) for i in (1, 2))


def test_sanitised_keeps_columns_and_clean_texts(corpus):
    done = pii.sanitised(corpus)
    assert done.columns == corpus.columns
    got = {(r["doc_id"], r["text"]) for r in done.collect()}
    assert done.count() == corpus.count()
    assert (1003, "common words [EMAIL]") in got and (1004, "zanzibar is alone here") in got and (None, None) in got
    assert not any("zanzibar" in (t or "") for i, t in got if i != 1004)
    assert done.where("doc_id = 1003").first()["n_chars"] == len("common words [EMAIL]")


def test_empty_table_and_writing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.with_spans(none).count() == 0 and pii.sanitised(none).count() == 0
    one = spark.createDataFrame([(1, "4111111111111111 a@b.c")], "doc_id long, text string")
    assert pii.with_spans(one).select(pii.written(F.col("base_spans")).alias("s")).first()["s"] == "card:0:16,email:17:22"
