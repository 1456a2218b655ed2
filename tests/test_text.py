from __future__ import annotations

import random

from pyspark.sql import functions as F

from dossier.functions import locations as L
from dossier.functions import text as X
from dossier.sources.transcripts import json_text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()["v"]


def test_normalise_text(spark):
    raw = "  a\t\tb\r\n   c\r\r\n\n\n\nd  \n"
    assert one(spark, X.normalise_text(F.col("t")), t=raw) == "a b\nc\n\nd"


def test_labels_and_tokens(spark):
    assert one(spark, X.normalise_label(F.col("t")), t=" Éngine—Fire_1 (no. 2) ") == "éngine fire_1 no 2"
    assert one(spark, X.normalise_label_ascii(F.col("t")), t="Éngine—Fire") == "ngine fire"
    assert sorted(one(spark, X.tokens(F.col("t")), t="The fire of the FIRE in an oil pump")) == ["fire", "oil", "pump"]


def _greedy(text: str, target: int, hard: int) -> list[str]:
    """Brute force over characters: paragraphs one by one, over-long ones cut at the last full stop."""
    result, current = [], ""
    for paragraph in [p.strip() for p in text.split("\n\n") if p.strip()]:
        if len(paragraph) > hard:
            result += [current] if current else []
            current = ""
            while paragraph:
                if len(paragraph) <= hard:
                    size = len(paragraph)
                else:
                    stops = [i + 1 for i in range(target, hard - 1) if paragraph[i : i + 2] == ". "]
                    size = stops[-1] if stops else hard
                result += [paragraph[:size].strip()] if paragraph[:size].strip() else []
                paragraph = paragraph[size:]
            continue
        grown = f"{current}\n\n{paragraph}" if current else paragraph
        if len(grown) > hard:
            result.append(current)
            current = paragraph
        elif len(grown) > target:
            result.append(grown)
            current = ""
        else:
            current = grown
    return result + ([current] if current else [])


def test_greedy_chunks_match_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        paragraphs = ["".join(rng.choice("abcdé.  ") for _ in range(rng.choice((3, 20, 45, 90, 200, 700)))) for _ in range(rng.randint(1, 8))]
        texts.append("\n\n".join(p.strip() or "x" for p in paragraphs))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    clean = X.normalise_text(F.col("t"))
    got = {r["i"]: (r["n"], r["c"]) for r in rows.select("i", clean.alias("n"), X.chunk_greedy(F.col("t"), 60, 90).alias("c")).collect()}
    for i in range(len(texts)):
        normal, chunks = got[i]
        assert chunks == _greedy(normal, 60, 90)
        assert all(0 < len(c) <= 90 for c in chunks)
        assert "".join("".join(chunks).split()) == "".join(normal.split())


def test_fixed_chunks_rebuild_the_text(spark):
    text = "\n\n".join(["a" * 10, "b" * 95, "c" * 30, "d" * 250])
    chunks = one(spark, X.chunk_fixed(F.col("t"), 100), t=text)
    assert chunks == ["a" * 10, "b" * 95, "c" * 30, "d" * 100, "d" * 100, "d" * 50]


def test_page_label_and_locations(spark):
    rows = spark.createDataFrame([("doc|3|3",), ("doc|0|3",), ("doc|5|3",), ("doc|a|3",), ("doc|3",), ("|1|2",)], "v string")
    parsed = rows.select("v", L.parse_location(F.col("v")).alias("l")).collect()
    assert [r["l"]["violation"] for r in parsed] == [
        None, "PAGE_NOT_POSITIVE", "PAGES_REVERSED", "PAGE_NOT_INTEGER", "WRONG_ARITY", "EMPTY_DOCUMENT",
    ]
    labels = spark.createDataFrame([(None, None), (3, None), (3, 3), (3, 5)], "a int, b int").select(X.page_label(F.col("a"), F.col("b")).alias("l"))
    assert [r["l"] for r in labels.collect()] == ["page unknown", "p. 3", "p. 3", "pp. 3–5"]


def test_clock_and_ranges(spark):
    rows = spark.createDataFrame([(589.0,), (-3.0,), (3661.5,)], "s double").select(L.clock(F.col("s")).alias("c"))
    assert [r["c"] for r in rows.collect()] == ["00:09:49", "00:00:00", "01:01:02"]
    text = "[00:05:28–00:05:34] a\n[00:01:00-00:02:00] b"
    assert tuple(one(spark, L.time_ranges(F.col("t")), t=text)) == (60.0, 334.0, None)
    assert one(spark, L.time_ranges(F.col("t")), t="none") is None
    assert one(spark, L.time_ranges(F.col("t")), t="[00:02:00–00:01:00]")["violation"] == "RANGE_REVERSED"
    assert one(spark, L.time_ranges(F.col("t")), t="[00:62:00–01:01:00]")["violation"] == "INVALID_CLOCK"


def test_explicit_time(spark):
    assert tuple(one(spark, L.explicit_time(F.col("t")), t="at 9.05 then 10:00")) == (545, "09:05")
    assert one(spark, L.explicit_time(F.col("t")), t="at 29:05 and 123:45") is None


def test_json_text(spark):
    payload = '{"id": 4, "segments": [{"text": " a "}, {"text": ""}, {"n": 1, "content": ["b", {"x": "c"}]}], "note": "skipped"}'
    assert one(spark, json_text(F.col("t")), t=payload) == "a\nb\nc"
    assert one(spark, json_text(F.col("t")), t='{"x": {"y": "deep"}, "z": "flat"}') == "deep\nflat"
    assert one(spark, json_text(F.col("t")), t="{broken") is None
