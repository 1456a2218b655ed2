"""Packages of passages in which a phrase has no word of its own."""

from __future__ import annotations

from dossier.operators import retrieval as R


def test_phrases_without_words_are_counted_by_analysis(spark):
    passages = spark.createDataFrame(
        [("p1", "a", "storm on the deck"), ("p2", "a", "calm deck"), ("p3", "a", "engine off"), ("p4", "b", "storms of old")], "passage_id string, package_id string, passage_text string"
    )
    text = R._case_text(passages)
    named = spark.createDataFrame([("x", "on"), ("y", "on"), ("x", "storm"), ("y", "eck")], "analysis_id string, _phrase string")
    lists = spark.createDataFrame([("x", ["deck", "storm"]), ("y", ["engine", "calm"])], "analysis_id string, _terms array<string>")
    counted = R.phrase_counts(text, named, lists)
    # no terms of passages are among what is brought together
    assert counted.columns == ["package_id", "_phrase", "analysis_id", "passages"]
    assert {tuple(r) for r in counted.collect()} == {("a", "on", "x", 1), ("a", "storm", None, 1), ("a", "eck", "y", 1)}
