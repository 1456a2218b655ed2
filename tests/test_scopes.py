"""Rows of whole-case runs: all of them, and in an order that columnar files hold in little room."""

from __future__ import annotations

from collections import Counter

import pytest

from dossier.operators import retrieval as R


def _tables(spark, runs, documents):
    none = spark.createDataFrame([], "run_id string, document_id string")
    return spark.createDataFrame(runs, "run_id string, analysis_id string, scope_mode string"), none, spark.createDataFrame(documents, "analysis_id string, document_id string")


@pytest.mark.parametrize("block, by", [(R.SCOPE_BLOCK, R.RUN_BLOCK), (4, 8), (20, 8), (3, 64)])
def test_rows_of_whole_cases_are_all_pairs(spark, monkeypatch, block, by):
    """Null and repeated keys too, whatever the blocks are."""
    monkeypatch.setattr(R, "SCOPE_BLOCK", block)
    monkeypatch.setattr(R, "RUN_BLOCK", by)
    runs = [(f"r{k}" if k % 9 else None, f"a{k % 3}" if k % 11 else None, "whole_case " if k % 4 else None) for k in range(75)] + [("r1", "a1", "WHOLE_CASE"), ("alone", "a9", "WHOLE_CASE")]
    documents = [(f"a{k % 4}" if k % 7 else None, f"d{k}" if k % 13 else None) for k in range(60)] + [("a1", "d1"), ("a1", "d1")]
    expected = Counter((r, a, d) for r, a, _ in runs for b, d in set(documents) if a is not None and a == b)
    assert Counter(map(tuple, R.resolve_scope(*_tables(spark, runs, documents)).collect())) == expected


def test_rows_of_whole_cases_take_little_room(spark, tmp_path):
    """They grow with runs times documents, so a byte a row or more fills the disks: on 6 GB of documents there are tens of thousands of millions."""
    runs = [(f"run_{k * 7919 % 100_003}", "a", "WHOLE_CASE") for k in range(1003)]
    documents = [("a", f"doc_{k * 2_654_435_761 % 2**32:08x}{k * 40_503 % 65_521:04x}") for k in range(1500)]
    R.resolve_scope(*_tables(spark, runs, documents)).write.parquet(str(tmp_path / "out"))
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1003 * 1500
    assert size < 0.4 * 1003 * 1500, size
