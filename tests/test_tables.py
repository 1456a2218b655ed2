from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.operators.graph import write_graph
from dossier.sources import tables
from dossier.sources.files import discover_files, read_registry
from dossier.sources.transcripts import read_transcript_json


def test_a_changed_table_goes_to_a_folder_of_its_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    first = tables.write_new(rows, str(tmp_path / "t1"))
    changed = tables.upsert(spark.read.parquet(first), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    second = tables.write_new(changed, str(tmp_path / "t2"))
    assert sorted(tuple(r) for r in spark.read.parquet(second).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(AnalysisException):
        tables.write_new(rows, first)


def test_append_conforms_and_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    schema = T.StructType([T.StructField("a", T.StringType(), False), T.StructField("n", T.LongType()), T.StructField("note", T.StringType())])
    tables.append(spark.createDataFrame([("x", 1), ("y", 2)], "a string, n int"), path, schema, ["a"])
    tables.append(spark.createDataFrame([("x", 5)], "a string, n int"), path, schema, ["a"])
    assert spark.read.parquet(path).count() == 3
    tables.overwrite_partitions(spark.createDataFrame([("x", 9, None)], "a string, n long, note string"), path, ["a"])
    assert sorted((r["a"], r["n"]) for r in spark.read.parquet(path).collect()) == [("x", 9), ("y", 2)]


def test_discovery_registry_and_transcripts(spark, tmp_path):
    root = tmp_path / "in"
    (root / "keep").mkdir(parents=True)
    (root / "reserved").mkdir()
    (root / "keep" / "A.TXT").write_text("one")
    (root / "keep" / "manifest.json").write_text("{}")
    (root / "keep" / "x.bin").write_text("no")
    (root / "reserved" / "b.txt").write_text("two")
    found = discover_files(spark, str(root), reserved=["reserved"]).collect()
    assert [(r["original_filename"], r["source_type"], r["byte_size"]) for r in found] == [("A.TXT", "TXT", 3)]
    assert found[0]["document_id"] == "doc_" + found[0]["sha256"][:24]
    registry = tmp_path / "r.json"
    registry.write_text(json.dumps({"registry_version": "v", "sources": [{"registry_key": "k1", "language": "EN"}, {"registry_key": "k2"}]}, indent=1))
    assert [(r["registry_version"], r["registry_key"]) for r in read_registry(spark, str(registry)).orderBy("registry_key").collect()] == [("v", "k1"), ("v", "k2")]
    transcript = tmp_path / "t.json"
    transcript.write_text(json.dumps({"response": {"duration_seconds": 9.5, "segments": [{"start": 0, "end": 1.5, "speaker_id": "S1", "text": "hi"}, {"start": 2, "end": 3, "text": "you"}]}}, indent=1))
    segments = read_transcript_json(spark, str(transcript)).orderBy("segment_index").collect()
    assert [(s["segment_index"], s["start_seconds"], s["end_seconds"], s["speaker_id"], s["transcript_text"]) for s in segments] == [(0, 0.0, 1.5, "S1", "hi"), (1, 2.0, 3.0, None, "you")]


def test_graph_is_partitioned_by_analysis(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "n1"), ("b", "n2")], "analysis_id string, node_id string")
    edges = spark.createDataFrame([("a", "e1")], "analysis_id string, edge_id string")
    folder, _ = write_graph(nodes, edges, str(tmp_path / "g"))
    plan = spark.read.parquet(folder).where(F.col("analysis_id") == "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(analysis_id" in plan
