"""Analyses ordered in buckets equal analyses ordered one by one."""

from __future__ import annotations

from dossier.operators import chronology as C


def test_small_analyses_share_a_call(spark, monkeypatch):
    events = spark.range(400).selectExpr(
        "CASE WHEN id % 23 <> 0 THEN concat('a', id % 40) END AS analysis_id", "concat('n', id) AS node_id", "concat('l', id % 3) AS label",
        "CASE WHEN id % 4 <> 0 THEN cast(id * 37 % 11 AS double) END AS source_sequence_index", "cast(NULL AS int) AS explicit_time_minutes",
        "cast(NULL AS string) AS explicit_time_label", "cast(array() AS array<string>) AS audio_evidence_locations", "false AS timeline_time_conflict",
    )
    links = spark.range(360).where("id % 3 = 0").selectExpr("concat('a', id % 40) AS analysis_id", "concat('n', id + 40) AS source_node_id", "concat('n', id) AS target_node_id")
    found = []
    for rows in (20_000, 60, 1):
        monkeypatch.setattr(C, "BUCKET_ROWS", rows)
        placed = C.project_timeline(events, links)
        found.append(sorted((r.analysis_id, r.sequence_position, r.node_id, r.in_cycle) for r in placed.collect()))
        calls = C._order_per_group(C._prioritised(events), C._valid_links(C._prioritised(events), links))
        assert "_bucket" in calls._jdf.queryExecution().analyzed().toString()
    assert len(found[0]) == 400 - 18 and found[0] == found[1] == found[2]
