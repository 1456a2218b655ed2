"""Queries of chronology, timelines and recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.functions import locations as L
from dossier.operators import audio as A
from dossier.operators import chronology as C
from dossier.queries import bindings as B
from dossier.queries.registry import query


@query(
    r"""SELECT event_id, CASE WHEN m IS NOT NULL THEN split_part(m, ':', 1)::INT * 60 + split_part(m, ':', 2)::INT END::VARCHAR AS minutes, lpad(split_part(m, ':', 1), 2, '0') || ':' || split_part(m, ':', 2) AS time_label
    FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN strftime(ts, '%-H:%M') ELSE strftime(ts, '%H:%M') END AS m FROM events)"""
)
def explicit_times(spark: SparkSession, d: str) -> DataFrame:
    clock = "CASE WHEN event_id % 5 = 1 THEN date_format(ts, 'H.mm') ELSE date_format(ts, 'HH:mm') END"
    rows = B.table(spark, d, "events").selectExpr(
        "event_id", f"CASE WHEN event_id % 5 = 0 THEN '124:30 and 12:345 and 25.99' ELSE concat('Report 2024 at ', {clock}, ' then 23:59') END AS label"
    )
    t = L.explicit_time(F.col("label"))
    return rows.select("event_id", t["minutes"].cast("string").alias("minutes"), t["label"].alias("time_label"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user, on any day, by the clock time in their label."""
    events = B.table(spark, d, "events").selectExpr("concat('user_', user_id) AS analysis_id", "concat('n', event_id) AS node_id", "concat(event_type, ' at ', date_format(ts, 'HH:mm')) AS label")
    return C.timed_events(events, "label")


_TIMED = """timed AS (SELECT 'user_' || user_id AS analysis_id, 'n' || event_id AS node_id, hour(ts) * 60 + minute(ts) AS minutes FROM events),
    nxt AS (SELECT analysis_id, node_id AS source_node_id, lead(node_id) OVER w AS target_node_id, minutes, lead(minutes) OVER w AS later FROM timed WINDOW w AS (PARTITION BY analysis_id ORDER BY minutes, node_id)),
    existing AS (SELECT analysis_id, node_id AS source_node_id, lead(node_id) OVER (PARTITION BY analysis_id ORDER BY node_id) AS target_node_id FROM timed)"""


def _existing(spark: SparkSession, d: str) -> DataFrame:
    """Already known edges: every second event of a user is followed by the one with the next id."""
    rows = _timed(spark, d)
    from pyspark.sql import Window

    lead = F.lead("node_id").over(Window.partitionBy("analysis_id").orderBy("node_id"))
    return rows.select("analysis_id", F.col("node_id").alias("source_node_id"), F.lit("FOLLOWED_BY").alias("relationship"), lead.alias("target_node_id"))


@query(
    f"""WITH {_TIMED}, fresh AS (SELECT * FROM nxt WHERE later > minutes AND (analysis_id, source_node_id, target_node_id) NOT IN (SELECT (analysis_id, source_node_id, target_node_id) FROM existing WHERE target_node_id IS NOT NULL))
    SELECT analysis_id, source_node_id, target_node_id, 'analysis_edge_' || substr(sha256(analysis_id || '|' || source_node_id || '|FOLLOWED_BY|' || target_node_id || '|explicit-time'), 1, 24) AS edge_id FROM fresh"""
)
def followed_by_edges(spark: SparkSession, d: str) -> DataFrame:
    return C.followed_by_edges(_timed(spark, d), _existing(spark, d)).select("analysis_id", "source_node_id", "target_node_id", "edge_id")


@query(
    f"""WITH {_TIMED}, e AS (SELECT analysis_id, source_node_id, target_node_id, 'analysis_edge_' || substr(sha256(analysis_id || '|' || source_node_id || '|FOLLOWED_BY|' || target_node_id || '|explicit-time'), 1, 24) AS edge_id
        FROM nxt WHERE later > minutes) SELECT DISTINCT edge_id, passage_id FROM (SELECT edge_id, unnest([source_node_id, target_node_id]) AS node_id FROM e)
    JOIN (SELECT 'n' || event_id AS node_id, unnest(['p' || (event_id % 200), 'p' || (event_id % 31)]) AS passage_id FROM events) USING (node_id)"""
)
def chronology_evidence(spark: SparkSession, d: str) -> DataFrame:
    none = _existing(spark, d).where("target_node_id IS NULL")
    edges = C.followed_by_edges(_timed(spark, d), none)
    passages = B.table(spark, d, "events").selectExpr("concat('n', event_id) AS node_id", "explode(array(concat('p', event_id % 200), concat('p', event_id % 31))) AS passage_id")
    return C.edge_passages(edges, passages)


@query(
    f"""WITH {_TIMED}, f AS (SELECT analysis_id, min((minutes, node_id))[2] AS first FROM timed GROUP BY 1)
    SELECT analysis_id, 'ves_' || analysis_id AS source_node_id, first AS target_node_id, 'analysis_edge_' || substr(sha256(analysis_id || '|ves_' || analysis_id || '|INVOLVED_IN|' || first), 1, 24) AS edge_id FROM f"""
)
def first_event_edges(spark: SparkSession, d: str) -> DataFrame:
    timed = _timed(spark, d)
    subjects = timed.select("analysis_id").distinct().withColumn("subject_node_id", F.concat(F.lit("ves_"), "analysis_id"))
    return C.first_event_edge(timed, subjects, _existing(spark, d)).select("analysis_id", "source_node_id", "target_node_id", "edge_id")


@query(
    r"""SELECT passage_id FROM (SELECT passage_id, passage_text || [' The vessel left.', ' this ship and another vessel', ' vessels met the ship', ''][(passage_order % 4)::INT + 1] AS t FROM passages)
        WHERE regexp_matches(t, '(?i)\b(?:the|this)\s+(?:vessel|ship)\b') AND NOT regexp_matches(t, '(?i)\b(?:another|other)\s+(?:vessel|ship)\b|\bvessels\b|\bships\b')""",
    "passages",
)
def generic_vessel_passages(spark: SparkSession, d: str) -> DataFrame:
    extra = "concat(passage_text, element_at(array(' The vessel left.', ' this ship and another vessel', ' vessels met the ship', ''), cast(passage_order % 4 + 1 AS int))) AS passage_text"
    return C.generic_vessel_passages(B.passages(spark, d).selectExpr("passage_id", extra)).select("passage_id")


_PHASES = ("ACCIDENT_INITIATION", "", "ESCALATION", "LATER")


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").selectExpr(
        "event_id", "concat('user_', user_id) AS analysis_id", "CASE WHEN event_id % 29 = 0 THEN ' ' ELSE event_type END AS summary", "CASE WHEN event_id % 3 = 0 THEN '' ELSE 'FAILURE' END AS event_type",
        f"element_at({B._array(_PHASES)}, cast(event_id % 4 + 1 AS int)) AS phase", "element_at(array('ABSOLUTE', 'RELATIVE_AUDIO', 'ORDER_ONLY', 'ABSOLUTE', 'UNKNOWN'), cast(event_id % 5 + 1 AS int)) AS time_basis",
        "element_at(array('', 'RANGE', 'MINUTE', 'RELATIVE_AUDIO'), cast(event_id % 4 + 1 AS int)) AS time_precision",
        "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'noon' ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") END AS event_time_start",
        "CASE WHEN event_id % 7 = 0 THEN '2024-01-15T00:00:00' ELSE '' END AS event_time_end",
        "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '-1' ELSE cast(event_id % 100 AS string) END AS relative_start_s",
        "CASE WHEN event_id % 9 = 0 THEN '50.5' WHEN event_id % 10 = 1 THEN 'x' ELSE '' END AS relative_end_s", "ts AS created_at",
    )


_TIMELINE = f"""raw AS (SELECT event_id, 'user_' || user_id AS analysis_id, CASE WHEN event_id % 29 = 0 THEN '' ELSE event_type END AS summary, CASE WHEN event_id % 3 = 0 THEN 'EVENT' ELSE 'FAILURE' END AS event_type,
        CASE WHEN event_id % 4 = 1 THEN 'UNASSIGNED' ELSE {B._list(_PHASES)}[event_id % 4 + 1] END AS phase, ['ABSOLUTE', 'RELATIVE_AUDIO', 'ORDER_ONLY', 'ABSOLUTE', 'UNKNOWN'][event_id % 5 + 1] AS basis, ['', 'RANGE', 'MINUTE', 'RELATIVE_AUDIO'][event_id % 4 + 1] AS prec,
        CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'noon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS s, CASE WHEN event_id % 7 = 0 THEN '2024-01-15T00:00:00' ELSE '' END AS e,
        CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '-1' ELSE (event_id % 100)::VARCHAR END AS rs, CASE WHEN event_id % 9 = 0 THEN '50.5' WHEN event_id % 10 = 1 THEN 'x' ELSE '' END AS re, ts FROM events),
    typed AS (SELECT *, basis = 'ABSOLUTE' AS ab, basis = 'RELATIVE_AUDIO' AS rel, CASE WHEN basis = 'ABSOLUTE' THEN CASE WHEN prec = '' THEN 'MINUTE' ELSE prec END WHEN basis = 'RELATIVE_AUDIO' THEN CASE WHEN prec = '' THEN 'RELATIVE_AUDIO' ELSE prec END ELSE 'ORDER_ONLY' END AS precision_,
        try_cast(s AS TIMESTAMP) AS ts1, try_cast(e AS TIMESTAMP) AS ts2, try_cast(rs AS DOUBLE) AS r1, try_cast(re AS DOUBLE) AS r2 FROM raw)"""
_TIME_RULES = {
    "SUMMARY_MISSING": "summary = ''",
    "UNSUPPORTED_PHASE": f"phase NOT IN {S.TIMELINE_PHASES}",
    "UNSUPPORTED_BASIS": f"basis NOT IN {S.TIME_BASES}",
    "UNSUPPORTED_PRECISION": f"(ab AND precision_ NOT IN {S.ABSOLUTE_PRECISIONS}) OR (rel AND precision_ NOT IN {S.RELATIVE_PRECISIONS})",
    "START_MISSING": "(ab AND s = '') OR (rel AND r1 IS NULL)",
    "START_NOT_ISO": "ab AND s <> '' AND ts1 IS NULL",
    "END_NOT_VALID": "(ab AND e <> '' AND ts2 IS NULL) OR (rel AND re <> '' AND r2 IS NULL)",
    "END_BEFORE_START": "(ab AND ts2 < ts1) OR (rel AND r2 < r1)",
    "START_NEGATIVE": "rel AND r1 < 0",
}


@query(
    f"""WITH {_TIMELINE} SELECT event_id, summary, event_type, phase, basis AS time_basis, precision_ AS time_precision, CASE WHEN ab THEN strftime(ts1, '%Y-%m-%d %H:%M:%S') END AS event_time_start,
        CASE WHEN rel THEN r1 END AS relative_start_s, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _TIME_RULES.items())}], lambda x: x IS NOT NULL), ',') AS violations FROM typed"""
)
def normalised_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = C.normalise_timeline(_timeline(spark, d))
    return rows.select(
        "event_id", "summary", "event_type", "phase", "time_basis", "time_precision", F.date_format("event_time_start", "yyyy-MM-dd HH:mm:ss").alias("event_time_start"),
        "relative_start_s", F.array_join("violations", ",").alias("violations"),
    )


@query(
    f"""WITH {_TIMELINE} SELECT event_id, analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY CASE WHEN ab THEN 0 WHEN rel THEN 1 ELSE 2 END,
        CASE WHEN ab THEN coalesce(ts1, TIMESTAMP '9999-12-31 23:59:59') WHEN NOT rel THEN ts END NULLS FIRST, CASE WHEN rel THEN coalesce(r1, 'infinity'::DOUBLE) END NULLS FIRST, summary, event_id) AS timeline_position FROM typed"""
)
def ordered_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = _timeline(spark, d)
    normal = C.normalise_timeline(rows).join(rows.select("event_id", "created_at"), "event_id")
    return C.timeline_order(normal).select("event_id", "analysis_id", "timeline_position")


def _projectable(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events of each user with edges to the next event; every tenth user has a cycle of two events."""
    events = B.table(spark, d, "events").selectExpr(
        "concat('user_', user_id) AS analysis_id", "user_id", "event_id", "concat('n', event_id) AS node_id", "concat(event_type, ' ', event_id % 13) AS label",
        "cast(CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id * 37) % 101 END AS double) AS source_sequence_index",
        "CASE WHEN event_id % 6 = 0 THEN cast(hour(ts) * 60 + minute(ts) AS int) END AS explicit_time_minutes", "CASE WHEN event_id % 6 = 0 THEN date_format(ts, 'HH:mm') END AS explicit_time_label",
        "CASE WHEN event_id % 5 = 0 THEN array(concat('audio|', sha2('x', 256), '|', event_id % 50 * 1000, '|', event_id % 50 * 1000 + 900), 'audio|bad') ELSE cast(array() AS array<string>) END AS audio_evidence_locations",
        "event_id % 211 = 0 AS timeline_time_conflict", "ts",
    )
    from pyspark.sql import Window

    window = Window.partitionBy("user_id").orderBy("event_id")
    linked = events.select("analysis_id", "user_id", "event_id", "node_id", F.lead("node_id", 3).over(window).alias("next"), F.row_number().over(window).alias("rn"))
    forward = linked.where("next IS NOT NULL AND event_id % 3 = 0").selectExpr("analysis_id", "node_id AS source_node_id", "next AS target_node_id")
    back = linked.where("next IS NOT NULL AND event_id % 3 = 0 AND user_id % 10 = 0 AND rn > 20 AND rn < 25").selectExpr("analysis_id", "next AS source_node_id", "node_id AS target_node_id")
    return events.drop("ts", "user_id", "event_id"), forward.unionByName(back)


_PROJECTED = """ev AS (SELECT 'user_' || user_id AS analysis_id, user_id, event_id, 'n' || event_id AS node_id, event_type || ' ' || (event_id % 13) AS label,
        CASE WHEN event_id % 4 <> 0 THEN ((event_id * 37) % 101)::DOUBLE END AS seq, CASE WHEN event_id % 6 = 0 THEN hour(ts) * 60 + minute(ts) END AS minutes, CASE WHEN event_id % 6 = 0 THEN strftime(ts, '%H:%M') END AS clock,
        CASE WHEN event_id % 5 = 0 THEN (event_id % 50)::DOUBLE END AS audio, event_id % 211 = 0 AS conflict FROM events),
    led AS (SELECT *, lead(node_id, 3) OVER w AS nxt, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    links AS (SELECT analysis_id, node_id AS source, nxt AS target FROM led WHERE nxt IS NOT NULL AND event_id % 3 = 0
        UNION SELECT analysis_id, nxt, node_id FROM led WHERE nxt IS NOT NULL AND event_id % 3 = 0 AND user_id % 10 = 0 AND rn > 20 AND rn < 25),
    before AS (SELECT analysis_id, target AS node_id, list(source) AS preds FROM links GROUP BY 1, 2),
    ranked AS (SELECT ev.*, coalesce(preds, []) AS preds, row_number() OVER (PARTITION BY ev.analysis_id ORDER BY coalesce(seq, 'infinity'::DOUBLE), coalesce(minutes, 'infinity'::DOUBLE), coalesce(audio, 'infinity'::DOUBLE), lower(label), ev.node_id) AS rank
        FROM ev LEFT JOIN before USING (analysis_id, node_id)),
    walk AS (SELECT DISTINCT analysis_id, []::VARCHAR[] AS done FROM ev UNION ALL
        SELECT w.analysis_id, list_append(any_value(w.done), arg_min(r.node_id, r.rank)) FROM walk w JOIN ranked r ON r.analysis_id = w.analysis_id AND NOT list_contains(w.done, r.node_id) AND list_has_all(w.done, r.preds) GROUP BY w.analysis_id),
    orders AS (SELECT analysis_id, arg_max(done, len(done)) AS done FROM walk GROUP BY 1),
    linked AS (SELECT analysis_id, source AS node_id FROM links UNION SELECT analysis_id, target FROM links),
    projected AS (SELECT r.*, NOT list_contains(done, r.node_id) AS in_cycle, CASE WHEN clock IS NOT NULL THEN 'EXPLICIT_TIME' WHEN audio IS NOT NULL THEN 'RELATIVE_AUDIO' WHEN l.node_id IS NOT NULL THEN 'FOLLOWED_BY'
        WHEN seq IS NOT NULL THEN 'SOURCE_ORDER' ELSE 'UNRESOLVED_ORDER' END AS basis, row_number() OVER (PARTITION BY r.analysis_id ORDER BY coalesce(list_position(done, r.node_id), 1000000000), r.rank) AS position
        FROM ranked r JOIN orders USING (analysis_id) LEFT JOIN linked l ON l.analysis_id = r.analysis_id AND l.node_id = r.node_id)"""


@query(
    f"""WITH RECURSIVE {_PROJECTED} SELECT analysis_id, node_id, label, seq AS source_sequence_index, minutes::INT AS explicit_time_minutes, clock AS explicit_time_label, conflict AS timeline_time_conflict,
        audio AS relative_start_s, audio + 0.9 AS relative_end_s, position AS sequence_position, basis AS ordering_basis, in_cycle, conflict OR in_cycle AS ordering_conflict FROM projected"""
)
def projected_timeline(spark: SparkSession, d: str) -> DataFrame:
    return C.project_timeline(*_projectable(spark, d)).drop("audio_evidence_locations")


@query(
    f"""WITH RECURSIVE {_PROJECTED} SELECT analysis_id, 'FOLLOWED_BY_CYCLE' AS conflict_type, node_id FROM projected WHERE in_cycle
        UNION ALL SELECT analysis_id, 'MULTIPLE_EXPLICIT_TIMES', node_id FROM projected WHERE conflict"""
)
def timeline_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return C.timeline_conflicts(C.project_timeline(*_projectable(spark, d)))


@query(
    """WITH l AS (SELECT event_id, 'user_' || user_id AS analysis_id, 'n' || event_id AS node_id, event_type AS label, CASE WHEN event_id % 4 <> 0 THEN event_id % 50 END AS seq, CASE WHEN event_id % 8 = 0 THEN ('~', 1000000000)
        ELSE least(('d' || (event_id % 30), CASE WHEN event_id % 12 = 0 THEN 1000000000 ELSE event_id % 9 END), ('d' || (event_id % 17), 3)) END AS place FROM events)
    SELECT node_id, seq::DOUBLE AS source_sequence_index FROM l WHERE seq IS NOT NULL UNION ALL SELECT node_id, (row_number() OVER (PARTITION BY analysis_id ORDER BY place[1], place[2], label, node_id))::DOUBLE FROM l WHERE seq IS NULL"""
)
def sequence_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "events").selectExpr(
        "concat('user_', user_id) AS analysis_id", "concat('n', event_id) AS node_id", "event_type AS label", "cast(CASE WHEN event_id % 4 <> 0 THEN event_id % 50 END AS double) AS source_sequence_index",
        """CASE WHEN event_id % 8 = 0 THEN array('broken') ELSE array(concat('d', event_id % 30, '|', CASE WHEN event_id % 12 = 0 THEN '' ELSE cast(event_id % 9 AS string) END, '|'), concat('d', event_id % 17, '|3|4')) END AS evidence_locations""",
    )
    return C.sequence_fallback(rows).select("node_id", "source_sequence_index")


# --- recordings -----------------------------------------------------------------------------------------------

_MARK = "printf('[%02d:%02d:%02d–%02d:%02d:%02d] ', a // 3600, a // 60 % 60, a % 60, b // 3600, b // 60 % 60, b % 60)"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns with one or two time marks; every ninth mark is reversed and some turns have none."""

    def mark(a: str, b: str) -> str:
        return f"format_string('[%02d:%02d:%02d–%02d:%02d:%02d] ', {a} div 3600, {a} div 60 % 60, {a} % 60, {b} div 3600, {b} div 60 % 60, {b} % 60)"

    return B.table(spark, d, "conversations").selectExpr(
        "conv_id", "turn", "concat('conv_', conv_id) AS analysis_id", "concat('p', conv_id, '_', turn) AS passage_id",
        f"CASE WHEN turn % 5 = 2 THEN text ELSE concat({mark('((turn + 1) * 900 + conv_id)', '((turn + 1) * 900 + conv_id + 30 - CASE WHEN (turn + conv_id) % 9 = 0 THEN 60 ELSE 0 END)')}, text, '\\n', {mark('(turn * 600 + 5)', '(turn * 600 + 65)')}, 'end') END AS passage_text",
    )


_RANGES = """marks AS (SELECT conv_id, turn, 'conv_' || conv_id AS analysis_id, 'p' || conv_id || '_' || turn AS passage_id, (turn + 1) * 900 + conv_id AS a, (turn + 1) * 900 + conv_id + 30 - CASE WHEN (turn + conv_id) % 9 = 0 THEN 60 ELSE 0 END AS b,
        turn * 600 + 5 AS c, turn * 600 + 65 AS d FROM conversations WHERE turn % 5 <> 2),
    ranges AS (SELECT *, CASE WHEN b >= a THEN least(a, c) END::DOUBLE AS start_s, CASE WHEN b >= a THEN greatest(b, d) END::DOUBLE AS end_s, CASE WHEN b < a THEN 'RANGE_REVERSED' END AS violation FROM marks)"""


@query(f"WITH {_RANGES} SELECT passage_id, start_s, end_s, violation FROM ranges")
def time_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = _marked(spark, d)
    return rows.withColumn("r", L.time_ranges(F.col("passage_text"))).where("r IS NOT NULL").select("passage_id", "r.start_s", "r.end_s", "r.violation")


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "conversations").select("conv_id").distinct().selectExpr("concat('conv_', conv_id) AS analysis_id", "sha2(cast(conv_id AS string), 256) AS source_sha256", "CASE WHEN conv_id % 4 = 0 THEN ' ' ELSE concat('tape ', conv_id) END AS source_name")


_CLOCK = "printf('%02d:%02d:%02d', {c}::INT // 3600, {c}::INT // 60 % 60, {c}::INT % 60)"
_AUDIO = f"""{_RANGES}, located AS (SELECT analysis_id, passage_id, start_s, end_s, CASE WHEN violation IS NULL THEN 'audio|' || sha256(conv_id::VARCHAR) || '|' || (start_s * 1000)::BIGINT || '|' || (end_s * 1000)::BIGINT END AS audio_location,
        CASE WHEN violation IS NULL THEN CASE WHEN conv_id % 4 = 0 THEN 'Audio recording' ELSE 'tape ' || conv_id END || ' · ' || {_CLOCK.format(c='start_s')} || '–' || {_CLOCK.format(c='end_s')} END AS audio_reference, violation FROM ranges)"""


def _located(spark: SparkSession, d: str) -> DataFrame:
    rows = _marked(spark, d)
    return A.audio_locations(rows.select("analysis_id", "passage_id", "passage_text"), _recordings(spark, d))


@query(f"WITH {_AUDIO} SELECT * FROM located")
def audio_locations(spark: SparkSession, d: str) -> DataFrame:
    return _located(spark, d)


@query(
    f"""WITH {_AUDIO} SELECT passage_id, split_part(audio_location, '|', 2) AS source_sha256, split_part(audio_location, '|', 3)::DOUBLE / 1000 AS start_s, split_part(audio_location, '|', 4)::DOUBLE / 1000 AS end_s FROM located WHERE audio_location IS NOT NULL"""
)
def parsed_audio_locations(spark: SparkSession, d: str) -> DataFrame:
    rows = _located(spark, d).select("passage_id", L.parse_audio_location(F.col("audio_location")).alias("a"))
    return rows.where("a IS NOT NULL").select("passage_id", "a.*")


def _audio_items(spark: SparkSession, d: str) -> DataFrame:
    """Two items per turn, citing the turn, the next and the previous one."""
    return B.table(spark, d, "conversations").selectExpr(
        "concat('conv_', conv_id) AS analysis_id", "concat('i', conv_id, '_', turn) AS item_id", "array(concat('p', conv_id, '_', turn), concat('p', conv_id, '_', turn + 1), concat('p', conv_id, '_', turn - 1)) AS passage_ids",
        "array(concat('Report p. ', turn), 'Note') AS evidence_references",
    )


_CITED = """cited AS (SELECT 'conv_' || conv_id AS analysis_id, 'i' || conv_id || '_' || turn AS item_id, unnest([turn, turn + 1, turn - 1]) AS t, unnest([0, 1, 2]) AS pos, conv_id FROM conversations)"""


@query(f"WITH {_AUDIO}, {_CITED} SELECT item_id, audio_location, audio_reference, min(pos)::BIGINT AS first_position FROM cited JOIN located ON passage_id = 'p' || conv_id || '_' || t WHERE audio_location IS NOT NULL GROUP BY 1, 2, 3")
def audio_evidence(spark: SparkSession, d: str) -> DataFrame:
    return A.enrich_with_audio(_audio_items(spark, d), _located(spark, d)).drop("analysis_id")


@query(
    f"""WITH {_AUDIO}, {_CITED} SELECT item_id, audio_reference AS reference FROM cited JOIN located ON passage_id = 'p' || conv_id || '_' || t WHERE audio_location IS NOT NULL
    UNION SELECT 'i' || conv_id || '_' || turn, unnest(['Report p. ' || turn, 'Note']) FROM conversations"""
)
def merged_references(spark: SparkSession, d: str) -> DataFrame:
    items = _audio_items(spark, d)
    return A.merged_references(items, A.enrich_with_audio(items, _located(spark, d))).drop("analysis_id")


@query(
    """SELECT audio_source_id, segment_index, CASE WHEN s >= 0 THEN strftime(TIMESTAMP '2024-03-01 08:00:00' + to_microseconds((conv_id * 60000000 + round(s * 1000000))::BIGINT), '%Y-%m-%d %H:%M:%S.%f') END AS aligned_at, CASE WHEN s < 0 THEN 'OFFSET_NEGATIVE' END AS violation
    FROM (SELECT conv_id, audio_source_id, segment_index, start_seconds / 8 - 1 AS s FROM segments)""",
    "segments",
)
def aligned_segments(spark: SparkSession, d: str) -> DataFrame:
    segments = B.segments(spark, d)
    anchors = segments.select("conv_id", "audio_source_id").distinct().select("audio_source_id", F.timestamp_micros(F.unix_micros(F.lit("2024-03-01 08:00:00").cast("timestamp")) + F.col("conv_id") * 60_000_000).alias("anchor_time"))
    rows = A.align_offsets(segments.select("audio_source_id", "segment_index", (F.col("start_seconds") / 8 - 1).alias("start_seconds")), anchors)
    return rows.select("audio_source_id", "segment_index", F.date_format("aligned_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("aligned_at"), "violation")


@query(
    """SELECT 'analysis_' || (conv_id % 10) AS analysis_id, audio_source_id AS document_id, transcript_segment_id AS passage_id, segment_index + 1 AS passage_order, transcript_text AS passage_text,
        segment_text_sha256 AS text_sha256, CASE lower(language_expected) WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' ELSE 'UNKNOWN' END AS detected_language FROM segments""",
    "segments",
)
def bound_segments(spark: SparkSession, d: str) -> DataFrame:
    segments = B.segments(spark, d)
    analyses = segments.select("conv_id", "audio_source_id").distinct().selectExpr("audio_source_id", "concat('analysis_', conv_id % 10) AS analysis_id")
    return A.bind_segments(segments, analyses, "BINDING_1").drop("page_start", "page_end", "extraction_version")


@query(
    """SELECT audio_source_id, count(*) AS segments, 0::BIGINT AS null_text, 0::BIGINT AS missing_start, 0::BIGINT AS missing_end, count(*) FILTER (start_seconds < 0 OR end_seconds < start_seconds) AS invalid_range,
        count(*) FILTER (classification <> 'TYPE_D') AS wrong_class, count(*) FILTER (sha256(transcript_text) <> segment_text_sha256) AS hash_differs FROM segments GROUP BY 1""",
    "segments",
)
def segment_contract(spark: SparkSession, d: str) -> DataFrame:
    return A.segment_violations(B.segments(spark, d))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN round(value / [3, 9, 27][event_id % 4], 4) END AS real_time_factor FROM events")
def real_time_factors(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "events").selectExpr("event_id", "value AS elapsed_s", "element_at(array(0, 3, 9, 27), cast(event_id % 4 + 1 AS int)) AS duration_s")
    return A.real_time_factor(rows).select("event_id", "real_time_factor")


@query(
    """WITH r AS (SELECT 'run_' || conv_id AS run, conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'REJECTED' ELSE 'accepted' END AS decision, CASE WHEN conv_id % 13 = 0 THEN 'nohash' ELSE sha256(conv_id::VARCHAR) END AS source,
        CASE WHEN conv_id % 17 = 0 THEN ' ' ELSE text END AS t FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
    SELECT run AS transcription_run_id, CASE WHEN conv_id % 13 <> 0 AND conv_id % 17 <> 0 THEN 'doc_' || substr(sha256(source || '|turbo|' || sha256(t)), 1, 24) END AS document_id, 'tape_' || conv_id || ' — validated transcript.txt' AS filename,
        sha256(t) AS sha256, strlen(t) AS byte_size, array_to_string(list_filter([CASE WHEN conv_id % 13 = 0 THEN 'SOURCE_HASH_NOT_VALID' END, CASE WHEN conv_id % 17 = 0 THEN 'EMPTY_TRANSCRIPT' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM r WHERE decision = 'accepted'"""
)
def reviewed_transcripts(spark: SparkSession, d: str) -> DataFrame:
    reviews = B.table(spark, d, "conversations").selectExpr(
        "concat('run_', conv_id) AS transcription_run_id", "CASE WHEN turn % 4 = 3 THEN 'REJECTED' ELSE 'accepted' END AS decision", "turn AS reviewed_at",
        "CASE WHEN conv_id % 13 = 0 THEN 'nohash' ELSE upper(sha2(cast(conv_id AS string), 256)) END AS source_sha256", "concat('/audio/tape_', conv_id, '.wav') AS source_name", "'Turbo' AS model",
        "CASE WHEN conv_id % 17 = 0 THEN ' ' ELSE text END AS reviewed_text",
    )
    return A.reviewed_transcripts(reviews).select("transcription_run_id", "document_id", "filename", "sha256", "byte_size", "violations")


@query(
    """SELECT DISTINCT 'req_' || conv_id || '_' || m.model AS request_id, EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = c.conv_id AND t.role = 'system' AND m.model = 'turbo') AS reusable
    FROM conversations c, (VALUES ('turbo'), ('large')) m(model)"""
)
def reusable_transcripts(spark: SparkSession, d: str) -> DataFrame:
    turns = B.table(spark, d, "conversations")
    requests = turns.select("conv_id").distinct().selectExpr("conv_id", "explode(array('turbo', 'large')) AS model").selectExpr(
        "concat('req_', conv_id, '_', model) AS request_id", "upper(sha2(cast(conv_id AS string), 256)) AS source_sha256", "model"
    )
    transcripts = turns.selectExpr(
        "sha2(cast(conv_id AS string), 256) AS source_sha256", "'turbo' AS model", "'D' AS classification", "CASE WHEN role = 'system' THEN 'MACHINE_GENERATED_UNVERIFIED' ELSE 'FAILED' END AS status"
    )
    return A.reusable_transcripts(requests, transcripts).select("request_id", "reusable")
