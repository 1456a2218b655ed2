"""Queries of candidate resolution, coverage and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import coverage as C
from dossier.operators import provenance as P
from dossier.queries import bindings as B
from dossier.queries.registry import query

_RELATIONSHIPS = ("FOLLOWED_BY", "CONTRIBUTED_TO", "RESULTED_IN", "AFFECTED", "SUPPORTS", "INVOLVED_IN")


@query(
    """WITH RECURSIVE o AS (SELECT analysis_id, document_id, passage_order, passage_id, length(passage_text) + 250 AS cost,
        row_number() OVER (PARTITION BY analysis_id ORDER BY document_id, passage_order, passage_id) AS position FROM passages),
    walk AS (SELECT analysis_id, passage_id, position, cost, 1::BIGINT AS batch, 1 AS items, cost AS total FROM o WHERE position = 1
        UNION ALL SELECT o.analysis_id, o.passage_id, o.position, o.cost, CASE WHEN items >= 8 OR total + o.cost > 14000 THEN batch + 1 ELSE batch END,
            CASE WHEN items >= 8 OR total + o.cost > 14000 THEN 1 ELSE items + 1 END, CASE WHEN items >= 8 OR total + o.cost > 14000 THEN o.cost ELSE total + o.cost END
        FROM walk JOIN o ON o.analysis_id = walk.analysis_id AND o.position = walk.position + 1)
    SELECT analysis_id, passage_id, position, batch FROM walk""",
    "passages",
)
def packed_batches(spark: SparkSession, d: str) -> DataFrame:
    return C.pack_batches(B.passages(spark, d)).select("analysis_id", "passage_id", "position", "batch")


_VALID = f"""valid AS (SELECT * REPLACE (CASE WHEN evidence_class = 'OTHER' THEN 'NORMALISED' ELSE evidence_class END AS evidence_class) FROM candidates WHERE node_kind IN {tuple(B.KINDS)} AND label <> '')"""


@query(f"WITH {_VALID} SELECT candidate_id, node_kind, label, evidence_class FROM valid", "candidates")
def validated_candidates(spark: SparkSession, d: str) -> DataFrame:
    return C.validate_candidates(B.candidates(spark, d)).select("candidate_id", "node_kind", "label", "evidence_class")


@query(
    f"""WITH {_VALID} SELECT candidate_relationship_id, relationship, CASE WHEN evidence_class = 'OTHER' THEN 'NORMALISED' ELSE evidence_class END AS evidence_class FROM candidate_relationships r
        WHERE relationship IN {_RELATIONSHIPS} AND EXISTS (SELECT 1 FROM valid v WHERE v.candidate_id = r.source_candidate_id AND v.extraction_batch = r.extraction_batch AND v.analysis_id = r.analysis_id)
        AND EXISTS (SELECT 1 FROM valid v WHERE v.candidate_id = r.target_candidate_id AND v.extraction_batch = r.extraction_batch AND v.analysis_id = r.analysis_id)""",
    "candidates", "candidate_relationships",
)
def validated_relationships(spark: SparkSession, d: str) -> DataFrame:
    valid = C.validate_relationships(B.candidate_relationships(spark, d), B.candidates(spark, d))
    return valid.select("candidate_relationship_id", "relationship", "evidence_class")


_BACKED = "LEFT JOIN (SELECT analysis_id, candidate_id, unnest(passage_ids) AS passage_id FROM candidates) c ON c.analysis_id = m.analysis_id AND c.candidate_id = m.candidate_id"


@query(
    f"""SELECT m.analysis_id, m.model_run_id, m.node_kind, m.node_id, min(trim(label)) AS label, count(DISTINCT m.candidate_id) AS members, count(DISTINCT c.passage_id) AS passages
        FROM members m {_BACKED} GROUP BY 1, 2, 3, 4""",
    "members", "candidates",
)
def resolved_nodes(spark: SparkSession, d: str) -> DataFrame:
    return C.resolve_nodes(B.assignments(spark, d), B.candidates(spark, d))


@query(f"SELECT DISTINCT m.node_id, c.passage_id FROM members m {_BACKED} WHERE c.passage_id IS NOT NULL", "members", "candidates")
def node_evidence(spark: SparkSession, d: str) -> DataFrame:
    return C.node_evidence(B.assignments(spark, d), B.candidates(spark, d)).select("node_id", "passage_id")


def _proposed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One proposed edge per candidate relationship between the resolutions of its ends, with two supports."""
    relationships = B.candidate_relationships(spark, d)
    owner = B.assignments(spark, d).groupBy("analysis_id", "candidate_id").agg(F.min("resolution_id").alias("_r"))
    proposed = relationships.selectExpr("event_id", "analysis_id", "concat('p', event_id) AS proposed_id", "relationship", "source_candidate_id", "target_candidate_id")
    for side in ("source", "target"):
        ends = owner.select("analysis_id", F.col("candidate_id").alias(f"{side}_candidate_id"), F.col("_r").alias(f"{side}_resolution_id"))
        proposed = proposed.join(ends, ["analysis_id", f"{side}_candidate_id"])
    supports = relationships.selectExpr(
        "analysis_id", "concat('p', event_id) AS proposed_id", "posexplode(array(concat('cr', event_id + 1), concat('cr', event_id + event_id % 2))) AS (position, candidate_relationship_id)"
    )
    return proposed, supports, relationships


@query(
    f"""WITH owner AS (SELECT analysis_id, candidate_id, min(resolution_id) AS r FROM assignments GROUP BY 1, 2),
    proposed AS (SELECT c.analysis_id, 'p' || event_id AS proposed_id, event_id, relationship, s.r AS sr, t.r AS tr FROM candidate_relationships c JOIN owner s ON s.analysis_id = c.analysis_id AND s.candidate_id = c.source_candidate_id
        JOIN owner t ON t.analysis_id = c.analysis_id AND t.candidate_id = c.target_candidate_id),
    sup AS (SELECT event_id, analysis_id, 0 AS position, 'cr' || (event_id + 1) AS cr FROM candidate_relationships UNION ALL SELECT event_id, analysis_id, 1, 'cr' || (event_id + event_id % 2) FROM candidate_relationships),
    facts AS (SELECT s.event_id, count(DISTINCT s.cr) AS supports, bool_or(r.relationship = p.relationship) AS typed, bool_or(r.evidence_class = 'DIRECT') AS direct, arg_min(r.evidence_class, (position, r.evidence_class)) AS cls
        FROM sup s JOIN candidate_relationships r ON r.candidate_relationship_id = s.cr AND r.analysis_id = s.analysis_id JOIN proposed p ON p.event_id = s.event_id GROUP BY 1),
    ends AS (SELECT DISTINCT analysis_id, resolution_id, node_id FROM members)
    SELECT proposed_id, a.node_id AS source_node_id, relationship, b.node_id AS target_node_id, supports, CASE WHEN direct THEN 'DIRECT' ELSE cls END AS evidence_class,
        'analysis_edge_' || substr(sha256(p.analysis_id || '|' || a.node_id || '|' || relationship || '|' || b.node_id), 1, 24) AS edge_id
    FROM proposed p JOIN facts USING (event_id) JOIN ends a ON a.analysis_id = p.analysis_id AND a.resolution_id = p.sr JOIN ends b ON b.analysis_id = p.analysis_id AND b.resolution_id = p.tr
    WHERE typed AND relationship IN {_RELATIONSHIPS}""",
    "members", "candidate_relationships",
)
def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    proposed, supports, relationships = _proposed(spark, d)
    edges = C.resolve_edges(proposed, supports, relationships, C.member_nodes(B.assignments(spark, d)))
    return edges.select("proposed_id", "source_node_id", "relationship", "target_node_id", "supports", "evidence_class", "edge_id")


_MAPPED = f"""ends AS (SELECT DISTINCT analysis_id, candidate_id, node_id FROM members),
    mapped AS (SELECT r.*, a.node_id AS source_node_id, b.node_id AS target_node_id FROM candidate_relationships r JOIN ends a ON a.analysis_id = r.analysis_id AND a.candidate_id = r.source_candidate_id
        JOIN ends b ON b.analysis_id = r.analysis_id AND b.candidate_id = r.target_candidate_id WHERE relationship IN {_RELATIONSHIPS})"""
_EDGE = "'edge_' || substr(sha256(analysis_id || '|' || source_node_id || '|' || relationship || '|' || target_node_id), 1, 24) AS edge_id"


@query(
    f"""WITH {_MAPPED} SELECT {_EDGE}, source_node_id, relationship, target_node_id, count(DISTINCT candidate_relationship_id) AS candidate_relationships, count(DISTINCT p) AS passages,
        array_to_string(list_sort(list_distinct(list(CASE WHEN evidence_class = 'OTHER' THEN 'NORMALISED' ELSE evidence_class END))), ',') AS evidence_classes, source_node_id = target_node_id AS self_relation
        FROM (SELECT *, unnest(passage_ids) AS p FROM mapped) GROUP BY analysis_id, source_node_id, relationship, target_node_id""",
    "members", "candidate_relationships",
)
def grouped_edges(spark: SparkSession, d: str) -> DataFrame:
    return C.group_edges(B.candidate_relationships(spark, d), C.member_nodes(B.assignments(spark, d))).drop("analysis_id")


@query(f"WITH {_MAPPED} SELECT DISTINCT {_EDGE}, unnest(passage_ids) AS passage_id FROM mapped", "members", "candidate_relationships")
def grouped_edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    return C.group_edge_evidence(B.candidate_relationships(spark, d), C.member_nodes(B.assignments(spark, d))).drop("analysis_id")


@query(
    f"""WITH m AS (SELECT analysis_id, candidate_id, count(DISTINCT resolution_id) AS owners, min(node_kind) AS lo, max(node_kind) AS hi FROM assignments GROUP BY 1, 2),
    both_ AS (SELECT coalesce(c.analysis_id, m.analysis_id) AS analysis_id, coalesce(c.candidate_id, m.candidate_id) AS key, c.candidate_id IS NOT NULL AS known, m.candidate_id IS NOT NULL AS mapped, owners, lo, hi,
        CASE WHEN c.event_id % 101 = 0 THEN 'Other' ELSE c.node_kind END AS kind FROM candidates c FULL JOIN m ON m.analysis_id = c.analysis_id AND m.candidate_id = c.candidate_id)
    SELECT analysis_id, key, unnest(list_filter([CASE WHEN known AND NOT mapped THEN 'CANDIDATE_NOT_MAPPED' END, CASE WHEN known AND owners > 1 THEN 'CANDIDATE_MAPPED_TWICE' END, CASE WHEN NOT known THEN 'UNKNOWN_MEMBER' END,
        CASE WHEN known AND mapped AND (lo <> kind OR hi <> kind) THEN 'KIND_DIFFERS' END], lambda x: x IS NOT NULL)) AS rule FROM both_
    UNION ALL SELECT r.analysis_id, candidate_relationship_id, unnest(list_filter([CASE WHEN relationship NOT IN {_RELATIONSHIPS} THEN 'RELATIONSHIP_TYPE_NOT_ALLOWED' END, CASE WHEN s.candidate_id IS NULL THEN 'SOURCE_NOT_MAPPED' END,
        CASE WHEN t.candidate_id IS NULL THEN 'TARGET_NOT_MAPPED' END], lambda x: x IS NOT NULL)) FROM candidate_relationships r LEFT JOIN m s ON s.analysis_id = r.analysis_id AND s.candidate_id = r.source_candidate_id
        LEFT JOIN m t ON t.analysis_id = r.analysis_id AND t.candidate_id = r.target_candidate_id""",
    "candidates", "assignments", "candidate_relationships",
)
def coverage_contract(spark: SparkSession, d: str) -> DataFrame:
    candidates = B.candidates(spark, d).withColumn("node_kind", F.expr("CASE WHEN event_id % 101 = 0 THEN 'Other' ELSE node_kind END"))
    return C.coverage_violations(B.assignments(spark, d), candidates, B.candidate_relationships(spark, d))


@query(
    """WITH ends AS (SELECT analysis_id, source_candidate_id AS candidate_id FROM candidate_relationships UNION SELECT analysis_id, target_candidate_id FROM candidate_relationships),
    open AS (SELECT * FROM ends ANTI JOIN (SELECT analysis_id, candidate_id FROM members WHERE node_kind IN ('Event', 'Finding')) USING (analysis_id, candidate_id))
    SELECT o.candidate_id, CASE WHEN node_kind IN ('Actor', 'Vessel', 'System', 'Claim') THEN 'support_node_' || substr(sha256(o.analysis_id || '|passthrough|' || node_kind || '|' || o.candidate_id || '|' || trim(label)), 1, 24) END AS node_id,
        node_kind, trim(coalesce(label, o.candidate_id)) AS label, CASE WHEN node_kind IS NULL THEN 'UNKNOWN_CANDIDATE' WHEN node_kind NOT IN ('Actor', 'Vessel', 'System', 'Claim') THEN 'KIND_NOT_SUPPORTED' END AS violation
    FROM open o LEFT JOIN candidates c ON c.analysis_id = o.analysis_id AND c.candidate_id = o.candidate_id""",
    "members", "candidates", "candidate_relationships",
)
def passthrough_nodes(spark: SparkSession, d: str) -> DataFrame:
    members = C.member_nodes(B.assignments(spark, d).where("node_kind IN ('Event', 'Finding')"))
    return C.passthrough_nodes(B.candidate_relationships(spark, d), members, B.candidates(spark, d)).drop("analysis_id")


def _published(spark: SparkSession, d: str) -> DataFrame:
    """Published graph: the resolved nodes with their label in other punctuation."""
    return C.resolve_nodes(B.assignments(spark, d), B.candidates(spark, d)).withColumn(
        "label", F.upper(F.replace("label", F.lit(" "), F.lit("--")))
    )


_PUBLISHED = "published AS (SELECT analysis_id, node_kind, node_id, min(trim(label)) AS label FROM members GROUP BY 1, 2, 3, model_run_id)"


@query(
    f"""WITH {_PUBLISHED} SELECT analysis_id, node_kind, coalesce(c, 0) AS candidates, coalesce(p, 0) AS published, coalesce(c, 0) - coalesce(p, 0) AS count_delta
        FROM (SELECT analysis_id, node_kind, count(*) AS c FROM candidates GROUP BY 1, 2) FULL JOIN (SELECT analysis_id, node_kind, count(*) AS p FROM published GROUP BY 1, 2) USING (analysis_id, node_kind)""",
    "candidates", "members",
)
def coverage_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage_by_kind(B.candidates(spark, d), _published(spark, d))


@query(
    f"""WITH {_PUBLISHED}, keys AS (SELECT DISTINCT analysis_id, node_kind, lower(label) AS l FROM published) SELECT c.candidate_id, k.l IS NOT NULL AS exact_label_match FROM candidates c
        LEFT JOIN keys k ON k.analysis_id = c.analysis_id AND k.node_kind = c.node_kind AND k.l = lower(trim(c.label)) AND c.label <> ''""",
    "candidates", "members",
)
def coverage_matches(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage_matches(B.candidates(spark, d), _published(spark, d)).select("candidate_id", "exact_label_match")


@query(
    """WITH items AS (SELECT 'item' || (doc_id // 3) AS item_id, passage_id, passage_order * 1000 + doc_id AS ord FROM passages),
    loc AS (SELECT item_id, p.document_id, p.page_start, p.page_end, min(rn) AS pos FROM (SELECT item_id, passage_id, row_number() OVER (PARTITION BY item_id ORDER BY ord, passage_id) AS rn FROM items) JOIN passages p USING (passage_id) GROUP BY 1, 2, 3, 4)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS reference_position, filename || ' · ' || CASE WHEN page_start IS NULL THEN 'page unknown' WHEN page_end IS NULL OR page_end = page_start THEN 'p. ' || page_start
        ELSE 'pp. ' || page_start || '–' || page_end END AS evidence_reference, document_id || '|' || coalesce(page_start::VARCHAR, '') || '|' || coalesce(page_end::VARCHAR, '') AS evidence_location
    FROM loc JOIN docs USING (document_id)""",
    "docs", "passages",
)
def item_references(spark: SparkSession, d: str) -> DataFrame:
    """Items that cite all passages of three documents, in an order that mixes them."""
    passages = B.passages(spark, d)
    cited = F.transform(F.array_sort(F.collect_list(F.struct((F.col("passage_order") * 1000 + F.col("doc_id")).alias("o"), "passage_id"))), lambda x: x["passage_id"])
    items = passages.groupBy(F.expr("concat('item', doc_id div 3)").alias("item_id")).agg(cited.alias("passage_ids"))
    return C.references_for(items, passages, B.docs(spark, d))


# --- provenance ---------------------------------------------------------------------------------------------

_KEYS = "CASE event_id % 7 WHEN 0 THEN 'd' || event_id || '|3' WHEN 1 THEN ' |2|3' WHEN 2 THEN 'd1|x|3' WHEN 3 THEN 'd' || (event_id % 40) || '|0|' || (event_id % 5) WHEN 4 THEN 'd2|9|' || (event_id % 12) ELSE ' d' || (event_id % 40) || '|' || (event_id % 9 + 1) || '| ' || (event_id % 9 + 1 + event_id % 3) END"


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").selectExpr("concat('run_', event_id % 50) AS run_id", "event_id", f"{_KEYS} AS location")


_PARSED = f"""keys AS (SELECT event_id, 'run_' || (event_id % 50) AS run_id, {_KEYS} AS location FROM events),
    parts AS (SELECT *, string_split(trim(location), '|') AS s FROM keys),
    parsed AS (SELECT event_id, run_id, location, trim(s[1]) AS doc, try_cast(s[2] AS INT) AS a, try_cast(s[3] AS INT) AS b, len(s) AS n FROM parts),
    checked AS (SELECT *, CASE WHEN n <> 3 THEN 'WRONG_ARITY' WHEN doc = '' THEN 'EMPTY_DOCUMENT' WHEN a IS NULL OR b IS NULL THEN 'PAGE_NOT_INTEGER' WHEN a < 1 OR b < 1 THEN 'PAGE_NOT_POSITIVE' WHEN b < a THEN 'PAGES_REVERSED' END AS violation FROM parsed)"""


@query(
    f"WITH {_PARSED} SELECT event_id, CASE WHEN violation IS NULL THEN doc END AS document_id, CASE WHEN violation IS NULL THEN doc || '|' || a || '|' || b END AS formatted, violation FROM checked"
)
def parsed_locations(spark: SparkSession, d: str) -> DataFrame:
    from dossier.functions.locations import format_location

    rows = P.parse_locations(_keys(spark, d), "location")
    text = F.when(F.col("violation").isNull(), format_location(F.col("document_id"), F.col("page_start"), F.col("page_end")))
    return rows.select("event_id", "document_id", text.alias("formatted"), "violation")


@query(f"WITH {_PARSED} SELECT run_id, location, doc AS document_id FROM checked WHERE violation IS NULL AND NOT EXISTS (SELECT 1 FROM events e WHERE 'run_' || (e.event_id % 50) = run_id AND 'd' || (e.event_id % 31) = doc AND e.event_type = 'click')")
def locations_outside_scope(spark: SparkSession, d: str) -> DataFrame:
    allowed = B.table(spark, d, "events").where("event_type = 'click'").selectExpr("concat('run_', event_id % 50) AS run_id", "concat('d', event_id % 31) AS document_id")
    return P.locations_outside_scope(_keys(spark, d), allowed)


@query(
    """WITH loc AS (SELECT 'run_' || (event_id % 20) AS run_id, 'd' || (event_id % 25) || '|' || (event_id % 6) || '|' || CASE WHEN event_id % 4 = 0 THEN '' ELSE (event_id % 8)::VARCHAR END AS location, 'd' || (event_id % 25) AS doc,
        event_id % 6 AS a, CASE WHEN event_id % 4 = 0 THEN event_id % 6 ELSE event_id % 8 END AS b FROM events),
    backed AS (SELECT DISTINCT 'run_' || (event_id % 20) AS run_id, 'd' || (event_id % 25) AS doc, (event_id * 7) % 6 AS a, CASE WHEN event_id % 3 = 0 THEN (event_id * 7) % 6 ELSE event_id % 8 END AS b FROM events)
    SELECT run_id, location FROM loc ANTI JOIN backed USING (run_id, doc, a, b)"""
)
def locations_without_passage(spark: SparkSession, d: str) -> DataFrame:
    events = B.table(spark, d, "events")
    locations = events.selectExpr(
        "concat('run_', event_id % 20) AS run_id", "concat('d', event_id % 25, '|', event_id % 6, '|', CASE WHEN event_id % 4 = 0 THEN '' ELSE cast(event_id % 8 AS string) END) AS location"
    )
    passages = events.selectExpr(
        "concat('run_', event_id % 20) AS run_id", "concat('d', event_id % 25) AS document_id", "cast((event_id * 7) % 6 AS int) AS page_start", "cast(CASE WHEN event_id % 3 <> 0 THEN event_id % 8 END AS int) AS page_end"
    )
    return P.locations_without_passage(locations, passages)


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Answers of two models per user; their citations come from the events of the user."""
    events = B.table(spark, d, "events")
    run = "concat('run_', user_id) AS run_id"
    model = "element_at(array('MODEL_A', 'MODEL_B'), cast(event_id % 2 + 1 AS int)) AS model_key"
    answers = events.groupBy("user_id").agg(F.max("value").alias("v")).selectExpr(
        run, "user_id", "v", "explode(array('MODEL_A', 'MODEL_B')) AS model_key"
    ).selectExpr("run_id", "model_key", "user_id % 2 = 0 AS reference_requested", "user_id % 9 = 0 AS no_support", "CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('Answer to a.b@example.org ', user_id) END AS answer", "user_id % 8 = 0 AS insufficient")
    citations = events.where("value > 120").selectExpr(
        run, model, "event_id", "user_id",
        "CASE WHEN event_id % 3 = 0 THEN 'REFERENCE' ELSE 'SOURCE' END AS own_layer", "concat('p', event_id % 50) AS passage_id",
    ).selectExpr("run_id", "model_key", "passage_id", "explode(CASE WHEN event_id % 13 = 0 THEN array(own_layer) ELSE array(own_layer, 'COMBINED') END) AS layer")
    scope = events.where("event_type <> 'signup'").selectExpr(run, "concat('p', event_id % 50) AS passage_id")
    reference = events.where("event_type = 'view'").selectExpr("concat('p', event_id % 45) AS passage_id")
    snapshots = events.where("user_id % 5 <> 0 AND event_type <> 'error'").selectExpr(run, "CASE WHEN event_id % 3 = 0 THEN 'REFERENCE' ELSE 'SOURCE' END AS layer", "concat('p', event_id % 50) AS passage_id")
    return answers, citations, scope, reference, snapshots


_ANSWERS = """answers AS (SELECT DISTINCT 'run_' || user_id AS run_id, user_id, m.model_key FROM events, (VALUES ('MODEL_A'), ('MODEL_B')) m(model_key)),
    raw AS (SELECT 'run_' || user_id AS run_id, ['MODEL_A', 'MODEL_B'][event_id % 2 + 1] AS model_key, event_id, CASE WHEN event_id % 3 = 0 THEN 'REFERENCE' ELSE 'SOURCE' END AS layer, 'p' || (event_id % 50) AS passage_id FROM events WHERE value > 120),
    citations AS (SELECT DISTINCT run_id, model_key, layer, passage_id FROM raw UNION SELECT run_id, model_key, 'COMBINED', passage_id FROM raw WHERE event_id % 13 <> 0),
    scope AS (SELECT DISTINCT 'run_' || user_id AS run_id, 'p' || (event_id % 50) AS passage_id FROM events WHERE event_type <> 'signup'),
    reference AS (SELECT DISTINCT 'p' || (event_id % 45) AS passage_id FROM events WHERE event_type = 'view'),
    snaps AS (SELECT DISTINCT 'run_' || user_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 'REFERENCE' ELSE 'SOURCE' END AS layer, 'p' || (event_id % 50) AS passage_id FROM events WHERE user_id % 5 <> 0 AND event_type <> 'error')"""
_BOUNDARY = {
    "SOURCE_OUTSIDE_SCOPE": "EXISTS (SELECT 1 FROM citations c WHERE c.run_id = a.run_id AND c.model_key = a.model_key AND layer = 'SOURCE' AND (c.run_id, passage_id) NOT IN (SELECT (run_id, passage_id) FROM scope))",
    "REFERENCE_NOT_REQUESTED": "user_id % 2 <> 0 AND refs > 0",
    "REFERENCE_OUTSIDE_CORPUS": "EXISTS (SELECT 1 FROM citations c WHERE c.run_id = a.run_id AND c.model_key = a.model_key AND layer = 'REFERENCE' AND passage_id NOT IN (SELECT passage_id FROM reference))",
    "SOURCE_OUTSIDE_SNAPSHOT": "has_s > 0 AND out_s > 0",
    "REFERENCE_OUTSIDE_SNAPSHOT": "has_r > 0 AND out_r > 0",
    "REFERENCE_WITHOUT_SNAPSHOT": "has_r = 0 AND refs > 0",
    "CITED_IN_BOTH_LAYERS": "both_ > 0",
    "COMBINED_IS_NOT_UNION": "differ > 0",
    "NO_SUPPORT_WITH_ANSWER": "user_id % 9 = 0",
}


@query(
    f"""WITH {_ANSWERS}, per AS (SELECT run_id, model_key, passage_id, bool_or(layer = 'SOURCE') AS s, bool_or(layer = 'REFERENCE') AS r, bool_or(layer = 'COMBINED') AS c FROM citations GROUP BY 1, 2, 3),
    facts AS (SELECT run_id, model_key, count(*) FILTER (r) AS refs, count(*) FILTER (s AND r) AS both_, count(*) FILTER (c <> (s OR r)) AS differ,
        count(*) FILTER (s AND NOT EXISTS (SELECT 1 FROM snaps x WHERE x.run_id = per.run_id AND x.layer = 'SOURCE' AND x.passage_id = per.passage_id)) AS out_s,
        count(*) FILTER (r AND NOT EXISTS (SELECT 1 FROM snaps x WHERE x.run_id = per.run_id AND x.layer = 'REFERENCE' AND x.passage_id = per.passage_id)) AS out_r FROM per GROUP BY 1, 2),
    has AS (SELECT run_id, count(*) FILTER (layer = 'SOURCE') AS has_s, count(*) FILTER (layer = 'REFERENCE') AS has_r FROM snaps GROUP BY 1),
    a AS (SELECT answers.*, coalesce(refs, 0) AS refs, coalesce(both_, 0) AS both_, coalesce(differ, 0) AS differ, coalesce(out_s, 0) AS out_s, coalesce(out_r, 0) AS out_r, coalesce(has_s, 0) AS has_s, coalesce(has_r, 0) AS has_r
        FROM answers LEFT JOIN facts USING (run_id, model_key) LEFT JOIN has USING (run_id))
    """ + " UNION ALL ".join(f"SELECT run_id, model_key, '{rule}' AS rule FROM a WHERE {condition}" for rule, condition in _BOUNDARY.items())
)
def citation_contract(spark: SparkSession, d: str) -> DataFrame:
    return P.citation_boundary_violations(*_answers(spark, d))


_ALLOWED = "allowed AS (SELECT run_id, 'SOURCE' AS layer, passage_id FROM scope UNION ALL SELECT DISTINCT s.run_id, 'REFERENCE', r.passage_id FROM (SELECT DISTINCT run_id FROM answers) s, reference r)"


def _allowed(spark: SparkSession, d: str) -> DataFrame:
    """Allowed passages: the run's scope, and the reference passages that the run cites."""
    _, citations, scope, reference, _ = _answers(spark, d)
    known = citations.where("layer = 'REFERENCE'").join(reference, "passage_id", "left_semi").select("run_id", "layer", "passage_id")
    return scope.selectExpr("run_id", "'SOURCE' AS layer", "passage_id").unionByName(known)


@query(
    f"""WITH {_ANSWERS}, {_ALLOWED}, marked AS (SELECT DISTINCT c.run_id, c.model_key, c.layer, c.passage_id, a.passage_id IS NOT NULL AS ok FROM citations c LEFT JOIN allowed a ON a.run_id = c.run_id AND a.layer = c.layer AND a.passage_id = c.passage_id),
    facts AS (SELECT run_id, model_key, count(*) FILTER (ok AND layer = 'SOURCE') AS vs, count(*) FILTER (ok AND layer = 'REFERENCE') AS vr, count(*) FILTER (NOT ok AND layer = 'SOURCE') AS is_, count(*) FILTER (NOT ok AND layer = 'REFERENCE') AS ir FROM marked GROUP BY 1, 2),
    j AS (SELECT a.run_id, a.model_key, user_id, coalesce(vs, 0) AS valid_source, coalesce(vr, 0) AS valid_reference, coalesce(is_, 0) AS invalid_source, coalesce(ir, 0) AS invalid_reference FROM answers a LEFT JOIN facts USING (run_id, model_key))
    SELECT run_id, model_key, valid_source, valid_reference, invalid_source, invalid_reference, CASE WHEN user_id % 10 = 0 THEN '{P.NO_ANSWER}' WHEN valid_source + valid_reference = 0 THEN '{P.NO_VALID_SOURCES}' ELSE 'Answer to [REDACTED_EMAIL] ' || user_id END AS answer,
        user_id % 8 = 0 OR user_id % 10 = 0 OR valid_source + valid_reference = 0 AS insufficient_evidence FROM j"""
)
def sanitised_answers(spark: SparkSession, d: str) -> DataFrame:
    answers, citations, *_ = _answers(spark, d)
    return P.sanitise_citations(answers.drop("reference_requested", "no_support"), citations, _allowed(spark, d))


@query(f"WITH {_ANSWERS}, {_ALLOWED} SELECT DISTINCT c.run_id, c.model_key, c.layer, c.passage_id FROM citations c JOIN allowed a ON a.run_id = c.run_id AND a.layer = c.layer AND a.passage_id = c.passage_id")
def valid_citations(spark: SparkSession, d: str) -> DataFrame:
    return P.valid_citations(_answers(spark, d)[1], _allowed(spark, d))
