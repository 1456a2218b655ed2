"""Queries of graph tables and human reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import graph as G
from dossier.operators import reviews as V
from dossier.queries import bindings as B
from dossier.queries.registry import query

_SEMANTICS = "CASE WHEN relationship = 'FOLLOWED_BY' THEN 'CHRONOLOGY' WHEN relationship = 'CONTRIBUTED_TO' THEN 'CAUSAL_OR_CONTRIBUTORY' WHEN relationship = 'INVOLVED_IN' THEN 'STRUCTURAL' ELSE 'SEMANTIC' END"


@query(f"SELECT edge_id, {_SEMANTICS} AS semantics FROM edges", "edges")
def relationship_semantics(spark: SparkSession, d: str) -> DataFrame:
    messy = B.edges(spark, d).withColumn("relationship", F.concat(F.lit(" "), F.lower("relationship")))
    return G.relationship_semantics(messy).select("edge_id", "semantics")


def _mappings(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "orders").selectExpr(
        "concat(element_at(array('occ_', 'ves_', 'cf_', 'evt_', 'x_'), cast(o_custkey % 5 + 1 AS int)), o_custkey) AS node_id", "o_orderstatus AS entity",
        "o_orderpriority AS attribute_name", "cast(o_orderkey % 4 AS string) AS code_value",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'OPEN' ELSE 'ASSISTANT_VALIDATED' END AS review_status",
    )


_MAPPINGS = """mappings AS (SELECT ['occ_', 'ves_', 'cf_', 'evt_', 'x_'][o_custkey % 5 + 1] || o_custkey AS node_id, o_orderstatus || ' → ' || o_orderpriority || ' = ' || (o_orderkey % 4) AS mapping
        FROM orders WHERE o_orderkey % 3 <> 0)"""


@query(f"WITH {_MAPPINGS} SELECT node_id, mapping, count(*) AS times FROM mappings GROUP BY 1, 2")
def mapping_strings(spark: SparkSession, d: str) -> DataFrame:
    return G.mapping_strings(_mappings(spark, d))


@query(
    f"""WITH {_MAPPINGS}, n AS (SELECT ['occ_', 'ves_', 'cf_', 'evt_', 'x_'][c_custkey % 5 + 1] || c_custkey AS node_id, c_name AS node_label, c_custkey FROM customer)
    SELECT node_id, node_label, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS mapping_disposition, ['Occurrence', 'Vessel', 'ContributingFactor', 'Event', 'Concept'][n.c_custkey % 5 + 1] AS node_kind,
        coalesce(m, 0) AS mappings, coalesce(t, '') AS mapping_texts FROM n JOIN customer USING (c_custkey) LEFT JOIN (SELECT node_id, count(*) AS m, array_to_string(list_sort(list(DISTINCT mapping)), ' | ') AS t FROM mappings GROUP BY 1) USING (node_id)"""
)
def published_nodes(spark: SparkSession, d: str) -> DataFrame:
    node_id = "concat(element_at(array('occ_', 'ves_', 'cf_', 'evt_', 'x_'), cast(c_custkey % 5 + 1 AS int)), c_custkey) AS node_id"
    customers = B.table(spark, d, "customer")
    nodes = customers.selectExpr(node_id, "c_name AS node_label")
    dispositions = customers.selectExpr(node_id, "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS mapping_disposition")
    return G.publish_nodes(nodes, dispositions, _mappings(spark, d))


@query(
    "SELECT analysis_id, edge_id, source_node_id, target_node_id, relationship, edge_class, evidence_status, passage_text, 'p' || edge_id AS evidence_anchor FROM edges", "edges"
)
def published_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.publish_edges(B.edges(spark, d).withColumn("evidence_anchor", F.concat(F.lit("p"), "edge_id")))


_SCOPED = """backed AS (SELECT DISTINCT analysis_id, node_id FROM (SELECT analysis_id, node_id, unnest(evidence_document_ids) AS document_id FROM nodes) JOIN scopes USING (analysis_id, document_id)
        UNION SELECT analysis_id, node_id FROM nodes WHERE analysis_id NOT IN (SELECT analysis_id FROM scopes)),
    chosen AS (SELECT * FROM edges e WHERE analysis_id NOT IN (SELECT analysis_id FROM scopes) OR EXISTS (SELECT 1 FROM scopes s WHERE s.analysis_id = e.analysis_id AND list_contains(e.evidence_document_ids, s.document_id))),
    kept AS (SELECT analysis_id, node_id FROM backed UNION SELECT analysis_id, source_node_id FROM chosen UNION SELECT analysis_id, target_node_id FROM chosen)"""


@query(f"WITH {_SCOPED} SELECT node_id FROM backed", "nodes", "edges", "scopes")
def evidence_backed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.evidence_backed_nodes(B.nodes(spark, d), B.scopes(spark, d)).select("node_id")


@query(f"WITH {_SCOPED} SELECT node_id FROM nodes JOIN kept USING (analysis_id, node_id)", "nodes", "edges", "scopes")
def scoped_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.scope_graph(B.nodes(spark, d), B.edges(spark, d), B.scopes(spark, d))[0].select("node_id")


@query(
    f"""WITH {_SCOPED} SELECT edge_id FROM edges e WHERE (edge_id IN (SELECT edge_id FROM chosen) OR edge_class = 'STRUCTURAL')
        AND source_node_id IN (SELECT node_id FROM kept) AND target_node_id IN (SELECT node_id FROM kept)""",
    "nodes", "edges", "scopes",
)
def scoped_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.scope_graph(B.nodes(spark, d), B.edges(spark, d), B.scopes(spark, d))[1].select("edge_id")


@query(
    f"""WITH {_SCOPED} SELECT analysis_id, node_id FROM backed UNION SELECT e.analysis_id, target_node_id FROM edges e JOIN backed b ON b.node_id = e.source_node_id WHERE relationship = 'INVOLVED_IN'
        UNION SELECT e.analysis_id, source_node_id FROM edges e JOIN backed b ON b.node_id = e.target_node_id WHERE relationship = 'INVOLVED_IN'""",
    "nodes", "edges", "scopes",
)
def structural_passthrough(spark: SparkSession, d: str) -> DataFrame:
    return G.structural_passthrough(G.evidence_backed_nodes(B.nodes(spark, d), B.scopes(spark, d)), B.edges(spark, d))


@query(
    """WITH n AS (SELECT node_id FROM nodes WHERE node_kind <> 'Claim')
    SELECT edge_id FROM edges WHERE source_node_id IN (SELECT node_id FROM n) AND target_node_id IN (SELECT node_id FROM n)""",
    "nodes", "edges",
)
def filtered_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.filter_edges(B.edges(spark, d), B.nodes(spark, d).where("node_kind <> 'Claim'")).select("edge_id")


@query(
    """SELECT analysis_id, 'node_kind' AS facet, node_kind AS value, count(*) AS items FROM nodes GROUP BY 1, 3
        UNION ALL SELECT analysis_id, 'relationship', relationship, count(*) FROM edges GROUP BY 1, 3""",
    "nodes", "edges",
)
def graph_facets(spark: SparkSession, d: str) -> DataFrame:
    return G.facets(B.nodes(spark, d), B.edges(spark, d))


@query(
    """SELECT analysis_id, coalesce(n, 0) AS nodes, coalesce(e, 0) AS edges, coalesce(s, 0) AS structural_edges FROM (SELECT analysis_id, count(*) AS n FROM nodes GROUP BY 1)
        FULL JOIN (SELECT analysis_id, count(*) AS e, count(*) FILTER (edge_class = 'STRUCTURAL') AS s FROM edges GROUP BY 1) USING (analysis_id)""",
    "nodes", "edges",
)
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_counts(B.nodes(spark, d), B.edges(spark, d))


@query(
    """SELECT node_id, min(label) AS label FROM (SELECT source_node_id AS node_id, source_label AS label FROM edges UNION ALL SELECT target_node_id, target_label FROM edges) GROUP BY 1""", "edges"
)
def node_labels(spark: SparkSession, d: str) -> DataFrame:
    return G.node_labels(B.edges(spark, d))


@query(
    """SELECT analysis_id, count(*) AS total_nodes, count(l.label) AS nodes_with_label FROM nodes LEFT JOIN (SELECT node_id, min(label) AS label FROM (
        SELECT source_node_id AS node_id, source_label AS label FROM edges UNION ALL SELECT target_node_id, target_label FROM edges) GROUP BY 1) l USING (node_id) GROUP BY 1""",
    "nodes", "edges",
)
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    return G.label_coverage(B.nodes(spark, d).select("analysis_id", "node_id"), G.node_labels(B.edges(spark, d)), ["analysis_id"])


@query("SELECT edge_id, CASE WHEN len(stronger_evidence) > 0 THEN array_to_string(stronger_evidence, ' | ') ELSE passage_text END AS evidence_display FROM edges", "edges")
def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_evidence(B.edges(spark, d)).select("edge_id", "evidence_display")


@query(
    """SELECT analysis_id, count(*) AS total_relationships, count(CASE WHEN len(stronger_evidence) > 0 THEN 'x' ELSE passage_text END) AS relationships_with_evidence,
        count(*) FILTER (evidence_status = 'ASSISTANT_VALIDATED') AS validated_relationships FROM edges GROUP BY 1""",
    "edges",
)
def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    return G.evidence_coverage(B.edges(spark, d), ["analysis_id"])


_CATEGORY = "CASE node_kind WHEN 'Event' THEN 'Events' WHEN 'ContributingFactor' THEN 'Contributing factors' WHEN 'Finding' THEN 'Findings' WHEN 'SafetyIssue' THEN 'Safety issues' ELSE 'Safety recommendations' END"
_INDEX = f"""idx AS (SELECT analysis_id, node_id AS item_id, node_kind AS kind, {_CATEGORY} AS category, label, coalesce(description, '') AS description FROM nodes
        WHERE node_kind IN ('Event', 'ContributingFactor', 'Finding', 'SafetyIssue', 'Recommendation') UNION ALL SELECT analysis_id, edge_id, 'Relationship', 'Analytical relationships',
        source_label || ' — ' || relationship || ' → ' || target_label, 'Relationship proposed from the referenced source evidence.' FROM edges WHERE edge_class <> 'STRUCTURAL')"""


@query(f"WITH {_INDEX} SELECT * FROM idx", "nodes", "edges")
def findings_index(spark: SparkSession, d: str) -> DataFrame:
    return G.findings_index(B.nodes(spark, d), B.edges(spark, d))


@query(f"WITH {_INDEX} SELECT analysis_id, category, count(*) AS items FROM idx GROUP BY 1, 2", "nodes", "edges")
def findings_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.findings_counts(G.findings_index(B.nodes(spark, d), B.edges(spark, d)))


@query(
    """SELECT analysis_id, model_run_id, model_key FROM (SELECT 'user_' || user_id AS analysis_id, 'run_' || event_id AS model_run_id, CASE WHEN event_type = 'click' THEN 'PRIMARY' ELSE 'B' END AS model_key, ts, value FROM events WHERE value < 100)
        QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY CASE WHEN model_key = 'PRIMARY' THEN 0 ELSE 1 END, ts DESC, model_run_id DESC) = 1"""
)
def active_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = B.table(spark, d, "events").selectExpr(
        "concat('user_', user_id) AS analysis_id", "concat('run_', event_id) AS model_run_id", "CASE WHEN event_type = 'click' THEN 'PRIMARY' ELSE 'B' END AS model_key",
        "ts AS completed_at", "CASE WHEN value < 100 THEN 'COMPLETED' ELSE 'FAILED' END AS status",
    )
    return G.active_run(runs)


# --- reviews ------------------------------------------------------------------------------------------------


def latest(spark: SparkSession, d: str) -> DataFrame:
    return V.latest_review(B.reviews(spark, d), ["edge_id"])


@query("SELECT edge_id, review_id, decision, model_run_id FROM latest", "latest")
def latest_reviews(spark: SparkSession, d: str) -> DataFrame:
    return latest(spark, d).select("edge_id", "review_id", "decision", "model_run_id")


_DECIDED = """decided AS (SELECT e.edge_id, e.analysis_id, e.edge_class, e.relationship, l.amended_relationship, CASE WHEN e.edge_class <> 'STRUCTURAL' AND e.model_run_id = l.model_run_id THEN l.decision END AS decision
        FROM edges e LEFT JOIN latest l ON e.edge_id = l.edge_id)"""


@query(
    f"""WITH {_DECIDED} SELECT edge_id, CASE WHEN decision = 'AMENDED' AND amended_relationship IS NOT NULL THEN amended_relationship ELSE relationship END AS relationship, decision AS human_review_decision
        FROM decided WHERE coalesce(decision, '') <> 'REJECTED'""",
    "edges", "latest",
)
def reviewed_graph(spark: SparkSession, d: str) -> DataFrame:
    return V.apply_reviews(B.edges(spark, d), latest(spark, d)).select("edge_id", "relationship", "human_review_decision")


@query(
    f"""WITH {_DECIDED} SELECT analysis_id, count(*) FILTER (decision = 'REJECTED') AS hidden_rejected, count(*) FILTER (decision = 'AMENDED' AND amended_relationship IS NOT NULL) AS amended,
        count(*) FILTER (decision = 'VALIDATED') AS validated FROM decided GROUP BY 1""",
    "edges", "latest",
)
def review_projection(spark: SparkSession, d: str) -> DataFrame:
    return V.review_projection(B.edges(spark, d), latest(spark, d), ["analysis_id"])


@query("SELECT edge_id FROM edges WHERE edge_class <> 'STRUCTURAL' AND edge_id NOT IN (SELECT edge_id FROM latest)", "edges", "latest")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return V.review_queue(B.edges(spark, d), latest(spark, d)).select("edge_id")


@query(
    """SELECT e.analysis_id, count(*) AS reviewable, count(l.edge_id) AS reviewed, count(*) FILTER (l.edge_id IS NULL) AS remaining FROM edges e LEFT JOIN latest l ON e.edge_id = l.edge_id
        WHERE edge_class <> 'STRUCTURAL' GROUP BY 1""",
    "edges", "latest",
)
def review_queue_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.review_queue_counts(B.edges(spark, d), latest(spark, d), ["analysis_id"])


_REVIEW_RULES = {
    "STRUCTURAL_RELATIONSHIP_REVIEWED": "r.original_relationship = 'INVOLVED_IN'",
    "STATUS_DOES_NOT_MATCH_DECISION": "r.status <> 'HUMAN_' || r.decision",
    "AMENDED_WITHOUT_AMENDMENT": "r.decision = 'AMENDED' AND r.amended_relationship IS NULL",
    "AMENDED_TO_STRUCTURAL": "r.decision = 'AMENDED' AND r.amended_relationship = 'INVOLVED_IN'",
    "AMENDMENT_WITHOUT_AMENDED": "r.decision <> 'AMENDED' AND r.amended_relationship IS NOT NULL",
    "EDGE_NOT_FOUND": "e.edge_id IS NULL",
    "RELATIONSHIP_DIFFERS": "e.relationship <> r.original_relationship",
    "SOURCE_OF_OTHER_ANALYSIS": "s.analysis_id IS DISTINCT FROM r.analysis_id",
    "SOURCE_OF_OTHER_RUN": "s.model_run_id IS DISTINCT FROM r.model_run_id",
    "TARGET_OF_OTHER_ANALYSIS": "t.analysis_id IS DISTINCT FROM r.analysis_id",
    "TARGET_OF_OTHER_RUN": "t.model_run_id IS DISTINCT FROM r.model_run_id",
}


@query(
    "SELECT review_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _REVIEW_RULES.items()) + """], lambda x: x IS NOT NULL)) AS rule
    FROM reviews r LEFT JOIN edges e USING (edge_id, analysis_id, model_run_id) LEFT JOIN nodes s ON s.node_id = r.source_node_id LEFT JOIN nodes t ON t.node_id = r.target_node_id""",
    "reviews", "edges", "nodes",
)
def review_contract(spark: SparkSession, d: str) -> DataFrame:
    return V.review_violations(B.reviews(spark, d), B.edges(spark, d), B.nodes(spark, d))


_GATE = """gate AS (SELECT *, CASE decision WHEN 'VALIDATED' THEN original_relationship WHEN 'AMENDED' THEN amended_relationship END = 'CONTRIBUTED_TO' AS confirmed FROM reviews),
    last AS (SELECT * FROM gate QUALIFY row_number() OVER (PARTITION BY analysis_id, model_run_id, edge_id ORDER BY reviewed_at DESC, review_id DESC) = 1)"""


@query(
    f"""WITH {_GATE} SELECT l.review_id AS gate_review_id, l.edge_id, s.node_id AS factor_node_id, s.label AS factor_label, t.label AS target_label FROM last l
        JOIN nodes s ON s.node_id = l.source_node_id AND s.analysis_id = l.analysis_id AND s.model_run_id = l.model_run_id AND s.node_kind = 'ContributingFactor'
        JOIN nodes t ON t.node_id = l.target_node_id AND t.analysis_id = l.analysis_id AND t.model_run_id = l.model_run_id WHERE l.confirmed""",
    "reviews", "nodes",
)
def gate_eligible_factors(spark: SparkSession, d: str) -> DataFrame:
    return V.gate1_eligible(B.reviews(spark, d), B.nodes(spark, d)).select("gate_review_id", "edge_id", "factor_node_id", "factor_label", "target_label")


#: Labels that some of the texts hold, one that none does, and no label.
_LABELS = ("que", "the ", "zzzz", "Er")


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    """One proposal per review, for the factor at the source of the reviewed edge."""
    return B.table(spark, d, "events").selectExpr(
        "event_id", "concat('prop', event_id) AS proposal_id", "concat('e', event_id div 4) AS edge_id", "concat('analysis_', (event_id div 4) div 100) AS analysis_id",
        "concat('run_', (event_id div 4) div 100) AS model_run_id", "concat('n', event_id div 4) AS factor_node_id", "concat('r', event_id) AS gate_review_id",
        "CASE WHEN event_id % 6 = 0 THEN 'NO_GROUNDED_PROPOSAL' ELSE 'ASSISTANT_PROPOSED' END AS status",
        f"get({B._array(_LABELS)}, cast(event_id % 5 AS int)) AS proposed_label",
    )


@query("SELECT 'prop' || event_id AS proposal_id, l.review_id = 'r' || event_id AS is_current FROM events JOIN latest l ON l.edge_id = 'e' || (event_id // 4)", "latest")
def proposal_staleness(spark: SparkSession, d: str) -> DataFrame:
    return V.proposal_staleness(_proposals(spark, d), latest(spark, d)).select("proposal_id", "is_current")


_PROPOSAL_RULES = {
    "EMPTY_PROPOSAL_WITH_CONTENT": "empty AND (label IS NOT NULL OR n > 0)",
    "GROUNDED_WITHOUT_LABEL": "NOT empty AND label IS NULL",
    "GROUNDED_WITHOUT_CITATION": "NOT empty AND n = 0",
    "CITATION_OUTSIDE_RETRIEVAL": "NOT empty AND outside > 0",
    "UNKNOWN_PASSAGE": "unknown > 0",
    "LABEL_NOT_IN_CITED_TEXT": "NOT empty AND label IS NOT NULL AND n > 0 AND NOT named",
    "GATE_DOES_NOT_CONFIRM": "NOT coalesce(confirmed, FALSE)",
    "STALE_GATE_REVIEW": "last_id IS DISTINCT FROM gate_review_id",
    "FACTOR_IS_NOT_CONTRIBUTING": "kind IS DISTINCT FROM 'ContributingFactor'",
}
_TURN_ID = "'t' || (event_id % 60) || '_' || (event_id % 4)"
_CITED = f"SELECT 'prop' || event_id AS proposal_id, {_TURN_ID} AS passage_id FROM events WHERE event_id % 7 <> 0"


@query(
    "WITH cited AS (" + _CITED + f"""), offered AS (SELECT 'prop' || event_id AS proposal_id, {_TURN_ID} AS passage_id FROM events WHERE event_id % 8 <> 0),
    corpus AS (SELECT 't' || conv_id || '_' || turn AS passage_id, lower(text) AS txt FROM conversations),
    p AS (SELECT event_id, 'prop' || event_id AS proposal_id, 'r' || event_id AS gate_review_id, event_id % 6 = 0 AS empty, trim({B._list(_LABELS)}[event_id % 5 + 1]) AS label,
        'e' || (event_id // 4) AS edge_id, 'n' || (event_id // 4) AS factor FROM events),
    facts AS (SELECT c.proposal_id, count(*) AS n, count(*) FILTER (o.passage_id IS NULL) AS outside, count(*) FILTER (t.passage_id IS NULL) AS unknown, bool_or(coalesce(contains(t.txt, lower(p.label)), FALSE)) AS named
        FROM cited c JOIN p USING (proposal_id) LEFT JOIN offered o USING (proposal_id, passage_id) LEFT JOIN corpus t USING (passage_id) GROUP BY 1),
    joined AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(outside, 0) AS outside, coalesce(unknown, 0) AS unknown, coalesce(named, FALSE) AS named,
        CASE r.decision WHEN 'VALIDATED' THEN r.original_relationship WHEN 'AMENDED' THEN r.amended_relationship END = 'CONTRIBUTED_TO' AS confirmed, l.review_id AS last_id, nodes.node_kind AS kind
        FROM p LEFT JOIN facts USING (proposal_id) LEFT JOIN reviews r ON r.review_id = p.gate_review_id LEFT JOIN latest l ON l.edge_id = p.edge_id LEFT JOIN nodes ON nodes.node_id = p.factor)
    SELECT proposal_id, unnest(list_filter([""" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _PROPOSAL_RULES.items()) + "], lambda x: x IS NOT NULL)) AS rule FROM joined",
    "reviews", "latest", "nodes",
)
def proposal_contract(spark: SparkSession, d: str) -> DataFrame:
    proposals = _proposals(spark, d)
    pair = ["proposal_id", "concat('t', event_id % 60, '_', event_id % 4) AS passage_id"]
    citations = proposals.where("event_id % 7 <> 0").selectExpr(*pair)
    offered = proposals.where("event_id % 8 <> 0").selectExpr(*pair)
    # a turn is a passage
    corpus = B.table(spark, d, "conversations").selectExpr("concat('t', conv_id, '_', turn) AS passage_id", "text AS passage_text")
    return V.proposal_violations(proposals.drop("event_id"), citations, offered, corpus, B.reviews(spark, d), B.nodes(spark, d))


_MAPPING_RULES = {
    "PROPOSED_WITHOUT_CODE": "event_id % 4 <> 0 AND code IS NULL",
    "SELECTION_OUTSIDE_SHORTLIST": "code <> 'NO_MAPPING' AND NOT listed",
    "SELECTION_OUTSIDE_REGISTRY": "code <> 'NO_MAPPING' AND NOT known",
}
_MAPPING_REVIEW_RULES = {
    "STATUS_DOES_NOT_MATCH_DECISION": "event_id % 41 = 0 AND decision <> 'REJECTED'",
    "AMENDED_WITHOUT_CODE": "decision = 'AMENDED' AND code IS NULL",
    "AMENDED_TO_NO_MAPPING": "decision = 'AMENDED' AND code = 'NO_MAPPING'",
    "AMENDMENT_OUTSIDE_SHORTLIST": "decision = 'AMENDED' AND code <> 'NO_MAPPING' AND NOT listed",
    "AMENDMENT_OUTSIDE_REGISTRY": "decision = 'AMENDED' AND code <> 'NO_MAPPING' AND NOT known",
    "AMENDMENT_WITHOUT_AMENDED": "decision <> 'AMENDED' AND code IS NOT NULL",
}


def _codes(rules: dict[str, str]) -> str:
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in rules.items()) + "], lambda x: x IS NOT NULL)) AS rule"


@query(
    f"""WITH base AS (SELECT event_id, ['VALIDATED', 'REJECTED', 'AMENDED'][event_id % 3 + 1] AS decision, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'NO_MAPPING' ELSE 'Brand#' || (event_id % 30) END AS code, event_id % 5 AS l FROM events),
    brands AS (SELECT DISTINCT p_brand FROM part),
    sel AS (SELECT event_id, code, coalesce(code IN ('Brand#' || (event_id % 30), 'Brand#1') AND l <> 0, FALSE) AS listed, coalesce(code IN (SELECT p_brand FROM brands), FALSE) AS known FROM base),
    rev AS (SELECT event_id, decision, c AS code, coalesce(c = 'Brand#' || (event_id % 30) AND l <> 0 OR c = 'Brand#1', FALSE) AS listed, coalesce(c IN (SELECT p_brand FROM brands), FALSE) AS known
        FROM (SELECT *, CASE WHEN event_id % 3 = 2 OR event_id % 31 = 0 THEN code END AS c FROM base))
    SELECT 'proposal' AS kind, 'm' || event_id AS id, {_codes(_MAPPING_RULES)} FROM sel UNION ALL SELECT 'review', 'mr' || event_id, {_codes(_MAPPING_REVIEW_RULES)} FROM rev""".replace(
        "coalesce(code IN ('Brand#' || (event_id % 30), 'Brand#1') AND l <> 0, FALSE)", "coalesce(code = 'Brand#' || (event_id % 30) AND l <> 0 OR code = 'Brand#1', FALSE)"
    )
)
def mapping_contract(spark: SparkSession, d: str) -> DataFrame:
    events = B.table(spark, d, "events")
    code = "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'NO_MAPPING' ELSE concat('Brand#', event_id % 30) END"
    proposals = events.selectExpr("concat('m', event_id) AS proposal_id", "CASE WHEN event_id % 4 = 0 THEN 'NO_PROPOSAL' ELSE 'ASSISTANT_PROPOSED' END AS status", f"{code} AS selected_code")
    shortlist = events.selectExpr(
        "concat('m', event_id) AS proposal_id", "explode(CASE WHEN event_id % 5 <> 0 THEN array(concat('Brand#', event_id % 30), 'Brand#1') ELSE array('Brand#1') END) AS code"
    )
    reviews = events.selectExpr(
        "concat('mr', event_id) AS review_id", "concat('m', event_id) AS proposal_id", "element_at(array('validated', 'REJECTED', 'AMENDED'), cast(event_id % 3 + 1 AS int)) AS decision",
        "CASE WHEN event_id % 41 = 0 THEN 'HUMAN_REJECTED' ELSE '' END AS status", f"CASE WHEN event_id % 3 = 2 OR event_id % 31 = 0 THEN {code} END AS amended_code",
    )
    return V.mapping_violations(proposals, shortlist, B.table(spark, d, "part").select(F.col("p_brand").alias("code")), reviews)


@query(
    f"""WITH base AS (SELECT event_id, ['VALIDATED', 'REJECTED', 'AMENDED', 'MAYBE'][event_id % 4 + 1] AS decision, CASE WHEN event_id % 11 <> 0 THEN event_type END AS proposed, CASE WHEN event_id % 5 = 0 THEN props END AS amended FROM events)
    SELECT 'r' || event_id AS review_id, {_codes({
        "UNSUPPORTED_DECISION": "decision = 'MAYBE'", "STATUS_DOES_NOT_MATCH_DECISION": "event_id % 13 = 0 AND decision IN ('REJECTED', 'AMENDED')", "REVIEW_WITHOUT_PROPOSED_LABEL": "proposed IS NULL",
        "AMENDED_WITHOUT_LABEL": "decision = 'AMENDED' AND amended IS NULL", "LABEL_WITHOUT_AMENDED": "decision <> 'AMENDED' AND amended IS NOT NULL"})} FROM base"""
)
def label_review_contract(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "events").selectExpr(
        "concat('r', event_id) AS review_id", "element_at(array('VALIDATED', 'REJECTED', 'AMENDED', 'MAYBE'), cast(event_id % 4 + 1 AS int)) AS decision",
        "CASE WHEN event_id % 13 = 0 THEN 'HUMAN_VALIDATED' END AS status", "CASE WHEN event_id % 11 <> 0 THEN event_type END AS proposed_label",
        "CASE WHEN event_id % 5 = 0 THEN props END AS amended_label",
    )
    return V.label_review_violations(rows)


_CORRECTION_RULES = {
    "UNSUPPORTED_ACTION": "action = 'OTHER'",
    "GRAPH_EDGE_WAS_OVERWRITTEN": "rel IS DISTINCT FROM original",
    "EVIDENCE_OUTSIDE_EDGE": "event_id % 6 = 0",
    "REPLACEMENT_NOT_ALLOWED": "action = 'CHANGE_RELATIONSHIP' AND (proposed IS NULL OR proposed = 'INVOLVED_IN')",
    "REPLACEMENT_UNCHANGED": "action = 'CHANGE_RELATIONSHIP' AND proposed <> 'INVOLVED_IN' AND proposed = original",
    "REPLACEMENT_WITHOUT_CHANGE": "action <> 'CHANGE_RELATIONSHIP' AND proposed IS NOT NULL",
    "UNREVIEWED_PROPOSAL_STALE": "creview IS NULL AND base IS DISTINCT FROM last_id",
    "UNSUPPORTED_CORRECTION_DECISION": "creview IS NOT NULL AND cdecision = 'LATER'",
    "DISMISSED_WITH_AUTHORITATIVE_REVIEW": "creview IS NOT NULL AND cdecision = 'DISMISSED' AND auth IS NOT NULL",
    "APPLIED_WITHOUT_AUTHORITATIVE_REVIEW": "applied AND auth IS NULL",
    "AUTHORITATIVE_REVIEW_NOT_FOUND": "applied AND auth IS NOT NULL AND r_edge IS NULL",
    "AUTHORITATIVE_PROVENANCE_DIFFERS": "applied AND r_edge IS NOT NULL AND (r_edge <> edge_id OR r_analysis <> analysis_id OR r_run <> run_id)",
    "AUTHORITATIVE_NOT_LINKED_TO_PROPOSAL": "applied AND r_edge IS NOT NULL AND event_id % 3 = 0",
    "AUTHORITATIVE_NOT_LINKED_TO_CORRECTION": "applied AND r_edge IS NOT NULL AND event_id % 4 = 0",
    "APPLIED_DECISION_DIFFERS": "applied AND r_edge IS NOT NULL AND r_decision <> 'AMENDED'",
    "APPLIED_RELATIONSHIP_DIFFERS": "applied AND r_edge IS NOT NULL AND r_amended IS DISTINCT FROM proposed",
}


@query(
    f"""WITH p AS (SELECT event_id, 'corr' || event_id AS proposal_id, 'e' || (event_id // 4) AS edge_id, 'analysis_' || ((event_id // 4) // 100) AS analysis_id, 'run_' || ((event_id // 4) // 100) AS run_id,
        ['KEEP', 'CHANGE_RELATIONSHIP', 'REJECT_RELATIONSHIP', 'OTHER'][event_id % 4 + 1] AS action, {B._R}[(event_id // 4) % 5 + 1] AS original_true,
        CASE WHEN event_id % 17 = 0 THEN 'FOLLOWED_BY' ELSE {B._R}[(event_id // 4) % 5 + 1] END AS original, CASE WHEN event_id % 2 = 1 AND event_id % 5 <> 0 THEN {B._R}[event_id % 5 + 1] END AS proposed,
        CASE WHEN event_id % 3 <> 1 THEN 'r' || event_id END AS base, CASE WHEN event_id % 2 = 0 THEN 'cr' || event_id END AS creview, ['APPROVED', 'DISMISSED', 'LATER', 'APPLIED_WITH_AMENDMENT'][(event_id // 2) % 4 + 1] AS cdecision,
        CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 14 = 0 THEN 'rx' ELSE 'r' || event_id END AS auth FROM events),
    j AS (SELECT p.*, e.relationship AS rel, l.review_id AS last_id, creview IS NOT NULL AND cdecision IN ('APPROVED', 'APPLIED_WITH_AMENDMENT') AS applied, r.edge_id AS r_edge, r.analysis_id AS r_analysis, r.model_run_id AS r_run, r.decision AS r_decision,
        r.amended_relationship AS r_amended FROM p LEFT JOIN edges e ON e.edge_id = p.edge_id LEFT JOIN latest l ON l.edge_id = p.edge_id LEFT JOIN reviews r ON r.review_id = p.auth)
    SELECT proposal_id, {_codes(_CORRECTION_RULES)} FROM j""",
    "edges", "reviews", "latest",
)
def correction_contract(spark: SparkSession, d: str) -> DataFrame:
    relations = B._array(B.RELATIONS)
    events = B.table(spark, d, "events")
    proposals = events.selectExpr(
        "event_id", "concat('corr', event_id) AS proposal_id", "concat('e', event_id div 4) AS edge_id", "concat('analysis_', (event_id div 4) div 100) AS analysis_id",
        "concat('run_', (event_id div 4) div 100) AS model_run_id", "element_at(array('KEEP', 'CHANGE_RELATIONSHIP', 'REJECT_RELATIONSHIP', 'OTHER'), cast(event_id % 4 + 1 AS int)) AS action",
        "'ASSISTANT_PROPOSED' AS assistant_status", f"CASE WHEN event_id % 17 = 0 THEN 'FOLLOWED_BY' ELSE element_at({relations}, cast((event_id div 4) % 5 + 1 AS int)) END AS original_relationship",
        f"CASE WHEN event_id % 2 = 1 AND event_id % 5 <> 0 THEN element_at({relations}, cast(event_id % 5 + 1 AS int)) END AS proposed_relationship",
        "CASE WHEN event_id % 3 <> 1 THEN concat('r', event_id) END AS base_review_id", "CASE WHEN event_id % 2 = 0 THEN concat('cr', event_id) END AS correction_review_id",
        "element_at(array('APPROVED', 'DISMISSED', 'LATER', 'APPLIED_WITH_AMENDMENT'), cast((event_id div 2) % 4 + 1 AS int)) AS correction_decision",
        "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 14 = 0 THEN 'rx' ELSE concat('r', event_id) END AS authoritative_review_id", "'AMENDED' AS applied_decision",
    ).withColumn("applied_relationship", F.col("proposed_relationship"))
    citations = proposals.selectExpr("proposal_id", "CASE WHEN event_id % 6 = 0 THEN 'elsewhere' ELSE concat('p', edge_id) END AS passage_id")
    edge_citations = B.edges(spark, d).selectExpr("edge_id", "concat('p', edge_id) AS passage_id")
    reviews = B.reviews(spark, d).withColumn("_n", F.expr("cast(substring(review_id, 2) AS bigint)")).withColumns(
        {
            "correction_proposal_id": F.expr("CASE WHEN _n % 3 <> 0 THEN concat('corr', _n) END"),
            "correction_review_id": F.expr("CASE WHEN _n % 4 <> 0 THEN concat('cr', _n) ELSE 'other' END"),
        }
    ).drop("_n")
    return V.correction_violations(proposals.drop("event_id"), B.edges(spark, d), citations, edge_citations, reviews)


@query(
    "SELECT review_id, CASE decision WHEN 'VALIDATED' THEN original_relationship WHEN 'AMENDED' THEN amended_relationship END AS effective_value FROM reviews", "reviews"
)
def effective_mappings(spark: SparkSession, d: str) -> DataFrame:
    return V.effective_mapping(B.reviews(spark, d), "original_relationship", "amended_relationship").select("review_id", "effective_value")
