"""The tables of the library derived from the driver's parquet tables, in Spark and as equal DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import content_id
from dossier.plans.sizing import spread_small

# Phrases appended to texts and headlines so that every rule occurs in the data.
MARKERS = (
    " Witness statement: the master spoke.", " VDR transcript: 10:21 begins.", " medical record attached.",
    " passport AB12345 and IMO 1234567", " MMSI 123456789 seen at 09.45", " contact a.b@example.org or a.b@example.org",
    " phone +32 475 12 34 56 given", " investigator notes and draft report", "",
)
HEADLINES = (
    "oil tanker collision off coast", "tugboat fire in port", "ferry RAN AGROUND at night", "two killed in trawler blast",
    "sailing yacht sinks", "container ship leak", "migrant boat rescue", "migrant boat with two dead after capsize",
    "river barge crash", "Windward sanctions note", "fishing boat man overboard", "bulk carrier grounded",
    "lng carrier explosion", "ro-ro flooding", "passenger vessel injured crew", "cargo ship missing",
    "workboat pollution", "refugee vessel stranded", "freighter runs aground", "lake ferry fire",
    "cruise ship evacuated", "pilot boat allision", "crew report loss of life on vessel", "harbour news",
)
KINDS = ("Event", "ContributingFactor", "Finding", "SafetyIssue", "Recommendation", "Actor", "Vessel", "System", "Claim")
RELATIONS = ("FOLLOWED_BY", "INVOLVED_IN", "CONTRIBUTED_TO", "RESULTED_IN", "SUPPORTS")


def _array(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread_small(df) if name in TEXT_TABLES else df


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id",
        "concat('doc_', substring(sha2(cast(doc_id AS string), 256), 1, 24)) AS document_id",
        "concat('analysis_', doc_id % 50) AS analysis_id",
        "source AS package_id",
        "lang",
        "text",
        "sha2(text, 256) AS sha256",
        "concat(source, '_', doc_id, '.txt') AS filename",
        "element_at(array('A', 'B', 'C', 'D'), cast(doc_id % 4 + 1 AS int)) AS information_class",
        "CASE WHEN doc_id % 5 < 2 THEN 'CANONICAL' ELSE 'LOCAL' END AS source_managed_by",
        "CASE WHEN doc_id % 3 = 0 THEN 'ANNEX' ELSE 'MAIN_REPORT' END AS document_role",
    )


def canon(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical catalogue with upper-case hashes; every third document has another content."""
    return table(spark, folder, "documents").selectExpr(
        "doc_id",
        "concat('canon_', doc_id) AS canonical_document_id",
        "source AS package_id",
        "upper(sha2(CASE WHEN doc_id % 3 = 0 THEN concat(text, '#') ELSE text END, 256)) AS sha256",
    )


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document that is not blank."""
    lines = docs(spark, folder).select(
        "doc_id", "document_id", "analysis_id", "package_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    rows = lines.where("trim(line) <> ''").selectExpr(
        "doc_id", "document_id", "analysis_id", "package_id", "lang",
        "cast(pos + 1 AS bigint) AS passage_order",
        "CASE WHEN doc_id % 7 <> 0 THEN cast(floor(pos / 5) + 1 AS int) END AS page_start",
        "CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN cast(floor(pos / 5) + 1 + pos % 2 AS int) END AS page_end",
        "trim(line) AS passage_text",
        "sha2(trim(line), 256) AS text_sha256",
    )
    return rows.withColumn(
        "passage_id", content_id("passage_", [F.col(c) for c in ("document_id", "page_start", "passage_order", "text_sha256")])
    )


def screened(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).withColumn(
        "text", F.expr(f"concat(text, element_at({_array(MARKERS)}, cast(doc_id % 9 + 1 AS int)))")
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").selectExpr("concat('q', item_id) AS query_id", "text AS query_text")


def concept_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every benchmark text as a node of one analysis per text."""
    rows = table(spark, folder, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "sentence"))
    return rows.selectExpr(
        "concat('case_', item_id) AS analysis_id",
        "concat('case_', item_id, '_', pos) AS node_id",
        f"element_at({_array(KINDS)}, cast((pos + item_id) % 9 + 1 AS int)) AS node_kind",
        "trim(sentence) AS label",
        "cast(pos + 1 AS bigint) AS position",
    )


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "concat('analysis_', event_id div 100) AS analysis_id",
        "concat('run_', event_id div 100) AS model_run_id",
        "concat('n', event_id) AS node_id",
        f"element_at({_array(KINDS)}, cast(event_id % 9 + 1 AS int)) AS node_kind",
        "concat(event_type, ' at ', date_format(ts, 'HH:mm')) AS label",
        "CASE WHEN event_id % 3 <> 0 THEN props END AS description",
        "array(concat('d', event_id % 40), concat('d', event_id % 7)) AS evidence_document_ids",
        "ts",
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """One edge per event to the tenth, or hundredth, event before it: hubs with many edges and self-relations."""
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "concat('analysis_', event_id div 100) AS analysis_id",
        "concat('run_', event_id div 100) AS model_run_id",
        "concat('e', event_id) AS edge_id",
        "concat('n', event_id) AS source_node_id",
        "concat('n', CASE WHEN event_id % 10 <> 0 THEN event_id - event_id % 10 ELSE event_id - event_id % 100 END) AS target_node_id",
        f"element_at({_array(RELATIONS)}, cast(event_id % 5 + 1 AS int)) AS relationship",
        "CASE WHEN event_id % 5 = 1 THEN 'STRUCTURAL' ELSE 'REPORT_DERIVED' END AS edge_class",
        "array(concat('d', event_id % 40)) AS evidence_document_ids",
        "event_type AS source_label",
        "concat('hub ', event_id div 10) AS target_label",
        "CASE WHEN event_id % 4 = 0 THEN 'ASSISTANT_VALIDATED' ELSE 'CANDIDATE' END AS evidence_status",
        "CASE WHEN event_id % 3 = 0 THEN array(props, event_type) ELSE cast(array() AS array<string>) END AS stronger_evidence",
        "CASE WHEN event_id % 6 <> 1 THEN props END AS passage_text",
    )


def scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Selected documents of the analyses: three documents for every second analysis, none for the others."""
    rows = table(spark, folder, "events").selectExpr("event_id div 100 AS a", "event_id % 3 AS k").distinct()
    return rows.where("a % 2 = 0").selectExpr("concat('analysis_', a) AS analysis_id", "concat('d', (a + k) % 40) AS document_id")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Four reviews of each edge of the first quarter of all edges, some of them contradicting policy."""
    return table(spark, folder, "events").selectExpr(
        "concat('r', event_id) AS review_id",
        "concat('e', event_id div 4) AS edge_id",
        "concat('analysis_', (event_id div 4) div 100) AS analysis_id",
        "CASE WHEN event_id % 37 = 0 THEN 'run_x' ELSE concat('run_', (event_id div 4) div 100) END AS model_run_id",
        "concat('n', event_id div 4) AS source_node_id",
        "concat('n', CASE WHEN (event_id div 4) % 10 <> 0 THEN (event_id div 4) - (event_id div 4) % 10 ELSE (event_id div 4) - (event_id div 4) % 100 END) AS target_node_id",
        f"element_at({_array(RELATIONS)}, cast((event_id div 4) % 5 + 1 AS int)) AS original_relationship",
        "element_at(array('VALIDATED', 'REJECTED', 'AMENDED'), cast(event_id % 3 + 1 AS int)) AS decision",
        "CASE WHEN event_id % 41 = 0 THEN 'HUMAN_REJECTED' ELSE element_at(array('HUMAN_VALIDATED', 'HUMAN_REJECTED', 'HUMAN_AMENDED'), cast(event_id % 3 + 1 AS int)) END AS status",
        "CASE WHEN event_id % 3 = 2 AND event_id % 43 <> 0 THEN 'CONTRIBUTED_TO' WHEN event_id % 47 = 0 THEN 'INVOLVED_IN' END AS amended_relationship",
        "ts AS reviewed_at",
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    kinds = (*KINDS, "Unknown")
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "concat('analysis_', event_id div 100) AS analysis_id",
        "concat('run_', event_id div 100) AS model_run_id",
        "event_id div 10 AS extraction_batch",
        "concat('c', event_id) AS candidate_id",
        f"element_at({_array(kinds)}, cast(event_id % 10 + 1 AS int)) AS node_kind",
        "CASE WHEN event_id % 50 = 49 THEN '' ELSE concat(event_type, ' ', event_id % 20) END AS label",
        "element_at(array('DIRECT', 'NORMALISED', 'INFERRED', 'OTHER'), cast(event_id % 4 + 1 AS int)) AS evidence_class",
        "array(concat('p', event_id % 200), concat('p', event_id % 31)) AS passage_ids",
    )


def candidate_relationships(spark: SparkSession, folder: str) -> DataFrame:
    types = (*RELATIONS, "LIKES", "AFFECTED")
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "concat('analysis_', event_id div 100) AS analysis_id",
        "event_id div 10 AS extraction_batch",
        "concat('cr', event_id) AS candidate_relationship_id",
        f"element_at({_array(types)}, cast(event_id % 7 + 1 AS int)) AS relationship",
        "concat('c', event_id) AS source_candidate_id",
        "concat('c', event_id - event_id % 10 + (event_id * 7) % 13) AS target_candidate_id",
        "element_at(array('NORMALISED', 'DIRECT', 'INFERRED', 'OTHER', 'NORMALISED'), cast(event_id % 5 + 1 AS int)) AS evidence_class",
        "array(concat('p', event_id % 200), concat('p', (event_id + 1) % 200)) AS passage_ids",
    )


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Resolution of candidates by kind and label; some members are unknown and some are mapped twice."""
    rows = candidates(spark, folder).selectExpr(
        "event_id", "analysis_id", "model_run_id", "node_kind", "label",
        "concat('res_', node_kind, '_', label) AS resolution_id",
        "CASE WHEN event_id % 89 = 0 THEN concat('cx', event_id) ELSE candidate_id END AS candidate_id",
    )
    times = F.expr("CASE WHEN event_id % 97 = 0 THEN array('', '_again') ELSE array('') END")
    return rows.withColumn("_again", F.explode(times)).selectExpr(
        "analysis_id", "model_run_id", "node_kind", "label", "concat(resolution_id, _again) AS resolution_id", "candidate_id"
    )


def usage(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "'w1' AS workspace_id",
        "'PUBLIC' AS cloud",
        "concat('sku_', l_partkey) AS sku_name",
        "l_linestatus AS usage_unit",
        "l_quantity AS usage_quantity",
        "cast(l_shipdate AS timestamp) AS usage_start_time",
        "cast(l_shipdate AS timestamp) + INTERVAL 1 DAY AS usage_end_time",
        "cast(l_shipdate AS date) AS usage_date",
        "CASE l_returnflag WHEN 'A' THEN 'JOBS' WHEN 'N' THEN 'APPS' ELSE 'MODEL_SERVING' END AS billing_origin_product",
        """named_struct(
            'job_id', CASE WHEN l_returnflag = 'A' THEN cast(l_suppkey AS string) END,
            'job_run_id', CASE WHEN l_returnflag = 'A' THEN concat('run_', l_linenumber) END,
            'job_name', CASE WHEN l_returnflag = 'A' AND l_suppkey % 2 = 0 THEN concat('job ', l_suppkey) END,
            'app_name', CASE WHEN l_returnflag = 'N' THEN concat('app ', l_suppkey % 7) END,
            'app_id', CASE WHEN l_returnflag = 'N' THEN cast(l_suppkey % 7 AS string) END,
            'endpoint_name', CASE WHEN l_returnflag = 'R' AND l_suppkey % 3 <> 0 THEN concat('endpoint ', l_suppkey % 5) END,
            'notebook_path', CASE WHEN l_returnflag = 'R' AND l_suppkey % 4 = 0 THEN concat('/n/', l_suppkey) END
        ) AS usage_metadata""",
        "named_struct('run_as', concat('user', l_suppkey % 10)) AS identity_metadata",
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Two validity intervals per part and unit, the second one open."""
    return table(spark, folder, "part").selectExpr(
        "'PUBLIC' AS cloud",
        "concat('sku_', p_partkey) AS sku_name",
        "p_retailprice",
        "explode(array('F', 'O')) AS usage_unit",
    ).selectExpr(
        "cloud", "sku_name", "usage_unit", "'EUR' AS currency_code",
        """inline(array(
            named_struct('price_start_time', timestamp '1990-01-01 00:00:00', 'price_end_time', timestamp '1998-06-01 00:00:00',
                         'pricing', named_struct('effective_list', named_struct('default', p_retailprice))),
            named_struct('price_start_time', timestamp '1998-06-01 00:00:00', 'price_end_time', cast(NULL AS timestamp),
                         'pricing', named_struct('effective_list', named_struct('default', p_retailprice * 2)))
        ))""",
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "'w1' AS workspace_id",
        "cast(o_custkey % 150 AS string) AS job_id",
        "concat(o_orderpriority, ' ', o_orderkey) AS name",
        "cast(o_orderdate AS timestamp) AS change_time",
        "o_orderkey AS change_id",
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.selectExpr(
        "concat('a', o_orderkey) AS alert_id",
        "concat('g', o_custkey) AS alert_group_id",
        "o_orderkey AS alert_version",
        "cast(o_orderdate AS timestamp) AS alert_timestamp",
        f"concat(c_mktsegment, ' ', element_at({_array(HEADLINES)}, cast(o_orderkey % 24 + 1 AS int))) AS headline",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('earlier ', c_mktsegment) END AS previous_headlines",
        "concat('Report IMO: ', 1000000 + o_orderkey % 1000) AS sub_headline_text",
        "CASE WHEN o_orderkey % 3 <> 0 THEN n_name END AS flag_country",
        "CASE WHEN o_orderkey % 4 = 0 THEN r_name END AS location_country",
        "CASE WHEN o_orderkey % 5 = 0 THEN concat('CREW ', n_name) END AS crew_country",
        "'Proximity' AS alert_reason",
        "cast(o_orderdate AS timestamp) AS load_date",
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as transcript segments; some ranges are reversed and some have another class."""
    return table(spark, folder, "conversations").selectExpr(
        "conv_id",
        "concat('conv_', conv_id) AS audio_source_id",
        "concat('segment_', conv_id, '_', turn) AS transcript_segment_id",
        "turn AS segment_index",
        "cast(turn * 10 + conv_id % 3 AS double) AS start_seconds",
        "cast(CASE WHEN turn % 5 = 4 THEN turn * 10 - 3 ELSE turn * 10 + 8 END AS double) AS end_seconds",
        "role AS speaker_id",
        "text AS transcript_text",
        "sha2(CASE WHEN turn % 4 = 3 THEN concat(text, '!') ELSE text END, 256) AS segment_text_sha256",
        "CASE WHEN role = 'system' THEN 'TYPE_C' ELSE 'TYPE_D' END AS classification",
        "CASE WHEN conv_id % 3 = 0 THEN 'EN' WHEN conv_id % 3 = 1 THEN 'es' ELSE 'fr' END AS language_expected",
    )


# --- the same tables as DuckDB CTEs --------------------------------------------------------------------------

_K, _R = _list(KINDS), _list(RELATIONS)
CTES: dict[str, str] = {
    "docs": """SELECT doc_id, 'doc_' || substr(sha256(doc_id::VARCHAR), 1, 24) AS document_id, 'analysis_' || (doc_id % 50) AS analysis_id,
        source AS package_id, lang, text, sha256(text) AS sha256, source || '_' || doc_id || '.txt' AS filename,
        ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS information_class,
        CASE WHEN doc_id % 5 < 2 THEN 'CANONICAL' ELSE 'LOCAL' END AS source_managed_by,
        CASE WHEN doc_id % 3 = 0 THEN 'ANNEX' ELSE 'MAIN_REPORT' END AS document_role FROM documents""",
    "canon": """SELECT doc_id, 'canon_' || doc_id AS canonical_document_id, source AS package_id,
        upper(sha256(CASE WHEN doc_id % 3 = 0 THEN text || '#' ELSE text END)) AS sha256 FROM documents""",
    "passages": """SELECT doc_id, document_id, analysis_id, package_id, lang, pos::BIGINT AS passage_order, page_start, page_end,
        passage_text, text_sha256, 'passage_' || substr(sha256(document_id || '|' || coalesce(page_start::VARCHAR, '') || '|' || pos || '|' || text_sha256), 1, 24) AS passage_id
        FROM (SELECT doc_id, document_id, analysis_id, package_id, lang, pos,
            CASE WHEN doc_id % 7 <> 0 THEN ((pos - 1) // 5 + 1)::INT END AS page_start,
            CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN ((pos - 1) // 5 + 1 + (pos - 1) % 2)::INT END AS page_end,
            trim(line) AS passage_text, sha256(trim(line)) AS text_sha256
            FROM (SELECT doc_id, document_id, analysis_id, package_id, lang, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs) WHERE trim(line) <> '')""",
    "screened": f"""SELECT * REPLACE (text || {_list(MARKERS)}[doc_id % 9 + 1] AS text) FROM docs""",
    "questions": "SELECT 'q' || item_id AS query_id, text AS query_text FROM benchmark",
    "concept_nodes": f"""SELECT 'case_' || item_id AS analysis_id, 'case_' || item_id || '_' || (pos - 1) AS node_id,
        {_K}[(pos - 1 + item_id) % 9 + 1] AS node_kind, trim(sentence) AS label, pos::BIGINT AS position
        FROM (SELECT item_id, unnest(string_split(text, '. ')) AS sentence, generate_subscripts(string_split(text, '. '), 1) AS pos FROM benchmark)""",
    "nodes": f"""SELECT event_id, 'analysis_' || (event_id // 100) AS analysis_id, 'run_' || (event_id // 100) AS model_run_id,
        'n' || event_id AS node_id, {_K}[event_id % 9 + 1] AS node_kind, event_type || ' at ' || strftime(ts, '%H:%M') AS label,
        CASE WHEN event_id % 3 <> 0 THEN props END AS description,
        ['d' || (event_id % 40), 'd' || (event_id % 7)] AS evidence_document_ids, ts FROM events""",
    "edges": f"""SELECT event_id, 'analysis_' || (event_id // 100) AS analysis_id, 'run_' || (event_id // 100) AS model_run_id,
        'e' || event_id AS edge_id, 'n' || event_id AS source_node_id,
        'n' || (CASE WHEN event_id % 10 <> 0 THEN event_id - event_id % 10 ELSE event_id - event_id % 100 END) AS target_node_id,
        {_R}[event_id % 5 + 1] AS relationship, CASE WHEN event_id % 5 = 1 THEN 'STRUCTURAL' ELSE 'REPORT_DERIVED' END AS edge_class,
        ['d' || (event_id % 40)] AS evidence_document_ids, event_type AS source_label, 'hub ' || (event_id // 10) AS target_label,
        CASE WHEN event_id % 4 = 0 THEN 'ASSISTANT_VALIDATED' ELSE 'CANDIDATE' END AS evidence_status,
        CASE WHEN event_id % 3 = 0 THEN [props, event_type] ELSE []::VARCHAR[] END AS stronger_evidence,
        CASE WHEN event_id % 6 <> 1 THEN props END AS passage_text FROM events""",
    "scopes": """SELECT DISTINCT 'analysis_' || (event_id // 100) AS analysis_id, 'd' || ((event_id // 100 + event_id % 3) % 40) AS document_id
        FROM events WHERE (event_id // 100) % 2 = 0""",
    "reviews": f"""SELECT 'r' || event_id AS review_id, 'e' || (event_id // 4) AS edge_id, 'analysis_' || ((event_id // 4) // 100) AS analysis_id,
        CASE WHEN event_id % 37 = 0 THEN 'run_x' ELSE 'run_' || ((event_id // 4) // 100) END AS model_run_id,
        'n' || (event_id // 4) AS source_node_id,
        'n' || (CASE WHEN (event_id // 4) % 10 <> 0 THEN (event_id // 4) - (event_id // 4) % 10 ELSE (event_id // 4) - (event_id // 4) % 100 END) AS target_node_id,
        {_R}[(event_id // 4) % 5 + 1] AS original_relationship, ['VALIDATED', 'REJECTED', 'AMENDED'][event_id % 3 + 1] AS decision,
        CASE WHEN event_id % 41 = 0 THEN 'HUMAN_REJECTED' ELSE ['HUMAN_VALIDATED', 'HUMAN_REJECTED', 'HUMAN_AMENDED'][event_id % 3 + 1] END AS status,
        CASE WHEN event_id % 3 = 2 AND event_id % 43 <> 0 THEN 'CONTRIBUTED_TO' WHEN event_id % 47 = 0 THEN 'INVOLVED_IN' END AS amended_relationship,
        ts AS reviewed_at FROM events""",
    "latest": """SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY reviewed_at DESC, review_id DESC) = 1""",
    "candidates": f"""SELECT event_id, 'analysis_' || (event_id // 100) AS analysis_id, 'run_' || (event_id // 100) AS model_run_id,
        event_id // 10 AS extraction_batch, 'c' || event_id AS candidate_id, {_list((*KINDS, "Unknown"))}[event_id % 10 + 1] AS node_kind,
        CASE WHEN event_id % 50 = 49 THEN '' ELSE event_type || ' ' || (event_id % 20) END AS label,
        ['DIRECT', 'NORMALISED', 'INFERRED', 'OTHER'][event_id % 4 + 1] AS evidence_class,
        ['p' || (event_id % 200), 'p' || (event_id % 31)] AS passage_ids FROM events""",
    "candidate_relationships": f"""SELECT event_id, 'analysis_' || (event_id // 100) AS analysis_id, event_id // 10 AS extraction_batch,
        'cr' || event_id AS candidate_relationship_id, {_list((*RELATIONS, "LIKES", "AFFECTED"))}[event_id % 7 + 1] AS relationship,
        'c' || event_id AS source_candidate_id, 'c' || (event_id - event_id % 10 + (event_id * 7) % 13) AS target_candidate_id,
        ['NORMALISED', 'DIRECT', 'INFERRED', 'OTHER', 'NORMALISED'][event_id % 5 + 1] AS evidence_class,
        ['p' || (event_id % 200), 'p' || ((event_id + 1) % 200)] AS passage_ids FROM events""",
    "assignments": """SELECT analysis_id, model_run_id, node_kind, label, 'res_' || node_kind || '_' || label || again AS resolution_id,
        CASE WHEN event_id % 89 = 0 THEN 'cx' || event_id ELSE candidate_id END AS candidate_id
        FROM (SELECT *, unnest(CASE WHEN event_id % 97 = 0 THEN ['', '_again'] ELSE [''] END) AS again FROM candidates)""",
    "members": f"""SELECT *, 'analysis_node_' || substr(sha256(analysis_id || '|' || model_run_id || '|' || node_kind || '|' || lower(trim(label))), 1, 24) AS node_id
        FROM assignments WHERE node_kind IN {tuple(KINDS)} AND trim(label) <> ''""",
    "usage": """SELECT 'w1' AS workspace_id, 'PUBLIC' AS cloud, 'sku_' || l_partkey AS sku_name, l_linestatus AS usage_unit, l_quantity AS usage_quantity,
        l_shipdate AS usage_start_time, l_shipdate + INTERVAL 1 DAY AS usage_end_time, l_shipdate::DATE AS usage_date,
        CASE l_returnflag WHEN 'A' THEN 'JOBS' WHEN 'N' THEN 'APPS' ELSE 'MODEL_SERVING' END AS billing_origin_product,
        CASE WHEN l_returnflag = 'A' THEN l_suppkey::VARCHAR END AS job_id, CASE WHEN l_returnflag = 'A' THEN 'run_' || l_linenumber END AS job_run_id,
        CASE WHEN l_returnflag = 'A' AND l_suppkey % 2 = 0 THEN 'job ' || l_suppkey END AS job_name,
        CASE WHEN l_returnflag = 'N' THEN 'app ' || (l_suppkey % 7) END AS app_name, CASE WHEN l_returnflag = 'N' THEN (l_suppkey % 7)::VARCHAR END AS app_id,
        CASE WHEN l_returnflag = 'R' AND l_suppkey % 3 <> 0 THEN 'endpoint ' || (l_suppkey % 5) END AS endpoint_name,
        CASE WHEN l_returnflag = 'R' AND l_suppkey % 4 = 0 THEN '/n/' || l_suppkey END AS notebook_path,
        'user' || (l_suppkey % 10) AS run_as FROM lineitem""",
    "prices": """SELECT 'PUBLIC' AS cloud, 'sku_' || p_partkey AS sku_name, u.usage_unit, 'EUR' AS currency_code, i.price_start_time, i.price_end_time,
        p_retailprice * i.factor AS unit_list_price FROM part, (VALUES ('F'), ('O')) u(usage_unit),
        (VALUES (TIMESTAMP '1990-01-01 00:00:00', TIMESTAMP '1998-06-01 00:00:00', 1), (TIMESTAMP '1998-06-01 00:00:00', NULL, 2)) i(price_start_time, price_end_time, factor)""",
    "priced": """SELECT u.*, p.currency_code, p.unit_list_price, u.usage_quantity * p.unit_list_price AS effective_list_cost
        FROM usage u JOIN prices p ON u.cloud = p.cloud AND u.sku_name = p.sku_name AND u.usage_unit = p.usage_unit
        AND u.usage_start_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_end_time <= p.price_end_time)""",
    "jobs": """SELECT 'w1' AS workspace_id, (o_custkey % 150)::VARCHAR AS job_id, o_orderpriority || ' ' || o_orderkey AS name,
        o_orderdate AS change_time, o_orderkey AS change_id FROM orders""",
    "alerts": f"""SELECT 'a' || o_orderkey AS alert_id, 'g' || o_custkey AS alert_group_id, o_orderkey AS alert_version, o_orderdate AS alert_timestamp,
        c_mktsegment || ' ' || {_list(HEADLINES)}[o_orderkey % 24 + 1] AS headline,
        CASE WHEN o_orderkey % 3 = 0 THEN 'earlier ' || c_mktsegment END AS previous_headlines,
        'Report IMO: ' || (1000000 + o_orderkey % 1000) AS sub_headline_text,
        CASE WHEN o_orderkey % 3 <> 0 THEN n_name END AS flag_country, CASE WHEN o_orderkey % 4 = 0 THEN r_name END AS location_country,
        CASE WHEN o_orderkey % 5 = 0 THEN 'CREW ' || n_name END AS crew_country, 'Proximity' AS alert_reason, o_orderdate AS load_date
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "segments": """SELECT conv_id, 'conv_' || conv_id AS audio_source_id, 'segment_' || conv_id || '_' || turn AS transcript_segment_id, turn AS segment_index,
        (turn * 10 + conv_id % 3)::DOUBLE AS start_seconds, (CASE WHEN turn % 5 = 4 THEN turn * 10 - 3 ELSE turn * 10 + 8 END)::DOUBLE AS end_seconds,
        role AS speaker_id, text AS transcript_text, sha256(CASE WHEN turn % 4 = 3 THEN text || '!' ELSE text END) AS segment_text_sha256,
        CASE WHEN role = 'system' THEN 'TYPE_C' ELSE 'TYPE_D' END AS classification,
        CASE WHEN conv_id % 3 = 0 THEN 'EN' WHEN conv_id % 3 = 1 THEN 'es' ELSE 'fr' END AS language_expected FROM conversations""",
}
_NEEDS = {
    "passages": ("docs",), "screened": ("docs",), "latest": ("reviews",), "assignments": ("candidates",), "members": ("assignments",),
    "priced": ("usage", "prices"),
}


def with_ctes(body: str, *names: str) -> str:
    """``body`` behind the named CTEs and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    body = body.strip()
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in ordered)
    if body.upper().startswith("WITH "):
        keyword, rest = ("WITH RECURSIVE ", body[15:]) if body.upper().startswith("WITH RECURSIVE ") else ("WITH ", body[5:])
        return f"{keyword}{head}, {rest}" if head else body
    return f"WITH {head} {body}" if head else body
