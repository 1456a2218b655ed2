"""Queries of the source catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import catalogue as C
from dossier.operators.graph import evidence_reference_view
from dossier.queries import bindings as B
from dossier.queries.registry import query

_ROUTED = """hashes AS (SELECT lower(sha256) AS h, count(DISTINCT canonical_document_id) AS n, min((canonical_document_id, package_id)) AS c FROM canon GROUP BY 1),
    routed AS (SELECT d.*, coalesce(n, 0) AS canonical_matches, CASE WHEN n IS NULL THEN 'LOCAL_FALLBACK' WHEN n = 1 THEN 'CANONICAL' ELSE 'AMBIGUOUS' END AS route,
        CASE WHEN n = 1 THEN c[1] END AS canonical_document_id, CASE WHEN n = 1 THEN c[2] END AS canonical_package_id FROM docs d LEFT JOIN hashes ON d.sha256 = h)"""


def routed(spark: SparkSession, d: str) -> DataFrame:
    documents = B.docs(spark, d).select("doc_id", "document_id", "analysis_id", "source_managed_by", "sha256")
    return C.route_by_hash(documents, B.canon(spark, d).select("canonical_document_id", "package_id", "sha256"))


@query(f"WITH {_ROUTED} SELECT document_id, canonical_matches, route, canonical_document_id, canonical_package_id FROM routed", "docs", "canon")
def routed_documents(spark: SparkSession, d: str) -> DataFrame:
    return routed(spark, d).select("document_id", "canonical_matches", "route", "canonical_document_id", "canonical_package_id")


@query(
    f"""WITH {_ROUTED} SELECT analysis_id, CASE WHEN doc_id % 50 = 9 THEN 'DIRECT_TEXT' WHEN bool_and(route = 'CANONICAL') THEN 'CANONICAL'
        WHEN bool_or(route = 'CANONICAL') THEN 'CANONICAL_FIRST_MIXED' ELSE 'LOCAL_FALLBACK' END AS evidence_source_mode FROM routed GROUP BY analysis_id, doc_id % 50""",
    "docs", "canon",
)
def evidence_source_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = routed(spark, d).withColumn("input_mode", F.expr("CASE WHEN doc_id % 50 = 9 THEN 'DIRECT_TEXT' ELSE 'DOCUMENTS' END"))
    return C.evidence_source_mode(rows)


def _canonical_passages(spark: SparkSession, d: str) -> DataFrame:
    return B.passages(spark, d).selectExpr(
        "concat('canon_', doc_id) AS canonical_document_id", "passage_id", "passage_order AS passage_number", "page_start AS start_page",
        "page_end AS end_page", "CASE WHEN passage_order % 50 = 0 THEN ' ' ELSE passage_text END AS passage_text",
        "upper(text_sha256) AS passage_text_sha256",
    )


_BRIDGE = f"""{_ROUTED}, bridge AS (SELECT r.analysis_id, r.document_id, r.canonical_document_id, r.canonical_package_id AS package_id, p.passage_id, p.passage_order,
        p.page_start, p.page_end, CASE WHEN p.passage_order % 50 = 0 THEN ' ' ELSE p.passage_text END AS passage_text, p.text_sha256, r.sha256 AS source_document_sha256
        FROM routed r JOIN passages p ON r.canonical_document_id = 'canon_' || p.doc_id)"""


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    return C.passage_bridge(routed(spark, d), _canonical_passages(spark, d), "BRIDGE_1")


@query(
    f"""WITH {_BRIDGE} SELECT 'BRIDGE_1' AS passage_contract_version, analysis_id, document_id, canonical_document_id, package_id, passage_id, passage_order,
        text_sha256, source_document_sha256 FROM bridge""",
    "docs", "canon", "passages",
)
def bridged_passages(spark: SparkSession, d: str) -> DataFrame:
    return _bridge(spark, d).drop("page_start", "page_end", "passage_text")


@query(
    f"""WITH {_BRIDGE} SELECT rule, key FROM (SELECT passage_id AS key, unnest(list_filter([CASE WHEN trim(passage_text) = '' THEN 'BLANK_TEXT' END,
            CASE WHEN page_end < page_start THEN 'PAGES_REVERSED' END, CASE WHEN sha256(passage_text) <> text_sha256 THEN 'TEXT_HASH_DIFFERS' END], lambda x: x IS NOT NULL)) AS rule FROM bridge)
        UNION ALL SELECT 'DUPLICATE_INPUT_CONTENT', analysis_id || '|' || sha256 FROM docs GROUP BY analysis_id, sha256 HAVING count(*) > 1
        UNION ALL SELECT 'DUPLICATE_PASSAGE', analysis_id || '|' || passage_id FROM bridge GROUP BY analysis_id, passage_id HAVING count(*) > 1""",
    "docs", "canon", "passages",
)
def bridge_contract(spark: SparkSession, d: str) -> DataFrame:
    return C.bridge_violations(_bridge(spark, d), B.docs(spark, d).select("analysis_id", "sha256"))


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = B.passages(spark, d).select("document_id", "passage_id", "passage_order", "page_start", "passage_text", "text_sha256")
    right = B.passages(spark, d).selectExpr(
        "document_id",
        "CASE WHEN passage_order % 40 = 0 THEN concat(passage_id, 'x') ELSE passage_id END AS passage_id",
        "CASE WHEN passage_order % 30 = 0 THEN passage_order + 1 ELSE passage_order END AS passage_order",
        "CASE WHEN passage_order % 20 = 0 THEN coalesce(page_start, 0) + 1 ELSE page_start END AS page_start",
        "passage_text", "text_sha256",
    )
    return left, right


_COPY = """b AS (SELECT document_id, CASE WHEN passage_order % 40 = 0 THEN passage_id || 'x' ELSE passage_id END AS passage_id,
        CASE WHEN passage_order % 30 = 0 THEN passage_order + 1 ELSE passage_order END AS passage_order,
        CASE WHEN passage_order % 20 = 0 THEN coalesce(page_start, 0) + 1 ELSE page_start END AS page_start, passage_text, text_sha256 FROM passages)"""


@query(
    f"""WITH {_COPY} SELECT passage_id, CASE WHEN b.text_sha256 IS NULL THEN 'MISSING_RIGHT' WHEN a.text_sha256 IS NULL THEN 'MISSING_LEFT' ELSE 'DIFFERENT' END AS status,
        CASE WHEN a.text_sha256 IS NOT NULL AND b.text_sha256 IS NOT NULL THEN array_to_string(list_filter([
            CASE WHEN a.passage_order IS DISTINCT FROM b.passage_order THEN 'passage_order' END, CASE WHEN a.page_start IS DISTINCT FROM b.page_start THEN 'page_start' END,
            CASE WHEN a.passage_text IS DISTINCT FROM b.passage_text THEN 'passage_text' END], lambda x: x IS NOT NULL), ',') END AS differing_columns
    FROM passages a FULL JOIN b USING (passage_id)
    WHERE a.text_sha256 IS NULL OR b.text_sha256 IS NULL OR a.passage_order IS DISTINCT FROM b.passage_order OR a.page_start IS DISTINCT FROM b.page_start OR a.passage_text IS DISTINCT FROM b.passage_text""",
    "passages",
)
def passage_parity(spark: SparkSession, d: str) -> DataFrame:
    return C.parity_diff(*_copies(spark, d), ["passage_id"], ["passage_order", "page_start", "passage_text"])


@query(
    """SELECT document_id, coalesce(a, 0) AS left_rows, coalesce(b, 0) AS right_rows FROM (SELECT document_id, count(*) AS a FROM passages GROUP BY 1)
    FULL JOIN (SELECT document_id, count(*) AS b FROM passages WHERE (doc_id + passage_order) % 5 <> 2 GROUP BY 1) USING (document_id)""",
    "passages",
)
def passage_parity_counts(spark: SparkSession, d: str) -> DataFrame:
    left = B.passages(spark, d)
    return C.parity_counts(left, left.where("(doc_id + passage_order) % 5 <> 2"), ["document_id"])


def _available(spark: SparkSession, d: str) -> DataFrame:
    """The passages of every fourth document are not processed yet."""
    processed = B.passages(spark, d).where("doc_id % 4 <> 3")
    return C.availability(B.docs(spark, d).select("document_id", "package_id", "document_role"), processed)


_AVAILABLE = """available AS (SELECT document_id, package_id, document_role, coalesce(n, 0) AS passage_count, CASE WHEN document_role = 'MAIN_REPORT' AND n > 0 THEN 'AVAILABLE'
        WHEN document_role = 'MAIN_REPORT' THEN 'MAIN_REPORT_WITHOUT_PASSAGES' WHEN n > 0 THEN 'SUPPLEMENTARY_PROCESSED_NOT_IN_QUERY_SCOPE' ELSE 'SUPPLEMENTARY_WITHOUT_PASSAGES' END AS availability_status
        FROM docs LEFT JOIN (SELECT document_id, count(DISTINCT passage_id) AS n FROM passages WHERE doc_id % 4 <> 3 GROUP BY 1) USING (document_id))"""


@query(f"WITH {_AVAILABLE} SELECT document_id, passage_count, availability_status, availability_status = 'AVAILABLE' AS query_ready FROM available", "docs", "passages")
def document_availability(spark: SparkSession, d: str) -> DataFrame:
    return _available(spark, d).drop("package_id", "document_role")


@query(
    f"""WITH {_AVAILABLE} SELECT document_role, availability_status, count(DISTINCT document_id) AS documents, count(DISTINCT package_id) AS packages,
        sum(passage_count)::BIGINT AS passages FROM available GROUP BY 1, 2""",
    "docs", "passages",
)
def availability_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.availability_summary(_available(spark, d))


@query(f"WITH {_AVAILABLE} SELECT document_id, package_id FROM available WHERE availability_status = 'MAIN_REPORT_WITHOUT_PASSAGES'", "docs", "passages")
def availability_gaps(spark: SparkSession, d: str) -> DataFrame:
    return C.availability_gaps(_available(spark, d)).select("document_id", "package_id")


@query(
    """WITH reg AS (SELECT doc_id, document_id, document_role, sha256, CASE WHEN doc_id % 11 <> 0 THEN '/v/' || filename END AS file_path FROM docs),
    files AS (SELECT '/v/' || filename || CASE WHEN doc_id % 7 = 0 THEN '.new' ELSE '' END AS file_path FROM docs),
    counts AS (SELECT document_id, count(*) AS n FROM passages WHERE doc_id % 8 <> 6 GROUP BY 1),
    cat AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'old_' || doc_id ELSE document_id END AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS catalogue_status,
        upper(CASE WHEN doc_id % 9 = 0 THEN sha256(text || '!') ELSE sha256 END) AS sha FROM docs),
    joined AS (SELECT r.*, f.file_path IS NOT NULL AS on_disk, coalesce(n, 0) AS n, catalogue_status, sha FROM reg r LEFT JOIN files f USING (file_path)
        LEFT JOIN counts USING (document_id) LEFT JOIN cat USING (document_id)),
    reasons AS (SELECT document_id AS item, n AS passages, array_to_string(list_filter([CASE WHEN file_path IS NULL THEN 'NO_REGISTERED_PATH' END,
        CASE WHEN file_path IS NOT NULL AND NOT on_disk THEN 'REGISTERED_FILE_NOT_FOUND' END,
        CASE WHEN coalesce(catalogue_status, '') <> 'AVAILABLE' THEN 'MISSING_OR_UNAVAILABLE_IN_CATALOGUE' END,
        CASE WHEN catalogue_status = 'AVAILABLE' AND lower(sha) <> sha256 THEN 'CATALOGUE_HASH_DIFFERS' END,
        CASE WHEN document_role = 'MAIN_REPORT' AND n = 0 THEN 'MAIN_REPORT_WITHOUT_PASSAGES' END,
        CASE WHEN document_role <> 'MAIN_REPORT' THEN 'SUPPLEMENTARY_NOT_IN_CASE_SEARCH' END], lambda x: x IS NOT NULL), ', ') AS status FROM joined)
    SELECT item, passages, CASE WHEN status = '' THEN 'READY' ELSE status END AS status FROM reasons
    UNION ALL SELECT 'file:' || file_path, 0, 'UNREGISTERED_FILE' FROM files WHERE file_path NOT IN (SELECT file_path FROM reg WHERE file_path IS NOT NULL)
    UNION ALL SELECT document_id, 0, 'STALE_CATALOGUE_ENTRY' FROM cat WHERE document_id NOT IN (SELECT document_id FROM reg)""",
    "docs", "passages",
)
def reconciled_catalogue(spark: SparkSession, d: str) -> DataFrame:
    docs = B.docs(spark, d)
    registry = docs.selectExpr("document_id", "document_role", "sha256", "CASE WHEN doc_id % 11 <> 0 THEN concat('/v/', filename) END AS file_path")
    files = docs.selectExpr("concat('/v/', filename, CASE WHEN doc_id % 7 = 0 THEN '.new' ELSE '' END) AS file_path")
    counts = B.passages(spark, d).where("doc_id % 8 <> 6").groupBy("document_id").agg(F.count(F.lit(1)).alias("passage_count"))
    catalogue = docs.selectExpr(
        "CASE WHEN doc_id % 13 = 0 THEN concat('old_', doc_id) ELSE document_id END AS document_id",
        "CASE WHEN doc_id % 5 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS catalogue_status",
        "upper(CASE WHEN doc_id % 9 = 0 THEN sha2(concat(text, '!'), 256) ELSE sha256 END) AS sha256",
    )
    return C.reconcile(registry, files, counts, catalogue)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return B.docs(spark, d).selectExpr(
        "document_id", "CASE WHEN doc_id % 17 = 0 THEN '' ELSE upper(sha256) END AS sha256", "source_managed_by", "filename",
        "CASE WHEN doc_id % 6 <> 0 THEN information_class ELSE '' END AS information_class",
        "CASE WHEN doc_id % 4 = 1 THEN 'PSEUDONYMISED_DERIVATIVE' ELSE 'TXT' END AS source_type",
        "element_at(array('REVIEWED', 'APPROVED', 'OPEN'), cast(doc_id % 3 + 1 AS int)) AS pseudonymisation_review_status",
    )


_ENTRIES = """entries AS (SELECT document_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE upper(sha256) END AS sha256, source_managed_by, filename,
        CASE WHEN doc_id % 6 <> 0 THEN information_class ELSE '' END AS information_class, CASE WHEN doc_id % 4 = 1 THEN 'PSEUDONYMISED_DERIVATIVE' ELSE 'TXT' END AS source_type,
        ['REVIEWED', 'APPROVED', 'OPEN'][doc_id % 3 + 1] AS pseudonymisation_review_status FROM docs)"""


@query(
    f"""WITH {_ENTRIES} SELECT document_id, sha256, source_managed_by FROM entries
        QUALIFY sha256 = '' OR row_number() OVER (PARTITION BY lower(sha256) ORDER BY CASE WHEN source_managed_by = 'CANONICAL' THEN 0 ELSE 1 END, document_id) = 1""",
    "docs",
)
def deduplicated_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return C.dedupe_catalogue(_entries(spark, d)).select("document_id", "sha256", "source_managed_by")


@query(
    f"""WITH {_ENTRIES} SELECT c.cls AS requested_class, document_id FROM entries, (VALUES ('A'), ('B'), ('C'), ('D')) c(cls)
        WHERE (source_managed_by = CASE WHEN c.cls = 'B' THEN 'CANONICAL' ELSE 'LOCAL' END OR (source_type = 'PSEUDONYMISED_DERIVATIVE' AND source_managed_by = 'LOCAL'
            AND information_class = c.cls AND pseudonymisation_review_status IN ('REVIEWED', 'APPROVED'))) AND (information_class = '' OR information_class = c.cls)""",
    "docs",
)
def usable_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return C.catalogue_by_class(_entries(spark, d)).select("requested_class", "document_id")


@query(
    """SELECT doc_id, CASE WHEN ok THEN CASE WHEN m = 'DOCUMENTS' AND information_class = 'B' THEN 'CANONICAL' ELSE 'LOCAL' END END AS allowed_owner,
        CASE WHEN ok THEN CASE WHEN m = 'DIRECT_TEXT' THEN 'DIRECT_TEXT_INGRESS' WHEN information_class = 'B' THEN 'PUBLISHED_MATERIAL' ELSE 'LOCAL_DOCUMENTS' END END AS catalogue_scope,
        CASE WHEN information_class = 'X' THEN 'UNSUPPORTED_CLASS' WHEN m IS NULL THEN 'UNSUPPORTED_INPUT_MODE' END AS violation
    FROM (SELECT *, information_class <> 'X' AND m IS NOT NULL AS ok FROM (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'X' ELSE information_class END AS information_class,
        ['DOCUMENTS', 'DOCUMENTS', 'DIRECT_TEXT', NULL][doc_id % 4 + 1] AS m FROM (SELECT doc_id, ['A', 'B', 'C', 'D'][(doc_id // 4) % 4 + 1] AS information_class FROM documents)))"""
)
def source_routes(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 19 = 0 THEN 'X' ELSE element_at(array('a', 'B', ' C ', 'D'), cast((doc_id div 4) % 4 + 1 AS int)) END AS information_class",
        "element_at(array('Documents', 'document', 'Direct text', 'mail'), cast(doc_id % 4 + 1 AS int)) AS input_mode",
    )
    return C.source_routes(rows).drop("information_class", "input_mode")


@query("SELECT passage_id FROM passages WHERE package_id NOT IN (SELECT source FROM documents GROUP BY 1 HAVING max(n_chars) > 25000)", "passages")
def passages_of_other_packages(spark: SparkSession, d: str) -> DataFrame:
    own = B.table(spark, d, "documents").groupBy(F.col("source").alias("package_id")).agg(F.max("n_chars").alias("n")).where("n > 25000")
    return C.exclude_own_package(B.passages(spark, d), own).select("passage_id")


@query(
    """SELECT DISTINCT p AS passage_id FROM (SELECT unnest(passage_ids) AS p FROM candidates UNION ALL SELECT unnest(passage_ids) FROM candidate_relationships)
        WHERE p NOT IN (SELECT 'p' || doc_id FROM documents WHERE lang <> 'fr')""",
    "candidates", "candidate_relationships",
)
def unresolved_citations(spark: SparkSession, d: str) -> DataFrame:
    resolver = B.table(spark, d, "documents").where("lang <> 'fr'").selectExpr("concat('p', doc_id) AS passage_id")
    return C.resolve_citations([B.candidates(spark, d), B.candidate_relationships(spark, d)], resolver)


def run_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scope of one run per benchmark item: the documents of its analysis that are in the run's language."""
    langs = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])
    runs = B.table(spark, d, "benchmark").select(
        F.concat(F.lit("run_"), F.col("item_id").cast("string")).alias("run_id"),
        F.concat(F.lit("analysis_"), (F.col("item_id") % 50).cast("string")).alias("analysis_id"),
        F.get(langs, (F.col("item_id") % 4).cast("int")).alias("lang"),
    )
    return runs.join(B.docs(spark, d).select("analysis_id", "lang", "document_id"), ["analysis_id", "lang"]).select("run_id", "analysis_id", "document_id")


RUN_SCOPES = """run_scopes AS (SELECT 'run_' || item_id AS run_id, analysis_id, document_id FROM benchmark JOIN docs ON analysis_id = 'analysis_' || (item_id % 50)
        AND lang = ['en', 'fr', 'de', 'es'][item_id % 4 + 1])"""


@query(f"WITH {RUN_SCOPES} SELECT run_id, passage_id FROM run_scopes JOIN passages USING (analysis_id, document_id)", "docs", "passages")
def scoped_passages(spark: SparkSession, d: str) -> DataFrame:
    return C.scope_passages(B.passages(spark, d), run_scopes(spark, d)).select("run_id", "passage_id")


@query(
    """SELECT coalesce(n.document_id, o.document_id) AS document_id, CASE WHEN n.document_id IS NOT NULL THEN 'CANONICAL' ELSE o.source_managed_by END AS source_managed_by,
        CASE WHEN n.document_id IS NOT NULL THEN 'AVAILABLE' WHEN o.source_managed_by = 'CANONICAL' THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS catalogue_status,
        coalesce(n.filename, o.filename) AS filename FROM docs o FULL JOIN (SELECT CASE WHEN doc_id % 8 = 0 THEN 'new_' || doc_id ELSE document_id END AS document_id, 'r_' || filename AS filename
            FROM docs WHERE source_managed_by = 'CANONICAL') n ON o.document_id = n.document_id""",
    "docs",
)
def synchronised_catalogue(spark: SparkSession, d: str) -> DataFrame:
    docs = B.docs(spark, d)
    catalogue = docs.selectExpr("document_id", "source_managed_by", "'AVAILABLE' AS catalogue_status", "filename")
    registry = docs.where("source_managed_by = 'CANONICAL'").selectExpr(
        "CASE WHEN doc_id % 8 = 0 THEN concat('new_', doc_id) ELSE document_id END AS document_id", "concat('r_', filename) AS filename"
    )
    return C.sync_catalogue(catalogue, registry)


@query(
    """WITH items AS (SELECT event_id, 'event' AS item_type, 'n' || event_id AS item_id, CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'broken|1'
            ELSE 'd' || (event_id % 1100) || '|' || (event_id % 7) || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE (event_id % 9)::VARCHAR END END AS location FROM events),
    parsed AS (SELECT *, split_part(location, '|', 1) AS doc, (event_id % 7)::INT AS s, CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE event_id % 9 END AS e FROM items),
    meta AS (SELECT 'd' || doc_id AS doc, CASE WHEN doc_id % 12 = 0 THEN '' ELSE '/v/' || doc_id END AS path, doc_id % 14 <> 0 AS path_exists, 1 + n_chars // 800 AS pages FROM documents)
    SELECT item_type, item_id, location, issue FROM (SELECT item_type, item_id, location, CASE WHEN location IS NULL THEN 'NO_EVIDENCE_LOCATION' WHEN location = 'broken|1' THEN 'INVALID_LOCATION_FORMAT'
        WHEN meta.doc IS NULL THEN 'DOCUMENT_NOT_LINKED' WHEN path = '' THEN 'NO_VIEWER_SOURCE_PATH' WHEN NOT path_exists THEN 'SOURCE_PATH_NOT_FOUND'
        WHEN NOT (s >= 1 AND e >= s AND e <= pages) THEN 'INVALID_PAGE_RANGE' END AS issue FROM parsed LEFT JOIN meta USING (doc)) WHERE issue IS NOT NULL"""
)
def viewer_metadata(spark: SparkSession, d: str) -> DataFrame:
    items = B.table(spark, d, "events").selectExpr(
        "'event' AS item_type", "concat('n', event_id) AS item_id",
        """CASE WHEN event_id % 23 = 0 THEN cast(array() AS array<string>) WHEN event_id % 29 = 0 THEN array('broken|1')
            ELSE array(concat('d', event_id % 1100, '|', event_id % 7, '|', CASE WHEN event_id % 3 = 0 THEN '' ELSE cast(event_id % 9 AS string) END)) END AS evidence_locations""",
    )
    documents = B.table(spark, d, "documents").selectExpr(
        "concat('d', doc_id) AS document_id", "CASE WHEN doc_id % 12 = 0 THEN '' ELSE concat('/v/', doc_id) END AS viewer_source_path",
        "doc_id % 14 <> 0 AS path_exists", "1 + n_chars div 800 AS page_count",
    )
    return C.viewer_metadata_violations(documents, items)


_CLOCK = "lpad((floor({c} / 3600)::INT)::VARCHAR, 2, '0') || ':' || lpad((floor({c} / 60)::INT % 60)::VARCHAR, 2, '0') || ':' || lpad((floor({c})::INT % 60)::VARCHAR, 2, '0')"


@query(
    f"""SELECT p.document_id, p.passage_id, CASE WHEN t.transcript_segment_id IS NOT NULL THEN 'TYPE_D_AUDIO_TRANSCRIPT' ELSE 'DOCUMENT' END AS source_locator_type, t.classification AS source_classification,
        CASE WHEN t.transcript_segment_id IS NOT NULL THEN {_CLOCK.format(c='t.start_seconds')} || '–' || {_CLOCK.format(c='t.end_seconds')} || CASE WHEN trim(t.speaker_id) <> '' THEN ' · Speaker ' || t.speaker_id ELSE '' END
            WHEN p.page_start IS NULL THEN 'source location unavailable' WHEN p.page_end IS NULL OR p.page_end = p.page_start THEN 'p. ' || p.page_start ELSE 'pp. ' || p.page_start || '–' || p.page_end END AS source_reference
    FROM (SELECT document_id, passage_id, page_start, page_end FROM passages UNION ALL SELECT audio_source_id, transcript_segment_id, NULL, NULL FROM segments) p
    LEFT JOIN segments t ON p.passage_id = t.transcript_segment_id AND p.document_id = t.audio_source_id""",
    "passages", "segments",
)
def evidence_references(spark: SparkSession, d: str) -> DataFrame:
    segments = B.segments(spark, d)
    columns = ["analysis_id", "document_id", "passage_id", "passage_order", "page_start", "page_end"]
    bound = segments.selectExpr(
        "concat('case_', conv_id) AS analysis_id", "audio_source_id AS document_id", "transcript_segment_id AS passage_id", "segment_index + 1 AS passage_order",
        "cast(NULL AS int) AS page_start", "cast(NULL AS int) AS page_end",
    )
    view = evidence_reference_view(B.passages(spark, d).select(*columns).unionByName(bound), segments)
    return view.select("document_id", "passage_id", "source_locator_type", "source_classification", "source_reference")
