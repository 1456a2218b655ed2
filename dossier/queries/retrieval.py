"""Queries of scopes, terms, retrieval, similar cases and taxonomy shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import CASE_STOP_WORDS
from dossier.operators import retrieval as R
from dossier.plans.durable import durable
from dossier.queries import bindings as B
from dossier.queries.catalogue import RUN_SCOPES, run_scopes
from dossier.queries.registry import query
from dossier.queries.text import norm_sql, tokens_sql

CASE_STOP = "[" + ", ".join(f"'{w}'" for w in CASE_STOP_WORDS) + "]"


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run per document: its mode by document, its selection one, two or no documents of its analysis."""
    docs = B.docs(spark, d).select("doc_id", "analysis_id", "document_id")
    runs = docs.selectExpr(
        "concat('run_', doc_id) AS run_id", "analysis_id",
        "element_at(array('WHOLE_CASE', 'ONE_DOCUMENT', 'SELECTED_DOCUMENTS', 'one_document ', 'ALL'), cast(doc_id % 5 + 1 AS int)) AS scope_mode",
    )
    chosen = docs.selectExpr(
        "concat('run_', doc_id) AS run_id",
        """explode(CASE WHEN doc_id % 7 = 0 THEN array('') WHEN doc_id % 11 = 0 THEN array(document_id, concat(document_id, 'x'))
            WHEN doc_id % 3 = 0 THEN array(document_id, concat('doc_', substring(sha2(cast((doc_id + 50) % 100 AS string), 256), 1, 24)))
            ELSE array(document_id) END) AS document_id""",
    )
    return runs, chosen, docs.select("analysis_id", "document_id")


_SCOPE = """runs AS (SELECT 'run_' || doc_id AS run_id, analysis_id, upper(trim(['WHOLE_CASE', 'ONE_DOCUMENT', 'SELECTED_DOCUMENTS', 'one_document ', 'ALL'][doc_id % 5 + 1])) AS mode FROM docs),
    chosen AS (SELECT DISTINCT 'run_' || doc_id AS run_id, analysis_id, x AS document_id FROM (SELECT doc_id, analysis_id, unnest(CASE WHEN doc_id % 7 = 0 THEN [''] WHEN doc_id % 11 = 0 THEN [document_id, document_id || 'x']
        WHEN doc_id % 3 = 0 THEN [document_id, 'doc_' || substr(sha256(((doc_id + 50) % 100)::VARCHAR), 1, 24)] ELSE [document_id] END) AS x FROM docs) WHERE x <> ''),
    counted AS (SELECT run_id, count(*) AS n, count(*) FILTER (d.document_id IS NULL) AS outside FROM chosen c LEFT JOIN docs d USING (analysis_id, document_id) GROUP BY 1),
    codes AS (SELECT run_id, analysis_id, mode, list_filter([CASE WHEN mode NOT IN ('WHOLE_CASE', 'ONE_DOCUMENT', 'SELECTED_DOCUMENTS') THEN 'UNSUPPORTED_SCOPE_MODE' END,
        CASE WHEN mode IN ('ONE_DOCUMENT', 'SELECTED_DOCUMENTS') AND n IS NULL THEN 'SCOPE_WITHOUT_DOCUMENTS' END, CASE WHEN mode = 'ONE_DOCUMENT' AND n > 1 THEN 'ONE_DOCUMENT_WITH_OTHER_COUNT' END,
        CASE WHEN mode IN ('ONE_DOCUMENT', 'SELECTED_DOCUMENTS') AND outside > 0 THEN 'DOCUMENT_OUTSIDE_ANALYSIS' END], lambda x: x IS NOT NULL) AS rules FROM runs LEFT JOIN counted USING (run_id))"""


@query(
    f"""WITH {_SCOPE} SELECT run_id, analysis_id, d.document_id FROM codes JOIN docs d USING (analysis_id) WHERE len(rules) = 0 AND mode = 'WHOLE_CASE'
        UNION ALL SELECT run_id, codes.analysis_id, document_id FROM codes JOIN chosen USING (run_id) WHERE len(rules) = 0 AND mode <> 'WHOLE_CASE'""",
    "docs",
)
def resolved_scopes(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_scope(*_runs(spark, d))


@query(f"WITH {_SCOPE} SELECT run_id, unnest(rules) AS rule FROM codes", "docs")
def scope_contract(spark: SparkSession, d: str) -> DataFrame:
    return R.scope_violations(*_runs(spark, d))


def _normalisations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First word of every benchmark text as an expression for its last word."""
    rows = B.table(spark, d, "benchmark").select("item_id", F.split(R.normalise_label(F.col("text")), " ").alias("w"))
    normalisations = rows.selectExpr(
        "w[0] AS source_expression", "concat('code_', item_id) AS target_code",
        "CASE WHEN item_id % 3 < 2 THEN 'HUMAN_VALIDATED' ELSE 'PROPOSED' END AS review_status",
    )
    registry = rows.selectExpr("concat('code_', item_id) AS code", "element_at(w, -1) AS code_value")
    return normalisations, registry


_EXPANSIONS = f"""words AS (SELECT item_id, string_split({norm_sql('text')}, ' ') AS w FROM benchmark),
    pairs AS (SELECT DISTINCT w[1] AS a, w[-1] AS b FROM words WHERE item_id % 3 < 2),
    expansions AS (SELECT a AS term, b AS expansion FROM pairs UNION SELECT b, a FROM pairs)"""


@query(f"WITH {_EXPANSIONS} SELECT term, expansion FROM expansions")
def expanded_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.expand_terms(*_normalisations(spark, d))


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "part").selectExpr(
        "concat('query_', p_size) AS query_id", "element_at(array('SUBJECT_FACTOR', 'OBJECT_EVENT', 'OBJECT_CONTEXT'), cast(p_partkey % 3 + 1 AS int)) AS role",
        "p_brand AS code", "p_type AS code_value",
    )


@query(
    """SELECT 'query_' || p_size AS query_id, ['SUBJECT_FACTOR', 'OBJECT_EVENT', 'OBJECT_CONTEXT'][p_partkey % 3 + 1] AS role, p_type AS term FROM part
    UNION SELECT 'query_' || a.p_size, ['SUBJECT_FACTOR', 'OBJECT_EVENT', 'OBJECT_CONTEXT'][a.p_partkey % 3 + 1], b.p_name FROM part a JOIN part b ON a.p_brand = b.p_brand WHERE b.p_partkey % 5 <> 0"""
)
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    normalisations = B.table(spark, d, "part").selectExpr(
        "p_name AS source_expression", "p_brand AS target_code", "CASE WHEN p_partkey % 5 <> 0 THEN 'HUMAN_VALIDATED' ELSE 'REJECTED' END AS review_status"
    )
    return R.query_terms(_concepts(spark, d), normalisations)


_SCORES = f"""{_EXPANSIONS},
    asked AS (SELECT query_id, {norm_sql('query_text')} AS phrase, {tokens_sql('query_text')} AS t FROM questions),
    own AS (SELECT query_id, unnest(t) AS term FROM asked),
    wide AS (SELECT DISTINCT term AS source, unnest({tokens_sql('expansion')}) AS term FROM expansions),
    added AS (SELECT DISTINCT query_id, w.term FROM asked JOIN wide w ON list_contains(string_split(phrase, ' '), w.source) ANTI JOIN own USING (query_id, term)),
    terms AS (SELECT query_id, term, FALSE AS expanded FROM own UNION ALL SELECT query_id, term, TRUE FROM added),
    spread AS (SELECT passage_id, document_id, passage_order, length(passage_text)::BIGINT AS chars, {norm_sql('passage_text')} AS norm, unnest({tokens_sql('passage_text')}) AS term FROM passages),
    scores AS (SELECT query_id, passage_id, document_id, passage_order, chars,
        array_to_string(list(term ORDER BY term) FILTER (NOT expanded), ' ') AS query_hits, coalesce(array_to_string(list(term ORDER BY term) FILTER (expanded), ' '), '') AS expansion_hits,
        (10 * count(*) FILTER (NOT expanded) + 4 * count(*) FILTER (expanded) + CASE WHEN count(*) FILTER (NOT expanded) > 0 AND contains(any_value(norm), any_value(phrase)) THEN 20 ELSE 0 END)::BIGINT AS lexical_score
        FROM spread JOIN terms USING (term) JOIN asked USING (query_id) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, document_id, passage_order, passage_id) AS rank FROM scores),
    hits AS (SELECT *, (sum(chars) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS cumulative_chars FROM ranked WHERE rank <= 40)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_retrieve(B.passages(spark, d), B.questions(spark, d), R.expand_terms(*_normalisations(spark, d)), k=40)


@query(f"WITH {_SCORES} SELECT query_id, passage_id, rank, lexical_score, chars, cumulative_chars, coalesce(query_hits, '') AS query_hits, expansion_hits FROM hits", "questions", "passages")
def lexical_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select(
        "query_id", "passage_id", "rank", "lexical_score", "chars", "cumulative_chars",
        F.array_join("matched_query_terms", " ").alias("query_hits"), F.array_join("matched_expansion_terms", " ").alias("expansion_hits"),
    )


@query(
    f"""WITH {_SCORES} SELECT q.query_id, coalesce(c, 0) AS candidate_count, coalesce(n, 0) AS selected_count, coalesce(s, 0)::BIGINT AS selected_characters FROM questions q
        LEFT JOIN (SELECT query_id, count(*) AS c FROM scores GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n, sum(chars) AS s FROM hits GROUP BY 1) USING (query_id)""",
    "questions", "passages",
)
def retrieval_summaries(spark: SparkSession, d: str) -> DataFrame:
    expansions = R.expand_terms(*_normalisations(spark, d))
    questions = B.questions(spark, d)
    return R.retrieval_summary(questions, R.lexical_scores(B.passages(spark, d), questions, expansions), _hits(spark, d))


@query(
    f"""WITH {_SCORES}, {RUN_SCOPES}, sized AS (SELECT run_id, count(*) AS n, sum(length(passage_text)) AS c FROM run_scopes JOIN passages USING (analysis_id, document_id) GROUP BY 1)
    SELECT 'run_' || item_id AS run_id, coalesce(n, 0) AS scope_passages, coalesce(c, 0)::BIGINT AS scope_chars, CASE WHEN n IS NULL THEN 'NO_PASSAGES_IN_SCOPE'
        WHEN item_id % 9 = 0 THEN 'GOVERNED_QUERY' WHEN item_id % 2 = 0 THEN 'ALL_SCOPED_PASSAGES' WHEN h.run_id IS NOT NULL THEN 'LEXICAL' ELSE 'DETERMINISTIC_NO_SUPPORT' END AS retrieval_mode
    FROM benchmark LEFT JOIN sized s ON s.run_id = 'run_' || item_id LEFT JOIN (SELECT DISTINCT 'run_' || substr(query_id, 2) AS run_id FROM hits) h ON h.run_id = 'run_' || item_id""",
    "questions", "docs", "passages",
)
def retrieval_modes(spark: SparkSession, d: str) -> DataFrame:
    runs = B.table(spark, d, "benchmark").selectExpr(
        "concat('run_', item_id) AS run_id", "CASE WHEN item_id % 9 = 0 THEN 'Q1' END AS governed_query_id", "CASE WHEN item_id % 2 = 0 THEN 'ALL' ELSE 'LEXICAL' END AS retrieval_policy"
    )
    found = _hits(spark, d).select(F.concat(F.lit("run_"), F.expr("substring(query_id, 2)")).alias("run_id"))
    return R.choose_retrieval_mode(runs, R.scope_sizes(run_scopes(spark, d), B.passages(spark, d)), found)


@query(
    f"""WITH {_SCORES} SELECT query_id, count(*) AS passages, 'snapshot_' || substr(sha256(query_id || '|' || string_agg(passage_id || '|' || text_sha256, chr(10)
        ORDER BY package_id, document_id, passage_order, passage_id)), 1, 32) AS retrieval_snapshot_id FROM hits JOIN passages USING (passage_id, document_id, passage_order) GROUP BY 1""",
    "questions", "passages",
)
def retrieval_snapshots(spark: SparkSession, d: str) -> DataFrame:
    hits = durable(_hits(spark, d).select("query_id", "passage_id"))
    texts = B.passages(spark, d).select("passage_id", "package_id", "document_id", "passage_order", "text_sha256")
    return R.retrieval_snapshot(texts.join(R.checked_broadcast(hits), "passage_id"), ["query_id"])


# Frequent words of the texts serve as cues, because the texts are invented.
CUES = (
    ("FOLLOWED_BY", "and", "FORWARD"), ("FOLLOWED_BY", "in", "REVERSE"), ("FOLLOWED_BY", "que", "FORWARD"),
    ("CONTRIBUTED_TO", "to", "FORWARD"), ("CONTRIBUTED_TO", "is", "REVERSE"), ("CONTRIBUTED_TO", "und", "FORWARD"),
)
_WORD_TERMS = f"""words AS (SELECT item_id, unnest(string_split({norm_sql('text')}, ' ')) AS w, generate_subscripts(string_split({norm_sql('text')}, ' '), 1) AS pos FROM benchmark)"""


def _word_terms(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "benchmark").select("item_id", F.split(R.normalise_label(F.col("text")), " ").alias("ws")).select(
        "item_id", "ws", F.posexplode("ws").alias("pos", "w")
    )


_RELATION_TERMS = f"""{_WORD_TERMS}, terms AS (SELECT DISTINCT 'q' || item_id AS query_id, ['FOLLOWED_BY', 'CONTRIBUTED_TO'][item_id % 2 + 1] AS relationship, role, term FROM (
        SELECT item_id, CASE WHEN pos % 2 = 1 THEN 'SUBJECT_FACTOR' ELSE 'OBJECT_EVENT' END AS role, w AS term FROM words
        UNION ALL SELECT a.item_id, 'OBJECT_EVENT', a.w || ' ' || b.w FROM words a JOIN words b ON a.item_id = b.item_id AND b.pos = a.pos + 1 WHERE a.pos % 4 = 0))"""


def _relation_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every word of a text is a subject or an object by turns; every fourth one with its successor is an object, too."""
    words = _word_terms(spark, d).selectExpr("concat('q', item_id) AS query_id", "pos", "w", "get(ws, pos + 1) AS next")
    single = words.selectExpr("query_id", "CASE WHEN pos % 2 = 0 THEN 'SUBJECT_FACTOR' ELSE 'OBJECT_EVENT' END AS role", "w AS term")
    pairs = words.where("(pos + 1) % 4 = 0 AND next IS NOT NULL").selectExpr("query_id", "'OBJECT_EVENT' AS role", "concat(w, ' ', next) AS term")
    return single.unionByName(pairs).distinct()


@query(
    f"""WITH {_RELATION_TERMS},
    cues(relationship, cue, direction) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in CUES)}),
    sentences AS (SELECT passage_id, pos - 1 AS sentence_index, s AS evidence_text, string_split({norm_sql('s')}, ' ') AS w FROM (SELECT passage_id,
        unnest(string_split(regexp_replace(passage_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s,
        generate_subscripts(string_split(regexp_replace(passage_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM passages)),
    cued AS (SELECT * FROM sentences WHERE list_has_any(w, [{', '.join(f"'{c.split(' ')[0]}'" for _, c, _ in CUES)}])),
    runs AS (SELECT passage_id, sentence_index, at_, array_to_string(w[at_:at_ + n - 1], ' ') AS run, n FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS at_ FROM cued, (VALUES (1), (2)) AS sizes(n))),
    places AS (SELECT passage_id, sentence_index, relationship, cue, direction, at_, at_ + n - 1 AS end_ FROM runs JOIN cues ON run = cue),
    found AS (SELECT r.passage_id, r.sentence_index, t.*, at_ AS from_, at_ + n - 1 AS to_ FROM runs r JOIN terms t ON run = term),
    met AS (SELECT p.*, f.query_id, role, term, CASE WHEN (role = 'SUBJECT_FACTOR') = (direction = 'FORWARD') THEN CASE WHEN to_ < at_ THEN at_ - to_ END WHEN from_ > end_ THEN from_ - end_ END AS dist
        FROM places p JOIN found f USING (passage_id, sentence_index, relationship)),
    nearest AS (SELECT query_id, relationship, passage_id, sentence_index, cue, direction, at_, min((dist, -length(term), term)) FILTER (role = 'SUBJECT_FACTOR') AS s,
        min((dist, -length(term), term)) FILTER (role = 'OBJECT_EVENT') AS o FROM met WHERE dist IS NOT NULL GROUP BY ALL)
    SELECT query_id, relationship AS requested_relationship, passage_id, sentence_index::BIGINT AS sentence_index, s[3] AS subject_term, cue AS relation_cue, at_::BIGINT AS cue_position, direction AS relation_direction,
        o[3] AS object_term, sha256(evidence_text) AS evidence_text_sha256 FROM nearest JOIN sentences USING (passage_id, sentence_index) WHERE s IS NOT NULL AND o IS NOT NULL""",
    "passages",
)
def governed_relationships(spark: SparkSession, d: str) -> DataFrame:
    queries = B.table(spark, d, "benchmark").selectExpr("concat('q', item_id) AS query_id", "element_at(array('FOLLOWED_BY', 'CONTRIBUTED_TO'), cast(item_id % 2 + 1 AS int)) AS relationship")
    return R.governed_relationship_query(B.passages(spark, d), queries, _relation_terms(spark, d), CUES).drop("document_id", "evidence_text")


_ROLES = f"""{_WORD_TERMS}, terms AS (SELECT DISTINCT 'q' || a.item_id AS query_id, ['SUBJECT_FACTOR', 'OBJECT_EVENT', 'OBJECT_CONTEXT'][a.pos % 3 + 1] AS role,
        a.w || CASE WHEN a.pos % 4 IN (2, 3) THEN coalesce(' ' || b.w, '') ELSE '' END || CASE WHEN a.pos % 4 = 3 THEN coalesce(' ' || c.w, '') ELSE '' END AS term
        FROM words a LEFT JOIN words b ON a.item_id = b.item_id AND b.pos = a.pos + 1 LEFT JOIN words c ON a.item_id = c.item_id AND c.pos = a.pos + 2),
    spaced AS (SELECT package_id, passage_id, string_split({norm_sql('passage_text')}, ' ') AS w FROM passages),
    runs AS (SELECT DISTINCT package_id, passage_id, array_to_string(w[at_:at_ + n - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS at_ FROM spaced, (VALUES (1), (2), (3)) AS sizes(n))),
    matches AS (SELECT query_id, role, term, package_id, passage_id FROM runs JOIN terms ON run = term),
    complete AS (SELECT query_id, package_id, roles FROM (SELECT query_id, package_id, count(DISTINCT role) AS n FROM matches GROUP BY 1, 2) JOIN (SELECT query_id, count(DISTINCT role) AS roles FROM terms GROUP BY 1) USING (query_id) WHERE n = roles)"""


@query(
    f"""WITH {_ROLES} SELECT query_id, package_id, passage_id, count(DISTINCT role) AS matched_roles, count(DISTINCT role) = any_value(roles) AS all_roles_in_passage,
        array_to_string(list(DISTINCT role || '=' || term ORDER BY role || '=' || term), '; ') AS matched_terms FROM matches JOIN complete USING (query_id, package_id) GROUP BY 1, 2, 3""",
    "passages",
)
def role_coverage(spark: SparkSession, d: str) -> DataFrame:
    """At every position of a text begins a term of one, two or three words of one of three roles."""
    words = _word_terms(spark, d)
    term = "concat_ws(' ', w, CASE WHEN (pos + 1) % 4 IN (2, 3) THEN get(ws, pos + 1) END, CASE WHEN (pos + 1) % 4 = 3 THEN get(ws, pos + 2) END) AS term"
    terms = words.selectExpr("concat('q', item_id) AS query_id", "element_at(array('SUBJECT_FACTOR', 'OBJECT_EVENT', 'OBJECT_CONTEXT'), cast((pos + 1) % 3 + 1 AS int)) AS role", term).distinct()
    return R.role_coverage_retrieve(B.passages(spark, d), terms).drop("document_id")


_FOCUS = f"""listed AS (SELECT analysis_id, label, node_kind, {norm_sql('label')} AS norm,
        CASE node_kind WHEN 'ContributingFactor' THEN 1 WHEN 'SafetyIssue' THEN 2 WHEN 'Event' THEN 3 WHEN 'Finding' THEN 4 ELSE 5 END AS ord,
        CASE node_kind WHEN 'ContributingFactor' THEN 5 WHEN 'SafetyIssue' THEN 4 WHEN 'Event' THEN 3 WHEN 'Finding' THEN 2 ELSE 1 END AS weight
        FROM concept_nodes WHERE node_kind IN ('ContributingFactor', 'SafetyIssue', 'Event', 'Finding', 'System')),
    concepts AS (SELECT analysis_id, norm, label, node_kind, weight, row_number() OVER (PARTITION BY analysis_id ORDER BY ord, label, norm) AS position
        FROM (SELECT * FROM listed WHERE norm NOT IN ('', 'subject vessel') QUALIFY row_number() OVER (PARTITION BY analysis_id, norm ORDER BY ord, label, node_kind) = 1))"""


def _focus(spark: SparkSession, d: str) -> DataFrame:
    return R.focus_concepts(B.concept_nodes(spark, d))


@query(f"WITH {_FOCUS} SELECT analysis_id, norm AS normalised_label, label, node_kind, weight, position FROM concepts", "concept_nodes")
def focus_concepts(spark: SparkSession, d: str) -> DataFrame:
    return _focus(spark, d)


@query(f"WITH {_FOCUS} SELECT analysis_id, term, max(weight) AS weight FROM (SELECT analysis_id, weight, unnest({tokens_sql('label', CASE_STOP)}) AS term FROM concepts) GROUP BY 1, 2", "concept_nodes")
def term_weights(spark: SparkSession, d: str) -> DataFrame:
    return R.term_weights(_focus(spark, d))


_SIMILAR = f"""{_FOCUS},
    weights AS (SELECT analysis_id, term, max(weight) AS w FROM (SELECT analysis_id, weight, unnest({tokens_sql('label', CASE_STOP)}) AS term FROM concepts) GROUP BY 1, 2),
    asked AS (SELECT analysis_id, string_agg(label, ' ; ' ORDER BY position) AS query_text FROM concepts GROUP BY 1),
    terms AS (SELECT analysis_id, {norm_sql('query_text')} AS phrase, unnest({tokens_sql('query_text', CASE_STOP)}) AS term FROM asked),
    spread AS (SELECT passage_id, document_id, package_id, passage_order, page_start, page_end, length(passage_text) AS chars, {norm_sql('passage_text')} AS norm, unnest({tokens_sql('passage_text', CASE_STOP)}) AS term FROM passages),
    own AS (SELECT 'case_' || item_id AS analysis_id, 'src' || (item_id % 20) AS package_id FROM benchmark),
    scores AS (SELECT analysis_id, passage_id, document_id, package_id, passage_order, page_start, page_end, chars, norm, list(term ORDER BY term) AS found, sum(coalesce(w, 1)) AS term_weight,
        10 * count(*) + CASE WHEN contains(norm, any_value(phrase)) THEN 20 ELSE 0 END AS lexical_score
        FROM spread JOIN terms USING (term) LEFT JOIN weights USING (analysis_id, term) ANTI JOIN own USING (analysis_id, package_id) GROUP BY analysis_id, passage_id, document_id, package_id, passage_order, page_start, page_end, chars, norm),
    hits AS (SELECT * FROM scores),
    phrases AS (SELECT h.analysis_id, h.passage_id, sum(c.weight) AS concept_weight, list(DISTINCT c.label) AS labels FROM hits h JOIN concepts c ON h.analysis_id = c.analysis_id AND contains(h.norm, c.norm) GROUP BY 1, 2),
    weighted AS (SELECT h.*, coalesce(concept_weight, 0) AS concept_weight, coalesce(labels, []) AS labels, lexical_score + 25 * term_weight + 40 * coalesce(concept_weight, 0) AS weighted_score
        FROM hits h LEFT JOIN phrases USING (analysis_id, passage_id)),
    packages AS (SELECT analysis_id, package_id, sum(lexical_score) AS total_score, max(lexical_score) AS max_passage_score, sum(weighted_score) AS weighted_score, sum(concept_weight) AS matched_concept_weight,
        list_sort(list_distinct(flatten(list(labels)))) AS labels, list_sort(list_distinct(flatten(list(found)))) AS terms FROM weighted GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY matched_concept_weight DESC, len(labels) DESC, weighted_score DESC, len(terms) DESC, total_score DESC, max_passage_score DESC, package_id) AS rank
        FROM packages QUALIFY rank <= 5)"""


def _own(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "benchmark").selectExpr("concat('case_', item_id) AS query_id", "concat('src', item_id % 20) AS package_id")


def _similar(spark: SparkSession, d: str) -> DataFrame:
    return R.similar_cases(B.passages(spark, d), _focus(spark, d), _own(spark, d), k=5)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return R.top_evidence(R.case_pairs(B.passages(spark, d), _focus(spark, d), _own(spark, d), best=4), B.docs(spark, d), n=4)


@query(
    f"""WITH {_SIMILAR} SELECT analysis_id, package_id, rank, total_score::BIGINT AS total_score, max_passage_score::BIGINT AS max_passage_score, weighted_score::BIGINT AS weighted_score,
        matched_concept_weight::BIGINT AS matched_concept_weight, array_to_string(labels, '; ') AS matched_concepts, array_to_string(terms, ' ') AS matched_query_terms,
        'similar_case_' || substr(sha256(analysis_id || '|' || package_id || '|SIMILAR_CASES_1'), 1, 24) AS candidate_id FROM best""",
    "concept_nodes", "passages",
)
def similar_cases(spark: SparkSession, d: str) -> DataFrame:
    found = _similar(spark, d)
    return found.select(
        "analysis_id", "package_id", "rank", "total_score", "max_passage_score", "weighted_score", "matched_concept_weight",
        F.array_join("matched_concepts", "; ").alias("matched_concepts"), F.array_join("matched_query_terms", " ").alias("matched_query_terms"), "candidate_id",
    )


@query(
    f"""WITH {_SIMILAR} SELECT analysis_id, package_id, evidence_rank, passage_id, lexical_score::BIGINT AS lexical_score, filename || ' · ' || CASE WHEN page_start IS NULL THEN 'page unknown'
        WHEN page_end IS NULL OR page_end = page_start THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '–' || page_end END AS evidence_reference,
        document_id || '|' || coalesce(page_start::VARCHAR, '') || '|' || coalesce(page_end::VARCHAR, '') AS evidence_location
    FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, package_id ORDER BY lexical_score DESC, document_id, passage_order, passage_id) AS evidence_rank FROM weighted QUALIFY evidence_rank <= 4)
    JOIN docs USING (document_id, package_id) """.replace("SELECT analysis_id, package_id, evidence_rank", "SELECT w.analysis_id, package_id, evidence_rank").replace("QUALIFY evidence_rank <= 4)", "QUALIFY evidence_rank <= 4) w"),
    "concept_nodes", "docs", "passages",
)
def top_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d)


@query(
    f"""WITH {_SIMILAR} SELECT analysis_id, rule, key FROM (
        SELECT analysis_id, 'OWN_PACKAGE' AS rule, package_id AS key FROM best WHERE package_id = 'src' || ((replace(analysis_id, 'case_', '')::INT + 1) % 20)
        UNION ALL SELECT analysis_id, 'RANKS_NOT_UNIQUE', '' FROM best GROUP BY 1 HAVING count(*) >= 4
        UNION ALL SELECT analysis_id, 'RANKS_NOT_CONTIGUOUS', '' FROM best GROUP BY 1 HAVING count(*) >= 4
        UNION ALL SELECT analysis_id, 'EVIDENCE_PASSAGE_MISSING', passage_id FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, package_id ORDER BY lexical_score DESC, document_id, passage_order, passage_id) AS r FROM weighted QUALIFY r <= 4) WHERE right(document_id, 1) IN ('0', '1', '2'))""",
    "concept_nodes", "passages",
)
def similar_case_contract(spark: SparkSession, d: str) -> DataFrame:
    """Checks of results that were damaged on purpose: rank 4 became 3, passages of some documents are unknown, another package is the own one."""
    found = _similar(spark, d).withColumn("rank", F.expr("CASE WHEN rank = 4 THEN 3 ELSE rank END"))
    own = B.table(spark, d, "benchmark").selectExpr("concat('case_', item_id) AS analysis_id", "concat('src', (item_id + 1) % 20) AS package_id")
    passages = B.passages(spark, d).where("right(document_id, 1) NOT IN ('0', '1', '2')")
    return R.similar_case_violations(found, _evidence(spark, d), passages, own)


def _taxonomy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = B.table(spark, d, "part")
    nodes = part.selectExpr(
        "concat('node_', p_partkey) AS node_id", f"element_at({B._array(B.KINDS)}, cast(p_partkey % 9 + 1 AS int)) AS node_kind", "p_name AS label",
        "concat(p_type, ' of ', p_size) AS description",
    )
    registry = part.selectExpr(
        "concat(element_at(array('Contributing Factor', 'Casualty Event', 'Vessel', 'Safety recommendation', 'Other'), cast(p_partkey % 5 + 1 AS int)), '/', p_brand) AS entity_path",
        "p_brand AS entity_name", "p_type AS attribute_name", "CASE WHEN p_partkey % 50 <> 0 THEN concat('code_', p_partkey % 700) END AS code",
        "CASE WHEN p_partkey % 10 = 0 THEN substring(p_name, 1, 4) ELSE p_name END AS code_value",
    )
    return nodes, registry


@query(
    f"""WITH n AS (SELECT 'node_' || p_partkey AS node_id, {B._K}[p_partkey % 9 + 1] AS node_kind, {norm_sql("p_name || ' ' || p_type || ' of ' || p_size")} AS txt FROM part),
    nt AS (SELECT DISTINCT node_kind, txt, {tokens_sql('txt')} AS w FROM n),
    r AS (SELECT ['Contributing Factor', 'Casualty Event', 'Vessel', 'Safety recommendation', 'Other'][p_partkey % 5 + 1] || '/' || p_brand AS entity_path, p_brand AS entity_name, p_type AS attribute_name,
        CASE WHEN p_partkey % 50 <> 0 THEN 'code_' || (p_partkey % 700) END AS code, trim(CASE WHEN p_partkey % 10 = 0 THEN substr(p_name, 1, 4) ELSE p_name END) AS code_value FROM part),
    rt AS (SELECT DISTINCT *, {norm_sql('code_value')} AS phrase, {tokens_sql('code_value')} AS cw, {tokens_sql('attribute_name')} AS aw, lower(entity_path) AS path FROM r),
    scored AS (SELECT node_kind, txt, rt.*, 18 * len(list_intersect(w, cw)) + 6 * len(list_intersect(w, aw)) + CASE WHEN node_kind = 'ContributingFactor' AND contains(path, 'contributing factor') THEN 60
        WHEN node_kind = 'Recommendation' AND contains(path, 'safety recommendation') THEN 60 WHEN node_kind IN ('Event', 'System') AND contains(path, 'casualty event') THEN 45
        WHEN node_kind = 'Vessel' AND contains(path, 'vessel') THEN 25 ELSE 0 END + CASE WHEN phrase <> '' AND contains(txt, phrase) THEN 120 ELSE 0 END
        + CASE WHEN len(cw) > 0 AND len(list_intersect(w, cw)) = len(cw) THEN 70 ELSE 0 END AS score FROM nt, rt),
    uniq AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY node_kind, txt, entity_path, attribute_name, code ORDER BY score DESC, code_value, entity_name) = 1),
    top AS (SELECT *, row_number() OVER (PARTITION BY node_kind, txt ORDER BY score DESC, entity_path, attribute_name, code_value, coalesce(code, '')) AS rank FROM uniq QUALIFY rank <= 12)
    SELECT node_id, rank, score::BIGINT AS score, entity_path, entity_name, attribute_name, code_value, code,
        'taxonomy_candidate_' || substr(sha256(entity_path || '|' || attribute_name || '|' || code_value || '|' || coalesce(code, '')), 1, 20) AS candidate_id FROM n JOIN top USING (node_kind, txt)"""
)
def taxonomy_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return R.taxonomy_shortlist(*_taxonomy(spark, d), k=12)


@query(
    f"""WITH asked AS (SELECT analysis_id || '#' || node_id AS factor_node_id, unnest({tokens_sql('label')}) AS term, {norm_sql('label')} AS phrase FROM concept_nodes WHERE node_kind = 'ContributingFactor'),
    spread AS (SELECT passage_id, document_id, passage_order, length(passage_text)::BIGINT AS chars, {norm_sql('passage_text')} AS norm, unnest({tokens_sql('passage_text')}) AS term FROM passages),
    scores AS (SELECT factor_node_id, passage_id, document_id, passage_order, chars, (10 * count(*) + CASE WHEN contains(any_value(norm), any_value(phrase)) THEN 20 ELSE 0 END)::BIGINT AS lexical_score
        FROM spread JOIN asked USING (term) GROUP BY 1, 2, 3, 4, 5),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY factor_node_id ORDER BY lexical_score DESC, document_id, passage_order, passage_id) AS rank FROM scores QUALIFY rank <= 12)
    SELECT factor_node_id, passage_id, rank, lexical_score, (sum(chars) OVER (PARTITION BY factor_node_id ORDER BY rank))::BIGINT AS cumulative_chars FROM ranked""",
    "concept_nodes", "passages",
)
def grounded_shortlist(spark: SparkSession, d: str) -> DataFrame:
    factors = B.concept_nodes(spark, d).where("node_kind = 'ContributingFactor'").selectExpr(
        "concat(analysis_id, '#', node_id) AS factor_node_id", "label AS factor_label", "cast(NULL AS string) AS factor_description"
    )
    return R.grounded_shortlist(factors, B.passages(spark, d), k=12).select("factor_node_id", "passage_id", "rank", "lexical_score", "cumulative_chars")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    """The newest 25 events: the limit is the report."""
    return R.recent(B.table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 25).select("event_id", "user_id", "event_type")
