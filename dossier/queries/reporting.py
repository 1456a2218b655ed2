"""Queries of alerts, costs, benchmarks, quotas, retention and table status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import rules as R
from dossier.operators import alerts as A
from dossier.operators import benchmarks as M
from dossier.operators import costs as C
from dossier.operators import retention as T
from dossier.operators.privacy import redaction_status
from dossier.operators.reviews import latest_review
from dossier.queries import bindings as B
from dossier.queries.registry import query

# --- alerts -------------------------------------------------------------------------------------------------


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _first(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, words)} THEN '{label}'" for words, label in rules) + f" ELSE '{default}' END"


_RELEVANT = (
    f"NOT regexp_matches(headline, '{R.INLAND_WATERS}') AND NOT {_any('upper(headline)', R.NOISE_WORDS)}"
    f" AND NOT ({_any('upper(headline)', R.MIGRATION_WORDS)} AND NOT {_any('upper(headline)', R.LOSS_OF_LIFE)})"
)
_NEWEST = f"newest AS (SELECT *, regexp_extract(sub_headline_text, 'IMO:\\s*(\\d{{7}})', 1) AS imo_number FROM alerts WHERE {_RELEVANT} QUALIFY row_number() OVER (PARTITION BY alert_group_id ORDER BY alert_version DESC) = 1)"
_EXPANDED = f"""{_NEWEST}, expanded AS (SELECT *, flag_country AS match_country, 'Flag' AS match_reason FROM newest WHERE flag_country IS NOT NULL UNION ALL SELECT *, location_country, 'Location' FROM newest WHERE location_country IS NOT NULL
    UNION ALL SELECT *, crew_country, 'Crew' FROM newest WHERE crew_country IS NOT NULL UNION ALL SELECT *, NULL, alert_reason FROM newest WHERE flag_country IS NULL AND location_country IS NULL AND crew_country IS NULL),
    labelled AS (SELECT *, headline || CASE WHEN previous_headlines IS NOT NULL THEN chr(10) || '---' || chr(10) || previous_headlines ELSE '' END AS headline_full, {_first('upper(headline)', R.VESSEL_TYPES, 'unknown')} AS vessel_type,
        {_first('upper(headline)', R.EVENT_TYPES, 'Other')} AS event_type, {_first('upper(headline)', R.SEVERITIES, 'unknown')} AS severity, CASE WHEN {_any('upper(headline)', R.LOSS_OF_LIFE)} THEN 'Yes' ELSE 'No' END AS loss_of_life FROM expanded)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    newest = A.latest_alert_version(B.alerts(spark, d))
    return A.classify_headline(A.full_headline(A.expand_matches(newest)))


@query(f"WITH {_NEWEST} SELECT alert_group_id, alert_id, alert_version, headline, imo_number FROM newest", "alerts")
def latest_alert_versions(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_alert_version(B.alerts(spark, d)).select("alert_group_id", "alert_id", "alert_version", "headline", "imo_number")


@query(f"WITH {_EXPANDED} SELECT alert_id, match_country, match_reason FROM expanded", "alerts")
def expanded_alerts(spark: SparkSession, d: str) -> DataFrame:
    return A.expand_matches(A.latest_alert_version(B.alerts(spark, d))).select("alert_id", "match_country", "match_reason")


@query(
    f"""SELECT alert_id, {_first('upper(headline)', R.VESSEL_TYPES, 'unknown')} AS vessel_type, {_first('upper(headline)', R.EVENT_TYPES, 'Other')} AS event_type,
        {_first('upper(headline)', R.SEVERITIES, 'unknown')} AS severity, CASE WHEN {_any('upper(headline)', R.LOSS_OF_LIFE)} THEN 'Yes' ELSE 'No' END AS loss_of_life FROM alerts""",
    "alerts",
)
def classified_headlines(spark: SparkSession, d: str) -> DataFrame:
    return A.classify_headline(B.alerts(spark, d)).select("alert_id", "vessel_type", "event_type", "severity", "loss_of_life")


@query(
    f"""WITH {_EXPANDED} SELECT alert_id, match_country, match_reason, headline_full FROM labelled WHERE alert_timestamp >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 400 DAY
        AND event_type IN ('Fire', 'Collision', 'Sinking', 'Fatality', 'Explosion') AND match_reason IN ('Flag', 'Crew') AND contains(lower(headline_full), 'earlier')""",
    "alerts",
)
def alert_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = A.alert_window(
        labelled(spark, d), datetime(2001, 8, 1), 400, event_types=("Fire", "Collision", "Sinking", "Fatality", "Explosion"), reasons=("Flag", "Crew"), text="EARLIER"
    )
    return rows.select("alert_id", "match_country", "match_reason", "headline_full")


@query(f"WITH {_EXPANDED} SELECT match_country AS value, count(DISTINCT alert_id) AS alerts FROM labelled WHERE match_country IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "alerts")
def alerts_by_country(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most frequent countries: the limit is the report."""
    return A.alert_counts(labelled(spark, d), "match_country")


@query(f"WITH {_EXPANDED} SELECT vessel_type AS value, count(DISTINCT alert_id) AS alerts FROM labelled GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "alerts")
def alerts_by_vessel_type(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most frequent vessel types: the limit is the report."""
    return A.alert_counts(labelled(spark, d), "vessel_type")


@query(f"WITH {_EXPANDED} SELECT event_type AS value, count(DISTINCT alert_id) AS alerts FROM labelled GROUP BY 1", "alerts")
def alerts_by_event_type(spark: SparkSession, d: str) -> DataFrame:
    return A.alert_counts(labelled(spark, d), "event_type", None)


@query(f"WITH {_EXPANDED} SELECT strftime(alert_timestamp, '%Y-%m-%d') AS value, count(DISTINCT alert_id) AS alerts FROM labelled GROUP BY 1", "alerts")
def alerts_by_day(spark: SparkSession, d: str) -> DataFrame:
    return A.alert_counts(labelled(spark, d).withColumn("day", F.to_date("alert_timestamp")), "day", None)


@query(
    f"""WITH {_EXPANDED} SELECT count(DISTINCT alert_id) AS alerts, count(DISTINCT alert_id) FILTER (loss_of_life = 'Yes') AS fatal_alerts, count(DISTINCT match_country) AS countries, strftime(max(load_date), '%Y-%m-%d') AS last_update FROM labelled""",
    "alerts",
)
def alert_kpis(spark: SparkSession, d: str) -> DataFrame:
    return A.alert_kpis(labelled(spark, d)).withColumn("last_update", F.date_format("last_update", "yyyy-MM-dd"))


_LABELS = ("Fire in port", "tanker", "Engine fire", "collision off coast", "Crew killed", "GROUNDED", "ferry", "subject vessel", "sinks", "loss of life", "fir")


def _alert_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of one analysis per customer segment and nation: five labels each, some repeated."""
    return B.table(spark, d, "customer").selectExpr(
        "concat('case_', c_nationkey) AS analysis_id", "c_custkey AS position", f"element_at({B._array(_LABELS)}, cast(c_custkey % 11 + 1 AS int)) AS label",
        "element_at(array('Event', 'ContributingFactor', 'Actor', 'Finding', 'SafetyIssue', 'System', 'Vessel'), cast(c_custkey % 7 + 1 AS int)) AS node_kind",
    )


_ALERT_CONCEPTS = f"""concepts AS (SELECT 'case_' || c_nationkey AS analysis_id, c_custkey AS position, {B._list(_LABELS)}[c_custkey % 11 + 1] AS label FROM customer WHERE c_custkey % 7 NOT IN (2, 6))"""


@query(
    f"""WITH {_EXPANDED}, {_ALERT_CONCEPTS}, phrases AS (SELECT analysis_id, lower(label) AS needle, 3 * count(*) AS points FROM concepts WHERE lower(label) <> 'subject vessel' GROUP BY 1, 2),
    terms AS (SELECT DISTINCT analysis_id, w AS needle, 1 AS points FROM (SELECT analysis_id, unnest(regexp_extract_all(lower(label), '\\w+')) AS w FROM concepts WHERE lower(label) <> 'subject vessel') WHERE length(w) >= 4
        AND w NOT IN ('with', 'from', 'that', 'this', 'were', 'into', 'after', 'before', 'during', 'vessel', 'ship', 'event', 'finding', 'factor', 'safety', 'system')),
    wanted AS (SELECT analysis_id, needle, sum(points) AS points FROM (SELECT * FROM phrases UNION ALL SELECT * FROM terms) GROUP BY 1, 2),
    texts AS (SELECT DISTINCT alert_id, lower(headline_full) AS t FROM labelled)
    SELECT analysis_id, alert_id, sum(points)::BIGINT AS relevance FROM texts JOIN wanted ON contains(t, needle) GROUP BY 1, 2""",
    "alerts",
)
def alert_relevance(spark: SparkSession, d: str) -> DataFrame:
    return A.alert_relevance(labelled(spark, d), _alert_concepts(spark, d))


@query(
    f"""WITH {_EXPANDED}, {_ALERT_CONCEPTS}, firsts AS (SELECT analysis_id, lower(label) AS needle, arg_min(label, position) AS label, min(position) AS position FROM concepts WHERE length(label) > 0 GROUP BY 1, 2),
    wanted AS (SELECT * FROM firsts), texts AS (SELECT DISTINCT alert_id, lower(headline_full) AS t FROM labelled)
    SELECT analysis_id, alert_id, label FROM texts JOIN wanted ON regexp_matches(t, '(^|\\W)' || needle || '($|\\W)')""",
    "alerts",
)
def related_alerts(spark: SparkSession, d: str) -> DataFrame:
    return A.related_concepts(labelled(spark, d), _alert_concepts(spark, d))


# --- costs ----------------------------------------------------------------------------------------------------

_BOUNDS = "strftime(min(usage_start_time), '%Y-%m-%d') AS first_usage, strftime(max(usage_end_time), '%Y-%m-%d') AS last_usage"
_SUMS = "round(sum(usage_quantity), 4) AS usage_quantity, round(sum(effective_list_cost), 2) AS effective_list_cost"


def _days(report: DataFrame) -> DataFrame:
    return report.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_usage", "last_usage")})


@query(
    "SELECT sku_name, usage_unit, strftime(usage_start_time, '%Y-%m-%d') AS day, currency_code, round(sum(unit_list_price), 2) AS price, count(*) AS n, round(sum(effective_list_cost), 2) AS cost FROM priced GROUP BY 1, 2, 3, 4", "priced"
)
def priced_usage(spark: SparkSession, d: str) -> DataFrame:
    priced = C.price_usage(B.usage(spark, d), B.prices(spark, d))
    return priced.groupBy("sku_name", "usage_unit", F.date_format("usage_start_time", "yyyy-MM-dd").alias("day"), "currency_code").agg(
        F.round(F.sum("unit_list_price"), 2).alias("price"), F.count(F.lit(1)).alias("n"), F.round(F.sum("effective_list_cost"), 2).alias("cost")
    )


@query(
    """SELECT billing_origin_product, count(*) FILTER (m = 0) AS unpriced, count(*) FILTER (m = 1) AS priced_once, count(*) FILTER (m > 1) AS priced_repeatedly FROM (SELECT billing_origin_product,
        (SELECT count(*) FROM prices p WHERE u.cloud = p.cloud AND u.sku_name = p.sku_name AND u.usage_unit = p.usage_unit AND u.usage_start_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_end_time <= p.price_end_time)) AS m FROM usage u) GROUP BY 1""",
    "usage", "prices",
)
def price_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.price_coverage(B.usage(spark, d), B.prices(spark, d))


@query(f"SELECT billing_origin_product, sku_name, usage_unit, currency_code, {_SUMS}, {_BOUNDS} FROM priced GROUP BY 1, 2, 3, 4", "priced")
def cost_by_product(spark: SparkSession, d: str) -> DataFrame:
    return _days(C.cost_by_product(B.usage(spark, d), B.prices(spark, d)))


@query(
    f"""WITH j AS (SELECT workspace_id, job_id, name FROM jobs QUALIFY row_number() OVER (PARTITION BY workspace_id, job_id ORDER BY change_time DESC, change_id DESC) = 1)
    SELECT coalesce(j.name, job_name, 'job_id=' || p.job_id) AS job_name, p.job_id, job_run_id, currency_code, {_SUMS}, {_BOUNDS} FROM priced p LEFT JOIN j ON j.workspace_id = p.workspace_id AND j.job_id = p.job_id
    WHERE billing_origin_product = 'JOBS' GROUP BY 1, 2, 3, 4""".replace("coalesce(j.name, job_name,", "coalesce(j.name, p.job_name,"),
    "priced", "jobs",
)
def cost_by_job(spark: SparkSession, d: str) -> DataFrame:
    return _days(C.cost_by_job(B.usage(spark, d), B.prices(spark, d), B.jobs(spark, d)))


@query("SELECT strftime(usage_date, '%Y-%m-%d') AS usage_date, billing_origin_product, currency_code, round(sum(effective_list_cost), 2) AS effective_list_cost FROM priced GROUP BY 1, 2, 3", "priced")
def daily_cost_trend(spark: SparkSession, d: str) -> DataFrame:
    return C.daily_cost_trend(B.usage(spark, d), B.prices(spark, d)).withColumn("usage_date", F.col("usage_date").cast("string"))


@query(f"SELECT app_name, app_id, currency_code, {_SUMS}, {_BOUNDS} FROM priced WHERE billing_origin_product = 'APPS' GROUP BY 1, 2, 3", "priced")
def cost_by_app(spark: SparkSession, d: str) -> DataFrame:
    return _days(C.cost_by_app(B.usage(spark, d), B.prices(spark, d)))


@query(f"SELECT endpoint_name, sku_name, currency_code, {_SUMS}, {_BOUNDS} FROM priced WHERE endpoint_name IS NOT NULL OR sku_name LIKE '%REAL_TIME_INFERENCE%' GROUP BY 1, 2, 3", "priced")
def cost_by_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return _days(C.cost_by_endpoint(B.usage(spark, d), B.prices(spark, d)))


@query(
    f"""SELECT strftime(usage_date, '%Y-%m-%d') AS usage_date, notebook_path, job_name, job_id, job_run_id, run_as, sku_name, currency_code, {_SUMS} FROM priced
        WHERE notebook_path IS NOT NULL OR job_id IS NOT NULL OR job_name IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
    "priced",
)
def cost_by_notebook(spark: SparkSession, d: str) -> DataFrame:
    return C.cost_by_notebook(B.usage(spark, d), B.prices(spark, d)).withColumn("usage_date", F.col("usage_date").cast("string"))


# --- benchmarks -----------------------------------------------------------------------------------------------


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} END"


@query(
    f"""WITH g AS (SELECT model_run_id, count(*) AS generated FROM edges WHERE edge_class <> 'STRUCTURAL' GROUP BY 1), r AS (SELECT model_run_id, count(*) AS reviewed, count(*) FILTER (decision = 'VALIDATED') AS validated,
        count(*) FILTER (decision = 'REJECTED') AS rejected, count(*) FILTER (decision = 'AMENDED') AS amended FROM latest GROUP BY 1),
    j AS (SELECT model_run_id, generated, coalesce(reviewed, 0) AS reviewed, coalesce(validated, 0) AS validated, coalesce(rejected, 0) AS rejected, coalesce(amended, 0) AS amended FROM g LEFT JOIN r USING (model_run_id)),
    pr AS (SELECT model_run_id, sum(n) AS s FROM (SELECT 'run_' || (event_id // 100) AS model_run_id, CASE WHEN event_id % 90 = 7 AND event_id // 100 % 3 <> 0 THEN 2 ELSE 0 END AS n FROM events WHERE event_id // 100 % 7 <> 5) GROUP BY 1)
    SELECT j.*, coalesce(s, 0)::BIGINT AS privacy_redactions, CASE WHEN s > 0 THEN 'PASSED_WITH_AUTOMATIC_REDACTION' WHEN s = 0 THEN 'PASSED' END AS privacy_validation_status, {_rate('reviewed', 'generated')} AS review_coverage, {_rate('validated', 'reviewed')} AS acceptance_rate, {_rate('rejected', 'reviewed')} AS rejection_rate, {_rate('amended', 'reviewed')} AS amendment_rate FROM j LEFT JOIN pr USING (model_run_id)""",
    "edges", "latest",
)
def review_metrics(spark: SparkSession, d: str) -> DataFrame:
    edges = B.edges(spark, d).where("edge_class <> 'STRUCTURAL'")
    outputs = B.table(spark, d, "events").where("event_id div 100 % 7 <> 5").selectExpr(
        "concat('run_', event_id div 100) AS model_run_id", "CASE WHEN event_id % 90 = 7 AND event_id div 100 % 3 <> 0 THEN 2 ELSE 0 END AS redaction_count"
    )
    privacy = redaction_status(outputs, ["model_run_id"]).withColumnRenamed("redaction_count", "privacy_redactions")
    return M.review_metrics(edges, latest_review(B.reviews(spark, d), ["edge_id"]), ["model_run_id"], privacy)


def _model_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of two models; quotes are the label of the cited event, with other white space or words."""
    types = B._array((*B.RELATIONS, "likes", "AFFECTED"))
    return B.table(spark, d, "events").selectExpr(
        "event_id", "concat('c', event_id) AS candidate_id", "concat('run_', user_id, '_', event_id % 2) AS run_id", "concat('bench_', user_id) AS benchmark_id",
        "element_at(array('MODEL_A', 'MODEL_B'), cast(event_id % 2 + 1 AS int)) AS model_key", "CASE WHEN event_id % 33 = 0 THEN ' ' ELSE concat('  ', event_type, '  ', event_id % 3) END AS source_label",
        f"element_at({types}, cast(event_id % 7 + 1 AS int)) AS relationship", "concat('Target ', event_id % 2) AS target_label",
        "CASE WHEN event_id % 21 = 0 THEN cast(array() AS array<string>) WHEN event_id % 22 = 0 THEN array('unknown', concat('n', event_id)) ELSE array(concat('n', event_id), concat('n', event_id - event_id % 10)) END AS evidence_passage_ids",
        "CASE event_id % 4 WHEN 0 THEN concat(event_type, '   at \\n', date_format(ts, 'HH')) WHEN 1 THEN 'invented words' WHEN 2 THEN '' ELSE event_type END AS evidence_quote",
        "element_at(array('direct', 'NORMALISED', 'GUESSED'), cast(event_id % 3 + 1 AS int)) AS evidence_class",
    )


def _checked(spark: SparkSession, d: str) -> DataFrame:
    passages = B.nodes(spark, d).select(F.col("node_id").alias("passage_id"), F.concat(F.lit("seen "), "label").alias("passage_text"))
    return M.candidate_contract(_model_candidates(spark, d), passages)


_SQ = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_CONTRACT = f"""cand AS (SELECT event_id, 'c' || event_id AS candidate_id, 'run_' || user_id || '_' || (event_id % 2) AS run_id, 'bench_' || user_id AS benchmark_id, ['MODEL_A', 'MODEL_B'][event_id % 2 + 1] AS model_key,
        CASE WHEN event_id % 33 = 0 THEN ' ' ELSE '  ' || event_type || '  ' || (event_id % 3) END AS src, upper({B._list((*B.RELATIONS, "likes", "AFFECTED"))}[event_id % 7 + 1]) AS rel, 'Target ' || (event_id % 2) AS tgt,
        CASE WHEN event_id % 21 = 0 THEN []::BIGINT[] WHEN event_id % 22 = 0 THEN [-1, event_id] ELSE [event_id, event_id - event_id % 10] END AS cited,
        CASE event_id % 4 WHEN 0 THEN event_type || ' at ' || strftime(ts, '%H') WHEN 1 THEN 'invented words' WHEN 2 THEN '' ELSE event_type END AS quote, event_id % 3 = 2 AS bad_class FROM events),
    hits AS (SELECT c.candidate_id, bool_or(quote <> '' AND contains('seen ' || e.event_type || ' at ' || strftime(e.ts, '%H:%M'), quote)) AS exact FROM (SELECT *, unnest(cited) AS x FROM cand) c JOIN events e ON e.event_id = c.x GROUP BY 1),
    checked AS (SELECT c.*, coalesce(exact, FALSE) AS exact, substr(sha256(lower({_SQ.format(c='src')}) || '|' || rel || '|' || lower(tgt)), 1, 24) AS sig, len(cited) > 0 AND event_id % 22 <> 0 AS ref_ok,
        list_filter([CASE WHEN rel = 'LIKES' THEN 'RELATIONSHIP_NOT_ALLOWED' END, CASE WHEN bad_class THEN 'EVIDENCE_CLASS_NOT_ALLOWED' END, CASE WHEN len(cited) = 0 THEN 'EVIDENCE_MISSING' END,
        CASE WHEN len(cited) > 0 AND event_id % 22 = 0 THEN 'UNKNOWN_EVIDENCE' END, CASE WHEN NOT coalesce(exact, FALSE) THEN 'QUOTE_NOT_VERBATIM' END, CASE WHEN trim(src) = '' THEN 'SOURCE_LABEL_MISSING' END], lambda x: x IS NOT NULL) AS errors
        FROM cand c LEFT JOIN hits USING (candidate_id))"""


@query(
    f"""WITH {_CONTRACT} SELECT candidate_id, model_key, sig AS candidate_signature, ref_ok AS evidence_reference_valid, exact AS evidence_quote_exact, rel = 'CONTRIBUTED_TO' AS requires_causal_review, len(errors) = 0 AS schema_valid,
        array_to_string(errors, ',') AS validation_errors FROM checked"""
)
def candidate_contract(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d)


@query(
    f"""WITH {_CONTRACT}, runs AS (SELECT 'run_' || user_id || '_' || k AS run_id, user_id, k FROM (SELECT DISTINCT user_id FROM events), (VALUES (0), (1), (2)) v(k)),
    n AS (SELECT run_id, count(*) AS c, count(*) FILTER (len(errors) > 0) AS e FROM checked GROUP BY 1)
    SELECT run_id, k AS model_key, user_id * 10 + k AS latency_ms, user_id AS input_tokens, (user_id % 7)::BIGINT AS output_tokens, user_id + user_id % 7 AS total_tokens, coalesce(c, 0) AS candidate_count, coalesce(e, 0) AS candidate_errors,
        user_id % 3 <> 0 AND coalesce(e, 0) = 0 AS schema_valid FROM runs LEFT JOIN n USING (run_id)""".replace("k AS model_key", "'M' || k AS model_key")
)
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    runs = B.table(spark, d, "events").select("user_id").distinct().selectExpr("user_id", "explode(array(0, 1, 2)) AS k").selectExpr(
        "concat('run_', user_id, '_', k) AS run_id", "concat('M', k) AS model_key", "user_id * 10 + k AS latency_ms", "user_id AS input_tokens", "user_id % 7 AS output_tokens", "CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS root_errors"
    )
    checked = _checked(spark, d).join(_model_candidates(spark, d).select("candidate_id", "run_id"), "candidate_id")
    return M.run_summary(runs, checked)


def _agreement(spark: SparkSession, d: str) -> DataFrame:
    checked = _checked(spark, d).join(_model_candidates(spark, d).select("candidate_id", "benchmark_id"), "candidate_id")
    return M.model_agreement(checked, ["benchmark_id"])


_AGREEMENT = f"{_CONTRACT}, agreed AS (SELECT benchmark_id, sig AS candidate_signature, bool_or(model_key = 'MODEL_A') AS in_model_a, bool_or(model_key = 'MODEL_B') AS in_model_b FROM checked GROUP BY 1, 2)"


@query(f"WITH {_AGREEMENT} SELECT *, in_model_a AND in_model_b AS exact_agreement FROM agreed")
def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _agreement(spark, d)


@query(f"WITH {_AGREEMENT} SELECT benchmark_id, count(*) FILTER (in_model_a) AS in_a, count(*) FILTER (in_model_b) AS in_b, count(*) FILTER (in_model_a AND in_model_b) AS in_both FROM agreed GROUP BY 1")
def agreement_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.agreement_totals(_agreement(spark, d), ["benchmark_id"])


@query(
    """SELECT source AS package_id, count(*) AS rated, count(*) FILTER (quality = 1) AS in_a, count(*) FILTER (toxic = 1) AS in_b, count(*) FILTER (quality = 1 AND toxic = 1) AS in_both FROM labels JOIN documents USING (doc_id) GROUP BY 1"""
)
def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The two labels of a document as two raters that mark it or not."""
    rated = B.table(spark, d, "labels").join(B.table(spark, d, "documents").select("doc_id", F.col("source").alias("package_id")), "doc_id")
    marks = rated.select("package_id", F.col("doc_id").cast("string").alias("candidate_signature"), F.explode(F.expr("array(CASE WHEN quality = 1 THEN 'MODEL_A' ELSE 'NONE' END, CASE WHEN toxic = 1 THEN 'MODEL_B' ELSE 'NONE' END)")).alias("model_key"))
    totals = M.agreement_totals(M.model_agreement(marks, ["package_id"]), ["package_id"])
    return totals.join(rated.groupBy("package_id").agg(F.count(F.lit(1)).alias("rated")), "package_id")


def _reviewed_candidates(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").selectExpr(
        "concat('bench_', user_id) AS benchmark_id", "element_at(array('MODEL_A', 'MODEL_B'), cast(event_id % 2 + 1 AS int)) AS model_key", "event_id % 2 = 0 AS schema_valid", "event_id % 3 = 0 AS relationship_supported",
        "event_id % 5 = 0 AS direction_correct", "event_id % 7 <> 0 AS evidence_reference_valid", "value > 50 AS evidence_quote_exact", "CASE WHEN event_id % 11 <> 0 THEN value > 80 END AS quote_supports",
        "user_id % 4 <> 0 AND event_id % 6 = 0 AS requested_label_match", "event_type = 'error' AS causal_overreach", "CASE WHEN event_id % 9 <> 0 THEN 'VALIDATED' END AS relationship_decision",
        "CASE WHEN user_id % 10 = 0 AND event_id % 8 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'AMENDED' ELSE 'VALIDATED' END AS output_decision",
    )


_COUNTS = {"contract_valid": "event_id % 2 = 0", "standalone_supported": "event_id % 3 = 0", "direction_correct": "event_id % 5 = 0", "valid_reference": "event_id % 7 <> 0", "exact_quote": "value > 50", "quote_support": "event_id % 11 <> 0 AND value > 80",
    "requested_label": "user_id % 4 <> 0 AND event_id % 6 = 0", "causal_overreach": "event_type = 'error'", "validated": "event_id % 9 <> 0", "amended_output": "event_id % 2 = 0 AND NOT (user_id % 10 = 0 AND event_id % 8 = 0)"}


@query(
    f"""WITH c AS (SELECT 'bench_' || user_id AS benchmark_id, ['MODEL_A', 'MODEL_B'][event_id % 2 + 1] AS model_key, count(*) AS generated, {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _COUNTS.items())} FROM events GROUP BY 1, 2),
    g AS (SELECT 'bench_' || user_id AS benchmark_id, count(*) AS gold FROM events WHERE value > 150 AND user_id % 3 <> 0 GROUP BY 1), j AS (SELECT c.*, coalesce(gold, 0) AS gold FROM c LEFT JOIN g USING (benchmark_id))
    SELECT *, {', '.join(f"{_rate(n, 'generated')} AS {n}_rate" for n in M.RATED)}, CASE WHEN gold > 0 AND requested_label = 0 THEN 0.0::DOUBLE END AS requested_recall,
        CASE WHEN gold = 0 THEN 'NOT_DEFINED_NO_GOLD_RELATIONSHIP' WHEN requested_label = 0 THEN 'ZERO_REQUESTED_LABEL_CANDIDATES_SO_ZERO_GOLD_RECOVERY' ELSE 'CANONICAL_GOLD_MATCH_REVIEW_REQUIRED_BEFORE_RECALL' END AS recall_interpretation FROM j"""
)
def benchmark_metrics(spark: SparkSession, d: str) -> DataFrame:
    gold = B.table(spark, d, "events").where("value > 150 AND user_id % 3 <> 0").selectExpr("concat('bench_', user_id) AS benchmark_id")
    return M.benchmark_metrics(_reviewed_candidates(spark, d), gold, ["benchmark_id", "model_key"])


@query(
    "SELECT p.passage_id AS assessment_id FROM passages p WHERE passage_order % 3 <> 0 AND (package_id, document_id, passage_order) IN (SELECT (package_id, document_id, passage_order) FROM passages WHERE (doc_id + passage_order) % 4 <> 1)", "passages"
)
def gold_in_snapshot(spark: SparkSession, d: str) -> DataFrame:
    passages = B.passages(spark, d)
    assessed = passages.selectExpr(
        "passage_id AS assessment_id", "package_id", "document_id", "passage_order", "CASE WHEN passage_order % 3 = 0 THEN 'NOT_SUPPORTED' ELSE 'SUPPORTED_REQUESTED_RELATIONSHIP' END AS assessment"
    )
    return M.gold_in_snapshot(assessed, passages.where("(doc_id + passage_order) % 4 <> 1")).select("assessment_id")


@query(
    f"""WITH gold AS (SELECT DISTINCT user_id, event_type AS s, (event_id % 6) AS o FROM events WHERE value > 150), m AS (SELECT user_id, ['MODEL_A', 'MODEL_B'][event_id % 2 + 1] AS model_key, event_type AS s, event_id % 6 AS o,
        (user_id, event_type, event_id % 6) IN (SELECT (user_id, s, o) FROM gold) AND event_id % 5 <> 0 AS ok FROM events),
    c AS (SELECT user_id, model_key, count(*) AS generated, count(*) FILTER (ok) AS matched FROM m GROUP BY 1, 2), r AS (SELECT user_id, model_key, count(DISTINCT (s, o)) AS recovered FROM m WHERE ok GROUP BY 1, 2),
    t AS (SELECT user_id, count(*) AS gold_relationships FROM gold GROUP BY 1), j AS (SELECT c.*, coalesce(recovered, 0) AS recovered, coalesce(gold_relationships, 0) AS gold_relationships FROM c LEFT JOIN r USING (user_id, model_key) LEFT JOIN t USING (user_id))
    SELECT 'bench_' || user_id AS benchmark_id, model_key, generated, matched, recovered, gold_relationships, {_rate('matched', 'generated')} AS canonical_precision, {_rate('recovered', 'gold_relationships')} AS canonical_recall FROM j"""
)
def canonical_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    events = B.table(spark, d, "events")
    triple = ["event_type AS subject_code", "'CONTRIBUTED_TO' AS requested_relationship", "cast(event_id % 6 AS string) AS object_code"]
    gold = events.where("value > 150").selectExpr("concat('bench_', user_id) AS benchmark_id", *triple)
    rows = events.selectExpr("concat('bench_', user_id) AS benchmark_id", "element_at(array('MODEL_A', 'MODEL_B'), cast(event_id % 2 + 1 AS int)) AS model_key", *triple, "event_id % 5 <> 0 AS confirmed")
    known = gold.distinct().withColumn("_gold", F.lit(True))
    matches = rows.join(known, ["benchmark_id", *M.TRIPLE], "left").withColumn("canonical_match", F.col("confirmed") & F.col("_gold").isNotNull())
    return M.canonical_precision_recall(matches, gold, ["benchmark_id", "model_key"])


@query(
    """WITH r AS (SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'click') OR user_id % 7 = 0) GROUP BY 1),
    c AS (SELECT user_id, count(*) FILTER (event_id % 9 = 0 OR (user_id % 10 = 0 AND event_id % 8 = 0)) AS u, count(DISTINCT event_id % 2) AS m FROM events GROUP BY 1)
    SELECT 'bench_' || user_id AS benchmark_id, unnest(list_filter([CASE WHEN user_id % 7 = 0 AND n > 1 THEN 'SEVERAL_PROMPT_SHA256' END, CASE WHEN user_id % 5 = 0 AND n > 1 THEN 'SEVERAL_QUERY_ID' END, CASE WHEN n <> 2 THEN 'RUN_COUNT_DIFFERS' END,
        CASE WHEN m <> 2 THEN 'MODEL_COUNT_DIFFERS' END, CASE WHEN u > 0 THEN 'UNREVIEWED_CANDIDATES' END], lambda x: x IS NOT NULL)) AS rule FROM r JOIN c USING (user_id)"""
)
def benchmark_identity(spark: SparkSession, d: str) -> DataFrame:
    runs = B.table(spark, d, "events").where("event_type IN ('view', 'click') OR user_id % 7 = 0").select("user_id", "event_type").distinct().selectExpr(
        "concat('bench_', user_id) AS benchmark_id", "'V1' AS benchmark_version", "CASE WHEN user_id % 7 = 0 THEN event_type ELSE 'same' END AS prompt_sha256", "'snapshot' AS retrieval_snapshot_id",
        "CASE WHEN user_id % 5 = 0 THEN event_type ELSE 'Q1' END AS query_id", "'CONTRIBUTED_TO' AS requested_relationship",
    )
    return M.benchmark_identity_violations(runs, _reviewed_candidates(spark, d))


@query(
    """WITH q AS (SELECT 'user_' || user_id AS user_key, ['MODEL_A', 'MODEL_B'][event_id % 2 + 1] AS model_key, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS usage_date, count(*) AS question_count FROM events WHERE event_type = 'click' GROUP BY 1, 2, 3)
    SELECT *, CASE model_key WHEN 'MODEL_A' THEN 1 ELSE 2 END::BIGINT AS daily_limit, greatest(CASE model_key WHEN 'MODEL_A' THEN 1 ELSE 2 END - question_count, 0)::BIGINT AS remaining, question_count >= CASE model_key WHEN 'MODEL_A' THEN 1 ELSE 2 END AS limit_reached FROM q"""
)
def usage_quota(spark: SparkSession, d: str) -> DataFrame:
    """Questions per local day; the zone is one hour ahead of UTC in January."""
    events = B.table(spark, d, "events")
    questions = events.where("event_type = 'click'").selectExpr("concat('user_', user_id) AS user_key", "element_at(array('MODEL_A', 'MODEL_B'), cast(event_id % 2 + 1 AS int)) AS model_key", "cast(ts AS timestamp) AS asked_at")
    limits = events.selectExpr("element_at(array('MODEL_A', 'MODEL_B'), cast(event_id % 2 + 1 AS int)) AS model_key", "event_id % 2 + 1 AS daily_limit").distinct()
    return M.usage_quota(questions, limits, "Europe/Brussels").withColumn("usage_date", F.col("usage_date").cast("string"))


# --- retention --------------------------------------------------------------------------------------------------


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").selectExpr(
        "event_id", "concat('source_', user_id) AS source_id", "ts AS created_at", "element_at(array('A', 'b ', 'C', 'D', 'X'), cast(event_id % 5 + 1 AS int)) AS information_class",
        "element_at(array('LOCAL', 'canonical', 'TAXONOMY', 'LOCAL', 'LOCAL', 'OTHER'), cast(event_id % 6 + 1 AS int)) AS source_managed_by", "CASE WHEN event_id % 23 = 0 THEN 'RESERVED_TAXONOMY' ELSE 'CASE_SOURCE' END AS source_role",
    )


_CLAIMS = """claims AS (SELECT event_id, 'source_' || user_id AS source_id, CASE WHEN event_id % 6 IN (1, 2) OR event_id % 23 = 0 OR event_id % 5 = 4 THEN NULL ELSE ts + CASE WHEN event_id % 5 = 3 THEN INTERVAL 24 HOUR ELSE INTERVAL 72 HOUR END END AS expires,
        CASE WHEN NOT (event_id % 6 IN (1, 2) OR event_id % 23 = 0) AND event_id % 5 = 4 THEN 'UNSUPPORTED_CLASS' END AS violation FROM events)"""
_F = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


@query(f"WITH {_CLAIMS} SELECT event_id, {_F.format(c='expires')} AS expires_at, violation FROM claims")
def retention_expiry(spark: SparkSession, d: str) -> DataFrame:
    rows = T.retention_expiry(_claims(spark, d))
    return rows.select("event_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("expires_at"), "violation")


@query(f"WITH {_CLAIMS} SELECT source_id, {_F.format(c='min(expires)')} AS expires_at, count(*) AS claims FROM claims GROUP BY 1")
def source_expiry(spark: SparkSession, d: str) -> DataFrame:
    return T.source_expiry(_claims(spark, d)).withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_NOW = datetime(2024, 1, 20)


def _finished(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").selectExpr(
        "concat('analysis_', event_id) AS analysis_id", "element_at(array('COMPLETED', 'FAILED', 'ANALYSING'), cast(event_id % 3 + 1 AS int)) AS status", "CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 72 HOURS END AS content_expires_at",
        "CASE WHEN event_id % 8 <> 0 THEN ts + INTERVAL 24 HOURS END AS derived_expires_at", "CASE WHEN event_id % 13 = 0 THEN TRUE END AS retain_for_validation", "CASE WHEN event_id % 17 = 0 THEN 'PURGED' END AS content_purge_status",
        "CASE WHEN event_id % 19 = 0 THEN 'PURGED' ELSE 'ACTIVE' END AS retention_purge_status",
    )


_GONE = """gone AS (SELECT event_id, 'analysis_' || event_id AS analysis_id, ['COMPLETED', 'FAILED', 'ANALYSING'][event_id % 3 + 1] AS status, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 72 HOUR WHEN event_id % 8 <> 0 THEN ts + INTERVAL 24 HOUR END AS due FROM events
        WHERE event_id % 13 <> 0 AND event_id % 3 <> 2 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 72 HOUR WHEN event_id % 8 <> 0 THEN ts + INTERVAL 24 HOUR END <= TIMESTAMP '2024-01-20 00:00:00')"""


@query(f"WITH {_GONE} SELECT analysis_id, status, {_F.format(c='due')} AS expires_at FROM gone")
def expired_analyses(spark: SparkSession, d: str) -> DataFrame:
    return T.expired(_finished(spark, d), _NOW).withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _derived(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").selectExpr("concat('analysis_', event_id - event_id % 2) AS analysis_id", "event_id", "props AS analysis_summary", "event_type AS model_key")


@query(f"WITH {_GONE} SELECT 'analysis_' || (event_id - event_id % 2) AS analysis_id, event_id, props AS analysis_summary, event_type AS model_key FROM events WHERE event_id - event_id % 2 NOT IN (SELECT event_id FROM gone)")
def purged_table(spark: SparkSession, d: str) -> DataFrame:
    return T.purge(_derived(spark, d), T.expired(_finished(spark, d), _NOW))


@query(
    f"""WITH {_GONE} SELECT 'analysis_' || (e.event_id - e.event_id % 2) AS analysis_id, e.event_id, CASE WHEN g.event_id IS NULL THEN props END AS analysis_summary, event_type AS model_key, CASE WHEN g.event_id IS NULL THEN 'ACTIVE' ELSE 'PURGED' END AS content_purge_status
    FROM events e LEFT JOIN gone g ON g.event_id = e.event_id - e.event_id % 2"""
)
def blanked_content(spark: SparkSession, d: str) -> DataFrame:
    return T.blank_content(_derived(spark, d), T.expired(_finished(spark, d), _NOW), ["analysis_summary"], _NOW).drop("content_purged_at")


@query(
    """SELECT 'analysis' AS area, 'analysis_passage' AS item, count(*) AS row_count, 'PASS' AS status FROM passages UNION ALL SELECT 'analysis', 'candidate', count(*), 'PASS' FROM candidates
    UNION ALL SELECT 'benchmark', 'gold', count(*), CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'WARN' END FROM events WHERE value > 1000000 UNION ALL SELECT 'benchmark', 'runs', count(*), CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END FROM events WHERE value < 0
    UNION ALL SELECT 'source', 'documents', count(*), 'PASS' FROM documents""",
    "passages", "candidates",
)
def status_board(spark: SparkSession, d: str) -> DataFrame:
    events = B.table(spark, d, "events")
    return T.status_board(
        {
            "analysis_passage": ("analysis", B.passages(spark, d), "WARN"),
            "candidate": ("analysis", B.candidates(spark, d), "WARN"),
            "gold": ("benchmark", events.where("value > 1000000"), "WARN"),
            "runs": ("benchmark", events.where("value < 0"), "FAIL"),
            "documents": ("source", B.docs(spark, d), "FAIL"),
        }
    )


@query(
    """SELECT 'bench_' || user_id AS benchmark_id, 'snapshot_' || (user_id % 5) AS retrieval_snapshot_id, CASE WHEN bool_or(event_id % 60 = user_id % 5) THEN 'PASS' ELSE 'FAIL' END AS status FROM events GROUP BY 1, user_id"""
)
def snapshot_lineage(spark: SparkSession, d: str) -> DataFrame:
    events = B.table(spark, d, "events")
    runs = events.selectExpr("concat('bench_', user_id) AS benchmark_id", "concat('snapshot_', event_id % 60) AS retrieval_snapshot_id")
    expected = events.select("user_id").distinct().selectExpr("concat('bench_', user_id) AS benchmark_id", "concat('snapshot_', user_id % 5) AS retrieval_snapshot_id")
    return T.lineage_check(runs, expected, ["benchmark_id"])
