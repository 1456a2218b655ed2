"""Identifiers, pseudonyms, redaction and the protected-record screen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.functions import privacy as P
from dossier.functions.rules import METADATA_RULES, TEXT_RULES, rule_counts, violations

# Outcomes an analysis declared as class D may have, and outcomes that let A and C proceed.
CLASS_D_OUTCOMES = (
    "DECLARED_D_WITH_STRONG_INDICATORS", "DECLARED_D_NO_STRONG_INDICATORS", "NO_SCREENABLE_RAW_CONTENT",
)
PASSED_OUTCOMES = ("PASSED_NO_STRONG_D_INDICATOR", "NO_SCREENABLE_RAW_CONTENT")


def find_identifiers(
    df: DataFrame,
    text: str = "text",
    categories: Iterable[str] = P.DEFAULT_CATEGORIES,
    terms: Mapping[str, Iterable[str]] | None = None,
) -> DataFrame:
    """One row per match with start, end, category, original text and RULE or MANUAL."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.inline(P.candidate_spans(F.col(text), categories, terms)))


def resolve_overlaps(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accepted spans of texts whose spans are given as rows. One text's spans form one bounded array."""
    item = F.struct("start", "end", "category", "original", "detected_by")
    return (
        spans.groupBy(*keys)
        .agg(F.collect_list(item).alias("_s"))
        .select(*keys, F.inline(P.resolve_overlaps(F.col("_s").cast(P.SPAN))))
    )


def pseudonymise(
    df: DataFrame,
    text: str = "text",
    categories: Iterable[str] = P.DEFAULT_CATEGORIES,
    terms: Mapping[str, Iterable[str]] | None = None,
) -> DataFrame:
    """Add pseudonymised_text and replacements (array of spans with their pseudonym) to every row."""
    categories = list(categories)
    spans = df.withColumn("_spans", P.resolve_overlaps(P.candidate_spans(F.col(text), categories, terms)))
    named = spans.withColumn("replacements", P.pseudonyms(F.col("_spans"))).drop("_spans")
    return named.withColumn("pseudonymised_text", P.replaced(F.col(text), F.col("replacements")))


def pseudonym_mapping(pseudonymised: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pseudonym, category, original): the last spelling of each replaced identity."""
    rows = pseudonymised.select(*keys, F.inline("replacements"))
    return rows.groupBy(*keys, "category", "pseudonym").agg(
        F.max(F.struct("start", "original")).alias("_m"), F.count(F.lit(1)).alias("occurrences")
    ).select(*keys, "category", "pseudonym", F.col("_m.original").alias("original"), "occurrences")


def redact_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Redact text columns and count the fields that changed."""
    before = {c: F.coalesce(F.col(c), F.lit("")) for c in columns}
    staged = df.withColumns({f"_r_{c}": P.redact(F.col(c)) for c in columns})
    changed = sum(((F.col(f"_r_{c}") != before[c]).cast("long") for c in columns), F.lit(0).cast("long"))
    return staged.select(
        *[(F.col(f"_r_{c}").alias(c) if c in columns else F.col(c)) for c in df.columns],
        changed.alias("redaction_count"),
    )


def redaction_status(redacted: DataFrame, groups: Sequence[str]) -> DataFrame:
    total = F.sum("redaction_count").cast("long")
    return redacted.groupBy(*groups).agg(total.alias("redaction_count")).withColumn(
        "privacy_validation_status",
        F.when(F.col("redaction_count") > 0, F.lit("PASSED_WITH_AUTOMATIC_REDACTION")).otherwise(F.lit("PASSED")),
    )


def prescreen_text(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Rule id, label and match count per key of the protected-record rules found in its texts."""
    found = df.select(*keys, F.inline(rule_counts(F.col(text), TEXT_RULES)))
    return found.groupBy(*keys, "rule_id", "label").agg(F.sum("match_count").cast("long").alias("match_count"))


def prescreen_metadata(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    found = df.select(*keys, F.inline(rule_counts(F.col(name), METADATA_RULES)))
    return found.groupBy(*keys, "rule_id", "label").agg(F.sum("match_count").cast("long").alias("match_count"))


def combine_findings(keys: Sequence[str], *findings: DataFrame) -> DataFrame:
    """Sum the counts of several screens per rule; any finding requires class D."""
    merged = findings[0]
    for other in findings[1:]:
        merged = merged.unionByName(other)
    return (
        merged.groupBy(*keys, "rule_id", "label")
        .agg(F.sum("match_count").cast("long").alias("match_count"))
        .withColumn("required_class", F.lit("D"))
    )


def prescreen_gate(analyses: DataFrame, documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Screening outcome of every analysis.

    ``analyses``: analysis_id, information_class, input_mode. ``documents``: analysis_id, document_id,
    source_managed_by, route, has_text. ``findings``: analysis_id, document_id, rule_id of screened texts.
    """
    screened = (F.col("input_mode") == "DIRECT_TEXT") | (F.col("route") == "LOCAL_FALLBACK")
    linked = documents.join(analyses, "analysis_id")
    per_document = linked.select(
        "analysis_id",
        "document_id",
        (F.col("source_managed_by") == S.CANONICAL_OWNER).alias("canonical"),
        (screened & F.col("has_text")).alias("screened"),
    )
    # Findings are reduced to one row per document before they meet the documents.
    hit = findings.groupBy("analysis_id", "document_id").agg(F.countDistinct("rule_id").alias("rules"))
    facts = (
        per_document.join(hit, ["analysis_id", "document_id"], "left")
        .groupBy("analysis_id")
        .agg(
            F.bool_and(F.coalesce("canonical", F.lit(False))).alias("all_canonical"),
            F.bool_or(F.coalesce("screened", F.lit(False))).alias("any_screened"),
            F.bool_or(F.coalesce("screened", F.lit(False)) & F.col("rules").isNotNull()).alias("indicated"),
        )
    )
    joined = analyses.join(facts, "analysis_id", "left")
    exempt = (
        (F.col("information_class") == "B")
        & (F.col("input_mode") == "DOCUMENTS")
        & F.coalesce("all_canonical", F.lit(False))
    )
    indicated = F.coalesce("indicated", F.lit(False))
    declared = F.col("information_class") == "D"
    status = (
        F.when(exempt, F.lit("PUBLISHED_CANONICAL_CLASS_B_EXEMPT"))
        .when(~F.coalesce("any_screened", F.lit(False)), F.lit("NO_SCREENABLE_RAW_CONTENT"))
        .when(declared & indicated, F.lit("DECLARED_D_WITH_STRONG_INDICATORS"))
        .when(declared, F.lit("DECLARED_D_NO_STRONG_INDICATORS"))
        .when(indicated, F.lit("REQUIRES_CLASS_D"))
        .otherwise(F.lit("PASSED_NO_STRONG_D_INDICATOR"))
    )
    return joined.select("analysis_id", "information_class", "input_mode", status.alias("prescreen_status")).withColumn(
        "required_class",
        F.when(F.col("prescreen_status").isin("REQUIRES_CLASS_D", "DECLARED_D_WITH_STRONG_INDICATORS"), F.lit("D")),
    )


def unblocked_passages(passages: DataFrame, gate: DataFrame) -> DataFrame:
    """Passages of analyses that the gate did not block."""
    blocked = gate.where(F.col("prescreen_status") == "REQUIRES_CLASS_D").select("analysis_id")
    return passages.join(blocked, "analysis_id", "left_anti")


def derivative_policy(df: DataFrame, source_class: str, processing_class: str) -> DataFrame:
    """Whether a reviewed derivative may be processed in its class: D may become C, all others stay."""
    source = F.upper(F.trim(F.coalesce(source_class, F.lit(""))))
    target = F.upper(F.trim(F.coalesce(processing_class, F.lit(""))))
    known = source.isin(*S.INFORMATION_CLASSES)
    allowed = (target == source) | ((source == "D") & (target == "C"))
    return df.withColumn(
        "violation",
        F.when(~known, F.lit("UNSUPPORTED_SOURCE_CLASS")).when(~allowed, F.lit("PROCESSING_CLASS_NOT_ALLOWED")),
    )


def prescreen_contract_violations(
    analyses: DataFrame, documents: DataFrame, passages: DataFrame, runs: DataFrame
) -> DataFrame:
    """(analysis_id, rule) for persisted analyses that contradict their screening outcome.

    ``analyses``: analysis_id, information_class, input_mode, prescreen_status, required_class, status,
    processing_stage, encrypted_text, text_retention_status.
    """
    owners = documents.groupBy("analysis_id").agg(
        F.bool_and(F.coalesce(F.col("source_managed_by") == S.CANONICAL_OWNER, F.lit(False))).alias("_canonical")
    )
    passage_counts = passages.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_passages"))
    run_counts = runs.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_runs"))
    joined = (
        analyses.join(owners, "analysis_id", "left")
        .join(passage_counts, "analysis_id", "left")
        .join(run_counts, "analysis_id", "left")
    )
    declared = F.coalesce("information_class", F.lit("B"))
    status = F.coalesce("prescreen_status", F.lit(""))
    exempt = status == "PUBLISHED_CANONICAL_CLASS_B_EXEMPT"
    blocked = status == "REQUIRES_CLASS_D"
    direct = blocked & (F.col("input_mode") == "DIRECT_TEXT")
    stopped = (F.col("status") == "FAILED") & (F.col("processing_stage") == "CLASSIFICATION_PRESCREEN_BLOCKED")
    purged = F.col("text_retention_status") == "ENCRYPTED_PAYLOAD_PURGED_AFTER_PRESCREEN"

    active = declared.isin("A", "C") & F.col("status").isin("EVIDENCE_READY", "ANALYSING", "COMPLETED")

    def unless(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    codes = violations(
        ("EXEMPTION_ON_OTHER_CLASS", exempt & (declared != "B")),
        ("EXEMPTION_WITH_OTHER_OWNER", exempt & unless(F.col("_canonical"))),
        ("ESCALATION_OF_CLASS_D", blocked & (declared == "D")),
        ("ESCALATION_WITHOUT_REQUIRED_CLASS", blocked & unless(F.col("required_class") == "D")),
        ("ESCALATION_DID_NOT_STOP", blocked & unless(stopped)),
        ("BLOCKED_ANALYSIS_HAS_PASSAGES", blocked & (F.coalesce("_passages", F.lit(0)) > 0)),
        ("BLOCKED_ANALYSIS_HAS_MODEL_RUN", blocked & (F.coalesce("_runs", F.lit(0)) > 0)),
        ("BLOCKED_TEXT_NOT_PURGED", direct & (F.length(F.coalesce("encrypted_text", F.lit(""))) > 0)),
        ("BLOCKED_TEXT_WRONG_RETENTION", direct & unless(purged)),
        ("CLASS_D_WITH_UNEXPECTED_STATUS", (declared == "D") & ~status.isin(*CLASS_D_OUTCOMES)),
        ("CLASS_D_WITH_LOWER_REQUIRED_CLASS", (declared == "D") & (F.coalesce("required_class", F.lit("D")) != "D")),
        ("ACTIVE_ANALYSIS_NOT_SCREENED", active & ~status.isin(*PASSED_OUTCOMES)),
    )
    return joined.select("analysis_id", F.explode(codes).alias("rule"))
