"""Model comparison: candidate contracts, run summaries, agreement, precision, recall and review metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.functions.rules import violations
from dossier.functions.text import clean, squeeze
from dossier.plans.sizing import checked_broadcast


def _rate(part: str, whole: str) -> Column:
    """part / whole, NULL when there is nothing to divide by."""
    return F.try_divide(F.col(part).cast("double"), F.when(F.col(whole) > 0, F.col(whole).cast("double")))


def review_metrics(edges: DataFrame, latest: DataFrame, groups: Sequence[str], privacy: DataFrame | None = None) -> DataFrame:
    """Generated and reviewed relationships per group with coverage and decision rates.

    ``privacy``: the groups with privacy_redactions and privacy_validation_status of their outputs; groups that it
    lacks have no redactions and no status.
    """
    generated = edges.groupBy(*groups).agg(F.count(F.lit(1)).alias("generated"))
    decision = F.upper("decision")
    reviewed = latest.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count_if(decision == "VALIDATED").alias("validated"),
        F.count_if(decision == "REJECTED").alias("rejected"),
        F.count_if(decision == "AMENDED").alias("amended"),
    )
    joined = generated.join(reviewed, list(groups), "left")
    names = ("reviewed", "validated", "rejected", "amended")
    joined = joined.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})
    if privacy is not None:
        joined = joined.join(privacy.select(*groups, "privacy_redactions", "privacy_validation_status"), list(groups), "left").withColumn(
            "privacy_redactions", F.coalesce("privacy_redactions", F.lit(0)).cast("long")
        )
    return joined.withColumns(
        {
            "review_coverage": _rate("reviewed", "generated"),
            "acceptance_rate": _rate("validated", "reviewed"),
            "rejection_rate": _rate("rejected", "reviewed"),
            "amendment_rate": _rate("amended", "reviewed"),
        }
    )


def candidate_signature(source: Column, relationship: Column, target: Column) -> Column:
    parts = F.concat_ws("|", F.lower(squeeze(source)), relationship, F.lower(squeeze(target)))
    return F.substring(F.sha2(parts, 256), 1, 24)


def candidate_contract(candidates: DataFrame, passages: DataFrame) -> DataFrame:
    """Every candidate with its signature and the result of the checks of its contract.

    ``candidates``: candidate_id, model_key, source_label, relationship, target_label, evidence_passage_ids,
    evidence_quote, evidence_class. ``passages``: passage_id, passage_text. The quote must occur word for word
    in a cited passage, white space aside.
    """
    quote = squeeze(F.col("evidence_quote"))
    cited = candidates.select("candidate_id", quote.alias("_quote"), F.explode("evidence_passage_ids").alias("passage_id")).distinct()
    texts = passages.select("passage_id", squeeze(F.col("passage_text")).alias("_text"))
    facts = (
        cited.join(texts, "passage_id", "left")
        .groupBy("candidate_id")
        .agg(
            F.count(F.lit(1)).alias("_cited"),
            F.count_if(F.col("_text").isNull()).alias("_unknown"),
            F.bool_or(F.coalesce((F.col("_quote") != "") & F.contains("_text", F.col("_quote")), F.lit(False))).alias("_exact"),
        )
    )
    joined = candidates.join(facts, "candidate_id", "left")
    relationship = F.upper(F.coalesce("relationship", F.lit("")))
    n, unknown = F.coalesce("_cited", F.lit(0)), F.coalesce("_unknown", F.lit(0))
    exact = F.coalesce("_exact", F.lit(False))
    errors = violations(
        ("RELATIONSHIP_NOT_ALLOWED", ~relationship.isin(*S.RELATIONSHIPS)),
        ("EVIDENCE_CLASS_NOT_ALLOWED", ~F.upper(F.coalesce("evidence_class", F.lit(""))).isin(*S.EVIDENCE_CLASSES)),
        ("EVIDENCE_MISSING", n == 0),
        ("UNKNOWN_EVIDENCE", unknown > 0),
        ("QUOTE_NOT_VERBATIM", ~exact),
        ("SOURCE_LABEL_MISSING", clean(F.col("source_label")) == ""),
        ("TARGET_LABEL_MISSING", clean(F.col("target_label")) == ""),
    )
    return joined.select(
        "candidate_id",
        "model_key",
        candidate_signature(F.col("source_label"), relationship, F.col("target_label")).alias("candidate_signature"),
        ((unknown == 0) & (n > 0)).alias("evidence_reference_valid"),
        exact.alias("evidence_quote_exact"),
        relationship.isin(*S.CAUSAL_RELATIONSHIPS).alias("requires_causal_review"),
        (F.size(errors) == 0).alias("schema_valid"),
        F.array_join(errors, ",").alias("validation_errors"),
    )


def run_summary(runs: DataFrame, checked: DataFrame) -> DataFrame:
    """Runs (run_id, model_key, latency_ms, input_tokens, output_tokens, root_errors) with their candidate counts."""
    counted = checked.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.count_if(~F.col("schema_valid")).alias("candidate_errors")
    )
    zero = F.lit(0).cast("long")
    joined = runs.join(counted, "run_id", "left")
    return joined.select(
        "run_id", "model_key", "latency_ms", "input_tokens", "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.coalesce("candidate_count", zero).alias("candidate_count"),
        F.coalesce("candidate_errors", zero).alias("candidate_errors"),
        ((F.col("root_errors") == 0) & (F.coalesce("candidate_errors", zero) == 0)).alias("schema_valid"),
    )


def model_agreement(candidates: DataFrame, groups: Sequence[str], first: str = "MODEL_A", second: str = "MODEL_B") -> DataFrame:
    """Every signature of a group with the models that produced it."""
    return (
        candidates.groupBy(*groups, "candidate_signature")
        .agg(F.bool_or(F.col("model_key") == first).alias("in_model_a"), F.bool_or(F.col("model_key") == second).alias("in_model_b"))
        .withColumn("exact_agreement", F.col("in_model_a") & F.col("in_model_b"))
    )


def agreement_totals(agreement: DataFrame, groups: Sequence[str]) -> DataFrame:
    return agreement.groupBy(*groups).agg(
        F.count_if("in_model_a").alias("in_a"),
        F.count_if("in_model_b").alias("in_b"),
        F.count_if("exact_agreement").alias("in_both"),
    )


# Reviewed properties of a candidate, the count reported for each and the rates of some of them.
REVIEWED = (
    ("schema_valid", "contract_valid"),
    ("relationship_supported", "standalone_supported"),
    ("direction_correct", "direction_correct"),
    ("evidence_reference_valid", "valid_reference"),
    ("evidence_quote_exact", "exact_quote"),
    ("quote_supports", "quote_support"),
    ("requested_label_match", "requested_label"),
    ("causal_overreach", "causal_overreach"),
)
RATED = ("contract_valid", "standalone_supported", "valid_reference", "exact_quote", "quote_support", "requested_label")


def benchmark_metrics(candidates: DataFrame, gold: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts and rates of reviewed candidates per benchmark and model, with an explicit state of recall.

    ``groups`` name the benchmark and the model; the first group is the benchmark and also a column of ``gold``.
    """
    benchmark = groups[0]
    counted = candidates.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("generated"),
        *[F.count_if(F.coalesce(F.col(source), F.lit(False))).alias(name) for source, name in REVIEWED],
        F.count_if(F.col("relationship_decision") == "VALIDATED").alias("validated"),
        F.count_if(F.col("output_decision") == "AMENDED").alias("amended_output"),
    )
    golds = gold.groupBy(benchmark).agg(F.count(F.lit(1)).alias("gold"))
    joined = counted.join(golds, benchmark, "left").withColumn("gold", F.coalesce("gold", F.lit(0)).cast("long"))
    none_asked = F.col("requested_label") == 0
    return joined.withColumns({f"{name}_rate": _rate(name, "generated") for name in RATED}).withColumns(
        {
            "requested_recall": F.when((F.col("gold") > 0) & none_asked, F.lit(0.0)),
            "recall_interpretation": F.when(F.col("gold") == 0, F.lit("NOT_DEFINED_NO_GOLD_RELATIONSHIP"))
            .when(none_asked, F.lit("ZERO_REQUESTED_LABEL_CANDIDATES_SO_ZERO_GOLD_RECOVERY"))
            .otherwise(F.lit("CANONICAL_GOLD_MATCH_REVIEW_REQUIRED_BEFORE_RECALL")),
        }
    )


def gold_in_snapshot(assessments: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Supported assessments whose passage is in the frozen snapshot (package_id, document_id, passage_order)."""
    keys = ["package_id", "document_id", "passage_order"]
    frozen = snapshot.select(*keys).distinct()
    return assessments.where(F.col("assessment") == "SUPPORTED_REQUESTED_RELATIONSHIP").join(frozen, keys, "left_semi")


TRIPLE = ("subject_code", "requested_relationship", "object_code")


def canonical_precision_recall(matches: DataFrame, gold: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Matched candidates per generated one, and distinct gold triples recovered per distinct gold triple.

    ``matches``: groups, canonical_match and the matched triple. ``gold``: first group and the triple; several
    assessments of one triple count once.
    """
    benchmark = groups[0]
    triples = gold.select(benchmark, *TRIPLE).distinct()
    totals = triples.groupBy(benchmark).agg(F.count(F.lit(1)).alias("gold_relationships"))
    counted = matches.groupBy(*groups).agg(F.count(F.lit(1)).alias("generated"), F.count_if("canonical_match").alias("matched"))
    recovered = (
        matches.where(F.col("canonical_match"))
        .select(*groups, *TRIPLE)
        .distinct()
        .join(triples, [benchmark, *TRIPLE], "left_semi")
        .groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("recovered"))
    )
    joined = counted.join(recovered, list(groups), "left").join(totals, benchmark, "left")
    joined = joined.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("recovered", "gold_relationships")})
    return joined.withColumns({"canonical_precision": _rate("matched", "generated"), "canonical_recall": _rate("recovered", "gold_relationships")})


IDENTITY = ("benchmark_version", "prompt_sha256", "retrieval_snapshot_id", "query_id", "requested_relationship")


def benchmark_identity_violations(runs: DataFrame, candidates: DataFrame, models: int = 2) -> DataFrame:
    """(benchmark_id, rule): benchmarks that mix identities, lack a model run or hold unreviewed candidates."""
    identities = runs.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("_runs"), *[F.countDistinct(c).alias(f"_{c}") for c in IDENTITY])
    reviewed = candidates.groupBy("benchmark_id").agg(
        F.count_if(F.col("relationship_decision").isNull() | F.col("output_decision").isNull()).alias("_unreviewed"),
        F.countDistinct("model_key").alias("_models"),
    )
    joined = identities.join(reviewed, "benchmark_id", "left")
    codes = violations(
        *[(f"SEVERAL_{c.upper()}", F.col(f"_{c}") > 1) for c in IDENTITY],
        ("RUN_COUNT_DIFFERS", F.col("_runs") != models),
        ("MODEL_COUNT_DIFFERS", F.coalesce("_models", F.lit(0)) != models),
        ("UNREVIEWED_CANDIDATES", F.coalesce("_unreviewed", F.lit(0)) > 0),
    )
    return joined.select("benchmark_id", F.explode(codes).alias("rule"))


def usage_quota(questions: DataFrame, limits: DataFrame, zone: str) -> DataFrame:
    """Questions per user, model and local day against the daily limit of the model.

    ``questions``: user_key, model_key, asked_at (UTC). ``limits``: model_key, daily_limit.
    """
    day = F.to_date(F.from_utc_timestamp("asked_at", zone))
    used = questions.groupBy("user_key", "model_key", day.alias("usage_date")).agg(F.count(F.lit(1)).alias("question_count"))
    joined = used.join(checked_broadcast(limits), "model_key")
    return joined.select(
        "user_key", "model_key", "usage_date", "question_count", "daily_limit",
        F.greatest(F.col("daily_limit") - F.col("question_count"), F.lit(0).cast("long")).alias("remaining"),
        (F.col("question_count") >= F.col("daily_limit")).alias("limit_reached"),
    )
