"""Citations: where they point, whether they stay inside their scope, and cleaning of invalid ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.locations import lenient_pages, parse_location
from dossier.functions.privacy import redact
from dossier.functions.rules import violations

# Texts shown when nothing supports an answer.
NO_VALID_SOURCES = "The supplied material does not contain a sufficiently grounded answer with valid source references."
NO_ANSWER = "The supplied material does not provide a supported answer to this question."


def parse_locations(df: DataFrame, column: str) -> DataFrame:
    """Strictly parsed location keys: document, pages and the violation of malformed keys."""
    return df.withColumn("_l", parse_location(F.col(column))).select(*df.columns, "_l.*")


def locations_outside_scope(locations: DataFrame, allowed: DataFrame) -> DataFrame:
    """Well-formed locations whose document is not allowed.

    ``locations``: run_id, location. ``allowed``: run_id, document_id.
    """
    parsed = parse_locations(locations, "location").where(F.col("violation").isNull())
    return parsed.join(allowed.select("run_id", "document_id"), ["run_id", "document_id"], "left_anti").select("run_id", "location", "document_id")


def locations_without_passage(locations: DataFrame, passages: DataFrame) -> DataFrame:
    """(run_id, location) of keys that no passage of the run's evidence backs.

    ``passages``: run_id, document_id, page_start, page_end. A passage without an end page ends where it starts.
    """
    parsed = locations.withColumn("_l", lenient_pages(F.col("location"))).select(
        "run_id", "location",
        F.col("_l.document_id").alias("document_id"),
        F.col("_l.page_start").alias("page_start"),
        F.coalesce("_l.page_end", "_l.page_start").alias("page_end"),
    )
    backed = passages.select("run_id", "document_id", "page_start", F.coalesce("page_end", "page_start").alias("page_end")).distinct()
    p, b = parsed.alias("p"), backed.alias("b")
    on = (
        (F.col("p.run_id") == F.col("b.run_id"))
        & (F.col("p.document_id") == F.col("b.document_id"))
        & F.col("p.page_start").eqNullSafe(F.col("b.page_start"))
        & F.col("p.page_end").eqNullSafe(F.col("b.page_end"))
    )
    return p.join(b, on, "left_anti").select("run_id", "location")


def citation_boundary_violations(
    answers: DataFrame, citations: DataFrame, scope: DataFrame, reference: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """(run_id, model_key, rule) of answers that cross the boundary between their evidence layers.

    ``answers``: run_id, model_key, reference_requested, no_support. ``citations``: run_id, model_key, layer
    (SOURCE, REFERENCE or COMBINED), passage_id. ``scope``: run_id, passage_id. ``reference``: passage_id.
    ``snapshots``: run_id, layer, passage_id.
    """
    cited = citations.select("run_id", "model_key", "layer", "passage_id").where(F.length(F.trim("passage_id")) > 0).distinct()
    by_passage = cited.groupBy("run_id", "model_key", "passage_id").agg(
        F.bool_or(F.col("layer") == "SOURCE").alias("_s"),
        F.bool_or(F.col("layer") == "REFERENCE").alias("_r"),
        F.bool_or(F.col("layer") == "COMBINED").alias("_c"),
    )
    allowed = scope.select("run_id", "passage_id").distinct().withColumn("_in_scope", F.lit(True))
    corpus = reference.select("passage_id").distinct().withColumn("_in_reference", F.lit(True))
    frozen = snapshots.groupBy("run_id", "passage_id").agg(
        F.bool_or(F.col("layer") == "SOURCE").alias("_snap_s"), F.bool_or(F.col("layer") == "REFERENCE").alias("_snap_r")
    )
    has = snapshots.groupBy("run_id").agg(
        F.bool_or(F.col("layer") == "SOURCE").alias("_has_s"), F.bool_or(F.col("layer") == "REFERENCE").alias("_has_r")
    )
    placed = by_passage.join(allowed, ["run_id", "passage_id"], "left").join(corpus, "passage_id", "left").join(frozen, ["run_id", "passage_id"], "left")
    facts = placed.groupBy("run_id", "model_key").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("_r").alias("_refs"),
        F.count_if(F.col("_s") & F.col("_in_scope").isNull()).alias("_bad_s"),
        F.count_if(F.col("_r") & F.col("_in_reference").isNull()).alias("_bad_r"),
        F.count_if(F.col("_s") & ~F.coalesce("_snap_s", F.lit(False))).alias("_out_s"),
        F.count_if(F.col("_r") & ~F.coalesce("_snap_r", F.lit(False))).alias("_out_r"),
        F.count_if(F.col("_s") & F.col("_r")).alias("_both"),
        F.count_if(F.col("_c") != (F.col("_s") | F.col("_r"))).alias("_union"),
    )
    joined = answers.join(facts, ["run_id", "model_key"], "left").join(has, "run_id", "left")

    def some(name: str):
        return F.coalesce(F.col(name), F.lit(0)) > 0

    snap_s, snap_r = F.coalesce("_has_s", F.lit(False)), F.coalesce("_has_r", F.lit(False))
    codes = violations(
        ("SOURCE_OUTSIDE_SCOPE", some("_bad_s")),
        ("REFERENCE_NOT_REQUESTED", some("_refs") & ~F.coalesce("reference_requested", F.lit(False))),
        ("REFERENCE_OUTSIDE_CORPUS", some("_bad_r")),
        ("SOURCE_OUTSIDE_SNAPSHOT", snap_s & some("_out_s")),
        ("REFERENCE_OUTSIDE_SNAPSHOT", snap_r & some("_out_r")),
        ("REFERENCE_WITHOUT_SNAPSHOT", ~snap_r & some("_refs")),
        ("CITED_IN_BOTH_LAYERS", some("_both")),
        ("COMBINED_IS_NOT_UNION", some("_union")),
        ("NO_SUPPORT_WITH_ANSWER", F.coalesce("no_support", F.lit(False))),
    )
    return joined.select("run_id", "model_key", F.explode(codes).alias("rule"))


def sanitise_citations(answers: DataFrame, citations: DataFrame, allowed: DataFrame) -> DataFrame:
    """Answers with only valid citations counted; without any left the answer becomes insufficient.

    ``answers``: run_id, model_key, answer, insufficient. ``citations``: run_id, model_key, layer, passage_id.
    ``allowed``: run_id, layer, passage_id.
    """
    known = allowed.select("run_id", "layer", "passage_id").distinct().withColumn("_ok", F.lit(True))
    cited = citations.select("run_id", "model_key", "layer", "passage_id").distinct().join(known, ["run_id", "layer", "passage_id"], "left")
    ok = F.col("_ok").isNotNull()
    facts = cited.groupBy("run_id", "model_key").agg(
        F.count_if(ok & (F.col("layer") == "SOURCE")).alias("valid_source"),
        F.count_if(ok & (F.col("layer") == "REFERENCE")).alias("valid_reference"),
        F.count_if(~ok & (F.col("layer") == "SOURCE")).alias("invalid_source"),
        F.count_if(~ok & (F.col("layer") == "REFERENCE")).alias("invalid_reference"),
    )
    joined = answers.join(facts, ["run_id", "model_key"], "left")
    names = ("valid_source", "valid_reference", "invalid_source", "invalid_reference")
    joined = joined.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})
    raw = F.trim(F.coalesce("answer", F.lit("")))
    ungrounded = (raw != "") & (F.col("valid_source") == 0) & (F.col("valid_reference") == 0)
    text = F.when(raw == "", F.lit(NO_ANSWER)).when(ungrounded, F.lit(NO_VALID_SOURCES)).otherwise(raw)
    return joined.select(
        "run_id",
        "model_key",
        redact(text).alias("answer"),
        (F.coalesce("insufficient", F.lit(False)) | ungrounded | (raw == "")).alias("insufficient_evidence"),
        *names,
    )


def valid_citations(citations: DataFrame, allowed: DataFrame) -> DataFrame:
    """The citations that survive ``sanitise_citations``, one row each."""
    return citations.select("run_id", "model_key", "layer", "passage_id").distinct().join(
        allowed.select("run_id", "layer", "passage_id"), ["run_id", "layer", "passage_id"], "left_semi"
    )
