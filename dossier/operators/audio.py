"""Recordings: segments, time marks, audio locations and reviewed transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.functions.locations import format_audio_location, time_range_label, time_ranges
from dossier.functions.rules import violations

_SHA = "^[0-9a-f]{64}$"


def audio_locations(passages: DataFrame, recordings: DataFrame) -> DataFrame:
    """Location, reference and bounds of every passage with time marks.

    ``passages``: analysis_id, passage_id, passage_text. ``recordings``: analysis_id, source_sha256,
    source_name. Passages with malformed marks are returned with a violation instead.
    """
    marked = passages.withColumn("_r", time_ranges(F.col("passage_text"))).where(F.col("_r").isNotNull())
    joined = marked.join(recordings, "analysis_id")
    name = F.when(F.length(F.trim(F.coalesce("source_name", F.lit("")))) > 0, F.trim("source_name")).otherwise(F.lit("Audio recording"))
    start, end = F.col("_r.start_s"), F.col("_r.end_s")
    return joined.select(
        "analysis_id",
        "passage_id",
        start.alias("start_s"),
        end.alias("end_s"),
        format_audio_location(F.col("source_sha256"), start, end).alias("audio_location"),
        F.when(start.isNotNull(), F.concat(name, F.lit(" · "), time_range_label(start, end))).alias("audio_reference"),
        F.col("_r.violation").alias("violation"),
    )


def enrich_with_audio(items: DataFrame, locations: DataFrame) -> DataFrame:
    """Distinct audio locations and references of nodes or edges through their passages, one row each.

    ``items``: analysis_id, item_id, passage_ids in order. ``locations``: result of ``audio_locations``.
    Positions follow the first citation.
    """
    cited = items.select("analysis_id", "item_id", F.posexplode("passage_ids").alias("_pos", "passage_id"))
    good = locations.where(F.col("audio_location").isNotNull()).select("analysis_id", "passage_id", "audio_location", "audio_reference")
    return (
        cited.join(good, ["analysis_id", "passage_id"])
        .groupBy("analysis_id", "item_id", "audio_location", "audio_reference")
        .agg(F.min("_pos").cast("long").alias("first_position"))
    )


def merged_references(items: DataFrame, enriched: DataFrame) -> DataFrame:
    """(analysis_id, item_id, reference): existing references plus added audio references, each once."""
    existing = items.select("analysis_id", "item_id", F.explode("evidence_references").alias("reference"))
    added = enriched.select("analysis_id", "item_id", F.col("audio_reference").alias("reference"))
    return existing.unionByName(added).distinct()


def align_offsets(segments: DataFrame, anchors: DataFrame) -> DataFrame:
    """Absolute time of every segment of a recording with a reviewed anchor; negative offsets are rejected.

    ``segments``: audio_source_id, segment_index, start_seconds. ``anchors``: audio_source_id, anchor_time.
    """
    micros = F.round(F.col("start_seconds") * 1_000_000).cast("long")
    moment = F.timestamp_micros(F.unix_micros("anchor_time") + micros)
    joined = segments.join(anchors, "audio_source_id")
    return joined.select(
        *segments.columns,
        F.when(F.col("start_seconds") >= 0, moment).alias("aligned_at"),
        F.when(F.col("start_seconds").isNull(), F.lit("OFFSET_MISSING")).when(F.col("start_seconds") < 0, F.lit("OFFSET_NEGATIVE")).alias("violation"),
    )


def bind_segments(segments: DataFrame, analyses: DataFrame, version: str) -> DataFrame:
    """Transcript segments as passages of the analyses that use the recording.

    ``segments``: audio_source_id, transcript_segment_id, segment_index, transcript_text,
    segment_text_sha256, language_expected. ``analyses``: analysis_id, audio_source_id.
    """
    language = F.when(F.lower("language_expected") == "en", F.lit("English")).when(F.lower("language_expected") == "es", F.lit("Spanish")).otherwise(F.lit("UNKNOWN"))
    return segments.join(analyses, "audio_source_id").select(
        "analysis_id",
        F.col("audio_source_id").alias("document_id"),
        F.col("transcript_segment_id").alias("passage_id"),
        F.lit(None).cast("int").alias("page_start"),
        F.lit(None).cast("int").alias("page_end"),
        (F.col("segment_index") + 1).cast("long").alias("passage_order"),
        F.col("transcript_text").alias("passage_text"),
        F.col("segment_text_sha256").alias("text_sha256"),
        F.lit(version).alias("extraction_version"),
        language.alias("detected_language"),
    )


def segment_violations(segments: DataFrame, classification: str = "TYPE_D") -> DataFrame:
    """(audio_source_id, segments, count per rule) of transcript segments."""
    start, end = F.col("start_seconds"), F.col("end_seconds")

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return segments.groupBy("audio_source_id").agg(
        F.count(F.lit(1)).alias("segments"),
        count(F.col("transcript_text").isNull(), "null_text"),
        count(start.isNull(), "missing_start"),
        count(end.isNull(), "missing_end"),
        count((start < 0) | (end < start), "invalid_range"),
        count(F.upper(F.coalesce("classification", F.lit(""))) != classification, "wrong_class"),
        count(F.sha2(F.coalesce("transcript_text", F.lit("")), 256) != F.col("segment_text_sha256"), "hash_differs"),
    )


def real_time_factor(runs: DataFrame) -> DataFrame:
    """elapsed_s / duration_s rounded to four digits; NULL without a positive duration."""
    ratio = F.try_divide(F.col("elapsed_s").cast("double"), F.when(F.col("duration_s") > 0, F.col("duration_s").cast("double")))
    return runs.withColumn("real_time_factor", F.round(ratio, 4))


def reviewed_transcripts(reviews: DataFrame) -> DataFrame:
    """Accepted transcripts as catalogue documents, identified by recording, model and reviewed text.

    ``reviews``: transcription_run_id, decision, reviewed_at, source_sha256, source_name, model,
    reviewed_text. The latest review of a run counts. Rows that cannot be published carry a violation.
    """
    rest = ["decision", "source_sha256", "source_name", "model", "reviewed_text"]
    latest = (
        reviews.groupBy("transcription_run_id")
        .agg(F.max(F.struct("reviewed_at", *rest)).alias("_l"))
        .select("transcription_run_id", *[f"_l.{c}" for c in rest])
        .where(F.upper("decision") == "ACCEPTED")
    )
    source = F.lower(F.trim(F.coalesce("source_sha256", F.lit(""))))
    text_hash = F.sha2(F.coalesce("reviewed_text", F.lit("")), 256)
    codes = violations(
        ("SOURCE_HASH_NOT_VALID", ~source.rlike(_SHA)),
        ("EMPTY_TRANSCRIPT", F.length(F.trim(F.coalesce("reviewed_text", F.lit("")))) == 0),
    )
    identity = F.sha2(F.concat_ws("|", source, F.lower(F.trim("model")), text_hash), 256)
    base = F.regexp_extract(F.trim(F.coalesce("source_name", F.lit(""))), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(F.when(base == "", F.lit("audio")).otherwise(base), r"(?<=.)\.[^.]*$", "")
    return latest.select(
        "transcription_run_id",
        F.when(F.size(codes) == 0, F.concat(F.lit("doc_"), F.substring(identity, 1, 24))).alias("document_id"),
        F.concat(stem, F.lit(" — validated transcript.txt")).alias("filename"),
        F.lit("TXT").alias("source_type"),
        F.lit("TRANSCRIPT").alias("document_kind"),
        F.lit(S.LOCAL_OWNER).alias("source_managed_by"),
        F.lit("D").alias("information_class"),
        F.lit("AVAILABLE").alias("catalogue_status"),
        text_hash.alias("sha256"),
        F.octet_length("reviewed_text").cast("long").alias("byte_size"),
        source.alias("audio_source_sha256"),
        F.array_join(codes, ",").alias("violations"),
    )


def reusable_transcripts(requests: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Requests (request_id, source_sha256, model) with a flag whether a machine transcript already covers them."""
    usable = (
        transcripts.where((F.col("classification") == "D") & (F.col("status") == "MACHINE_GENERATED_UNVERIFIED"))
        .select(F.lower("source_sha256").alias("_h"), "model")
        .distinct()
        .withColumn("_usable", F.lit(True))
    )
    joined = requests.withColumn("_h", F.lower("source_sha256")).join(usable, ["_h", "model"], "left")
    return joined.select(*requests.columns, F.col("_usable").isNotNull().alias("reusable"))
