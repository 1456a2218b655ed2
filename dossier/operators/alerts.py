"""External alerts: latest versions, matches, triage labels, filters, counts and relevance to a case."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.functions import rules as R
from dossier.functions.text import ALERT_STOP_WORDS
from dossier.plans.containment import containing
from dossier.plans.sizing import checked_broadcast, spread_by


def relevant_headline(headline: Column) -> Column:
    """False for inland waters, sanctions and migration without loss of life."""
    upper = F.upper(headline)
    migration = R.contains_any(upper, R.MIGRATION_WORDS) & ~R.contains_any(upper, R.LOSS_OF_LIFE)
    return ~headline.rlike(R.INLAND_WATERS) & ~R.contains_any(upper, R.NOISE_WORDS) & ~migration


def latest_alert_version(alerts: DataFrame) -> DataFrame:
    """Newest relevant version of every alert group, with the vessel number found in its sub-headline."""
    rest = [c for c in alerts.columns if c not in ("alert_group_id", "alert_version", "alert_id")]
    kept = alerts.where(relevant_headline(F.col("headline")))
    # The maximum is taken per task first, so a group with very many versions costs one row per task.
    newest = kept.groupBy("alert_group_id").agg(
        F.max(F.struct("alert_version", "alert_id", F.struct(*rest).alias("_rest"))).alias("_l")
    )
    flat = newest.select("alert_group_id", "_l.alert_version", "_l.alert_id", "_l._rest.*")
    imo = F.regexp_extract(F.coalesce("sub_headline_text", F.lit("")), r"IMO:\s*(\d{7})", 1)
    return flat.withColumn("imo_number", imo)


def expand_matches(alerts: DataFrame) -> DataFrame:
    """One row per flag, location and crew country of an alert, or one unmatched row with the alert's reason."""
    countries = F.array_compact(
        F.array(
            *[
                F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("match_country"), F.lit(reason).alias("match_reason")))
                for c, reason in (("flag_country", "Flag"), ("location_country", "Location"), ("crew_country", "Crew"))
            ]
        )
    )
    unmatched = F.array(F.struct(F.lit(None).cast("string").alias("match_country"), F.col("alert_reason").alias("match_reason")))
    return alerts.select("*", F.inline(F.when(F.size(countries) > 0, countries).otherwise(unmatched)))


def classify_headline(alerts: DataFrame, headline: str = "headline") -> DataFrame:
    """Vessel type, event type, severity and loss of life by ordered keyword rules."""
    upper = F.upper(F.coalesce(F.col(headline), F.lit("")))
    return alerts.withColumns(
        {
            "vessel_type": R.first_label(upper, R.VESSEL_TYPES, "unknown"),
            "event_type": R.first_label(upper, R.EVENT_TYPES, "Other"),
            "severity": R.first_label(upper, R.SEVERITIES, "unknown"),
            "loss_of_life": F.when(R.contains_any(upper, R.LOSS_OF_LIFE), F.lit("Yes")).otherwise(F.lit("No")),
        }
    )


def full_headline(alerts: DataFrame) -> DataFrame:
    """Headline followed by the previous headlines of the alert."""
    before = F.when(F.col("previous_headlines").isNotNull(), F.concat(F.lit("\n---\n"), F.col("previous_headlines"))).otherwise(F.lit(""))
    return alerts.withColumn("headline_full", F.concat(F.col("headline"), before))


def alert_window(
    alerts: DataFrame,
    now: datetime,
    days: int = 7,
    countries: Sequence[str] = (),
    event_types: Sequence[str] = (),
    vessel_types: Sequence[str] = (),
    reasons: Sequence[str] = (),
    text: str = "",
) -> DataFrame:
    """Alerts of the last ``days`` days that pass the chosen facets and contain ``text`` in any case."""
    kept = alerts.where(F.col("alert_timestamp") >= F.lit(now) - F.make_dt_interval(F.lit(days)))
    for column, values in (
        ("match_country", countries), ("event_type", event_types), ("vessel_type", vessel_types), ("match_reason", reasons),
    ):
        if values:
            kept = kept.where(F.col(column).isin(*values))
    if text:
        kept = kept.where(F.contains(F.lower(F.coalesce("headline_full", F.lit(""))), F.lit(text.lower())))
    return kept


def alert_counts(alerts: DataFrame, dimension: str, top: int | None = 15) -> DataFrame:
    """Distinct alerts per value of a column, the most frequent first; ``top`` limits the report."""
    counted = alerts.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).cast("string").alias("value")).agg(F.countDistinct("alert_id").alias("alerts"))
    return counted if top is None else counted.orderBy(F.desc("alerts"), "value").limit(top)


def alert_kpis(alerts: DataFrame) -> DataFrame:
    """One row: distinct alerts, fatal alerts, countries and the last load."""
    return alerts.agg(
        F.countDistinct("alert_id").alias("alerts"),
        F.countDistinct(F.when(F.col("loss_of_life") == "Yes", F.col("alert_id"))).alias("fatal_alerts"),
        F.countDistinct("match_country").alias("countries"),
        F.max("load_date").alias("last_update"),
    )


def _concept_labels(concepts: DataFrame) -> DataFrame:
    return concepts.where(F.col("node_kind").isin(*S.FOCUS_ORDER))


def _held(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_text, needle) of the distinct texts that contain a wanted needle. Equal texts are read once."""
    return containing(spread_by(texts.select("_text").distinct(), "_text"), "_text", wanted, "needle")


def alert_relevance(alerts: DataFrame, concepts: DataFrame, text: str = "headline_full") -> DataFrame:
    """(analysis_id, alert_id, relevance): 3 per concept phrase and 1 per concept word found in an alert.

    Phrases and words are found as parts of the text. Every concept counts, repeated labels repeatedly, as
    they appear in the graph; words count once per analysis.
    """
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    labels = _concept_labels(concepts).select("analysis_id", label.alias("needle")).where(~F.col("needle").isin("", "subject vessel"))
    phrases = labels.groupBy("analysis_id", "needle").agg((3 * F.count(F.lit(1))).alias("points"))
    words = F.filter(
        F.array_distinct(F.regexp_extract_all(F.col("needle"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))), lambda w: F.length(w) >= 4
    )
    terms = (
        labels.select("analysis_id", F.explode(words).alias("needle"))
        .where(~F.col("needle").isin(*ALERT_STOP_WORDS))
        .distinct()
        .withColumn("points", F.lit(1).cast("long"))
    )
    # Needles shared by several analyses are searched once, equal texts are read and judged once, and only then meet their alerts.
    wanted = phrases.unionByName(terms).groupBy("analysis_id", "needle").agg(F.sum("points").alias("points"))
    texts = alerts.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"), "alert_id").distinct()
    judged = _held(texts, wanted).join(checked_broadcast(wanted), "needle").groupBy("_text", "analysis_id").agg(F.sum("points").cast("long").alias("relevance"))
    return judged.join(texts, "_text").select("analysis_id", "alert_id", "relevance")


def related_concepts(alerts: DataFrame, concepts: DataFrame, text: str = "headline_full") -> DataFrame:
    """(analysis_id, alert_id, label): concept labels found in an alert as whole words.

    All labels of each analysis are screened, each spelling once, named by its first occurrence in graph order
    (column position).
    """
    squeezed = F.trim(F.regexp_replace(F.coalesce("label", F.lit("")), r"\s+", " "))
    labels = _concept_labels(concepts).select("analysis_id", "position", squeezed.alias("label")).where(F.length("label") > 0)
    first = labels.groupBy("analysis_id", F.lower("label").alias("needle")).agg(F.min(F.struct("position", "label")).alias("_f"))
    wanted = first.select("analysis_id", "needle", F.col("_f.label").alias("label"))
    texts = alerts.select(F.coalesce(F.col(text), F.lit("")).alias("_raw"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"), "alert_id").distinct()
    found = _held(texts, wanted)
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(F.col("needle"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    whole = found.where(F.rlike(F.col("_text"), quoted))
    return whole.join(texts, "_text").select("alert_id", "needle").distinct().join(wanted, "needle").select("analysis_id", "alert_id", "label")
