"""Retention: expiry of content, purging of derived tables and the status board of persisted tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import schemas as S

# Hours for which content of class D and of all other classes is kept.
CLASS_D_HOURS, OTHER_HOURS = 24, 72


def _upper(name: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(name), F.lit(""))))


def is_persistent(owner: str = "source_managed_by", role: str = "source_role") -> Column:
    return _upper(owner).isin(*S.PERSISTENT_OWNERS) | _upper(role).isin(*S.PERSISTENT_ROLES)


def expiry(created: Column, information_class: str) -> Column:
    hours = F.when(_upper(information_class) == "D", F.lit(CLASS_D_HOURS)).otherwise(F.lit(OTHER_HOURS))
    return F.when(_upper(information_class).isin(*S.INFORMATION_CLASSES), created + F.make_dt_interval(F.lit(0), hours))


def retention_expiry(sources: DataFrame) -> DataFrame:
    """Expiry of every claim on a source; persistent sources never expire and unknown classes are violations.

    ``sources``: source_id, created_at, information_class, source_managed_by, source_role.
    """
    known = _upper("information_class").isin(*S.INFORMATION_CLASSES)
    return sources.withColumns(
        {
            "expires_at": F.when(~is_persistent(), expiry(F.col("created_at"), "information_class")),
            "violation": F.when(~is_persistent() & ~known, F.lit("UNSUPPORTED_CLASS")),
        }
    )


def source_expiry(claims: DataFrame) -> DataFrame:
    """The earliest expiry of all claims on a source."""
    return retention_expiry(claims).groupBy("source_id").agg(F.min("expires_at").alias("expires_at"), F.count(F.lit(1)).alias("claims"))


def expired(analyses: DataFrame, now: datetime) -> DataFrame:
    """Finished analyses past their expiry that are neither kept for validation nor purged already.

    ``analyses``: analysis_id, status, content_expires_at, derived_expires_at, retain_for_validation,
    content_purge_status, retention_purge_status.
    """
    due = F.coalesce("content_expires_at", "derived_expires_at")
    return analyses.where(
        ~F.coalesce("retain_for_validation", F.lit(False))
        & (due <= F.lit(now))
        & F.col("status").isin("COMPLETED", "FAILED")
        & (F.coalesce("content_purge_status", "retention_purge_status", F.lit("ACTIVE")) != "PURGED")
    ).select("analysis_id", "status", due.alias("expires_at"))


def purge(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a derived table that stay: the content of its next version."""
    return table.join(gone.select("analysis_id").distinct(), "analysis_id", "left_anti").select(*table.columns)


def blank_content(table: DataFrame, gone: DataFrame, content: Sequence[str], now: datetime) -> DataFrame:
    """Audit rows stay, their content columns are emptied and the purge is recorded."""
    marked = table.join(gone.select("analysis_id", F.lit(True).alias("_gone")).distinct(), "analysis_id", "left")
    hit = F.col("_gone").isNotNull()
    return marked.select(
        *[(F.when(~hit, F.col(c)).alias(c) if c in content else F.col(c)) for c in table.columns],
        F.when(hit, F.lit("PURGED")).otherwise(F.lit("ACTIVE")).alias("content_purge_status"),
        F.when(hit, F.lit(now)).alias("content_purged_at"),
    )


def status_board(checks: Mapping[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """(area, item, row_count, status) of persisted tables.

    ``checks`` maps an item to its area, its rows and the status of an empty table (WARN or FAIL).
    """
    parts = []
    for item, (area, df, empty) in checks.items():
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(
            counted.select(
                F.lit(area).alias("area"),
                F.lit(item).alias("item"),
                "row_count",
                F.when(F.col("row_count") > 0, F.lit("PASS")).otherwise(F.lit(empty)).alias("status"),
            )
        )
    board = parts[0]
    for part in parts[1:]:
        board = board.unionByName(part)
    return board


def lineage_check(runs: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status): PASS when the expected snapshot is among the persisted ones of the benchmark."""
    persisted = runs.select(*keys, "retrieval_snapshot_id").distinct().withColumn("_ok", F.lit(True))
    joined = expected.join(persisted, [*keys, "retrieval_snapshot_id"], "left")
    return joined.select(*keys, "retrieval_snapshot_id", F.when(F.col("_ok").isNotNull(), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"))
