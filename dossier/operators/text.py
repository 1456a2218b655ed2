"""Passages: building them, naming them and describing a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import chunk_fixed, chunk_greedy, content_id, page_label, sha256
from dossier.plans.ordering import numbered


def greedy_passages(df: DataFrame, text: str = "text", target: int = 2400, hard: int = 3600) -> DataFrame:
    """One row per passage with its position; the other columns of ``df`` are kept."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(chunk_greedy(F.col(text), target, hard)).alias("_p", "passage_text")).select(
        *rest, (F.col("_p") + 1).cast("long").alias("passage_order"), "passage_text"
    )


def fixed_passages(df: DataFrame, text: str = "text", max_chars: int = 4500) -> DataFrame:
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(chunk_fixed(F.col(text), max_chars)).alias("_p", "passage_text")).select(
        *rest, (F.col("_p") + 1).cast("long").alias("passage_order"), "passage_text"
    )


def assign_passage_ids(df: DataFrame, order: Sequence[Column] | None = None, prefix: str = "passage_") -> DataFrame:
    """Add text_sha256 and passage_id. ``order`` numbers passages that have no passage_order yet."""
    if order is not None:
        df = numbered(df, ["document_id"], order, "passage_order")
    df = df.withColumn("text_sha256", sha256(F.col("passage_text")))
    return df.withColumn(
        "passage_id",
        content_id(
            prefix, [F.col("document_id"), F.col("page_start"), F.col("passage_order"), F.col("text_sha256")]
        ),
    )


def dominant_language(df: DataFrame, groups: Sequence[str], language: str = "detected_language") -> DataFrame:
    """Most common language of each group; ties go to the first name; UNKNOWN without any language."""
    known = F.col(language).isNotNull() & (F.col(language) != "UNKNOWN")
    counted = df.groupBy(*groups, language).agg(F.sum(F.when(known, 1).otherwise(0)).alias("_n"))
    best = F.min(F.when(F.col("_n") > 0, F.struct((-F.col("_n")).alias("n"), F.col(language).alias("language"))))
    return counted.groupBy(*groups).agg(best.alias("_b")).select(
        *groups, F.coalesce(F.col("_b.language"), F.lit("UNKNOWN")).alias("dominant_language")
    )


def corpus_profile(passages: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Documents, pages, passages and characters of each group."""
    return passages.groupBy(*groups).agg(
        F.countDistinct("document_id").alias("documents"),
        F.countDistinct("document_id", "page_start").alias("pages"),
        F.count(F.lit(1)).alias("passages"),
        F.sum(F.length("passage_text")).cast("long").alias("characters"),
    )


def passage_preview(passages: DataFrame, chars: int | None = None) -> DataFrame:
    """Listing of passages with their length and their text, or its first ``chars`` characters where a page shows no more."""
    return passages.select(
        "document_id", "page_start", "passage_order",
        F.length("passage_text").cast("long").alias("chars"),
        (F.col("passage_text") if chars is None else F.left(F.col("passage_text"), F.lit(chars))).alias("passage_preview"),
        page_label(F.col("page_start"), F.col("page_end")).alias("page_reference"),
    )


def _hashed(rows: DataFrame, groups: Sequence[str], digest: str, digits: int) -> DataFrame:
    """One level of a hash tree: (groups, bucket, files, digest) of the sorted digests that begin with the same ``digits``."""
    bucket = F.left(F.col("bucket"), F.lit(digits))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", digest))), lambda x: x[digest]), "\n")
    return rows.groupBy(*groups, bucket.alias("_bucket")).agg(F.sum("files").alias("files"), F.sha2(lines, 256).alias("digest")).withColumnRenamed("_bucket", "bucket")


def snapshot_buckets(df: DataFrame, groups: Sequence[str], parts: Sequence[Column]) -> DataFrame:
    """(groups, bucket, files, digest): the entries of each group by the first four digits of their digests, sorted and hashed per bucket."""
    entry = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    rows = df.select(*groups, entry.alias("digest"), entry.alias("bucket"), F.lit(1).cast("long").alias("files"))
    return _hashed(rows, groups, "digest", 4)


def corpus_snapshot_id(df: DataFrame, groups: Sequence[str], parts: Sequence[Column], prefix: str = "corpus_snapshot_") -> DataFrame:
    """One id per group: the root of a hash tree over its sorted entries, whatever their order in the table.

    Entries meet in 65,536 buckets, these in 256, and these in the root, so no task holds more than a bucket.
    """
    leaves = snapshot_buckets(df, groups, parts)
    root = _hashed(_hashed(leaves, groups, "digest", 2), groups, "digest", 0)
    return root.select(*groups, "files", content_id(prefix, [F.col("files"), F.col("digest")], 32).alias("corpus_snapshot_id"))


def changed_buckets(before: DataFrame, after: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, bucket) of ``snapshot_buckets`` whose entries differ between two snapshots; only these need to be compared entry by entry."""
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in (*groups, "bucket")]
    joined = before.alias("b").join(after.alias("a"), same, "full_outer").where(~F.col("b.digest").eqNullSafe(F.col("a.digest")))
    return joined.select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in (*groups, "bucket")])
