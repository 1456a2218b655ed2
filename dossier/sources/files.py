"""File discovery and the registry of reference sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File types that can be registered, the manifest that is not a source, and reserved folders.
SUPPORTED_SUFFIXES = (".pdf", ".docx", ".txt")
MANIFEST = "manifest.json"


def discover_files(
    spark: SparkSession,
    path: str,
    suffixes: Sequence[str] = SUPPORTED_SUFFIXES,
    reserved: Sequence[str] = (),
) -> DataFrame:
    """One row per supported file below ``path`` with its hash, size and document id.

    ``reserved`` names top-level folders that are not registered. Contents are hashed by the executors and
    never leave them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.regexp_replace(F.lit(path.rstrip("/")), r"^[a-z0-9]+:/*", "/")
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    relative = F.regexp_replace(F.substr(plain, F.length(root) + 1), "^/", "")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    top = F.when(F.contains(relative, F.lit("/")), F.split_part(relative, F.lit("/"), F.lit(1))).otherwise("")
    kept = files.where(suffix.isin(*suffixes) & (name != MANIFEST))
    if reserved:
        kept = kept.where(~top.isin(*reserved))
    return kept.select(
        F.concat(F.lit("doc_"), F.substring(F.sha2("content", 256), 1, 24)).alias("document_id"),
        name.alias("original_filename"),
        F.col("path").alias("storage_uri"),
        F.upper(F.substring(suffix, 2, 20)).alias("source_type"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("byte_size"),
        F.col("modificationTime").alias("modified_at"),
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per source of a JSON registry document {registry_version, sources: [...]}."""
    fields = (
        "registry_key", "source_authority", "reference_family", "reference_code", "reference_title", "language",
        "canonical_url", "snapshot_url", "snapshot_filename", "source_type", "note",
    )
    schema = "registry_version string, sources array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    registry = spark.read.schema(schema).option("multiLine", "true").json(path)
    return registry.select("registry_version", F.inline("sources"))
