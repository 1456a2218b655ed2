"""Source catalogue: routing by content hash, bridges between layers, reconciliation and screening joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.functions.locations import lenient_pages
from dossier.functions.rules import violations

_SHA = "^[0-9a-f]{64}$"


def _sha(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


def route_by_hash(documents: DataFrame, canonical: DataFrame) -> DataFrame:
    """Route each document by the number of canonical documents with its hash: none, one or ambiguous.

    ``documents``: document_id, sha256. ``canonical``: canonical_document_id, package_id, sha256. The
    canonical side is reduced to one row per hash first, so copies cannot multiply the rows.
    """
    by_hash = canonical.groupBy(_sha("sha256").alias("_h")).agg(
        F.countDistinct("canonical_document_id").alias("matches"),
        F.min(F.struct("canonical_document_id", "package_id")).alias("_c"),
    )
    joined = documents.withColumn("_h", _sha("sha256")).join(by_hash, "_h", "left")
    matches = F.coalesce("matches", F.lit(0)).cast("long")
    valid = F.col("_h").rlike(_SHA)
    return joined.select(
        *documents.columns,
        matches.alias("canonical_matches"),
        F.when(~valid, F.lit("INVALID_SHA256"))
        .when(matches == 0, F.lit("LOCAL_FALLBACK"))
        .when(matches == 1, F.lit("CANONICAL"))
        .otherwise(F.lit("AMBIGUOUS"))
        .alias("route"),
        F.when(valid & (matches == 1), F.col("_c.canonical_document_id")).alias("canonical_document_id"),
        F.when(valid & (matches == 1), F.col("_c.package_id")).alias("canonical_package_id"),
    )


def evidence_source_mode(routes: DataFrame) -> DataFrame:
    """Per analysis (analysis_id, input_mode, route): which layers its evidence came from."""
    facts = routes.groupBy("analysis_id").agg(
        F.bool_or(F.col("input_mode") == "DIRECT_TEXT").alias("direct"),
        F.bool_or(F.col("route") == "CANONICAL").alias("some"),
        F.bool_and(F.col("route") == "CANONICAL").alias("all"),
    )
    return facts.select(
        "analysis_id",
        F.when(F.col("direct"), F.lit("DIRECT_TEXT"))
        .when(F.col("all"), F.lit("CANONICAL"))
        .when(F.col("some"), F.lit("CANONICAL_FIRST_MIXED"))
        .otherwise(F.lit("LOCAL_FALLBACK"))
        .alias("evidence_source_mode"),
    )


def passage_bridge(routed: DataFrame, passages: DataFrame, contract_version: str) -> DataFrame:
    """Canonical passages of the documents routed to exactly one canonical document.

    ``routed``: analysis_id, document_id, sha256, canonical_document_id, canonical_package_id.
    ``passages``: canonical_document_id, passage_id, passage_number, start_page, end_page, passage_text,
    passage_text_sha256.
    """
    matched = routed.where(F.col("canonical_document_id").isNotNull()).select(
        "analysis_id",
        "document_id",
        "canonical_document_id",
        F.col("canonical_package_id").alias("package_id"),
        F.lower("sha256").alias("source_document_sha256"),
    )
    return matched.join(passages, "canonical_document_id").select(
        F.lit(contract_version).alias("passage_contract_version"),
        "analysis_id",
        "document_id",
        "canonical_document_id",
        "package_id",
        "passage_id",
        F.col("passage_number").alias("passage_order"),
        F.col("start_page").alias("page_start"),
        F.col("end_page").alias("page_end"),
        "passage_text",
        F.lower("passage_text_sha256").alias("text_sha256"),
        "source_document_sha256",
    )


BRIDGE_REQUIRED = (
    "analysis_id", "document_id", "canonical_document_id", "package_id", "passage_id", "passage_text",
    "text_sha256", "source_document_sha256",
)


def bridge_violations(bridge: DataFrame, documents: DataFrame) -> DataFrame:
    """(rule, key) of duplicate document content per analysis, duplicate passages and invalid passage rows."""
    text = F.col("passage_text")
    missing = F.lit(False)
    for name in BRIDGE_REQUIRED:
        missing = missing | F.col(name).isNull()
    rows = bridge.select(
        F.col("passage_id").cast("string").alias("key"),
        F.explode(
            violations(
                ("REQUIRED_FIELD_MISSING", missing),
                ("BLANK_TEXT", F.length(F.trim(text)) == 0),
                ("PAGE_START_BELOW_ONE", F.col("page_start") < 1),
                ("PAGES_REVERSED", F.col("page_end") < F.col("page_start")),
                ("ORDER_BELOW_ONE", F.col("passage_order") < 1),
                ("TEXT_HASH_DIFFERS", F.sha2(text, 256) != F.col("text_sha256")),
            )
        ).alias("rule"),
    )
    inputs = (
        documents.groupBy("analysis_id", _sha("sha256").alias("_h"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(F.concat_ws("|", "analysis_id", "_h").alias("key"), F.lit("DUPLICATE_INPUT_CONTENT").alias("rule"))
    )
    repeated = (
        bridge.groupBy("analysis_id", "passage_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(F.concat_ws("|", "analysis_id", "passage_id").alias("key"), F.lit("DUPLICATE_PASSAGE").alias("rule"))
    )
    return rows.select("rule", "key").unionByName(inputs).unionByName(repeated)


def parity_diff(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that one side lacks or whose columns differ, with the names of the differing columns."""
    a = left.select(*key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    b = right.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    both = a.join(b, list(key), "full")
    differing = violations(*[(c, ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))) for c in columns])
    status = (
        F.when(F.col("_in_b").isNull(), F.lit("MISSING_RIGHT"))
        .when(F.col("_in_a").isNull(), F.lit("MISSING_LEFT"))
        .when(F.size(differing) > 0, F.lit("DIFFERENT"))
    )
    present = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return both.select(
        *key, status.alias("status"), F.when(present, F.array_join(differing, ",")).alias("differing_columns")
    ).where(F.col("status").isNotNull())


def parity_counts(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows of both sides per group."""
    a = left.groupBy(*groups).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(*groups).agg(F.count(F.lit(1)).alias("right_rows"))
    return a.join(b, list(groups), "full").select(
        *groups,
        F.coalesce("left_rows", F.lit(0)).cast("long").alias("left_rows"),
        F.coalesce("right_rows", F.lit(0)).cast("long").alias("right_rows"),
    )


def availability(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Four-way status of each document by its role and the number of its passages."""
    counts = passages.groupBy("document_id").agg(F.countDistinct("passage_id").alias("passage_count"))
    main = F.col("document_role") == "MAIN_REPORT"
    some = F.col("passage_count") > 0
    return (
        documents.join(counts, "document_id", "left")
        .withColumn("passage_count", F.coalesce("passage_count", F.lit(0)).cast("long"))
        .withColumn("query_ready", main & some)
        .withColumn(
            "availability_status",
            F.when(main & some, F.lit("AVAILABLE"))
            .when(main, F.lit("MAIN_REPORT_WITHOUT_PASSAGES"))
            .when(some, F.lit("SUPPLEMENTARY_PROCESSED_NOT_IN_QUERY_SCOPE"))
            .otherwise(F.lit("SUPPLEMENTARY_WITHOUT_PASSAGES")),
        )
    )


def availability_summary(available: DataFrame) -> DataFrame:
    return available.groupBy("document_role", "availability_status").agg(
        F.countDistinct("document_id").alias("documents"),
        F.countDistinct("package_id").alias("packages"),
        F.sum("passage_count").cast("long").alias("passages"),
    )


def availability_gaps(available: DataFrame) -> DataFrame:
    """Main reports that cannot be queried yet."""
    return available.where((F.col("document_role") == "MAIN_REPORT") & (F.col("passage_count") == 0))


def reconcile(documents: DataFrame, files: DataFrame, counts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every registered document, unregistered file and stale catalogue entry with its list of reasons.

    ``documents``: document_id, document_role, file_path, sha256. ``files``: file_path. ``counts``:
    document_id, passage_count. ``catalogue``: document_id, catalogue_status, sha256.
    """
    present = files.select("file_path").distinct().withColumn("_on_disk", F.lit(True))
    listed = catalogue.select(
        "document_id", "catalogue_status", F.lower("sha256").alias("_catalogue_sha"), F.lit(True).alias("_listed")
    )
    # Documents without a path get a key of their own, so that they do not all meet in one task.
    path = F.coalesce("file_path", F.concat(F.lit("no path:"), "document_id"))
    joined = (
        documents.select("document_id", "document_role", "sha256", path.alias("_path"), F.col("file_path").alias("_file"))
        .withColumn("_registered", F.lit(True))
        .join(present.withColumnRenamed("file_path", "_path"), "_path", "left")
        .join(counts, "document_id", "left")
        .join(listed, "document_id", "full")
    )
    registered = F.col("_registered").isNotNull()
    on_disk = F.col("_on_disk").isNotNull()
    selectable = F.coalesce(F.col("catalogue_status") == "AVAILABLE", F.lit(False))
    main = F.coalesce(F.col("document_role") == "MAIN_REPORT", F.lit(False))
    has_path = F.length(F.coalesce("_file", F.lit(""))) > 0
    same_hash = F.coalesce("_catalogue_sha", F.lit("")) == F.lower(F.coalesce("sha256", F.lit("")))
    reasons = violations(
        ("STALE_CATALOGUE_ENTRY", ~registered),
        ("NO_REGISTERED_PATH", registered & ~has_path),
        ("REGISTERED_FILE_NOT_FOUND", registered & has_path & ~on_disk),
        ("MISSING_OR_UNAVAILABLE_IN_CATALOGUE", registered & ~selectable),
        ("CATALOGUE_HASH_DIFFERS", registered & selectable & ~same_hash),
        ("MAIN_REPORT_WITHOUT_PASSAGES", registered & main & (F.coalesce("passage_count", F.lit(0)) == 0)),
        ("SUPPLEMENTARY_NOT_IN_CASE_SEARCH", registered & ~main),
    )
    listed_rows = joined.select(
        F.col("document_id").alias("item"),
        F.coalesce("passage_count", F.lit(0)).cast("long").alias("passages"),
        F.when(F.size(reasons) == 0, F.lit("READY")).otherwise(F.array_join(reasons, ", ")).alias("status"),
    )
    unregistered = present.join(documents.select("file_path"), "file_path", "left_anti").select(
        F.concat(F.lit("file:"), "file_path").alias("item"),
        F.lit(0).cast("long").alias("passages"),
        F.lit("UNREGISTERED_FILE").alias("status"),
    )
    return listed_rows.unionByName(unregistered)


def dedupe_catalogue(catalogue: DataFrame) -> DataFrame:
    """One entry per content hash, the canonical owner first; entries without a hash are all kept.

    The best entry of a hash is an aggregate, so a hash with very many copies is reduced before the shuffle.
    """
    owner = F.when(F.col("source_managed_by") == S.CANONICAL_OWNER, 0).otherwise(1)
    rest = [c for c in catalogue.columns]
    hashed = catalogue.where(_sha("sha256") != "")
    best = hashed.groupBy(_sha("sha256").alias("_h")).agg(
        F.min(F.struct(owner.alias("_o"), F.col("document_id").alias("_d"), F.struct(*rest).alias("row"))).alias("_b")
    )
    return best.select("_b.row.*").unionByName(catalogue.where(_sha("sha256") == ""))


def filter_catalogue(catalogue: DataFrame, information_class: str) -> DataFrame:
    """Entries an analysis of this class may use: owned by the right layer, or a reviewed derivative of the class."""
    wanted = str(information_class or "").strip().upper()
    if wanted not in S.INFORMATION_CLASSES:
        raise ValueError(f"Unsupported information class: {information_class!r}")
    return _usable(catalogue, F.lit(wanted))


def catalogue_by_class(catalogue: DataFrame) -> DataFrame:
    """``filter_catalogue`` for all classes at once: one row per (requested_class, entry)."""
    classes = F.array(*[F.lit(c) for c in S.INFORMATION_CLASSES])
    return _usable(catalogue.withColumn("requested_class", F.explode(classes)), F.col("requested_class"))


def _usable(catalogue: DataFrame, wanted: Column) -> DataFrame:
    def upper(name: str) -> Column:
        return F.upper(F.trim(F.coalesce(F.col(name), F.lit(""))))

    allowed = F.when(wanted == "B", F.lit(S.CANONICAL_OWNER)).otherwise(F.lit(S.LOCAL_OWNER))
    explicit = upper("information_class")
    derivative = (
        (upper("source_type") == S.DERIVATIVE)
        & (upper("source_managed_by") == S.LOCAL_OWNER)
        & (explicit == wanted)
        & upper("pseudonymisation_review_status").isin("REVIEWED", "APPROVED")
    )
    owned = upper("source_managed_by") == allowed
    return catalogue.where((owned | derivative) & ((explicit == "") | (explicit == wanted)))


def source_routes(ingress: DataFrame) -> DataFrame:
    """Owner and catalogue scope of each (information_class, input_mode); unknown values become violations."""
    information = F.upper(F.trim(F.coalesce("information_class", F.lit(""))))
    raw = F.replace(F.upper(F.trim(F.coalesce("input_mode", F.lit("")))), F.lit(" "), F.lit("_"))
    mode = F.when(raw.isin("DOCUMENT", "DOCUMENTS"), F.lit("DOCUMENTS")).when(
        raw.isin("DIRECT_TEXT", "DIRECTTEXT"), F.lit("DIRECT_TEXT")
    )
    good = information.isin(*S.INFORMATION_CLASSES) & mode.isNotNull()
    published = (mode == "DOCUMENTS") & (information == "B")
    scope = (
        F.when(mode == "DIRECT_TEXT", F.lit("DIRECT_TEXT_INGRESS"))
        .when(published, F.lit("PUBLISHED_MATERIAL"))
        .otherwise(F.lit("LOCAL_DOCUMENTS"))
    )
    owner = F.when(published, F.lit(S.CANONICAL_OWNER)).otherwise(F.lit(S.LOCAL_OWNER))
    return ingress.withColumns(
        {
            "allowed_owner": F.when(good, owner),
            "catalogue_scope": F.when(good, scope),
            "violation": F.when(~information.isin(*S.INFORMATION_CLASSES), F.lit("UNSUPPORTED_CLASS")).when(
                mode.isNull(), F.lit("UNSUPPORTED_INPUT_MODE")
            ),
        }
    )


def exclude_own_package(passages: DataFrame, packages: DataFrame) -> DataFrame:
    """Drop passages of the packages that belong to the case itself."""
    return passages.join(packages.select("package_id"), "package_id", "left_anti")


def resolve_citations(cited: Sequence[DataFrame], resolver: DataFrame) -> DataFrame:
    """Distinct cited passage ids of several tables (column passage_ids) that the resolver does not know."""
    ids = [df.select(F.explode("passage_ids").alias("passage_id")).where(F.col("passage_id").isNotNull()) for df in cited]
    merged = ids[0]
    for other in ids[1:]:
        merged = merged.unionByName(other)
    return merged.distinct().join(resolver.select("passage_id"), "passage_id", "left_anti")


def scope_passages(passages: DataFrame, scopes: DataFrame) -> DataFrame:
    """Passages whose document is in the effective scope (run_id, analysis_id, document_id) of each run."""
    return scopes.select("run_id", "analysis_id", "document_id").distinct().join(passages, ["analysis_id", "document_id"])


def sync_catalogue(catalogue: DataFrame, registry: DataFrame) -> DataFrame:
    """Catalogue after a registry load: registered entries are current, vanished ones become UNAVAILABLE.

    ``registry``: document_id and further columns of the catalogue except catalogue_status.
    """
    payload = [c for c in registry.columns if c != "document_id"]
    old = catalogue.select(
        "document_id", "source_managed_by", "catalogue_status", *[F.col(c).alias(f"_old_{c}") for c in payload],
        F.lit(True).alias("_old"),
    )
    new = registry.select("document_id", *payload, F.lit(True).alias("_new"))
    both = old.join(new, "document_id", "full")
    fresh = F.col("_new").isNotNull()
    vanished = ~fresh & (F.col("source_managed_by") == S.CANONICAL_OWNER)
    return both.select(
        "document_id",
        F.when(fresh, F.lit(S.CANONICAL_OWNER)).otherwise(F.col("source_managed_by")).alias("source_managed_by"),
        F.when(fresh, F.lit("AVAILABLE")).when(vanished, F.lit("UNAVAILABLE")).otherwise(F.col("catalogue_status")).alias("catalogue_status"),
        *[F.when(fresh, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in payload],
    )


def viewer_metadata_violations(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Cited locations that a reader cannot open.

    ``documents``: document_id, viewer_source_path, path_exists, page_count. ``items``: item_type, item_id and
    evidence_locations (array of keys).
    """
    exploded = items.select("item_type", "item_id", F.explode_outer("evidence_locations").alias("location"))
    parsed = exploded.withColumn("_l", lenient_pages(F.col("location"))).withColumn("document_id", F.col("_l.document_id"))
    joined = parsed.join(
        documents.select("document_id", "viewer_source_path", "path_exists", "page_count", F.lit(True).alias("_linked")),
        "document_id",
        "left",
    )
    start = F.col("_l.page_start")
    end = F.coalesce("_l.page_end", "_l.page_start")
    valid = (start >= 1) & (end >= start) & (end <= F.col("page_count"))
    issue = (
        F.when(F.col("location").isNull(), F.lit("NO_EVIDENCE_LOCATION"))
        .when(F.col("_l").isNull(), F.lit("INVALID_LOCATION_FORMAT"))
        .when(F.col("_linked").isNull(), F.lit("DOCUMENT_NOT_LINKED"))
        .when(F.length(F.coalesce("viewer_source_path", F.lit(""))) == 0, F.lit("NO_VIEWER_SOURCE_PATH"))
        .when(~F.coalesce("path_exists", F.lit(False)), F.lit("SOURCE_PATH_NOT_FOUND"))
        .when(~F.coalesce(valid, F.lit(False)), F.lit("INVALID_PAGE_RANGE"))
    )
    return joined.select("item_type", "item_id", "location", issue.alias("issue")).where(F.col("issue").isNotNull())
