"""Knowledge graph as node and edge tables: publishing, scoping, facets, labels and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.sources.tables import write_new

# Node id prefixes of a published graph and the kind they mean.
ID_PREFIX_KINDS = (("occ_", "Occurrence"), ("ves_", "Vessel"), ("cf_", "ContributingFactor"), ("evt_", "Event"))
# Heading of each kind in the findings index.
FINDING_CATEGORIES = {
    "Event": "Events",
    "ContributingFactor": "Contributing factors",
    "Finding": "Findings",
    "SafetyIssue": "Safety issues",
    "Recommendation": "Safety recommendations",
}


def semantics(relationship: Column) -> Column:
    """CHRONOLOGY, CAUSAL_OR_CONTRIBUTORY, STRUCTURAL or SEMANTIC."""
    value = F.upper(F.trim(F.coalesce(relationship, F.lit(""))))
    return (
        F.when(value.isin(*S.CHRONOLOGY_RELATIONSHIPS), F.lit("CHRONOLOGY"))
        .when(value.isin(*S.CAUSAL_RELATIONSHIPS), F.lit("CAUSAL_OR_CONTRIBUTORY"))
        .when(value.isin(*S.STRUCTURAL_RELATIONSHIPS), F.lit("STRUCTURAL"))
        .otherwise(F.lit("SEMANTIC"))
    )


def relationship_semantics(edges: DataFrame) -> DataFrame:
    return edges.withColumn("semantics", semantics(F.col("relationship")))


def mapping_strings(mappings: DataFrame, status: str = "ASSISTANT_VALIDATED") -> DataFrame:
    """``entity → attribute = value`` strings of validated mappings: one row per (node, mapping), numbered."""
    text = F.concat_ws(
        " → ", F.col("entity"), F.concat(F.col("attribute_name"), F.lit(" = "), F.col("code_value"))
    )
    rows = mappings.where(F.col("review_status") == status).groupBy("node_id", text.alias("mapping")).agg(F.count(F.lit(1)).alias("times"))
    return rows.where(F.col("mapping") != "")


def publish_nodes(nodes: DataFrame, dispositions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Nodes with their kind, mapping disposition, and the number and texts of their validated mappings.

    The texts of a node are bounded by the entities, attributes and values of the registry.
    """
    kind = F.when(F.lit(False), F.lit(""))
    for prefix, value in ID_PREFIX_KINDS:
        kind = kind.when(F.startswith("node_id", F.lit(prefix)), F.lit(value))
    counted = mapping_strings(mappings).groupBy("node_id").agg(
        F.sum("times").cast("long").alias("mappings"), F.array_join(F.array_sort(F.collect_set("mapping")), " | ").alias("mapping_texts")
    )
    return (
        nodes.join(dispositions, "node_id", "left")
        .join(counted, "node_id", "left")
        .withColumn("node_kind", kind.otherwise(F.lit("Concept")))
        .withColumn("mappings", F.coalesce("mappings", F.lit(0)).cast("long"))
        .withColumn("mapping_texts", F.coalesce("mapping_texts", F.lit("")))
    )


def publish_edges(edges: DataFrame) -> DataFrame:
    """Edges as they are published: ends, relationship, class, status, and the anchor and text of their evidence."""
    return edges.select(
        "analysis_id", "edge_id", "source_node_id", "target_node_id", "relationship", "edge_class", "evidence_status",
        "evidence_anchor", "passage_text",
    )


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, partition_by: str = "analysis_id") -> tuple[str, str]:
    """Publish both tables below a new folder, partitioned by analysis."""
    return write_new(nodes, f"{path}/nodes", [partition_by]), write_new(edges, f"{path}/edges", [partition_by])


def _scoped(items: DataFrame, documents: str, scope: DataFrame) -> DataFrame:
    """Items whose evidence documents meet the selected documents of their analysis; no selection means all."""
    exploded = items.select("*", F.explode(documents).alias("document_id"))
    hit = exploded.join(scope.select("analysis_id", "document_id").distinct(), ["analysis_id", "document_id"], "left_semi")
    limited = scope.select("analysis_id").distinct()
    inside = hit.drop("document_id").dropDuplicates(["analysis_id", _key(items)])
    return inside.select(*items.columns).unionByName(items.join(limited, "analysis_id", "left_anti").select(*items.columns))


def _key(items: DataFrame) -> str:
    return "edge_id" if "edge_id" in items.columns else "node_id"


def evidence_backed_nodes(nodes: DataFrame, scope: DataFrame) -> DataFrame:
    """Nodes (analysis_id, node_id, evidence_document_ids) supported by the selected documents."""
    return _scoped(nodes, "evidence_document_ids", scope)


def _ends(edges: DataFrame) -> DataFrame:
    """One row per edge end."""
    return edges.select(
        "analysis_id", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")
    ).where(F.col("node_id").isNotNull())


def scope_graph(nodes: DataFrame, edges: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of the selected documents.

    Nodes are kept when their own evidence or the evidence of one of their edges is selected; edges when both
    ends are kept and they are selected themselves or structural.
    """
    own = evidence_backed_nodes(nodes, scope).select("analysis_id", "node_id")
    chosen = _scoped(edges, "evidence_document_ids", scope)
    ids = own.unionByName(_ends(chosen)).distinct()
    kept_nodes = nodes.join(ids, ["analysis_id", "node_id"], "left_semi")
    # An edge is chosen at most once, so a flag replaces a second pass over all edges.
    flagged = edges.join(chosen.select("analysis_id", "edge_id").withColumn("_chosen", F.lit(True)), ["analysis_id", "edge_id"], "left")
    wanted = flagged.where(F.col("_chosen").isNotNull() | (F.col("edge_class") == "STRUCTURAL")).select(*edges.columns)
    return kept_nodes, filter_edges(wanted, ids)


def structural_passthrough(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (analysis_id, node_id) plus their direct structural neighbours; added nodes add no others."""
    anchors = nodes.select("analysis_id", "node_id").distinct()
    structural = edges.where(semantics(F.col("relationship")) == "STRUCTURAL")
    both = F.array(
        F.struct(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("other")),
        F.struct(F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("other")),
    )
    reached = (
        structural.select("analysis_id", F.inline(both))
        .join(anchors, ["analysis_id", "node_id"], "left_semi")
        .select("analysis_id", F.col("other").alias("node_id"))
        .where(F.col("node_id").isNotNull())
    )
    return anchors.unionByName(reached).distinct()


def filter_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("analysis_id", "node_id").distinct()
    source = ids.withColumnRenamed("node_id", "source_node_id")
    target = ids.withColumnRenamed("node_id", "target_node_id")
    return edges.join(source, ["analysis_id", "source_node_id"], "left_semi").join(
        target, ["analysis_id", "target_node_id"], "left_semi"
    ).select(*edges.columns)


def facets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(analysis_id, facet, value, items): node kinds and relationships that can be filtered on."""
    kinds = nodes.select("analysis_id", F.lit("node_kind").alias("facet"), F.coalesce("node_kind", F.lit("Other")).alias("value"))
    relations = edges.select("analysis_id", F.lit("relationship").alias("facet"), F.coalesce("relationship", F.lit("OTHER")).alias("value"))
    return kinds.unionByName(relations).groupBy("analysis_id", "facet", "value").agg(F.count(F.lit(1)).alias("items"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges of every analysis that has either."""
    n = nodes.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("edge_class") == "STRUCTURAL").alias("structural_edges")
    )
    zero = F.lit(0).cast("long")
    return n.join(e, "analysis_id", "full").select(
        "analysis_id", *[F.coalesce(c, zero).alias(c) for c in ("nodes", "edges", "structural_edges")]
    )


def node_labels(edge_view: DataFrame) -> DataFrame:
    """One label per node from both ends of the edges; of several labels the first in order."""
    both = F.array(
        F.struct(F.col("source_node_id").alias("node_id"), F.col("source_label").alias("label")),
        F.struct(F.col("target_node_id").alias("node_id"), F.col("target_label").alias("label")),
    )
    return edge_view.select(F.inline(both)).groupBy("node_id").agg(F.min("label").alias("label"))


def label_coverage(nodes: DataFrame, labels: DataFrame, groups: Sequence[str]) -> DataFrame:
    return nodes.select(*groups, "node_id").join(labels, "node_id", "left").groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count("label").alias("nodes_with_label")
    )


def edge_evidence(edge_view: DataFrame) -> DataFrame:
    """Displayed evidence: the stronger evidence joined by bars, else the passage text."""
    stronger = F.filter("stronger_evidence", lambda x: x.isNotNull())
    return edge_view.withColumn(
        "evidence_display",
        F.when(F.coalesce(F.size("stronger_evidence"), F.lit(0)) > 0, F.array_join(stronger, " | ")).otherwise(F.col("passage_text")),
    )


def evidence_coverage(edge_view: DataFrame, groups: Sequence[str]) -> DataFrame:
    return edge_evidence(edge_view).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_relationships"),
        F.count("evidence_display").alias("relationships_with_evidence"),
        F.count_if(F.col("evidence_status") == "ASSISTANT_VALIDATED").alias("validated_relationships"),
    )


def findings_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One list of findings nodes and analytical relationships with category, label, description."""
    category = F.when(F.lit(False), F.lit(""))
    for kind, heading in FINDING_CATEGORIES.items():
        category = category.when(F.col("node_kind") == kind, F.lit(heading))
    from_nodes = nodes.where(F.col("node_kind").isin(*FINDING_CATEGORIES)).select(
        "analysis_id",
        F.col("node_id").alias("item_id"),
        F.col("node_kind").alias("kind"),
        category.alias("category"),
        "label",
        F.coalesce("description", F.lit("")).alias("description"),
    )
    from_edges = edges.where(F.coalesce("edge_class", F.lit("")) != "STRUCTURAL").select(
        "analysis_id",
        F.col("edge_id").alias("item_id"),
        F.lit("Relationship").alias("kind"),
        F.lit("Analytical relationships").alias("category"),
        F.concat(F.col("source_label"), F.lit(" — "), F.col("relationship"), F.lit(" → "), F.col("target_label")).alias("label"),
        F.lit("Relationship proposed from the referenced source evidence.").alias("description"),
    )
    return from_nodes.unionByName(from_edges)


def findings_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("analysis_id", "category").agg(F.count(F.lit(1)).alias("items"))


def active_run(runs: DataFrame) -> DataFrame:
    """Per analysis the completed PRIMARY run, else the newest completed one."""
    primary = F.when(F.col("model_key") == "PRIMARY", 1).otherwise(0)
    best = F.max(F.struct(primary.alias("p"), F.col("completed_at").alias("t"), F.col("model_run_id").alias("model_run_id"), F.col("model_key").alias("model_key")))
    return (
        runs.where(F.col("status") == "COMPLETED")
        .groupBy("analysis_id")
        .agg(best.alias("_b"))
        .select("analysis_id", "_b.model_run_id", "_b.model_key")
    )


def evidence_reference_view(passages: DataFrame, segments: DataFrame) -> DataFrame:
    """One resolver row per passage: page reference of a document or clock and speaker of a recording."""
    from dossier.functions.locations import clock_floor

    joined = passages.join(
        segments.select(
            F.col("transcript_segment_id").alias("passage_id"),
            F.col("audio_source_id").alias("document_id"),
            "classification", "start_seconds", "end_seconds", "speaker_id",
            F.lit(True).alias("_audio"),
        ),
        ["passage_id", "document_id"],
        "left",
    )
    audio = F.col("_audio").isNotNull()
    speaker = F.when(F.length(F.trim(F.coalesce("speaker_id", F.lit("")))) > 0, F.concat(F.lit(" · Speaker "), F.col("speaker_id"))).otherwise(F.lit(""))
    start, end = F.col("page_start"), F.col("page_end")
    reference = (
        F.when(audio, F.concat(clock_floor(F.col("start_seconds")), F.lit("–"), clock_floor(F.col("end_seconds")), speaker))
        .when(start.isNull(), F.lit("source location unavailable"))
        .when(end.isNull() | (end == start), F.concat(F.lit("p. "), start.cast("string")))
        .otherwise(F.concat(F.lit("pp. "), start.cast("string"), F.lit("–"), end.cast("string")))
    )
    return joined.select(
        "analysis_id", "document_id", "passage_id", "passage_order", "page_start", "page_end",
        F.when(audio, F.lit("TYPE_D_AUDIO_TRANSCRIPT")).otherwise(F.lit("DOCUMENT")).alias("source_locator_type"),
        F.when(audio, F.col("classification")).alias("source_classification"),
        "start_seconds", "end_seconds", "speaker_id",
        reference.alias("source_reference"),
    )
