"""Candidates: batching, validation, resolution into nodes and edges, and proof that nothing was lost.

Evidence lists are long tables (one row per item and passage), because an item may be backed by any number of
passages. ``evidence_lists`` turns them into arrays where a caller needs them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.functions.locations import format_location
from dossier.functions.rules import violations
from dossier.functions.text import content_id, normalise_label_ascii, page_label
from dossier.plans.ordering import numbered

# Budget of one batch and what each passage costs beyond its text.
BATCH_CHARS, BATCH_ITEMS, ITEM_COST = 14_000, 8, 250
BATCH_BLOCK_ROWS = 50_000


def pack_batches(
    passages: DataFrame,
    max_chars: int = BATCH_CHARS,
    max_items: int = BATCH_ITEMS,
    block_rows: int = BATCH_BLOCK_ROWS,
) -> DataFrame:
    """Number the sequential batches of each analysis in (document, passage order).

    A batch closes when it has ``max_items`` passages or the next one would exceed ``max_chars``; a passage
    costs its length plus a fixed amount. Whether a row starts a batch depends on all rows before it, but only
    through the position of the last start, which is fewer than ``max_items`` rows away. Each block of rows is
    therefore described by a small table "first start in this block -> first start in the next block, batches
    opened"; the tables of one analysis are chained, and then every block numbers its rows on its own.
    """
    ordered = numbered(
        passages.select(
            "analysis_id", "document_id", "passage_order", "passage_id",
            (F.length(F.coalesce("passage_text", F.lit(""))) + ITEM_COST).cast("long").alias("cost"),
        ),
        ["analysis_id"],
        [F.col("document_id"), F.col("passage_order"), F.col("passage_id")],
        "position",
    )
    block = F.floor((F.col("position") - 1) / block_rows).cast("long")
    ahead = (block > 0) & ((F.col("position") - 1) % block_rows < max_items)
    # The first rows of a block are also shown to the block before it, whose last batch they may join.
    homes = F.when(ahead, F.array(block, block - 1)).otherwise(F.array(block))
    placed = ordered.select("*", F.explode(homes).alias("block"), block.alias("home"))

    def next_starts(costs: list[int]) -> list[int]:
        result = []
        for i in range(len(costs)):
            total, j = costs[i], i + 1
            while j < len(costs) and j - i < max_items and total + costs[j] <= max_chars:
                total += costs[j]
                j += 1
            result.append(j)
        return result

    def describe(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        own = int((pdf["home"] == pdf["block"]).sum())
        following = next_starts(pdf["cost"].tolist())
        # exits[i], opened[i]: where a chain of starts that begins at row i leaves the block.
        exits, opened = [0] * (own + max_items), [0] * (own + max_items)
        for i in range(len(exits) - 1, -1, -1):
            if i >= own:
                exits[i], opened[i] = i - own, 0
            else:
                exits[i], opened[i] = exits[following[i]], opened[following[i]] + 1
        return pd.DataFrame(
            {
                "analysis_id": [pdf["analysis_id"].iloc[0]],
                "block": [int(pdf["block"].iloc[0])],
                "exits": [exits[:max_items]],
                "opened": [opened[:max_items]],
            }
        )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        entry, done, entries, base = 0, 0, [], []
        for exits, opened in zip(pdf["exits"], pdf["opened"]):
            entries.append(entry)
            base.append(done)
            entry, done = int(exits[entry]), done + int(opened[entry])
        return pd.DataFrame({"analysis_id": pdf["analysis_id"], "block": pdf["block"], "entry": entries, "base": base})

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position").reset_index(drop=True)
        own = int((pdf["home"] == pdf["block"]).sum())
        following = next_starts(pdf["cost"].tolist())
        batch, start = [0] * own, int(pdf["entry"].iloc[0])
        current = int(pdf["base"].iloc[0])
        while start < own:
            current += 1
            for i in range(start, min(following[start], own)):
                batch[i] = current
            start = following[start]
        # Rows before the first start belong to the batch that was open when the block began.
        for i in range(min(int(pdf["entry"].iloc[0]), own)):
            batch[i] = int(pdf["base"].iloc[0])
        out = pdf.iloc[:own][["analysis_id", "document_id", "passage_order", "passage_id", "position", "cost"]].copy()
        out["batch"] = batch
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    keys = ["analysis_id", "block"]
    key_type = ordered.schema["analysis_id"].dataType.simpleString()
    described = placed.select("analysis_id", "block", "home", "position", "cost").groupBy(*keys).applyInPandas(
        describe, f"analysis_id {key_type}, block long, exits array<long>, opened array<long>"
    )
    # One small row per block: a hot analysis has rows / block_rows of them.
    chained = described.groupBy("analysis_id").applyInPandas(chain, f"analysis_id {key_type}, block long, entry long, base long")
    columns = ["analysis_id", "document_id", "passage_order", "passage_id", "position", "cost"]
    order = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    schema = ", ".join(f"{c} {order[c]}" for c in columns) + ", batch long"
    return placed.join(chained, keys).groupBy(*keys).applyInPandas(number, schema)


def validate_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with a known kind, an id and a label; an unknown evidence class becomes NORMALISED."""
    return candidates.where(
        F.col("node_kind").isin(*S.NODE_KINDS) & _filled("candidate_id") & _filled("label")
    ).withColumn("evidence_class", _evidence_class())


def validate_relationships(relationships: DataFrame, candidates: DataFrame) -> DataFrame:
    """Relationships of a known type whose ends are valid candidates of the same analysis and batch."""
    valid = relationships.where(
        F.col("relationship").isin(*S.RELATIONSHIPS) & _filled("source_candidate_id") & _filled("target_candidate_id")
    ).withColumn("evidence_class", _evidence_class())
    known = validate_candidates(candidates).select("analysis_id", "extraction_batch", "candidate_id").distinct()
    for side in ("source", "target"):
        valid = valid.join(
            known.withColumnRenamed("candidate_id", f"{side}_candidate_id"),
            ["analysis_id", "extraction_batch", f"{side}_candidate_id"],
            "left_semi",
        )
    return valid.select(*[c for c in relationships.columns])


def _filled(name: str) -> Column:
    return F.length(F.coalesce(F.col(name), F.lit(""))) > 0


def _evidence_class() -> Column:
    known = F.col("evidence_class").isin(*S.EVIDENCE_CLASSES)
    return F.when(known, F.col("evidence_class")).otherwise(F.lit("NORMALISED"))


def resolve_nodes(assignments: DataFrame, candidates: DataFrame) -> DataFrame:
    """Canonical nodes of the resolution: one per (analysis, run, kind, label) with member and passage counts.

    ``assignments``: analysis_id, model_run_id, resolution_id, node_kind, label, candidate_id.
    ``candidates``: analysis_id, candidate_id, passage_ids.
    """
    members = _members(assignments, candidates)
    backed = members.select("node_id", F.explode_outer("passage_ids").alias("passage_id"), "candidate_id")
    # Distinct counts are taken over (node, passage) and (node, candidate), so no node is gathered in one task.
    passages = backed.where(F.col("passage_id").isNotNull()).groupBy("node_id").agg(F.countDistinct("passage_id").alias("passages"))
    nodes = members.groupBy("analysis_id", "model_run_id", "node_kind", "node_id").agg(
        F.min("label").alias("label"), F.countDistinct("candidate_id").alias("members")
    )
    return nodes.join(passages, "node_id", "left").withColumn("passages", F.coalesce("passages", F.lit(0)).cast("long"))


def _identified(assignments: DataFrame) -> DataFrame:
    label = F.trim(F.coalesce("label", F.lit("")))
    valid = assignments.where(
        F.col("node_kind").isin(*S.NODE_KINDS) & _filled("resolution_id") & (F.length(label) > 0)
    ).withColumn("label", label)
    return valid.withColumn(
        "node_id",
        content_id("analysis_node_", [F.col("analysis_id"), F.col("model_run_id"), F.col("node_kind"), F.lower("label")]),
    )


def _members(assignments: DataFrame, candidates: DataFrame) -> DataFrame:
    return _identified(assignments).join(
        candidates.select("analysis_id", "candidate_id", "passage_ids"), ["analysis_id", "candidate_id"], "left"
    )


def node_evidence(assignments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(analysis_id, node_id, passage_id) rows behind the resolved nodes."""
    members = _members(assignments, candidates)
    return members.select("analysis_id", "node_id", F.explode("passage_ids").alias("passage_id")).where(F.col("passage_id").isNotNull()).distinct()


def member_nodes(assignments: DataFrame) -> DataFrame:
    """(analysis_id, model_run_id, resolution_id, candidate_id, node_id) of the valid assignments."""
    return _identified(assignments).select("analysis_id", "model_run_id", "resolution_id", "candidate_id", "node_id")


def resolve_edges(proposed: DataFrame, supports: DataFrame, relationships: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Edges between resolved nodes that rest on known candidate relationships of the same type.

    ``proposed``: analysis_id, proposed_id, relationship, source_resolution_id, target_resolution_id.
    ``supports``: analysis_id, proposed_id, position, candidate_relationship_id. ``relationships``:
    analysis_id, candidate_relationship_id, relationship, evidence_class. ``resolutions``: analysis_id,
    resolution_id, node_id.
    """
    facts = relationships.select("analysis_id", "candidate_relationship_id", F.col("relationship").alias("_type"), F.coalesce("evidence_class", F.lit("NORMALISED")).alias("_class"))
    backed = (
        supports.join(facts, ["analysis_id", "candidate_relationship_id"])
        .join(proposed.select("analysis_id", "proposed_id", "relationship"), ["analysis_id", "proposed_id"])
        .groupBy("analysis_id", "proposed_id")
        .agg(
            F.countDistinct("candidate_relationship_id").alias("supports"),
            F.bool_or(F.col("_type") == F.col("relationship")).alias("_typed"),
            F.bool_or(F.col("_class") == "DIRECT").alias("_direct"),
            F.min(F.struct("position", "_class")).alias("_first"),
        )
        .where(F.col("_typed"))
    )
    ends = resolutions.select("analysis_id", "resolution_id", "node_id").distinct()
    mapped = proposed.where(F.col("relationship").isin(*S.RELATIONSHIPS))
    for side in ("source", "target"):
        mapped = mapped.join(
            ends.select("analysis_id", F.col("resolution_id").alias(f"{side}_resolution_id"), F.col("node_id").alias(f"{side}_node_id")),
            ["analysis_id", f"{side}_resolution_id"],
        )
    return mapped.join(backed, ["analysis_id", "proposed_id"]).select(
        "analysis_id",
        "proposed_id",
        content_id("analysis_edge_", [F.col("analysis_id"), F.col("source_node_id"), F.col("relationship"), F.col("target_node_id")]).alias("edge_id"),
        "source_node_id",
        "relationship",
        "target_node_id",
        "supports",
        F.when(F.col("_direct"), F.lit("DIRECT")).otherwise(F.col("_first._class")).alias("evidence_class"),
        F.lit("REPORT_DERIVED").alias("edge_class"),
    )


def group_edges(relationships: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate relationships mapped to nodes and grouped by (source, type, target); self-relations are kept and marked.

    ``relationships``: analysis_id, candidate_relationship_id, relationship, source_candidate_id,
    target_candidate_id, passage_ids, evidence_class. ``members``: analysis_id, candidate_id, node_id.
    """
    mapped = _mapped(relationships, members)
    keys = ["analysis_id", "source_node_id", "relationship", "target_node_id"]
    passages = mapped.select(*keys, F.explode("passage_ids").alias("passage_id")).groupBy(*keys).agg(F.countDistinct("passage_id").alias("passages"))
    # At most as many evidence classes as the vocabulary has.
    edges = mapped.groupBy(*keys).agg(
        F.countDistinct("candidate_relationship_id").alias("candidate_relationships"),
        F.array_join(F.array_sort(F.collect_set(_evidence_class())), ",").alias("evidence_classes"),
    )
    return edges.join(passages, keys, "left").select(
        *keys,
        content_id("edge_", [F.col(k) for k in keys]).alias("edge_id"),
        "candidate_relationships",
        F.coalesce("passages", F.lit(0)).cast("long").alias("passages"),
        "evidence_classes",
        (F.col("source_node_id") == F.col("target_node_id")).alias("self_relation"),
    )


def _mapped(relationships: DataFrame, members: DataFrame) -> DataFrame:
    ends = members.select("analysis_id", "candidate_id", "node_id").distinct()
    mapped = relationships.where(F.col("relationship").isin(*S.RELATIONSHIPS))
    for side in ("source", "target"):
        mapped = mapped.join(
            ends.select("analysis_id", F.col("candidate_id").alias(f"{side}_candidate_id"), F.col("node_id").alias(f"{side}_node_id")),
            ["analysis_id", f"{side}_candidate_id"],
        )
    return mapped


def group_edge_evidence(relationships: DataFrame, members: DataFrame) -> DataFrame:
    """(analysis_id, edge_id, passage_id) rows behind the grouped edges."""
    keys = ["analysis_id", "source_node_id", "relationship", "target_node_id"]
    return (
        _mapped(relationships, members)
        .select("analysis_id", content_id("edge_", [F.col(k) for k in keys]).alias("edge_id"), F.explode("passage_ids").alias("passage_id"))
        .distinct()
    )


def coverage_violations(assignments: DataFrame, candidates: DataFrame, relationships: DataFrame) -> DataFrame:
    """(analysis_id, rule, key): candidates mapped never or twice, unknown members, wrong kinds, lost relationships.

    ``assignments``: analysis_id, resolution_id, node_kind, candidate_id. ``candidates``: analysis_id,
    candidate_id, node_kind. ``relationships``: analysis_id, candidate_relationship_id, relationship,
    source_candidate_id, target_candidate_id.
    """
    mapped = assignments.groupBy("analysis_id", "candidate_id").agg(
        F.countDistinct("resolution_id").alias("_owners"),
        F.min("node_kind").alias("_lo"),
        F.max("node_kind").alias("_hi"),
        F.lit(True).alias("_mapped"),
    )
    known = candidates.select("analysis_id", "candidate_id", F.col("node_kind").alias("_kind"), F.lit(True).alias("_known"))
    both = known.join(mapped, ["analysis_id", "candidate_id"], "full")
    is_known, is_mapped = F.col("_known").isNotNull(), F.col("_mapped").isNotNull()
    wrong = (F.col("_lo") != F.col("_kind")) | (F.col("_hi") != F.col("_kind"))
    codes = violations(
        ("CANDIDATE_NOT_MAPPED", is_known & ~is_mapped),
        ("CANDIDATE_MAPPED_TWICE", is_known & (F.col("_owners") > 1)),
        ("UNKNOWN_MEMBER", is_mapped & ~is_known),
        ("KIND_DIFFERS", is_known & is_mapped & wrong),
    )
    from_members = both.select("analysis_id", F.explode(codes).alias("rule"), F.col("candidate_id").alias("key"))
    ends = assignments.select("analysis_id", "candidate_id").distinct().withColumn("_end", F.lit(True))
    checked = relationships
    for side in ("source", "target"):
        checked = checked.join(
            ends.select("analysis_id", F.col("candidate_id").alias(f"{side}_candidate_id"), F.col("_end").alias(f"_{side}")),
            ["analysis_id", f"{side}_candidate_id"],
            "left",
        )
    lost = violations(
        ("RELATIONSHIP_TYPE_NOT_ALLOWED", ~F.col("relationship").isin(*S.RELATIONSHIPS)),
        ("SOURCE_NOT_MAPPED", F.col("_source").isNull()),
        ("TARGET_NOT_MAPPED", F.col("_target").isNull()),
    )
    from_relationships = checked.select("analysis_id", F.explode(lost).alias("rule"), F.col("candidate_relationship_id").alias("key"))
    return from_members.unionByName(from_relationships)


def passthrough_nodes(relationships: DataFrame, members: DataFrame, candidates: DataFrame, kinds: tuple[str, ...] = ("Actor", "Vessel", "System", "Claim")) -> DataFrame:
    """Hidden support nodes for candidates that relationships refer to but no node contains.

    Candidates that are unknown or of another kind are returned without a node id and with a violation.
    """
    ends = relationships.select(
        "analysis_id", F.explode(F.array("source_candidate_id", "target_candidate_id")).alias("candidate_id")
    ).where(_filled("candidate_id")).distinct()
    open_ends = ends.join(members.select("analysis_id", "candidate_id"), ["analysis_id", "candidate_id"], "left_anti")
    joined = open_ends.join(candidates.select("analysis_id", "candidate_id", "node_kind", "label"), ["analysis_id", "candidate_id"], "left")
    supported = F.coalesce(F.col("node_kind").isin(*kinds), F.lit(False))
    label = F.trim(F.coalesce("label", "candidate_id"))
    return joined.select(
        "analysis_id",
        "candidate_id",
        F.when(
            supported,
            content_id("support_node_", [F.col("analysis_id"), F.lit("passthrough"), F.col("node_kind"), F.col("candidate_id"), label]),
        ).alias("node_id"),
        "node_kind",
        label.alias("label"),
        F.when(F.col("node_kind").isNull(), F.lit("UNKNOWN_CANDIDATE")).when(~supported, F.lit("KIND_NOT_SUPPORTED")).alias("violation"),
    )


def coverage_by_kind(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates and published nodes of each analysis and kind with their difference."""
    c = candidates.groupBy("analysis_id", F.coalesce("node_kind", F.lit("Other")).alias("node_kind")).agg(F.count(F.lit(1)).alias("candidates"))
    n = nodes.groupBy("analysis_id", F.coalesce("node_kind", F.lit("Other")).alias("node_kind")).agg(F.count(F.lit(1)).alias("published"))
    zero = F.lit(0).cast("long")
    return c.join(n, ["analysis_id", "node_kind"], "full").select(
        "analysis_id", "node_kind", F.coalesce("candidates", zero).alias("candidates"), F.coalesce("published", zero).alias("published")
    ).withColumn("count_delta", F.col("candidates") - F.col("published"))


def coverage_matches(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every candidate with a flag whether a published node of its kind has the same normalised label."""
    key = ["analysis_id", "node_kind", "_label"]
    published = nodes.select("analysis_id", F.coalesce("node_kind", F.lit("Other")).alias("node_kind"), normalise_label_ascii(F.col("label")).alias("_label")).where(F.col("_label") != "").distinct().withColumn("_hit", F.lit(True))
    return (
        candidates.select("analysis_id", F.coalesce("node_kind", F.lit("Other")).alias("node_kind"), "candidate_id", "label", normalise_label_ascii(F.col("label")).alias("_label"))
        .join(published, key, "left")
        .select("analysis_id", "node_kind", "candidate_id", "label", F.col("_hit").isNotNull().alias("exact_label_match"))
    )


def references_for(items: DataFrame, passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Ordered distinct references and location keys of each item.

    ``items``: item_id, passage_ids in citation order. ``passages``: passage_id, document_id, page_start,
    page_end. ``documents``: document_id, filename. One row per reference, numbered by its first citation.
    """
    cited = items.select("item_id", F.posexplode("passage_ids").alias("_pos", "passage_id"))
    located = cited.join(passages.select("passage_id", "document_id", "page_start", "page_end"), "passage_id")
    unique = located.groupBy("item_id", "document_id", "page_start", "page_end").agg(F.min("_pos").alias("_pos"))
    named = unique.join(documents.select("document_id", "filename"), "document_id", "left")
    fallback = F.when(F.startswith("document_id", F.lit("text_")), F.lit("Direct text")).otherwise(F.col("document_id"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("_pos", "document_id", "page_start", "page_end"))
    return named.select(
        "item_id",
        rank.cast("long").alias("reference_position"),
        F.concat_ws(" · ", F.coalesce("filename", fallback), page_label(F.col("page_start"), F.col("page_end"))).alias("evidence_reference"),
        format_location(F.col("document_id"), F.col("page_start"), F.col("page_end")).alias("evidence_location"),
    )
