"""Human reviews: latest decisions, effective graph, gates and violations of the review contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.functions.rules import violations
from dossier.plans.sizing import checked_broadcast

NO_MAPPING = "NO_MAPPING"
# What a correction proposal may ask for and what a person may decide about it.
CORRECTION_ACTIONS = ("KEEP", "CHANGE_RELATIONSHIP", "REJECT_RELATIONSHIP", "INSUFFICIENT_EVIDENCE")
GROUNDED_ACTIONS = ("KEEP", "CHANGE_RELATIONSHIP", "REJECT_RELATIONSHIP")
CORRECTION_APPLIED = ("APPROVED", "APPLIED_WITH_AMENDMENT")
CORRECTION_RELATIONSHIPS = ("FOLLOWED_BY", "CONTRIBUTED_TO", "RESULTED_IN", "AFFECTED", "SUPPORTS")


def _upper(name: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(name), F.lit(""))))


def _blank(name: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))) == 0


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def latest_review(reviews: DataFrame, keys: Sequence[str], order: Sequence[str] = ("reviewed_at", "review_id")) -> DataFrame:
    """The last review of each key. The maximum is taken per task first, so busy keys stay cheap."""
    rest = [c for c in reviews.columns if c not in (*keys, *order)]
    last = F.max(F.struct(*order, F.struct(*rest).alias("_rest"))) if rest else F.max(F.struct(*order))
    flat = reviews.groupBy(*keys).agg(last.alias("_l"))
    return flat.select(*keys, *[f"_l.{c}" for c in order], *([f"_l._rest.{c}" for c in rest]))


def effective_value(decision: Column, proposed: Column, amended: Column) -> Column:
    """Accepted value: the proposed one when validated, the amended one when amended, none when rejected."""
    return F.when(decision == "VALIDATED", proposed).when(decision == "AMENDED", amended)


def effective_mapping(reviews: DataFrame, proposed: str, amended: str) -> DataFrame:
    return reviews.withColumn(
        "effective_value", effective_value(_upper("decision"), F.col(proposed), F.col(amended))
    )


def apply_reviews(edges: DataFrame, latest: DataFrame) -> DataFrame:
    """Graph as people decided: rejected edges hidden, amended ones relabelled, validated ones marked.

    ``latest``: edge_id, model_run_id, decision, amended_relationship. Structural edges stay as they are and a
    review of another model run is ignored.
    """
    joined = _with_decision(edges, latest)
    amended = (F.col("_decision") == "AMENDED") & ~_blank("amended_relationship")
    return joined.where(F.coalesce(F.col("_decision"), F.lit("")) != "REJECTED").select(
        *[c for c in edges.columns if c != "relationship"],
        F.when(amended, F.col("amended_relationship")).otherwise(F.col("relationship")).alias("relationship"),
        F.col("_decision").alias("human_review_decision"),
    )


def review_projection(edges: DataFrame, latest: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Hidden, amended and validated edges per group."""
    joined = _with_decision(edges, latest)
    return joined.groupBy(*groups).agg(
        F.count_if(F.col("_decision") == "REJECTED").alias("hidden_rejected"),
        F.count_if((F.col("_decision") == "AMENDED") & ~_blank("amended_relationship")).alias("amended"),
        F.count_if(F.col("_decision") == "VALIDATED").alias("validated"),
    )


def _with_decision(edges: DataFrame, latest: DataFrame) -> DataFrame:
    mine = latest.select("edge_id", F.col("model_run_id").alias("_review_run"), "decision", "amended_relationship")
    joined = edges.join(mine, "edge_id", "left")
    other_run = F.col("model_run_id").isNotNull() & F.col("_review_run").isNotNull() & (F.col("model_run_id") != F.col("_review_run"))
    counts = F.coalesce(F.col("edge_class") != "STRUCTURAL", F.lit(True)) & ~other_run
    return joined.withColumn("_decision", F.when(counts, F.upper("decision")))


def review_queue(edges: DataFrame, latest: DataFrame) -> DataFrame:
    """Analytical edges that nobody has reviewed yet."""
    open_edges = edges.where(F.coalesce(F.col("edge_class") != "STRUCTURAL", F.lit(True)))
    return open_edges.join(latest.select("edge_id"), "edge_id", "left_anti")


def review_queue_counts(edges: DataFrame, latest: DataFrame, groups: Sequence[str]) -> DataFrame:
    open_edges = edges.where(F.coalesce(F.col("edge_class") != "STRUCTURAL", F.lit(True)))
    done = latest.select("edge_id", F.lit(True).alias("_done"))
    return open_edges.join(done, "edge_id", "left").groupBy(*groups).agg(
        F.count(F.lit(1)).alias("reviewable"), F.count("_done").alias("reviewed"), F.count_if(F.col("_done").isNull()).alias("remaining")
    )


def review_violations(reviews: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(review_id, rule) of relationship reviews that contradict policy or the reviewed graph.

    ``reviews``: review_id, analysis_id, model_run_id, edge_id, source_node_id, target_node_id,
    original_relationship, decision, status, amended_relationship. ``edges``: edge_id, analysis_id,
    model_run_id, relationship. ``nodes``: node_id, analysis_id, model_run_id.
    """
    e = edges.select(
        "edge_id", "analysis_id", "model_run_id", F.col("relationship").alias("_relationship")
    )
    joined = reviews.join(e, ["edge_id", "analysis_id", "model_run_id"], "left")
    for side in ("source", "target"):
        n = nodes.select(
            F.col("node_id").alias(f"{side}_node_id"),
            F.col("analysis_id").alias(f"_{side}_analysis"),
            F.col("model_run_id").alias(f"_{side}_run"),
        )
        joined = joined.join(n, f"{side}_node_id", "left")
    decision, relationship, amended = _upper("decision"), _upper("original_relationship"), _upper("amended_relationship")
    expected = F.when(F.lit(False), F.lit(""))
    for name, status in S.HUMAN_STATUS.items():
        expected = expected.when(decision == name, F.lit(status))
    codes = violations(
        ("STRUCTURAL_RELATIONSHIP_REVIEWED", (relationship == "") | relationship.isin(*S.STRUCTURAL_RELATIONSHIPS)),
        ("UNSUPPORTED_DECISION", ~decision.isin(*S.HUMAN_STATUS)),
        ("STATUS_DOES_NOT_MATCH_DECISION", ~_blank("status") & (_upper("status") != expected)),
        ("AMENDED_WITHOUT_AMENDMENT", (decision == "AMENDED") & (amended == "")),
        ("AMENDED_TO_STRUCTURAL", (decision == "AMENDED") & amended.isin(*S.STRUCTURAL_RELATIONSHIPS)),
        ("AMENDMENT_WITHOUT_AMENDED", (decision != "AMENDED") & (amended != "")),
        ("MODEL_RUN_MISSING", _blank("model_run_id")),
        ("EDGE_NOT_FOUND", F.col("_relationship").isNull()),
        ("RELATIONSHIP_DIFFERS", F.col("_relationship") != F.col("original_relationship")),
        ("SOURCE_OF_OTHER_ANALYSIS", _differs(F.col("_source_analysis"), F.col("analysis_id"))),
        ("SOURCE_OF_OTHER_RUN", _differs(F.col("_source_run"), F.col("model_run_id"))),
        ("TARGET_OF_OTHER_ANALYSIS", _differs(F.col("_target_analysis"), F.col("analysis_id"))),
        ("TARGET_OF_OTHER_RUN", _differs(F.col("_target_run"), F.col("model_run_id"))),
    )
    return joined.select("review_id", F.explode(codes).alias("rule"))


def confirms_contribution(decision: Column, original: Column, amended: Column) -> Column:
    return F.coalesce(effective_value(F.upper(decision), original, amended) == "CONTRIBUTED_TO", F.lit(False))


def gate1_eligible(reviews: DataFrame, nodes: DataFrame) -> DataFrame:
    """Contributing factors whose latest review confirms that they contributed.

    ``reviews``: analysis_id, model_run_id, edge_id, source_node_id, target_node_id, original_relationship,
    decision, amended_relationship, reviewed_at, review_id. ``nodes``: analysis_id, model_run_id, node_id,
    node_kind, label, description.
    """
    latest = latest_review(reviews, ["analysis_id", "model_run_id", "edge_id"])
    confirmed = latest.where(confirms_contribution(F.col("decision"), F.col("original_relationship"), F.col("amended_relationship")))
    factor = nodes.where(F.col("node_kind") == "ContributingFactor").select(
        "analysis_id", "model_run_id", F.col("node_id").alias("source_node_id"),
        F.col("label").alias("factor_label"), F.col("description").alias("factor_description"),
    )
    target = nodes.select("analysis_id", "model_run_id", F.col("node_id").alias("target_node_id"), F.col("label").alias("target_label"))
    run = ["analysis_id", "model_run_id"]
    return (
        confirmed.join(factor, [*run, "source_node_id"])
        .join(target, [*run, "target_node_id"])
        .select(
            *run, F.col("review_id").alias("gate_review_id"), "edge_id", F.col("decision").alias("gate_decision"),
            F.col("source_node_id").alias("factor_node_id"), "factor_label", "factor_description", "target_node_id", "target_label",
        )
    )


def proposal_staleness(proposals: DataFrame, latest: DataFrame) -> DataFrame:
    """Whether the gate review of each proposal (proposal_id, edge_id, gate_review_id) is still the latest."""
    now = latest.select("edge_id", F.col("review_id").alias("latest_review_id"))
    current = ~_blank("gate_review_id") & F.coalesce(F.col("gate_review_id") == F.col("latest_review_id"), F.lit(False))
    return proposals.join(now, "edge_id", "left").withColumn("is_current", current)


def proposal_violations(
    proposals: DataFrame, citations: DataFrame, retrieved: DataFrame, corpus: DataFrame, reviews: DataFrame, nodes: DataFrame
) -> DataFrame:
    """(proposal_id, rule) of classification proposals without grounding, gate or provenance.

    ``proposals``: proposal_id, analysis_id, model_run_id, factor_node_id, edge_id, gate_review_id, status,
    proposed_label. ``citations`` and ``retrieved``: proposal_id, passage_id. ``corpus``: passage_id,
    passage_text. ``reviews``: as in ``gate1_eligible``. ``nodes``: node_id, analysis_id, model_run_id,
    node_kind.
    """
    cited = citations.select("proposal_id", "passage_id").distinct()
    offered = retrieved.select("proposal_id", "passage_id").distinct().withColumn("_offered", F.lit(True))
    texts = corpus.select("passage_id", F.lower("passage_text").alias("_text"))
    labels = proposals.select("proposal_id", F.lower(F.trim("proposed_label")).alias("_label"))
    # The label must occur in one of the cited texts; texts are tested one by one and never glued together.
    facts = (
        cited.join(offered, ["proposal_id", "passage_id"], "left")
        .join(texts, "passage_id", "left")
        .join(labels, "proposal_id")
        .groupBy("proposal_id")
        .agg(
            F.count(F.lit(1)).alias("_cited"),
            F.count_if(F.col("_offered").isNull()).alias("_outside"),
            F.count_if(F.col("_text").isNull()).alias("_unknown"),
            F.bool_or(F.coalesce(F.contains("_text", F.col("_label")), F.lit(False))).alias("_named"),
        )
    )
    gate = reviews.select(
        F.col("review_id").alias("gate_review_id"),
        confirms_contribution(F.col("decision"), F.col("original_relationship"), F.col("amended_relationship")).alias("_confirmed"),
    )
    now = latest_review(reviews, ["edge_id"]).select("edge_id", F.col("review_id").alias("_latest"))
    factor = nodes.select(
        F.col("node_id").alias("factor_node_id"), F.col("node_kind").alias("_kind"),
        F.col("analysis_id").alias("_analysis"), F.col("model_run_id").alias("_run"),
    )
    joined = (
        proposals.join(facts, "proposal_id", "left").join(gate, "gate_review_id", "left").join(now, "edge_id", "left").join(factor, "factor_node_id", "left")
    )
    n = F.coalesce("_cited", F.lit(0))
    empty = _upper("status") == "NO_GROUNDED_PROPOSAL"
    codes = violations(
        ("EMPTY_PROPOSAL_WITH_CONTENT", empty & (~_blank("proposed_label") | (n > 0))),
        ("GROUNDED_WITHOUT_LABEL", ~empty & _blank("proposed_label")),
        ("GROUNDED_WITHOUT_CITATION", ~empty & (n == 0)),
        ("CITATION_OUTSIDE_RETRIEVAL", ~empty & (F.coalesce("_outside", F.lit(0)) > 0)),
        ("UNKNOWN_PASSAGE", F.coalesce("_unknown", F.lit(0)) > 0),
        ("LABEL_NOT_IN_CITED_TEXT", ~empty & ~_blank("proposed_label") & (n > 0) & ~F.coalesce("_named", F.lit(False))),
        ("GATE_DOES_NOT_CONFIRM", ~F.coalesce("_confirmed", F.lit(False))),
        ("STALE_GATE_REVIEW", _differs(F.col("_latest"), F.col("gate_review_id"))),
        ("FACTOR_IS_NOT_CONTRIBUTING", _differs(F.col("_kind"), F.lit("ContributingFactor"))),
        ("FACTOR_OF_OTHER_ANALYSIS", _differs(F.col("_analysis"), F.col("analysis_id")) | _differs(F.col("_run"), F.col("model_run_id"))),
    )
    return joined.select("proposal_id", F.explode(codes).alias("rule"))


def mapping_violations(proposals: DataFrame, shortlist: DataFrame, registry: DataFrame, reviews: DataFrame) -> DataFrame:
    """(kind, id, rule) of taxonomy proposals and reviews outside their shortlist or the registry.

    ``proposals``: proposal_id, status, selected_code. ``shortlist``: proposal_id, code. ``registry``: code.
    ``reviews``: review_id, proposal_id, decision, status, amended_code.
    """
    listed = shortlist.select("proposal_id", "code").where(F.col("code").isNotNull()).distinct().withColumn("_listed", F.lit(True))
    known = checked_broadcast(registry.select("code").distinct()).withColumn("_known", F.lit(True))

    def located(df: DataFrame, column: str) -> DataFrame:
        with_code = df.withColumn("code", F.nullif(F.trim(column), F.lit("")))
        return with_code.join(listed, ["proposal_id", "code"], "left").join(known, "code", "left")

    selected = located(proposals, "selected_code")
    chosen = F.col("code").isNotNull() & (F.col("code") != NO_MAPPING)
    proposed = _upper("status") == "ASSISTANT_PROPOSED"
    proposal_codes = violations(
        ("PROPOSED_WITHOUT_CODE", proposed & F.col("code").isNull()),
        ("SELECTION_OUTSIDE_SHORTLIST", chosen & F.col("_listed").isNull()),
        ("SELECTION_OUTSIDE_REGISTRY", chosen & F.col("_known").isNull()),
    )
    amended = located(reviews, "amended_code").join(proposals.select("proposal_id", F.lit(True).alias("_proposal")), "proposal_id", "left")
    decision = _upper("decision")
    expected = F.when(F.lit(False), F.lit(""))
    for name, status in S.HUMAN_STATUS.items():
        expected = expected.when(decision == name, F.lit(status))
    is_amended = decision == "AMENDED"
    review_codes = violations(
        ("REVIEW_WITHOUT_PROPOSAL", F.col("_proposal").isNull()),
        ("UNSUPPORTED_DECISION", ~decision.isin(*S.HUMAN_STATUS)),
        ("STATUS_DOES_NOT_MATCH_DECISION", ~_blank("status") & (_upper("status") != expected)),
        ("AMENDED_WITHOUT_CODE", is_amended & F.col("code").isNull()),
        ("AMENDED_TO_NO_MAPPING", is_amended & (F.col("code") == NO_MAPPING)),
        ("AMENDMENT_OUTSIDE_SHORTLIST", is_amended & chosen & F.col("_listed").isNull()),
        ("AMENDMENT_OUTSIDE_REGISTRY", is_amended & chosen & F.col("_known").isNull()),
        ("AMENDMENT_WITHOUT_AMENDED", ~is_amended & F.col("code").isNotNull()),
    )
    a = selected.select(F.lit("proposal").alias("kind"), F.col("proposal_id").alias("id"), F.explode(proposal_codes).alias("rule"))
    b = amended.select(F.lit("review").alias("kind"), F.col("review_id").alias("id"), F.explode(review_codes).alias("rule"))
    return a.unionByName(b)


def label_review_violations(reviews: DataFrame) -> DataFrame:
    """(review_id, rule) of second-gate reviews (review_id, decision, status, proposed_label, amended_label)."""
    decision = _upper("decision")
    expected = F.when(F.lit(False), F.lit(""))
    for name, status in S.HUMAN_STATUS.items():
        expected = expected.when(decision == name, F.lit(status))
    codes = violations(
        ("UNSUPPORTED_DECISION", ~decision.isin(*S.HUMAN_STATUS)),
        ("STATUS_DOES_NOT_MATCH_DECISION", ~_blank("status") & (_upper("status") != expected)),
        ("REVIEW_WITHOUT_PROPOSED_LABEL", _blank("proposed_label")),
        ("AMENDED_WITHOUT_LABEL", (decision == "AMENDED") & _blank("amended_label")),
        ("LABEL_WITHOUT_AMENDED", (decision != "AMENDED") & ~_blank("amended_label")),
    )
    return reviews.select("review_id", F.explode(codes).alias("rule"))


def correction_violations(proposals: DataFrame, edges: DataFrame, citations: DataFrame, edge_citations: DataFrame, reviews: DataFrame) -> DataFrame:
    """(proposal_id, rule) of correction proposals that overreach or are linked wrongly.

    ``proposals``: proposal_id, analysis_id, model_run_id, edge_id, action, assistant_status,
    original_relationship, proposed_relationship, base_review_id, correction_review_id, correction_decision,
    authoritative_review_id, applied_decision, applied_relationship. ``edges``: edge_id, relationship.
    ``citations``: proposal_id, passage_id. ``edge_citations``: edge_id, passage_id. ``reviews``: review_id,
    edge_id, analysis_id, model_run_id, decision, amended_relationship, correction_proposal_id,
    correction_review_id, reviewed_at.
    """
    backed = edge_citations.select("edge_id", "passage_id").distinct().withColumn("_backed", F.lit(True))
    cited = (
        citations.select("proposal_id", "passage_id").distinct()
        .join(proposals.select("proposal_id", "edge_id"), "proposal_id")
        .join(backed, ["edge_id", "passage_id"], "left")
        .groupBy("proposal_id")
        .agg(F.count(F.lit(1)).alias("_cited"), F.count_if(F.col("_backed").isNull()).alias("_outside"))
    )
    graph = edges.select("edge_id", F.col("relationship").alias("_relationship"))
    now = latest_review(reviews, ["edge_id"]).select("edge_id", F.col("review_id").alias("_latest"))
    authority = reviews.select(
        F.col("review_id").alias("authoritative_review_id"),
        *[F.col(c).alias(f"_r_{c}") for c in ("edge_id", "analysis_id", "model_run_id", "decision", "amended_relationship", "correction_proposal_id", "correction_review_id")],
        F.lit(True).alias("_authority"),
    )
    joined = (
        proposals.join(cited, "proposal_id", "left").join(graph, "edge_id", "left").join(now, "edge_id", "left").join(authority, "authoritative_review_id", "left")
    )
    change = F.col("action") == "CHANGE_RELATIONSHIP"
    current = F.col("base_review_id").eqNullSafe(F.col("_latest"))
    reviewed = F.col("correction_review_id").isNotNull()
    applied = reviewed & F.col("correction_decision").isin(*CORRECTION_APPLIED)
    found = applied & F.col("_authority").isNotNull()
    provenance = _differs(F.col("_r_edge_id"), F.col("edge_id")) | _differs(F.col("_r_analysis_id"), F.col("analysis_id")) | _differs(F.col("_r_model_run_id"), F.col("model_run_id"))
    allowed = F.col("proposed_relationship").isin(*CORRECTION_RELATIONSHIPS)
    codes = violations(
        ("UNSUPPORTED_ACTION", ~F.coalesce(F.col("action").isin(*CORRECTION_ACTIONS), F.lit(False))),
        ("GRAPH_EDGE_WAS_OVERWRITTEN", _differs(F.col("_relationship"), F.col("original_relationship"))),
        ("EVIDENCE_OUTSIDE_EDGE", F.coalesce("_outside", F.lit(0)) > 0),
        ("ACTION_WITHOUT_EVIDENCE", (F.col("assistant_status") == "ASSISTANT_PROPOSED") & F.col("action").isin(*GROUNDED_ACTIONS) & (F.coalesce("_cited", F.lit(0)) == 0)),
        ("REPLACEMENT_NOT_ALLOWED", change & ~F.coalesce(allowed, F.lit(False))),
        ("REPLACEMENT_UNCHANGED", change & allowed & (F.col("proposed_relationship") == F.col("original_relationship"))),
        ("REPLACEMENT_WITHOUT_CHANGE", ~F.coalesce(change, F.lit(False)) & ~_blank("proposed_relationship")),
        ("UNREVIEWED_PROPOSAL_STALE", ~reviewed & ~current),
        ("UNSUPPORTED_CORRECTION_DECISION", reviewed & ~F.coalesce(F.col("correction_decision").isin("DISMISSED", *CORRECTION_APPLIED), F.lit(False))),
        ("DISMISSED_WITH_AUTHORITATIVE_REVIEW", reviewed & (F.col("correction_decision") == "DISMISSED") & F.col("authoritative_review_id").isNotNull()),
        ("APPLIED_WITHOUT_AUTHORITATIVE_REVIEW", applied & F.col("authoritative_review_id").isNull()),
        ("AUTHORITATIVE_REVIEW_NOT_FOUND", applied & F.col("authoritative_review_id").isNotNull() & F.col("_authority").isNull()),
        ("AUTHORITATIVE_PROVENANCE_DIFFERS", found & provenance),
        ("AUTHORITATIVE_NOT_LINKED_TO_PROPOSAL", found & _differs(F.col("_r_correction_proposal_id"), F.col("proposal_id"))),
        ("AUTHORITATIVE_NOT_LINKED_TO_CORRECTION", found & _differs(F.col("_r_correction_review_id"), F.col("correction_review_id"))),
        ("APPLIED_DECISION_DIFFERS", found & _differs(F.col("_r_decision"), F.col("applied_decision"))),
        ("APPLIED_RELATIONSHIP_DIFFERS", found & _differs(F.col("_r_amended_relationship"), F.col("applied_relationship"))),
    )
    return joined.select("proposal_id", F.explode(codes).alias("rule"))
