"""Vocabularies and table schemas. All values here are fixed values."""


NODE_KINDS = (
    "Event", "ContributingFactor", "Finding", "SafetyIssue", "Recommendation", "Actor", "Vessel", "System", "Claim",
)
RELATIONSHIPS = ("FOLLOWED_BY", "CONTRIBUTED_TO", "RESULTED_IN", "AFFECTED", "SUPPORTS", "INVOLVED_IN")
EVIDENCE_CLASSES = ("DIRECT", "NORMALISED", "INFERRED", "SYNTHESISED", "INSUFFICIENT_EVIDENCE")
CHRONOLOGY_RELATIONSHIPS = ("FOLLOWED_BY",)
CAUSAL_RELATIONSHIPS = ("CAUSED", "CAUSED_BY", "CONTRIBUTED_TO", "LED_TO")
STRUCTURAL_RELATIONSHIPS = (
    "INVOLVED_IN", "HAS_SOURCE", "HAS_MODEL_RUN", "HAS_QUESTION_RUN", "HAS_MODEL_ANSWER", "HAS_REVIEW",
)
HUMAN_STATUS = {"VALIDATED": "HUMAN_VALIDATED", "REJECTED": "HUMAN_REJECTED", "AMENDED": "HUMAN_AMENDED"}
INFORMATION_CLASSES = ("A", "B", "C", "D")
SCOPE_MODES = ("WHOLE_CASE", "ONE_DOCUMENT", "SELECTED_DOCUMENTS")
TIMELINE_PHASES = (
    "PRE_ACCIDENT", "ACCIDENT_INITIATION", "ESCALATION", "EMERGENCY_RESPONSE", "ABANDONMENT_RESCUE",
    "POST_OCCURRENCE", "INVESTIGATION", "UNASSIGNED",
)
TIME_BASES = ("ABSOLUTE", "RELATIVE_AUDIO", "ORDER_ONLY")
ABSOLUTE_PRECISIONS = ("EXACT", "MINUTE", "APPROXIMATE", "RANGE", "DATE_ONLY")
RELATIVE_PRECISIONS = ("RELATIVE_AUDIO", "APPROXIMATE", "RANGE")
FOCUS_WEIGHTS = {"ContributingFactor": 5, "SafetyIssue": 4, "Event": 3, "Finding": 2, "System": 1}
# Order in which focus concepts of equal label are preferred.
FOCUS_ORDER = ("ContributingFactor", "SafetyIssue", "Event", "Finding", "System")
TRACKED_KINDS = ("Event", "ContributingFactor", "Finding", "SafetyIssue", "Recommendation")

# The owner of published canonical sources, the owner of everything else, and the owners that never expire.
CANONICAL_OWNER = "CANONICAL"
LOCAL_OWNER = "LOCAL"
TAXONOMY_OWNER = "TAXONOMY"
REFERENCE_OWNER = "REFERENCE_CONTEXT"
PERSISTENT_OWNERS = (CANONICAL_OWNER, TAXONOMY_OWNER, REFERENCE_OWNER)
PERSISTENT_ROLES = ("RESERVED_TAXONOMY", "REFERENCE_CONTEXT")
DERIVATIVE = "PSEUDONYMISED_DERIVATIVE"
