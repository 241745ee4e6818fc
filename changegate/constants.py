"""Enumerations and ranks shared by all operators."""

# Change types, in canonical output order.
GENERIC_CHANGE_TYPES = (
    "rename_column",
    "drop_column",
    "add_column",
    "type_change",
    "nullability_change",
)
SPECIFIC_CHANGE_TYPES = (
    "incompatible_type",
    "widening_type",
    "nullable_to_required",
    "add_required_column",
    "add_nullable_column",
)
CHANGE_TYPE_ALIASES = {
    "add": "add_column",
    "drop": "drop_column",
    "rename": "rename_column",
    "type": "type_change",
    "nullability": "nullability_change",
}
ADDITIVE_TYPES = ("add_column", "add_required_column", "add_nullable_column")
TYPE_CHANGE_TYPES = ("type_change", "incompatible_type", "widening_type")
NULLABILITY_TYPES = ("nullability_change", "nullable_to_required")

# Evidence status and its "worst of" rank.
STATUS_RANK = {
    "complete": 0,
    "missing": 1,
    "truncated": 2,
    "ambiguous": 3,
    "stale": 4,
    "unavailable": 5,
    "error": 6,
}
EVIDENCE_FIELDS = ("catalog", "lineage", "traversal", "ownership", "assertions")

# Asset type and its risk rank.
ASSET_TYPE_RANK = {
    "other": 0,
    "dataset": 1,
    "data_flow": 2,
    "data_job": 3,
    "chart": 4,
    "dashboard": 5,
    "assertion": 6,
}
# Entity name prefix to asset type.
ASSET_TYPE_PREFIXES = {
    "urn:li:dataset:": "dataset",
    "urn:li:dashboard:": "dashboard",
    "urn:li:chart:": "chart",
    "urn:li:dataJob:": "data_job",
    "urn:li:dataFlow:": "data_flow",
    "urn:li:assertion:": "assertion",
}

GATE_DECISIONS = ("PASS", "PASS_WITH_REMEDIATION", "REVIEW", "BLOCK")

# Facts compared when one asset is reported by several changes,
# with the record kind and the evidence field a disagreement makes ambiguous.
CONFLICT_FACTS = (
    ("asset_type", "asset_type", "catalog"),
    ("hop_count", "traversal", "traversal"),
    ("owners", "ownership", "ownership"),
    ("assertion_urns", "assertion", "assertions"),
    ("critical_asset", "criticality", "catalog"),
    ("sensitive_data", "sensitivity", "catalog"),
    ("direct_column_lineage", "lineage", "lineage"),
    ("recent_query_usage_score", "usage", "catalog"),
)
