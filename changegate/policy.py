"""The fixed scoring policy, validated once on the driver and used as literals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points per class of change.
SEVERITY_POINTS = {
    "drop_column": 45,
    "incompatible_type": 40,
    "rename_column": 35,
    "nullable_to_required": 30,
    "widening_type": 15,
    "add_required_column": 12,
    "add_nullable_column": 2,
}
# Points per signal of an impacted asset.
SIGNAL_POINTS = {
    "assertion_contract": 25,
    "critical_asset": 15,
    "dashboard_or_chart": 15,
    "data_job_or_flow": 12,
    "sensitive_data": 10,
    "direct_column_lineage": 10,
    "missing_owner": 5,
    "max_recent_query_usage": 10,
}
BREADTH_FORMULA = "round_half_up_log2_one_plus_assets"
PASS_MAX = 24
REVIEW_MAX = 59
MAXIMUM_SCORE = 100


class PolicyError(ValueError):
    """The policy is incomplete, has unknown keys or breaks the public contract."""


@dataclass(frozen=True)
class Policy:
    version: str = "1.0.0"
    severity: Mapping[str, int] = field(default_factory=lambda: dict(SEVERITY_POINTS))
    signals: Mapping[str, int] = field(default_factory=lambda: dict(SIGNAL_POINTS))
    breadth_multiplier: int = 3
    breadth_maximum: int = 15
    hop_penalty: int = 4

    def __post_init__(self) -> None:
        if not isinstance(self.version, str) or not self.version:
            raise PolicyError("version must be a non-empty text")
        for name, wanted in (("severity", SEVERITY_POINTS), ("signals", SIGNAL_POINTS)):
            if set(getattr(self, name)) != set(wanted):
                raise PolicyError(f"{name} must have exactly the keys {sorted(wanted)}")
        numbers = [*self.severity.values(), *self.signals.values()]
        numbers += [self.breadth_multiplier, self.breadth_maximum, self.hop_penalty]
        if any(isinstance(n, bool) or not isinstance(n, int) or n < 0 for n in numbers):
            raise PolicyError("weights must be non-negative whole numbers")
        capped = [*self.severity.values(), *self.signals.values(), self.breadth_maximum]
        if max(capped) > MAXIMUM_SCORE:
            raise PolicyError("no weight may exceed the maximum score")

    def severity_points(self, key: Column) -> Column:
        pairs = [F.lit(x) for pair in self.severity.items() for x in pair]
        return F.try_element_at(F.create_map(*pairs), key)

    def breadth_points(self, n_assets: Column) -> Column:
        """Logarithmic fan-out bonus; exact halves cannot occur."""
        grown = F.round(self.breadth_multiplier * F.log2(F.lit(1.0) + n_assets)).cast("int")
        return F.least(F.lit(self.breadth_maximum), grown)

    def clamp(self, points: Column) -> Column:
        return F.greatest(F.lit(0), F.least(points, F.lit(MAXIMUM_SCORE)))

    def decision(self, score: Column) -> Column:
        return F.when(score <= PASS_MAX, "PASS").when(score <= REVIEW_MAX, "REVIEW").otherwise("BLOCK")


def policy_from_mapping(payload: Mapping) -> Policy:
    """Validate the nested layout of a policy file; unknown keys are errors."""
    layout = {"version", "thresholds", "change_severity", "signals", "breadth", "hop_penalty", "maximum_score"}
    if not isinstance(payload, Mapping) or set(payload) != layout:
        raise PolicyError(f"policy must have exactly the keys {sorted(layout)}")
    if dict(payload["thresholds"]) != {"pass_max": PASS_MAX, "review_max": REVIEW_MAX}:
        raise PolicyError(f"thresholds must be {PASS_MAX} and {REVIEW_MAX}")
    if payload["maximum_score"] != MAXIMUM_SCORE:
        raise PolicyError(f"maximum_score must be {MAXIMUM_SCORE}")
    breadth = dict(payload["breadth"])
    if breadth.pop("formula", BREADTH_FORMULA) != BREADTH_FORMULA or set(breadth) != {"multiplier", "maximum"}:
        raise PolicyError("breadth needs multiplier and maximum and has one fixed formula")
    return Policy(
        version=payload["version"],
        severity=dict(payload["change_severity"]),
        signals=dict(payload["signals"]),
        breadth_multiplier=breadth["multiplier"],
        breadth_maximum=breadth["maximum"],
        hop_penalty=payload["hop_penalty"],
    )


def load_policy(path: str | Path) -> Policy:
    """Read a YAML (or JSON) policy file of a few lines on the driver."""
    import json

    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        payload = yaml.safe_load(text)
    except ImportError:
        try:
            payload = json.loads(text)
        except json.JSONDecodeError as exc:
            raise PolicyError("no YAML reader is installed; give the policy as JSON") from exc
    return policy_from_mapping(payload)
