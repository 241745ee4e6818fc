"""All registered queries and their SQL oracles."""

from __future__ import annotations

from changegate.plans import bridging, diffing, publishing, scanning, scoring, testing, tracing

FLAGSHIP = "gate_decision"

_MODULES = (diffing, tracing, scoring, testing, bridging, scanning, publishing)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: text for module in _MODULES for name, text in module.ORACLES.items()}
