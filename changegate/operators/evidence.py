"""What must have been observed before a result counts as proven.

Requirements are a table of (run_key, relation, evidence).  They are joined from their own side to what was observed, so
evidence that is absent is a row that says no, never a row that is missing: a proof over such rows fails closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELATION_KEY = ["run_key", "relation"]
COLUMNS, NODES, TESTS = "columns", "nodes", "tests"

# Outcomes of a bridge.
TESTED, TEST_FAILED, VERIFICATION_ERROR = "TESTED", "TEST_FAILED", "VERIFICATION_ERROR"


def requirements(relations: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(run_key, relation, evidence): every kind for every relation."""
    return relations.select(*RELATION_KEY, F.explode(F.array(*map(F.lit, kinds))).alias("evidence"))


def sides_observed(rows: DataFrame, kind: str, sides: tuple[str, ...], one_row: bool = False) -> DataFrame:
    """(run_key, relation, evidence, observed): whether ``rows`` show a relation on all sides, with one row each if asked."""
    seen = [F.count_if(F.col("side") == s) for s in sides]
    whole = F.lit(True)
    for n in seen:
        whole = whole & ((n == 1) if one_row else (n > 0))
    return rows.groupBy(*RELATION_KEY).agg(whole.alias("observed")).select(*RELATION_KEY, F.lit(kind).alias("evidence"), "observed")


def evidence_check(required: DataFrame, observed: DataFrame) -> DataFrame:
    """One rule per requirement: (run_key, relation, rule, ok); what was not observed is not ok."""
    met = required.join(observed, [*RELATION_KEY, "evidence"], "left")
    return met.select(
        *RELATION_KEY, F.concat(F.lit("evidence_"), "evidence").alias("rule"), F.coalesce("observed", F.lit(False)).alias("ok")
    )


def missing_evidence(checks: DataFrame) -> DataFrame:
    """(run_key, relation, evidence) that was required and not observed."""
    absent = checks.filter(F.startswith("rule", F.lit("evidence_")) & ~F.col("ok"))
    return absent.select(*RELATION_KEY, F.substring_index("rule", "evidence_", -1).alias("evidence"))


def bridge_outcomes(built: DataFrame, verdicts: DataFrame, proofs: DataFrame) -> DataFrame:
    """(run_key, proven, remediation_status) of every built bridge.

    ``built``: run_key.  ``verdicts`` (run_key, clean, verified) are those of ``quality.gate_run_results``; ``proofs`` have
    run_key and proven.  A run without results was not tested, one with a failed test is told apart from one whose model or
    compatibility test was not seen to succeed, and only what was tested and proven is ``TESTED``.
    """
    facts = built.select("run_key").join(verdicts.select("run_key", "clean", "verified"), "run_key", "left")
    facts = facts.join(proofs.select("run_key", "proven"), "run_key", "left")
    passed = F.coalesce(F.col("clean") & F.col("verified"), F.lit(False))
    proven = F.coalesce("proven", F.lit(False)) & passed
    status = F.when(~F.col("clean"), TEST_FAILED).when(proven, TESTED).otherwise(VERIFICATION_ERROR)
    return facts.select("run_key", proven.alias("proven"), status.alias("remediation_status"))
