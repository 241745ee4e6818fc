"""The whole gate: from two snapshots and a catalog to one decision per run.

Stages whose rows have several readers are written once to the shared folder
(``cut_lineage``): later stages then start from files of known size, and a lost
executor costs at most the stage at hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegate.constants import EVIDENCE_FIELDS
from changegate.operators import diff, evidence, interface, lineage, merge, quality, score
from changegate.operators.skew import even_join
from changegate.policy import Policy
from changegate.session import cut_lineage


@dataclass(frozen=True)
class Catalog:
    """Catalog tables: datasets(urn), fields, edges, assets, owners, tags, assertions."""

    datasets: DataFrame
    fields: DataFrame
    edges: DataFrame
    assets: DataFrame
    owners: DataFrame
    tags: DataFrame
    assertions: DataFrame


@dataclass(frozen=True)
class Context:
    """What the catalog says about each change."""

    resolved: DataFrame
    impacted: DataFrame
    links: DataFrame
    states: DataFrame
    records: DataFrame


@dataclass(frozen=True)
class Bridge:
    """What was built to keep an old interface, and the evidence that it does.

    ``patched`` is the patched snapshot, in the columns of the other two; ``nodes`` and ``tests`` are of all three sides (see
    ``interface.interface_check``); ``results`` and ``expectations`` are those of the runs that tested the patched side (see
    ``quality.gate_run_results``).  All of them are required: without one, or without a run's rows in one, nothing is proven.
    """

    patched: DataFrame
    nodes: DataFrame | None = None
    tests: DataFrame | None = None
    results: DataFrame | None = None
    expectations: DataFrame | None = None


@dataclass(frozen=True)
class Proofs:
    """(run_key, proven, n_broken_rules, remediation_status) of every bridge in scope, and what the proven ones leave to be
    scored; ``missing`` names evidence that was required and absent."""

    proofs: DataFrame
    residual: DataFrame
    missing: DataFrame | None = None


@dataclass(frozen=True)
class Gate:
    decisions: DataFrame
    assessment: score.Assessment
    merged: merge.Merged
    state: DataFrame
    rejections: DataFrame


def resolve_changes(changes: DataFrame, catalog: Catalog) -> DataFrame:
    resolved = lineage.resolve_dataset(changes, catalog.datasets)
    checked = lineage.check_baseline(resolved, catalog.fields)
    # A change without a column to look up has no source to trace from.
    return checked.withColumn(
        "source_urn", F.when(F.col("checked_column").isNotNull(), F.col("source_urn"))
    ).withColumn("start_column", F.lower(F.coalesce("old_column", "new_column")))


def reach_columns(resolved: DataFrame, catalog: Catalog, max_hops: int | None = None) -> lineage.Reach:
    """Reach per distinct (dataset, column): changes of many runs share one trace."""
    sources = resolved.filter(F.col("source_urn").isNotNull()).select("source_urn", "start_column")
    return lineage.column_reach(sources, catalog.edges, max_hops)


def enrich_changes(resolved: DataFrame, columns: DataFrame, catalog: Catalog) -> DataFrame:
    reached = lineage.reached_assets(columns)
    per_change = resolved.select("run_key", "change_id", "source_urn", "start_column").join(
        reached, ["source_urn", "start_column"]
    )
    facts = lineage.asset_facts(catalog.assets, catalog.owners, catalog.tags)
    return lineage.enrich_assets(per_change, facts)


def link_changes(
    resolved: DataFrame, columns: DataFrame, enriched: DataFrame, assertions: DataFrame
) -> DataFrame:
    """Assertions on the changed datasets and on the reached ones."""
    sourced = resolved.filter(F.col("source_urn").isNotNull())
    own = sourced.select(
        "run_key", "change_id", F.col("source_urn").alias("dataset_urn"), F.lit(True).alias("has_columns")
    )
    reached = enriched.filter(F.col("asset_type") == "dataset").select(
        "run_key",
        "change_id",
        F.col("urn").alias("dataset_urn"),
        F.col("direct_column_lineage").alias("has_columns"),
    )
    own_columns = sourced.select(
        "run_key",
        "change_id",
        F.col("source_urn").alias("dataset_urn"),
        F.explode(F.array_compact(F.array("old_column", "new_column"))).alias("column"),
    )
    reached_columns = (
        columns.filter(F.col("column").isNotNull())
        .select("source_urn", "start_column", F.col("urn").alias("dataset_urn"), "column")
        .join(sourced.select("run_key", "change_id", "source_urn", "start_column"), ["source_urn", "start_column"])
        .select("run_key", "change_id", "dataset_urn", "column")
    )
    return lineage.link_assertions(
        own.unionByName(reached), own_columns.unionByName(reached_columns), assertions
    )


def collect_context(changes: DataFrame, catalog: Catalog, max_hops: int | None = None) -> Context:
    """Resolve, trace, enrich and link all changes of all runs together.

    Lineage is traced to its end unless ``max_hops`` bounds it; a change whose trace the bound cuts off has truncated
    lineage and traversal.
    """
    resolved = cut_lineage(resolve_changes(changes, catalog))
    reach = reach_columns(resolved, catalog, max_hops)  # already written hop by hop
    columns = reach.rows
    enriched = cut_lineage(enrich_changes(resolved, columns, catalog))
    ownership = cut_lineage(lineage.ownership_status(resolved, enriched))
    kept = lineage.drop_unavailable(enriched, ownership)
    links = cut_lineage(link_changes(resolved, columns, kept, catalog.assertions))
    names = catalog.assertions.select("assertion_urn", "name")
    sources = resolved.filter(F.col("source_urn").isNotNull()).select("run_key", "change_id", "source_urn")
    impacted = lineage.attach_assertions(kept, links).unionByName(
        lineage.assertion_assets(sources, links, names)
    )

    known = F.col("source_urn").isNotNull()
    states = (
        even_join(
            resolved.select("run_key", "change_id", "source_urn", "start_column", F.col("catalog_status").alias("catalog")),
            reach.truncated.withColumn("cut_off", F.lit(True)),
            ["source_urn", "start_column"],
            "left",
        )
        .join(ownership, lineage.CHANGE_KEY, "left")
        .join(lineage.assertion_status(resolved, links), lineage.CHANGE_KEY, "left")
    )
    missing = F.lit("missing")
    states = states.select(
        "run_key",
        "change_id",
        "source_urn",
        "catalog",
        # The whole edge table was read, so a trace that was not cut off is complete.
        *[F.when(known & F.col("cut_off"), "truncated").when(known, "complete").otherwise(missing).alias(f) for f in ("lineage", "traversal")],
        *[F.when(known, F.col(f)).otherwise(missing).alias(f) for f in ("ownership", "assertions")],
    )
    states = cut_lineage(states)
    return Context(resolved, impacted, links, states, context_records(states))


def context_records(states: DataFrame) -> DataFrame:
    """Critical evidence records of each change: the catalog read, then the rest if resolved."""
    parts = [
        F.when(
            F.lit(field == "catalog") | F.col("source_urn").isNotNull(),
            F.struct(
                F.concat(F.lit(f"evidence:{field}:"), F.col("change_id")).alias("id"),
                F.lit(field).alias("kind"),
                F.col(field).alias("status"),
                F.lit(True).alias("critical"),
            ),
        )
        for field in EVIDENCE_FIELDS
    ]
    return states.select("run_key", F.inline(F.array_compact(F.array(*parts))))


def link_members(context: Context) -> DataFrame:
    """Assertion lists of the impacted assets in long form."""
    linked = context.links.select(
        "run_key",
        "change_id",
        F.col("dataset_urn").alias("urn"),
        F.lit("assertion_urns").alias("fact"),
        F.col("assertion_urn").alias("member"),
    )
    own = context.impacted.filter(F.col("asset_type") == "assertion").select(
        "run_key", "change_id", "urn", F.lit("assertion_urns").alias("fact"), F.col("urn").alias("member")
    )
    sources = context.resolved.select("run_key", "change_id", F.col("source_urn").alias("urn"))
    return linked.join(sources, ["run_key", "change_id", "urn"], "left_anti").unionByName(own)


def merge_context(context: Context, staged: bool = True) -> merge.Merged:
    return merge.merge_assets(context.impacted, link_members(context), staged=staged)


def assess_context(context: Context, policy: Policy) -> Gate:
    merged = merge_context(context)
    state = merge.worst_status(context.states, merged.conflicts)
    records = evidence_records(context, merged)
    # Change ids are content hashes and assets were just grouped: both unique.
    assessment = score.assess(
        context.resolved, merged.assets, state, policy, records, check_duplicates=False
    )
    return Gate(assessment.runs, assessment, merged, state, assessment.reasons)


def evidence_records(context: Context, merged: merge.Merged) -> DataFrame:
    """Records of all changes and of conflicting facts, and an error for every id that stands for different contents."""
    records = context.records.unionByName(merge.conflict_records(merged.conflicts))
    return records.unionByName(merge.record_conflicts(records, ["kind", "status", "critical"]))


NODE_SCHEMA = ", ".join(f"{c} string" for c in ("run_key", "relation", "side", *interface.NODE_FACTS)) + ", tests_complete boolean"
TEST_SCHEMA = "run_key string, relation string, side string, test_sha256 string"
RESULT_SCHEMA = "run_key string, unique_id string, status string, message string"
EXPECTATION_SCHEMA = "run_key string, model string, test string, text string, downstream string"
# What a column promises besides its name, type and nullability, where a snapshot says so.
PROMISES = tuple(f for f in interface.CONTRACT_FIELDS if f not in ("column_name", "data_type", "nullable"))


def _three_sides(before: DataFrame, after: DataFrame, patched: DataFrame, scope: DataFrame) -> DataFrame:
    """The columns of the runs in scope on all sides, with the digest of everything that any side says they promise."""
    fields = ["run_key", "relation", "column_name", "data_type", "nullable", "ordinal", "expr_fingerprint"]
    sides = None
    for name, snapshot in zip(interface.SIDES, (before, after, patched), strict=True):
        side = snapshot.select(*fields, *[f for f in PROMISES if f in snapshot.columns]).withColumn("side", F.lit(name))
        sides = side if sides is None else sides.unionByName(side, allowMissingColumns=True)
    sides = even_join(sides, scope, ["run_key"], "left_semi")
    if "constraints" in sides.columns:
        sides = sides.withColumn("constraints", interface.constraint_digests(F.col("constraints")))
    return interface.column_contracts(sides, [f for f in interface.CONTRACT_FIELDS if f in sides.columns])


def prove_bridges(changes: DataFrame, before: DataFrame, after: DataFrame, bridge: Bridge) -> Proofs:
    """Was the patched side of a single rename tested, does it keep the old interface, and what else does it change?

    The snapshots have run_key, relation, column_name, data_type, nullable, ordinal and expr_fingerprint, and may have
    ``not_null``, ``quote``, ``constraints`` (texts) and ``tests_sha256``, which count as promised then.  Only runs that are
    exactly one rename, and for which something was built, are looked at.
    """
    spark = changes.sparkSession
    built = even_join(score.remediation_scope(changes), bridge.patched.select("run_key").distinct(), ["run_key"], "left_semi")
    scope = cut_lineage(built)
    renames = even_join(changes, scope, ["run_key"], "left_semi").select(
        "run_key", "relation", "old_column", "new_column", "new_type", "new_nullable"
    )
    columns = cut_lineage(_three_sides(before, after, bridge.patched, scope))

    def given(rows: DataFrame | None, schema: str) -> DataFrame:
        return spark.createDataFrame([], schema) if rows is None else even_join(rows, scope, ["run_key"], "left_semi")

    nodes, tests = given(bridge.nodes, NODE_SCHEMA), given(bridge.tests, TEST_SCHEMA)
    checks = interface.interface_check(columns, renames, nodes, tests)
    if bridge.tests is None:
        required = evidence.requirements(renames.select(*interface.RELATION_KEY).distinct(), (evidence.TESTS,))
        nothing = spark.createDataFrame([], "run_key string, relation string, evidence string, observed boolean")
        checks = checks.unionByName(evidence.evidence_check(required, nothing))
    checks = cut_lineage(checks)
    left = interface.residual_diff(columns)
    # A patched side that cannot be compared proves nothing, and a run without any rule is not proven.
    unclear = left.rejections.select("run_key", F.lit("comparable").alias("rule"), F.lit(False).alias("ok"))
    proofs = interface.interface_proof(checks.select("run_key", "rule", "ok").unionByName(unclear))
    verdicts = quality.gate_run_results(given(bridge.results, RESULT_SCHEMA), given(bridge.expectations, EXPECTATION_SCHEMA))
    outcomes = evidence.bridge_outcomes(scope, verdicts, proofs)
    outcomes = cut_lineage(outcomes.join(proofs.select("run_key", "n_broken_rules"), "run_key", "left"))
    proven = outcomes.filter("proven").select("run_key")
    residual = even_join(left.changes, proven, ["run_key"], "left_semi")
    return Proofs(outcomes, residual, evidence.missing_evidence(checks))


def run_gate(
    before: DataFrame,
    after: DataFrame,
    catalog: Catalog,
    policy: Policy | None = None,
    bridge: Bridge | None = None,
    max_hops: int | None = None,
) -> Gate:
    """Diff, context, score and final decision of every change set.

    ``bridge`` has what was built and tested for some runs; its proof, and the score of what it leaves, are derived here.  Only
    a run that is a single rename can have one.  Change sets that cannot be judged are shown as rejected
    and blocked; ``rejections`` says why.
    """
    policy = policy or Policy()
    found = diff.schema_diff(before, after)
    changes = cut_lineage(found.changes)
    context = collect_context(changes, catalog, max_hops)
    gate = assess_context(context, policy)
    proofs = None if bridge is None else prove_bridges(changes, before, after, bridge)
    records = evidence_records(context, gate.merged)
    decisions = decide(gate.decisions, changes, context, gate.state, policy, proofs, records)
    return Gate(with_rejected(decisions, found.rejections), gate.assessment, gate.merged, gate.state, found.rejections)


def with_rejected(decisions: DataFrame, rejections: DataFrame) -> DataFrame:
    """One row per rejected change set besides the judged ones: nothing is known of it, so it is blocked."""
    rejected = rejections.select("run_key").distinct().select(
        "run_key",
        F.lit("UNSUPPORTED").alias("remediation_status"),
        F.lit("BLOCK").alias("final_decision"),
        F.lit("REJECTED").alias("status"),
        F.lit(False).alias("passing"),
    )
    return decisions.unionByName(rejected, allowMissingColumns=True)


def decide(
    runs: DataFrame,
    changes: DataFrame,
    context: Context,
    state: DataFrame,
    policy: Policy,
    proofs: Proofs | None = None,
    records: DataFrame | None = None,
) -> DataFrame:
    """Final decision and status per run, with the residual score of proven bridges.

    What a bridge leaves is judged on the same evidence as the change itself, its records included.
    """
    scope = score.remediation_scope(changes)
    if proofs is None:
        nothing = scope.filter(F.lit(False)).select("run_key", F.lit(False).alias("proven"), F.lit("").alias("remediation_status"))
        proofs = Proofs(nothing, changes.filter(F.lit(False)))
    tested = scope.join(proofs.proofs.select("run_key", "proven", "remediation_status"), "run_key", "left").select(
        "run_key",
        F.coalesce("remediation_status", F.lit("GENERATED")).alias("remediation_status"),
        F.coalesce("proven", F.lit(False)).alias("proven"),
    )
    residual = proofs.residual
    if records is not None:
        records = even_join(records, residual.select("run_key").distinct(), ["run_key"], "left_semi")
    rescored = score.residual_assess(residual, context.impacted, state, policy, records).select(
        "run_key",
        F.col("score").alias("residual_score"),
        F.col("decision").alias("residual_decision"),
        F.col("n_override_reasons").alias("residual_override_reasons"),
    )
    joined = (
        runs.join(tested, "run_key", "left")
        .join(rescored, "run_key", "left")
        .withColumn("remediation_status", F.coalesce("remediation_status", F.lit("UNSUPPORTED")))
        .withColumn("counterfactual_verified", F.coalesce("proven", F.lit(False)))
        .withColumn("interface_preserved", F.coalesce("proven", F.lit(False)))
        .withColumn(
            "counterfactual_condition",
            F.when(F.col("proven") & F.col("residual_score").isNull(), "NO_RESIDUAL_CHANGES").when(F.col("proven"), "RESIDUAL_CHANGES"),
        )
        .withColumn("publish_state", F.lit("NOT_REQUESTED"))
    )
    final = joined.withColumn("final_decision", score.gate_decision()).withColumn("status", score.run_status())
    return final.withColumn("passing", score.is_passing()).select(
        "run_key",
        "score",
        "score_decision",
        "decision",
        "score_basis_asset_urn",
        "worst_change_id",
        "severity_key",
        "n_changes",
        "n_assets",
        "n_override_reasons",
        "remediation_status",
        "residual_score",
        "final_decision",
        "status",
        "passing",
    )
