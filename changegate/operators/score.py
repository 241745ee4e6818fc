"""Risk scoring and decisions, one result per change set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegate.constants import EVIDENCE_FIELDS
from changegate.operators.diff import duplicates, severity_key
from changegate.operators.skew import even_join, exclude_runs
from changegate.policy import Policy


def worst_change(changes: DataFrame, policy: Policy) -> DataFrame:
    """The change with most severity points per run; ties go to the smallest id."""
    key = severity_key()
    ranked = F.struct(
        (-policy.severity_points(key)).alias("rank"),
        F.col("change_id").alias("change_id"),
        key.alias("severity_key"),
    )
    return (
        changes.groupBy("run_key")
        .agg(F.min(ranked).alias("worst"), F.count(F.lit(1)).alias("n_changes"))
        .select(
            "run_key",
            F.col("worst.change_id").alias("worst_change_id"),
            F.col("worst.severity_key").alias("severity_key"),
            (-F.col("worst.rank")).alias("severity_points"),
            "n_changes",
        )
    )


def with_fact_states(assets: DataFrame) -> DataFrame:
    """Three-valued ``has_owners`` and ``has_assertions`` from the list columns.

    Null means not established, false means established as empty.
    """
    out = assets
    for flag, values in (("has_owners", "owners"), ("has_assertions", "assertion_urns")):
        if flag not in out.columns:
            out = out.withColumn(flag, F.when(F.col(values).isNotNull(), F.size(values) > 0))
    if "recent_query_usage_score" not in out.columns:
        out = out.withColumn("recent_query_usage_score", F.lit(None).cast("int"))
    return out


def _signals(policy: Policy) -> list[Column]:
    """One nullable (category, key, points) entry per rule of an asset."""
    p = policy.signals
    kind = F.col("asset_type")
    rules = [
        ("signal", "assertion_contract", F.col("has_assertions"), F.lit(p["assertion_contract"])),
        ("signal", "critical_asset", F.col("critical_asset"), F.lit(p["critical_asset"])),
        ("signal", "dashboard_or_chart", kind.isin("dashboard", "chart"), F.lit(p["dashboard_or_chart"])),
        ("signal", "data_job_or_flow", kind.isin("data_job", "data_flow"), F.lit(p["data_job_or_flow"])),
        ("signal", "sensitive_data", F.col("sensitive_data"), F.lit(p["sensitive_data"])),
        (
            "signal",
            "direct_column_lineage",
            F.col("direct_column_lineage"),
            F.lit(p["direct_column_lineage"]),
        ),
        ("signal", "missing_owner", ~F.col("has_owners"), F.lit(p["missing_owner"])),
        (
            "signal",
            "recent_query_usage",
            F.col("recent_query_usage_score") > 0,
            F.least(F.col("recent_query_usage_score"), F.lit(p["max_recent_query_usage"])),
        ),
        (
            "hop_penalty",
            "downstream_hops",
            F.col("hop_count") > 1,
            F.lit(-policy.hop_penalty) * (F.col("hop_count") - 1),
        ),
    ]
    return [
        F.when(
            cond & (points != 0),
            F.struct(F.lit(cat).alias("category"), F.lit(key).alias("key"), points.cast("int").alias("points")),
        )
        for cat, key, cond, points in rules
    ]


def score_assets(assets: DataFrame, worst: DataFrame, policy: Policy) -> DataFrame:
    """Score of every impacted asset, computed row by row.

    All points of an asset come from its own row and its run's worst change, so
    the only data movement is the join with that one row per run.
    """
    joined = even_join(with_fact_states(assets), worst, ["run_key"], "inner")
    severity = F.struct(
        F.lit("severity").alias("category"),
        F.col("severity_key").alias("key"),
        F.col("severity_points").alias("points"),
    )
    parts = F.array_compact(F.array(severity, *_signals(policy)))
    raw = F.aggregate(F.col("parts"), F.lit(0), lambda acc, x: acc + x["points"])
    return (
        joined.withColumn("parts", parts)
        .withColumn("raw_score", raw)
        .withColumn("score", policy.clamp(F.col("raw_score")))
    )


# Why each kind of points is given, by key.
EXPLANATIONS = {
    "assertion_contract": "an assertion depends on the asset",
    "critical_asset": "the asset is marked critical",
    "dashboard_or_chart": "people look at the asset",
    "data_job_or_flow": "a job or flow runs on the asset",
    "sensitive_data": "the asset is marked sensitive",
    "direct_column_lineage": "a changed column is known to reach the asset",
    "missing_owner": "ownership was looked up and nobody owns the asset",
    "recent_query_usage": "recent queries use the asset, counted up to the policy's limit",
    "asset_score_range": "the sum was moved into the range of scores",
}


def explanation(category: Column, key: Column, points: Column, policy_penalty: int) -> Column:
    """One sentence for a contribution; severities and hops are told with their numbers."""
    told = F.when(category == "severity", F.concat(F.lit("the worst change of the set is of class "), key))
    if policy_penalty:
        hops = (-points / policy_penalty).cast("int")
        told = told.when(key == "downstream_hops", F.concat(hops.cast("string"), F.lit(f" more hops at {policy_penalty} points each")))
    for name, text in EXPLANATIONS.items():
        told = told.when(key == name, text)
    return told


def contribution_evidence(contributions: DataFrame, changes: DataFrame, members: DataFrame) -> DataFrame:
    """What each contribution rests on: (run_key, asset_urn, key, evidence_ref), in long form.

    A severity rests on the evidence of the worst change, everything else on the merged evidence of the asset (``members``
    of the merge, by the fact ``evidence_refs``).  No list is gathered, so an asset may have any number of references.
    """
    of_change = changes.select("run_key", "change_id", F.explode("evidence_refs").alias("evidence_ref"))
    of_asset = members.filter(F.col("fact") == "evidence_refs").select(
        "run_key", F.col("urn").alias("asset_urn"), F.col("member").alias("evidence_ref")
    )
    shown = ["run_key", "asset_urn", "key", "evidence_ref"]
    severe = contributions.filter(F.col("category") == "severity")
    other = contributions.filter(~F.col("category").isin("severity", "clamp"))
    return (
        even_join(severe, of_change, ["run_key", "change_id"], "inner").select(*shown)
        .unionByName(even_join(other, of_asset, ["run_key", "asset_urn"], "inner").select(*shown))
        .distinct()
    )


def asset_contributions(scored: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Long form of the points of each asset and why, with a clamp row where it applied."""
    clamp = F.when(
        F.col("score") != F.col("raw_score"),
        F.struct(
            F.lit("clamp").alias("category"),
            F.lit("asset_score_range").alias("key"),
            (F.col("score") - F.col("raw_score")).alias("points"),
        ),
    )
    every = F.array_compact(F.array_append(F.col("parts"), clamp))
    return scored.select(
        "run_key", F.col("urn").alias("asset_urn"), "worst_change_id", F.explode(every).alias("part")
    ).select(
        "run_key",
        "asset_urn",
        F.when(F.col("part.category") == "severity", F.col("worst_change_id")).alias("change_id"),
        "part.category",
        "part.key",
        "part.points",
        explanation(F.col("part.category"), F.col("part.key"), F.col("part.points"), (policy or Policy()).hop_penalty).alias(
            "explanation"
        ),
    )


def asset_score(contributions: DataFrame, policy: Policy) -> DataFrame:
    """Clamped sum of points per asset, from the long form."""
    return (
        contributions.filter(F.col("category") != "clamp")
        .groupBy("run_key", "asset_urn")
        .agg(F.sum("points").cast("int").alias("raw_score"))
        .withColumn("score", policy.clamp(F.col("raw_score")))
    )


def score_basis(scored: DataFrame, worst: DataFrame | None = None) -> DataFrame:
    """Highest asset score per run, ties to the smallest name, and the asset count.

    ``score_assets`` has no row for a run that impacts nothing.  With ``worst`` such a run is there too, and its base is the
    points of its worst change; who joins the result with the worst changes needs none.
    """
    best = F.min(F.struct((-F.col("score")).alias("rank"), F.col("urn").alias("urn")))
    found = scored.groupBy("run_key").agg(best.alias("best"), F.count(F.lit(1)).alias("n_assets"))
    base, n_assets = -F.col("best.rank"), F.col("n_assets")
    if worst is not None:
        found = worst.select("run_key", "severity_points").join(found, "run_key", "left")
        base, n_assets = F.coalesce(base, "severity_points"), F.coalesce(n_assets, F.lit(0)).cast("bigint")
    return found.select(
        "run_key", F.col("best.urn").alias("score_basis_asset_urn"), base.alias("asset_base"), n_assets.alias("n_assets")
    )


def breadth(assets: DataFrame, policy: Policy) -> DataFrame:
    """Bonus points for the number of impacted assets of a run."""
    return (
        assets.groupBy("run_key")
        .agg(F.count(F.lit(1)).alias("n_assets"))
        .withColumn("breadth_points", policy.breadth_points(F.col("n_assets")))
    )


def evidence_state_of(df: DataFrame) -> DataFrame:
    """A state that says nothing counts as missing."""
    return df.select("run_key", *[F.coalesce(f, F.lit("missing")).alias(f) for f in EVIDENCE_FIELDS])


def override_reasons(
    changes: DataFrame,
    assets: DataFrame,
    state: DataFrame,
    records: DataFrame | None = None,
) -> DataFrame:
    """Distinct reason codes per run, in long form: a run may have any number.

    ``records`` are evidence records (run_key, id, status, critical) of the
    state, of the changes and of the assets.
    """
    status = F.array(
        *[
            F.when(
                F.col(f) != "complete",
                F.concat(F.lit(f"critical_evidence.{f}."), F.col(f)),
            )
            for f in EVIDENCE_FIELDS
        ]
    )
    from_state = evidence_state_of(state).select("run_key", F.explode(F.array_compact(status)).alias("reason"))

    def change_reason(condition: Column, suffix: str) -> Column:
        return F.when(
            condition, F.concat(F.lit("schema_change."), F.col("change_id"), F.lit(f".{suffix}"))
        )

    found = F.array(
        change_reason(F.col("confidence") == "low", "low_confidence"),
        change_reason(
            (F.col("change_type") == "add_column") & F.col("new_nullable").isNull(), "requiredness_missing"
        ),
        change_reason(F.col("change_type") == "type_change", "type_compatibility_ambiguous"),
    )
    from_changes = changes.select("run_key", F.explode(F.array_compact(found)).alias("reason"))

    known = evidence_state_of(state).select("run_key", "ownership", "assertions")
    open_assets = with_fact_states(assets).filter(
        F.col("has_owners").isNull() | F.col("has_assertions").isNull()
    )
    joined = even_join(
        open_assets.select("run_key", "urn", "has_owners", "has_assertions"), known, ["run_key"], "inner"
    )

    def asset_reason(condition: Column, suffix: str) -> Column:
        return F.when(condition, F.concat(F.lit("impacted_asset."), F.col("urn"), F.lit(f".{suffix}")))

    gaps = F.array(
        asset_reason((F.col("ownership") == "complete") & F.col("has_owners").isNull(), "ownership_missing"),
        asset_reason(
            (F.col("assertions") == "complete") & F.col("has_assertions").isNull(),
            "assertion_evidence_missing",
        ),
    )
    from_assets = joined.select("run_key", F.explode(F.array_compact(gaps)).alias("reason"))
    reasons = from_state.unionByName(from_changes).unionByName(from_assets)
    if records is not None:
        # Only records can repeat a reason, so only they are made distinct.
        weak = records.filter(F.col("critical") & (F.col("status") != "complete"))
        reasons = reasons.unionByName(
            weak.select(
                "run_key", F.concat_ws(".", F.lit("critical_record"), "id", "status").alias("reason")
            ).distinct()
        )
    return reasons


@dataclass(frozen=True)
class Assessment:
    runs: DataFrame
    reasons: DataFrame
    scored: DataFrame
    rejections: DataFrame


def assess(
    changes: DataFrame,
    assets: DataFrame,
    state: DataFrame,
    policy: Policy,
    records: DataFrame | None = None,
    check_duplicates: bool = True,
) -> Assessment:
    """Score, threshold decision and evidence-raised decision of every run.

    ``check_duplicates`` rejects runs whose change ids or asset names repeat; a
    caller whose inputs are unique by construction can save those shuffles.
    """
    rejections = None
    if check_duplicates:
        rejections = duplicates(changes, ["run_key", "change_id"], "duplicate_change_id").unionByName(
            duplicates(assets, ["run_key", "urn"], "duplicate_asset_urn")
        )
        changes = exclude_runs(changes, rejections)
        assets = exclude_runs(assets, rejections)
    worst = worst_change(changes, policy)
    scored = score_assets(assets, worst, policy)
    basis = score_basis(scored)
    # A run without any evidence state misses all of it.
    state = worst.select("run_key").join(state, "run_key", "left")
    reasons = override_reasons(changes, assets, state, records)
    counted = reasons.groupBy("run_key").agg(F.count(F.lit(1)).alias("n_override_reasons"))
    runs = worst.join(basis, "run_key", "left").join(counted, "run_key", "left")
    n_assets = F.coalesce("n_assets", F.lit(0)).cast("bigint")
    n_reasons = F.coalesce("n_override_reasons", F.lit(0)).cast("bigint")
    bonus = policy.breadth_points(n_assets)
    score = policy.clamp(F.coalesce("asset_base", "severity_points") + bonus)
    runs = runs.select(
        "run_key",
        score.alias("score"),
        "score_basis_asset_urn",
        "worst_change_id",
        "severity_key",
        "severity_points",
        bonus.alias("breadth_points"),
        "n_changes",
        n_assets.alias("n_assets"),
        n_reasons.alias("n_override_reasons"),
        F.lit(policy.version).alias("policy_version"),
    )
    return Assessment(risk_decision(runs, policy), reasons, scored, rejections)


def risk_decision(runs: DataFrame, policy: Policy) -> DataFrame:
    """Threshold decision, raised to at least REVIEW by any override reason."""
    by_score = policy.decision(F.col("score"))
    raised = F.when((F.col("n_override_reasons") > 0) & (by_score == "PASS"), "REVIEW").otherwise(by_score)
    return runs.withColumn("score_decision", by_score).withColumn("decision", raised)


def residual_assess(
    residual_changes: DataFrame,
    assets_like: DataFrame,
    state: DataFrame,
    policy: Policy,
    records: DataFrame | None = None,
) -> DataFrame:
    """Rescore what remains after a proven bridge: no assets, same evidence."""
    empty = assets_like.filter(F.lit(False))
    return assess(residual_changes, empty, state, policy, records, check_duplicates=False).runs


def gate_decision() -> Column:
    """Final decision from the columns of a joined assessment, residual and proof.

    Expects n_override_reasons, decision, remediation_status,
    counterfactual_verified, interface_preserved, counterfactual_condition and
    residual_decision (null when there is no residual assessment).
    """
    proven = (
        (F.col("n_override_reasons") == 0)
        & (F.col("remediation_status") == "TESTED")
        & F.col("counterfactual_verified")
        & F.col("interface_preserved")
    )
    nothing_left = F.col("residual_decision").isNull() & (
        F.col("counterfactual_condition") == "NO_RESIDUAL_CHANGES"
    )
    clean = proven & ((F.col("residual_decision") == "PASS") | nothing_left)
    return F.when(clean, "PASS_WITH_REMEDIATION").otherwise(F.col("decision"))


def run_status() -> Column:
    """INCOMPLETE while evidence, verification or publication is open."""
    open_points = (
        (F.col("n_override_reasons") > 0)
        | (F.coalesce("residual_override_reasons", F.lit(0)) > 0)
        | F.col("remediation_status").eqNullSafe("VERIFICATION_ERROR")
        | F.col("publish_state").eqNullSafe("WRITEBACK_PENDING")
    )
    return F.when(open_points, "INCOMPLETE").otherwise("COMPLETE")


def is_passing(require_publish: bool = False) -> Column:
    passes = F.col("final_decision").isin("PASS", "PASS_WITH_REMEDIATION") & (F.col("status") == "COMPLETE")
    if require_publish:
        passes = passes & F.col("publish_state").eqNullSafe("VERIFIED")
    return F.coalesce(passes, F.lit(False))


def remediation_scope(changes: DataFrame) -> DataFrame:
    """Runs eligible for a bridge: exactly one change, and it is a rename."""
    return (
        changes.groupBy("run_key")
        .agg(
            F.count(F.lit(1)).alias("n_changes"),
            F.bool_and(F.col("change_type") == "rename_column").alias("only_renames"),
        )
        .filter((F.col("n_changes") == 1) & F.col("only_renames"))
        .select("run_key")
    )
