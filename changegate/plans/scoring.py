"""Queries of merging, scoring and deciding."""

from __future__ import annotations

from pyspark.sql import functions as F

from changegate.constants import CONFLICT_FACTS
from changegate.operators import merge, score
from changegate.plans import gate
from changegate.plans.diffing import gate_changes, snapshot
from changegate.plans.staging import staged
from changegate.plans.tracing import TRACE_VIEWS, gate_context, load_catalog
from changegate.plans.views import table, view, with_clause
from changegate.policy import Policy


def _reports(spark, sf_dir):
    """Order lines as reports of one asset by several changes, lists as arrays."""
    rows = view(spark, sf_dir, "asset_report")
    owners = F.when(
        F.col("has_owners").isNotNull(),
        F.when(F.col("owner").isNotNull(), F.array("owner")).otherwise(F.array().cast("array<string>")),
    )
    return (
        rows.withColumn("owners", owners)
        .withColumn("assertion_urns", F.when(F.col("hop_count") < 3, F.array(F.concat(F.lit("check:"), "hop_count"))))
        .drop("has_owners", "owner")
    )


def _merged(spark, sf_dir):
    return merge.merge_assets(_reports(spark, sf_dir), staged=True)


def q_merge_context(spark, sf_dir):
    return _merged(spark, sf_dir).assets


def q_fact_conflicts(spark, sf_dir):
    return _merged(spark, sf_dir).conflicts


def q_conflict_records(spark, sf_dir):
    return merge.conflict_records(_merged(spark, sf_dir).conflicts)


def q_merged_members(spark, sf_dir):
    return _merged(spark, sf_dir).members


def q_worst_status(spark, sf_dir):
    """Worst status per order, each line a change with its own evidence."""
    rows = view(spark, sf_dir, "asset_report").select(
        F.col("urn").alias("run_key"),
        "traversal",
        F.when(F.col("hop_count") == 3, "unavailable").when(F.col("hop_count") == 2, "complete").alias("catalog"),
        F.lit("complete").alias("lineage"),
        F.when(F.col("critical_asset"), "ambiguous").otherwise("complete").alias("ownership"),
        F.when(F.col("direct_column_lineage"), "error").otherwise("missing").alias("assertions"),
    )
    return merge.worst_status(rows)


def q_record_conflicts(spark, sf_dir):
    """Lines of one order and number are one record; differing contents are errors."""
    return _record_conflicts(spark, sf_dir)


def _record_conflicts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("run:"), F.col("l_orderkey") % 10).alias("run_key"),
        F.concat_ws("-", F.lit("record"), "l_orderkey", "l_linenumber").alias("id"),
        "l_returnflag",
        "l_linestatus",
    )
    return merge.record_conflicts(lines, ["l_returnflag", "l_linestatus"])


def q_merge_reasons(spark, sf_dir):
    """Why the merged context of a run is to be doubted."""
    return merge.merge_reasons(_merged(spark, sf_dir), _record_conflicts(spark, sf_dir))


def _worst(spark, sf_dir):
    return score.worst_change(gate_context(spark, sf_dir).resolved, Policy())


def _scored(spark, sf_dir):
    context = gate_context(spark, sf_dir)
    policy = Policy()
    worst = _worst(spark, sf_dir)
    assets = staged(spark, sf_dir, "merged", lambda: gate.merge_context(context, staged=False).assets)
    return score.score_assets(assets, worst, policy)


def q_gate_conflicts(spark, sf_dir):
    return gate.merge_context(gate_context(spark, sf_dir)).conflicts


def q_merged_evidence(spark, sf_dir):
    """The evidence of every merged asset: one reference per change that reports it."""
    reports = _reports(spark, sf_dir).withColumn("evidence_refs", F.array(F.concat(F.lit("report:"), "change_id")))
    return merge.merge_assets(reports).members.filter(F.col("fact") == merge.EVIDENCE_FACT)


def q_contribution_evidence(spark, sf_dir):
    """What the points of every impacted asset rest on: the worst change's evidence, or the changes that reach the asset."""
    context, scored = gate_context(spark, sf_dir), _scored(spark, sf_dir)
    members = context.impacted.select(
        "run_key", "urn", F.lit(merge.EVIDENCE_FACT).alias("fact"), F.concat(F.lit("lineage:"), "change_id").alias("member")
    )
    return score.contribution_evidence(score.asset_contributions(scored), gate_changes(spark, sf_dir), members)


def q_asset_contributions(spark, sf_dir):
    return score.asset_contributions(_scored(spark, sf_dir))


def q_asset_score(spark, sf_dir):
    return score.asset_score(score.asset_contributions(_scored(spark, sf_dir)), Policy())


def q_score_basis(spark, sf_dir):
    """What every run's score starts from: its highest asset, or its worst change if it impacts nothing."""
    return score.score_basis(_scored(spark, sf_dir), _worst(spark, sf_dir))


def q_breadth(spark, sf_dir):
    """Breadth bonus of every part: the orders it appears in are its assets."""
    reached = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part:"), "l_partkey").alias("run_key"), "l_orderkey"
    )
    return score.breadth(reached.distinct(), Policy())


def q_override_reasons(spark, sf_dir):
    return gate.assess_context(gate_context(spark, sf_dir), Policy()).assessment.reasons


def q_assess(spark, sf_dir):
    return gate.assess_context(gate_context(spark, sf_dir), Policy()).decisions


def _bridge(spark, sf_dir) -> gate.Bridge:
    nodes, tests, results, expected = (
        view(spark, sf_dir, n) for n in ("gate_node", "bridge_model_test", "gate_result", "gate_expectation")
    )
    return gate.Bridge(snapshot(spark, sf_dir, "gate_patched"), nodes, tests, results, expected)


def q_gate_decision(spark, sf_dir):
    """The flagship: three snapshots, a catalog and the evidence of bridges in, one final decision per change set out."""
    before, after = (snapshot(spark, sf_dir, n) for n in ("gate_before", "gate_after"))
    return gate.run_gate(before, after, load_catalog(spark, sf_dir), bridge=_bridge(spark, sf_dir)).decisions


def q_gate_proofs(spark, sf_dir):
    """Which bridges of single renames were tested and keep the old interface, and why the others are not proven."""
    before, after = (snapshot(spark, sf_dir, n) for n in ("gate_before", "gate_after"))
    found = gate.prove_bridges(gate_changes(spark, sf_dir), before, after, _bridge(spark, sf_dir))
    return found.proofs.select("run_key", "proven", "remediation_status")


def _outcomes(spark, sf_dir):
    """Orders as finished runs in every combination of evidence, proof and publication."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("order:"), k).alias("run_key"),
        F.when(k % 5 == 0, "PASS").when(k % 5 < 3, "REVIEW").otherwise("BLOCK").alias("decision"),
        F.when(k % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("n_override_reasons"),
        F.when(F.col("o_orderstatus") == "F", "TESTED")
        .when(F.col("o_orderstatus") == "O", "UNSUPPORTED")
        .otherwise("VERIFICATION_ERROR")
        .alias("remediation_status"),
        (k % 7 != 0).alias("counterfactual_verified"),
        (k % 11 != 0).alias("interface_preserved"),
        F.when(k % 13 == 0, "NO_RESIDUAL_CHANGES").otherwise("RESIDUAL_CHANGES").alias("counterfactual_condition"),
        F.when(k % 13 == 0, F.lit(None)).when(k % 4 == 0, "REVIEW").otherwise("PASS").alias("residual_decision"),
        F.when(k % 17 == 0, F.lit(1)).alias("residual_override_reasons"),
        F.when(k % 19 == 0, "WRITEBACK_PENDING")
        .when(k % 2 == 0, "VERIFIED")
        .otherwise("NOT_REQUESTED")
        .alias("publish_state"),
    )


def q_run_status(spark, sf_dir):
    decided = (
        _outcomes(spark, sf_dir)
        .withColumn("final_decision", score.gate_decision())
        .withColumn("status", score.run_status())
    )
    return decided.select(
        "run_key",
        "final_decision",
        "status",
        score.is_passing().alias("passing"),
        score.is_passing(require_publish=True).alias("passing_published"),
    )


QUERIES = {
    "merge_context": q_merge_context,
    "fact_conflicts": q_fact_conflicts,
    "conflict_records": q_conflict_records,
    "merged_members": q_merged_members,
    "worst_status": q_worst_status,
    "record_conflicts": q_record_conflicts,
    "merge_reasons": q_merge_reasons,
    "gate_conflicts": q_gate_conflicts,
    "asset_contributions": q_asset_contributions,
    "merged_evidence": q_merged_evidence,
    "contribution_evidence": q_contribution_evidence,
    "asset_score": q_asset_score,
    "score_basis": q_score_basis,
    "breadth": q_breadth,
    "override_reasons": q_override_reasons,
    "assess": q_assess,
    "gate_decision": q_gate_decision,
    "gate_proofs": q_gate_proofs,
    "run_status": q_run_status,
}

_RANK = """case {0} when 'other' then 0 when 'dataset' then 1 when 'data_flow' then 2 when 'data_job' then 3
  when 'chart' then 4 when 'dashboard' then 5 when 'assertion' then 6 end"""
_UNRANK = "['other', 'dataset', 'data_flow', 'data_job', 'chart', 'dashboard', 'assertion'][{0} + 1]"
_STATUS = ["complete", "missing", "truncated", "ambiguous", "stale", "unavailable", "error"]
_STATUS_RANK = "list_position([" + ", ".join(f"'{s}'" for s in _STATUS) + "], {0})"
_STATUS_NAME = "[" + ", ".join(f"'{s}'" for s in _STATUS) + "][{0}]"
_DIFFERS = "count(distinct {0}) + max(case when {0} is null then 1 else 0 end) > 1"
_OR3 = "case when bool_or({0}) then true when count({0}) < count(*) then null else false end"
_ALL3 = "case when count({0}) = count(*) then bool_or({0}) end"


def _merge_views(rows: str, prefix: str) -> dict[str, str]:
    """Merged assets and conflicts of a report table with list columns as sorted text."""
    facts = ["asset_type", "hop_count", "owners", "assertion_urns", "critical_asset", "sensitive_data",
             "direct_column_lineage", "recent_query_usage_score"]
    flags = ", ".join(f"{_DIFFERS.format(f)} as d_{f}" for f in facts)
    conflicts = " union all ".join(
        f"select run_key, urn, '{f}' as field, '{kind}' as kind, '{state}' as state_field from {prefix}_flags where d_{f}"
        for f, kind, state in CONFLICT_FACTS
    )
    return {
        f"{prefix}_assets": f"""select run_key, urn, {_UNRANK.format('max(' + _RANK.format('asset_type') + ')')} as asset_type,
            min(name) as name, min(hop_count) as hop_count, {_ALL3.format('has_owners')} as has_owners,
            {_ALL3.format('has_assertions')} as has_assertions, {_OR3.format('critical_asset')} as critical_asset,
            {_OR3.format('sensitive_data')} as sensitive_data,
            {_OR3.format('direct_column_lineage')} as direct_column_lineage,
            max(recent_query_usage_score) as recent_query_usage_score, count(*) as n_reports
          from {rows} group by run_key, urn""",
        f"{prefix}_flags": f"select run_key, urn, {flags} from {rows} group by run_key, urn",
        f"{prefix}_conflicts": conflicts,
    }


SCORE_VIEWS = {
    **TRACE_VIEWS,
    "report_rows": """select *, case when has_owners is not null then coalesce(owner, '-') end as owners,
      case when hop_count < 3 then 'check:' || hop_count end as assertion_urns,
      case when hop_count < 3 then true end as has_assertions from asset_report""",
    **_merge_views("report_rows", "report"),
    "gate_rows": """select i.*, cast(null as int) as recent_query_usage_score, has_owners as owners,
      case when asset_type = 'assertion' then urn else (select coalesce(string_agg(assertion_urn, ',' order by assertion_urn), '')
        from gate_link l where l.run_key = i.run_key and l.change_id = i.change_id and l.dataset_urn = i.urn) end
        as assertion_urns from gate_impacted i""",
    **_merge_views("gate_rows", "merged"),
    "gate_run_state": "select run_key, "
    + ", ".join(
        _STATUS_NAME.format(
            f"greatest(max({_STATUS_RANK.format(f)}), max(coalesce((select 4 from merged_conflicts m "
            f"where m.run_key = s.run_key and m.state_field = '{f}' limit 1), 0)))"
        )
        + f" as {f}"
        for f in ("catalog", "lineage", "traversal", "ownership", "assertions")
    )
    + " from gate_state s group by run_key",
    "gate_record": " union all ".join(
        f"select run_key, 'evidence:{f}:' || change_id as id, {f} as status from gate_state"
        + ("" if f == "catalog" else " where source_urn is not null")
        for f in ("catalog", "lineage", "traversal", "ownership", "assertions")
    )
    + """ union all select run_key, 'context.asset_fact_conflict.' || field || '.' || substr(sha256(urn), 1, 12),
      'ambiguous' from merged_conflicts""",
    "gate_reason": " union all ".join(
        [
            f"select run_key, 'critical_evidence.{f}.' || {f} as reason from gate_run_state where {f} <> 'complete'"
            for f in ("catalog", "lineage", "traversal", "ownership", "assertions")
        ]
        + [
            "select distinct run_key, 'critical_record.' || id || '.' || status from gate_record where status <> 'complete'",
            """select run_key, 'schema_change.' || change_id || '.requiredness_missing' from gate_change
               where change_type = 'add_column' and new_nullable is null""",
            """select run_key, 'schema_change.' || change_id || '.type_compatibility_ambiguous' from gate_change
               where change_type = 'type_change'""",
            """select a.run_key, 'impacted_asset.' || urn || '.ownership_missing' from merged_assets a
               join gate_run_state s using (run_key) where s.ownership = 'complete' and a.has_owners is null""",
            """select a.run_key, 'impacted_asset.' || urn || '.assertion_evidence_missing' from merged_assets a
               join gate_run_state s using (run_key) where s.assertions = 'complete' and a.has_assertions is null""",
        ]
    ),
    "gate_points": """select a.run_key, a.urn as asset_urn, w.worst_change_id as change_id, 'severity' as category,
        w.severity_key as key, w.severity_points as points from merged_assets a join gate_worst w using (run_key)
      union all select run_key, urn, null, 'signal', 'assertion_contract', 25 from merged_assets where has_assertions
      union all select run_key, urn, null, 'signal', 'critical_asset', 15 from merged_assets where critical_asset
      union all select run_key, urn, null, 'signal', 'dashboard_or_chart', 15 from merged_assets
        where asset_type in ('dashboard', 'chart')
      union all select run_key, urn, null, 'signal', 'data_job_or_flow', 12 from merged_assets
        where asset_type in ('data_job', 'data_flow')
      union all select run_key, urn, null, 'signal', 'sensitive_data', 10 from merged_assets where sensitive_data
      union all select run_key, urn, null, 'signal', 'direct_column_lineage', 10 from merged_assets
        where direct_column_lineage
      union all select run_key, urn, null, 'signal', 'missing_owner', 5 from merged_assets where not has_owners
      union all select run_key, urn, null, 'hop_penalty', 'downstream_hops', -4 * (hop_count - 1) from merged_assets
        where hop_count > 1""",
    "gate_score": """select run_key, asset_urn, cast(sum(points) as int) as raw_score,
      cast(greatest(0, least(100, sum(points))) as int) as score from gate_points group by run_key, asset_urn""",
    "gate_basis": """select run_key, asset_urn as score_basis_asset_urn, score as asset_base, n_assets from (select *,
      row_number() over (partition by run_key order by score desc, asset_urn) as rn,
      count(*) over (partition by run_key) as n_assets from gate_score) s where rn = 1""",
    "gate_assessed": """select run_key, score, score_basis_asset_urn, worst_change_id, severity_key, severity_points,
        breadth_points, n_changes, n_assets, n_override_reasons, '1.0.0' as policy_version, score_decision,
        case when n_override_reasons > 0 and score_decision = 'PASS' then 'REVIEW' else score_decision end as decision
      from (select *, case when score <= 24 then 'PASS' when score <= 59 then 'REVIEW' else 'BLOCK' end as score_decision
      from (select *, greatest(0, least(100, coalesce(asset_base, severity_points) + breadth_points)) as score
      from (select w.*, b.score_basis_asset_urn, b.asset_base, coalesce(b.n_assets, 0) as n_assets,
        least(15, cast(round(3 * log2(1 + coalesce(b.n_assets, 0))) as int)) as breadth_points,
        (select count(*) from gate_reason r where r.run_key = w.run_key) as n_override_reasons
      from gate_worst w left join gate_basis b using (run_key)) a) b) c""",
    "gate_built": """select run_key, tested and rules as proven,
        case when failed then 'TEST_FAILED' when tested and rules then 'TESTED' else 'VERIFICATION_ERROR' end as remediation_status
      from (select 'run:' || k as run_key, k % 9 <> 5 and k % 10 = 0 as failed, k % 9 <> 5 and k % 10 <> 0 and k % 7 <> 3 as tested,
        k % 2 = 0 and k % 5 <> 3 and k % 8 <> 4 and k % 26 <> 0 and not (k % 11 = 0 and exists (select 1 from bridge_model_test t
          where t.run_key = 'run:' || k and t.side <> 'patched')) as rules
        from (select distinct cast(floor(p_partkey / 8) as bigint) as k from part) p where k % 3 <> 0) b""",
    "gate_tested": """select c.run_key, coalesce(p.remediation_status, 'GENERATED') as remediation_status,
        coalesce(p.proven, false) as proven, c.new_nullable
      from (select run_key, bool_and(new_nullable) as new_nullable from gate_change group by run_key
        having count(*) = 1 and min(change_type) = 'rename_column') c left join gate_built p using (run_key)""",
    "gate_rescored": """select t.run_key, case when new_nullable then 2 else 12 end as residual_score,
        (select count(*) from gate_reason r where r.run_key = t.run_key and r.reason like 'critical_evidence.%')
          + case when new_nullable is null then 1 else 0 end as n_open from gate_tested t where proven""",
    "gate_final": """select a.run_key, a.score, a.score_decision, a.decision, a.score_basis_asset_urn, a.worst_change_id,
        a.severity_key, a.n_changes, a.n_assets, a.n_override_reasons,
        coalesce(t.remediation_status, 'UNSUPPORTED') as remediation_status, r.residual_score,
        case when a.n_override_reasons = 0 and t.proven and r.n_open = 0 then 'PASS_WITH_REMEDIATION'
          else a.decision end as final_decision,
        case when a.n_override_reasons > 0 or coalesce(r.n_open, 0) > 0
          or coalesce(t.remediation_status, '') = 'VERIFICATION_ERROR' then 'INCOMPLETE' else 'COMPLETE' end as status
      from gate_assessed a left join gate_tested t using (run_key) left join gate_rescored r using (run_key)""",
}


def sql(statement: str) -> str:
    return with_clause(statement, SCORE_VIEWS)


_CLAMP_SQL = """select *, case when category = 'severity' then 'the worst change of the set is of class ' || key
  when key = 'downstream_hops' then cast(points // -4 as int) || ' more hops at 4 points each' """ + " ".join(
    f"when key = '{k}' then '{t.replace(chr(39), chr(39) * 2)}'" for k, t in score.EXPLANATIONS.items()
) + """ end as explanation from (
select run_key, asset_urn, change_id, category, key, points from gate_points
union all select run_key, asset_urn, null, 'clamp', 'asset_score_range', score - raw_score from gate_score
where score <> raw_score) c"""

ORACLES = {
    "merge_context": sql("select * from report_assets"),
    "fact_conflicts": sql("select * from report_conflicts"),
    "conflict_records": sql("""select run_key, 'context.asset_fact_conflict.' || field || '.' || substr(sha256(urn), 1, 12) as id,
kind, 'ambiguous' as status, true as critical from report_conflicts"""),
    "merged_members": sql("""
select distinct r.run_key, r.urn, 'owners' as fact, r.owner as member from report_rows r
join report_assets a using (run_key, urn) where a.has_owners is not null and r.owner is not null
union all
select distinct r.run_key, r.urn, 'assertion_urns', r.assertion_urns from report_rows r
join report_assets a using (run_key, urn) where a.has_assertions is not null and r.assertion_urns is not null"""),
    "worst_status": with_clause(
        "select run_key, " + ", ".join(
            _STATUS_NAME.format(f"max({_STATUS_RANK.format(f)})") + f" as {f}"
            for f in ("catalog", "lineage", "traversal", "ownership", "assertions")
        ) + " from report_state group by run_key",
        {"report_state": """select urn as run_key, traversal, case hop_count when 3 then 'unavailable' when 2 then 'complete'
          else 'missing' end as catalog, 'complete' as lineage,
          case when critical_asset then 'ambiguous' else 'complete' end as ownership,
          case when direct_column_lineage then 'error' else 'missing' end as assertions from asset_report"""},
    ),
    "record_conflicts": """
select 'run:' || (l_orderkey % 10) as run_key,
  'merge-conflict:' || substr(sha256('record-' || l_orderkey || '-' || l_linenumber), 1, 16) as id,
  'other' as kind, 'error' as status, true as critical from lineitem group by l_orderkey, l_linenumber
having count(distinct l_returnflag || l_linestatus) > 1""",
    "merge_reasons": sql(f"""
select f.run_key, 'context.asset_merged.' || substr(sha256(f.urn), 1, 12) as reason from report_flags f
  join (select run_key, urn, {_DIFFERS.format('name')} as d_name from report_rows group by run_key, urn) n
  on n.run_key = f.run_key and n.urn = f.urn where d_name or {' or '.join(f'd_{f}' for f, *_ in CONFLICT_FACTS)}
union all select run_key, 'context.asset_fact_conflict.' || field || '.' || substr(sha256(urn), 1, 12) from report_conflicts
union all select distinct 'run:' || (l_orderkey % 10), 'context.evidence_record_conflict' from (select l_orderkey, l_linenumber from lineitem
  group by l_orderkey, l_linenumber having count(distinct l_returnflag || l_linestatus) > 1) x"""),
    "gate_conflicts": sql("select * from merged_conflicts"),
    "asset_contributions": sql(_CLAMP_SQL),
    "merged_evidence": sql("select distinct run_key, urn, 'evidence_refs' as fact, 'report:' || change_id as member from report_rows"),
    "contribution_evidence": sql("""
select p.run_key, p.asset_urn, p.key, unnest(string_split(c.evidence_refs, ',')) as evidence_ref from gate_points p
  join gate_change c on c.run_key = p.run_key and c.change_id = p.change_id where p.category = 'severity'
union select p.run_key, p.asset_urn, p.key, 'lineage:' || i.change_id from gate_points p
  join gate_impacted i on i.run_key = p.run_key and i.urn = p.asset_urn where p.category <> 'severity'"""),
    "asset_score": sql("select * from gate_score"),
    "score_basis": sql("""select w.run_key, b.score_basis_asset_urn, coalesce(b.asset_base, w.severity_points) as asset_base,
  coalesce(b.n_assets, 0) as n_assets from gate_worst w left join gate_basis b using (run_key)"""),
    "breadth": """select 'part:' || l_partkey as run_key, count(distinct l_orderkey) as n_assets,
least(15, cast(round(3 * log2(1 + count(distinct l_orderkey))) as int)) as breadth_points from lineitem group by l_partkey""",
    "override_reasons": sql("select run_key, reason from gate_reason"),
    "assess": sql("select * from gate_assessed"),
    "gate_decision": sql("""select *, final_decision in ('PASS', 'PASS_WITH_REMEDIATION') and status = 'COMPLETE' as passing
from gate_final
union all by name select distinct run_key, 'UNSUPPORTED' as remediation_status, 'BLOCK' as final_decision, 'REJECTED' as status,
  false as passing from gate_rejection"""),
    "gate_proofs": sql("""select run_key, proven, remediation_status from gate_tested where remediation_status <> 'GENERATED'"""),
    "run_status": """
with o as (select o_orderkey as k, o_orderstatus as s from orders),
d as (select k, case when k % 3 <> 0 and s = 'F' and k % 7 <> 0 and k % 11 <> 0 and (k % 13 = 0 or k % 4 <> 0)
    then 'PASS_WITH_REMEDIATION' when k % 5 = 0 then 'PASS' when k % 5 < 3 then 'REVIEW' else 'BLOCK' end as final_decision,
  case when k % 3 = 0 or k % 17 = 0 or s not in ('F', 'O') or k % 19 = 0 then 'INCOMPLETE' else 'COMPLETE' end as status from o)
select 'order:' || k as run_key, final_decision, status,
  final_decision like 'PASS%' and status = 'COMPLETE' as passing,
  final_decision like 'PASS%' and status = 'COMPLETE' and k % 19 <> 0 and k % 2 = 0 as passing_published from d""",
}
