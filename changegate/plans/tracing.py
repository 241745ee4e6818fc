"""Queries of catalog resolution, reach, enrichment, assertions and paging."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import functions as F

from changegate.operators import lineage
from changegate.plans import gate
from changegate.plans.diffing import DIFF_VIEWS, gate_changes
from changegate.plans.staging import staged
from changegate.plans.views import table, view, with_clause


def load_catalog(spark, sf_dir) -> gate.Catalog:
    return gate.Catalog(
        datasets=view(spark, sf_dir, "gate_catalog"),
        fields=view(spark, sf_dir, "gate_field"),
        edges=view(spark, sf_dir, "gate_edge"),
        assets=view(spark, sf_dir, "gate_asset"),
        owners=view(spark, sf_dir, "gate_owner"),
        tags=view(spark, sf_dir, "gate_tag"),
        assertions=view(spark, sf_dir, "gate_assertion"),
    )


def resolved_changes(spark, sf_dir):
    return staged(
        spark,
        sf_dir,
        "resolved",
        lambda: gate.resolve_changes(gate_changes(spark, sf_dir), load_catalog(spark, sf_dir)),
    )


def reached_columns(spark, sf_dir):
    return staged(
        spark,
        sf_dir,
        "columns",
        lambda: gate.reach_columns(resolved_changes(spark, sf_dir), load_catalog(spark, sf_dir)).rows,
    )


def gate_context(spark, sf_dir) -> gate.Context:
    """The context of all changes, each of its tables written once."""
    built: list[gate.Context] = []

    def part(name: str):
        def build():
            if not built:
                built.append(gate.collect_context(gate_changes(spark, sf_dir), load_catalog(spark, sf_dir)))
            return getattr(built[0], name)

        return staged(spark, sf_dir, f"context-{name}", build)

    return gate.Context(*[part(f.name) for f in fields(gate.Context)])


def q_resolve_dataset(spark, sf_dir):
    """Datasets by full name, by a name that only ends alike, and by names that are the dataset's own."""
    k = F.substring("run_key", 5, 20).cast("bigint") % 5
    last = F.substring_index("relation", ".", -1)
    relation = (
        F.when(k == 1, F.concat(F.lit('"Other".'), last))
        .when(k == 2, F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:lake,x."), last, F.lit(",PROD)")))
        .when(k == 3, F.concat(F.lit("urn:li:dataset:"), last))
        .otherwise(F.col("relation"))
    )
    changes = gate_changes(spark, sf_dir).withColumn("relation", relation)
    return lineage.resolve_dataset(changes, view(spark, sf_dir, "gate_catalog")).select(
        "run_key", "change_id", "source_urn", "catalog_status", "catalog_reason"
    )


def q_check_baseline(spark, sf_dir):
    resolved = gate.resolve_changes(gate_changes(spark, sf_dir), load_catalog(spark, sf_dir))
    return resolved.select(
        "run_key", "change_id", "source_urn", "checked_column", "catalog_status", "catalog_reason"
    )


def q_downstream_reach(spark, sf_dir):
    """Everything below every supplier, counted per source and hop."""
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier:"), "s_suppkey").alias("source_urn")
    )
    reach = lineage.downstream_reach(suppliers, view(spark, sf_dir, "lineage_edge"))
    # Numbers are in the order of the names, so only the counted rows need names.
    counted = reach.folded(
        lambda ids: ids.groupBy("source", "hop_count").agg(
            F.count(F.lit(1)).alias("n_assets"), F.min("node").alias("first"), F.max("node").alias("last")
        )
    )
    name = lambda node, urn: reach.names.select(F.col("id").alias(node), F.col("urn").alias(urn))
    named = counted.join(name("source", "source_urn"), "source")
    for node in ("first", "last"):
        named = named.join(name(node, f"{node}_urn"), node, "left")
    return named.select("source_urn", "hop_count", "n_assets", "first_urn", "last_urn")


def q_downstream_reach_parts(spark, sf_dir):
    """Every asset below every part, row by row."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("source_urn"))
    return lineage.downstream_reach(parts, view(spark, sf_dir, "lineage_edge")).rows


def q_reach_truncated(spark, sf_dir):
    """Suppliers below which something is left after two hops."""
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("source_urn"))
    return lineage.downstream_reach(suppliers, view(spark, sf_dir, "lineage_edge"), max_hops=2).truncated


def q_column_reach(spark, sf_dir):
    reach = gate.reach_columns(resolved_changes(spark, sf_dir), load_catalog(spark, sf_dir)).rows
    return reach.filter(F.col("urn") != F.col("source_urn"))


def q_tag_signals(spark, sf_dir):
    return lineage.tag_signals(view(spark, sf_dir, "gate_tag"))


def q_owners_state(spark, sf_dir):
    return lineage.owners_state(view(spark, sf_dir, "gate_owner"))


def q_enrich_assets(spark, sf_dir):
    resolved, columns = resolved_changes(spark, sf_dir), reached_columns(spark, sf_dir)
    return gate.enrich_changes(resolved, columns, load_catalog(spark, sf_dir)).drop("malformed")


def q_link_assertions(spark, sf_dir):
    resolved, columns = resolved_changes(spark, sf_dir), reached_columns(spark, sf_dir)
    enriched = gate.enrich_changes(resolved, columns, load_catalog(spark, sf_dir))
    assertions = view(spark, sf_dir, "gate_assertion").withColumn("fields", F.array("field", F.lit(""))).drop("field")
    return gate.link_changes(resolved, columns, enriched, assertions)


def q_impacted_assets(spark, sf_dir):
    """Reached assets with their facts, and the assertions of the changed datasets."""
    return gate.collect_context(gate_changes(spark, sf_dir), load_catalog(spark, sf_dir)).impacted


def q_assertion_assets(spark, sf_dir):
    sources = resolved_changes(spark, sf_dir).filter(F.col("source_urn").isNotNull())
    names = view(spark, sf_dir, "gate_assertion").select("assertion_urn", "name")
    return lineage.assertion_assets(
        sources.select("run_key", "change_id", "source_urn"), gate_context(spark, sf_dir).links, names
    )


def q_evidence_states(spark, sf_dir):
    return gate_context(spark, sf_dir).states.drop("source_urn")


def q_audit_pages(spark, sf_dir):
    return lineage.audit_pages(view(spark, sf_dir, "result_page"), view(spark, sf_dir, "result_item"), max_hops=3)


QUERIES = {
    "resolve_dataset": q_resolve_dataset,
    "check_baseline": q_check_baseline,
    "downstream_reach": q_downstream_reach,
    "downstream_reach_parts": q_downstream_reach_parts,
    "reach_truncated": q_reach_truncated,
    "column_reach": q_column_reach,
    "tag_signals": q_tag_signals,
    "owners_state": q_owners_state,
    "enrich_assets": q_enrich_assets,
    "link_assertions": q_link_assertions,
    "assertion_assets": q_assertion_assets,
    "impacted_assets": q_impacted_assets,
    "evidence_states": q_evidence_states,
    "audit_pages": q_audit_pages,
}


def _entity_reach(sources: str) -> str:
    hops, seen = [], ["h0"]
    views = {"h0": f"select distinct source_urn, source_urn as urn from ({sources}) s"}
    for hop in (1, 2, 3, 4):
        minus = " ".join(f"except select source_urn, urn from {s}" for s in seen)
        views[f"h{hop}"] = f"""select distinct f.source_urn, e.dst_urn as urn from h{hop - 1} f
          join lineage_edge e on e.src_urn = f.urn {minus}"""
        seen.append(f"h{hop}")
        hops.append(f"select source_urn, urn, {hop} as hop_count from h{hop}")
    views["entity_reach"] = " union all ".join(hops)
    return views


def _column_reach() -> dict[str, str]:
    views = {
        "col_edge": "select distinct src_urn, src_column, dst_urn, dst_column from gate_edge",
        "c0": """select distinct source_urn, start_column, source_urn as urn, start_column as col
          from gate_resolved where source_urn is not null""",
    }
    seen, hops = ["c0"], []
    for hop in (1, 2, 3, 4):
        minus = " ".join(f"except select * from {s}" for s in seen)
        views[f"c{hop}"] = f"""select distinct f.source_urn, f.start_column, e.dst_urn as urn,
            case when e.src_column is not null then e.dst_column end as col
          from c{hop - 1} f join col_edge e on e.src_urn = f.urn
            and (f.col is null or e.src_column is null or e.src_column = f.col) {minus}"""
        seen.append(f"c{hop}")
        hops.append(f"select *, {hop} as hop_count from c{hop}")
    views["col_reach"] = f"select * from ({' union all '.join(hops)}) x where urn <> source_urn"
    return views


TRACE_VIEWS = {
    **DIFF_VIEWS,
    "gate_named": """select urn, lower(regexp_extract(urn, '^urn:li:dataset:\\(([^,]*),(.*),[^,]*\\)$', 2)) as full_name
      from gate_catalog""",
    "gate_hit": """select c.run_key, c.change_id, (select count(*) from gate_named n where n.full_name = c.relation) as n_exact,
      (select min(urn) from gate_named n where n.full_name = c.relation) as exact_urn from gate_change c""",
    "gate_source": """select run_key, change_id, case when n_exact = 1 then exact_urn end as source_urn,
      case when n_exact = 1 then 'complete' when n_exact > 1 then 'ambiguous' else 'missing' end as catalog_status,
      case when n_exact > 1 then 'catalog.dataset_ambiguous' when n_exact = 0 then 'catalog.dataset_missing' end
        as catalog_reason from gate_hit""",
    "gate_checked": """select c.*, s.source_urn, s.catalog_status as dataset_status, s.catalog_reason as dataset_reason,
      case when c.change_type = 'add_column' then c.new_column else coalesce(c.old_column, c.new_column) end
        as checked_column,
      lower(coalesce(c.old_column, c.new_column)) as start_column
      from gate_change c join gate_source s using (run_key, change_id)""",
    "gate_match": """select c.run_key, c.change_id, count(f.urn) as n_match, max(f.native_type) as native_type,
      (select count(*) from gate_field g where g.urn = c.source_urn) as n_fields
      from gate_checked c left join gate_field f on f.urn = c.source_urn and lower(f.field_path) = lower(c.checked_column)
      group by c.run_key, c.change_id, c.source_urn""",
    "gate_resolved": """select c.* exclude (dataset_status, dataset_reason),
      case when source_urn is null then dataset_reason
        when change_type = 'add_column' then case when n_match > 0 then 'catalog.addition_column_exists' end
        when n_match <> 1 then case when n_fields > 0 then 'catalog.column_stale' else 'catalog.column_missing' end
        when old_type is null then null
        when native_type is null then 'catalog.type_fingerprint_missing'
        when lower(replace(native_type, ' ', '')) <> lower(replace(old_type, ' ', ''))
          then 'catalog.type_fingerprint_stale' end as catalog_reason,
      case when source_urn is null then dataset_status
        when change_type = 'add_column' then case when n_match > 0 then 'stale' else 'complete' end
        when n_match <> 1 then case when n_fields > 0 then 'stale' else 'missing' end
        when old_type is null then 'complete' when native_type is null then 'missing'
        when lower(replace(native_type, ' ', '')) <> lower(replace(old_type, ' ', '')) then 'stale'
        else 'complete' end as catalog_status
      from gate_checked c join gate_match m using (run_key, change_id)""",
    **_column_reach(),
    "gate_tagged": """select urn, bool_or(contains(t, 'critical') or contains(t, 'finance')) as critical_asset,
      bool_or(contains(t, 'pii') or contains(t, 'sensitive')) as sensitive_data,
      bool_or(n > 1 or not starts_with(tag, 'urn:li:tag:')) as tags_malformed
      from (select *, lower(concat_ws(' ', tag, tag_name)) as t, count(*) over (partition by urn, tag) as n from gate_tag) x
      group by urn""",
    "gate_owned": """select urn, count(distinct owner) as owner_count,
      bool_or(n > 1 or not (starts_with(owner, 'urn:li:corpuser:') or starts_with(owner, 'urn:li:corpGroup:')))
        as owners_malformed
      from (select *, count(*) over (partition by urn, owner) as n from gate_owner) x group by urn""",
    "gate_reached": """select r.run_key, r.change_id, c.urn, min(c.hop_count) as hop_count, count(c.col) > 0 as has_columns
      from gate_resolved r join col_reach c on c.source_urn = r.source_urn and c.start_column = r.start_column
      group by r.run_key, r.change_id, c.urn""",
    "gate_enriched": """select r.run_key, r.change_id, r.urn,
      case when starts_with(r.urn, 'urn:li:dataset:') then 'dataset' when starts_with(r.urn, 'urn:li:dashboard:') then 'dashboard'
        when starts_with(r.urn, 'urn:li:chart:') then 'chart' when starts_with(r.urn, 'urn:li:dataJob:') then 'data_job'
        else 'other' end as asset_type,
      a.name, r.hop_count, case when a.ownership_known then coalesce(o.owner_count, 0) > 0 end as has_owners,
      coalesce(t.critical_asset and a.urn is not null, false) as critical_asset,
      coalesce(t.sensitive_data and a.urn is not null, false) as sensitive_data,
      r.has_columns as direct_column_lineage, a.urn is not null as found
      from gate_reached r left join gate_asset a on a.urn = r.urn left join gate_owned o on o.urn = r.urn
        left join gate_tagged t on t.urn = r.urn""",
    "gate_checked_set": """select run_key, change_id, source_urn as dataset_urn, true as has_columns from gate_resolved
        where source_urn is not null
      union all select run_key, change_id, urn, direct_column_lineage from gate_enriched where asset_type = 'dataset'""",
    "gate_known_column": """select run_key, change_id, source_urn as dataset_urn, lower(old_column) as col
        from gate_resolved where source_urn is not null and old_column is not null
      union select run_key, change_id, source_urn, lower(new_column) from gate_resolved
        where source_urn is not null and new_column is not null
      union select r.run_key, r.change_id, c.urn, c.col from gate_resolved r join col_reach c
        on c.source_urn = r.source_urn and c.start_column = r.start_column where c.col is not null""",
    "gate_link": """select d.run_key, d.change_id, d.dataset_urn, a.assertion_urn,
        bool_or(a.field is not null and not d.has_columns) as unknown_columns
      from gate_checked_set d join gate_assertion a on a.dataset_urn = d.dataset_urn
      where a.field is null or not d.has_columns or exists (select 1 from gate_known_column k
        where k.run_key = d.run_key and k.change_id = d.change_id and k.dataset_urn = d.dataset_urn
          and k.col = lower(a.field))
      group by all""",
    "gate_own_assertion": """select l.run_key, l.change_id, l.assertion_urn as urn, 'assertion' as asset_type,
      (select min(name) from gate_assertion a where a.assertion_urn = l.assertion_urn) as name, 1 as hop_count,
      cast(null as boolean) as has_owners, cast(null as boolean) as critical_asset,
      cast(null as boolean) as sensitive_data, cast(null as boolean) as direct_column_lineage, true as has_assertions
      from gate_link l join gate_resolved r using (run_key, change_id) where l.dataset_urn = r.source_urn""",
    "gate_impacted": """select e.* exclude (found), exists (select 1 from gate_link l where l.run_key = e.run_key
        and l.change_id = e.change_id and l.dataset_urn = e.urn) as has_assertions from gate_enriched e
      union all by name select * from gate_own_assertion""",
    "gate_state": """select r.run_key, r.change_id, r.source_urn, r.catalog_status as catalog,
      case when r.source_urn is null then 'missing' else 'complete' end as lineage,
      case when r.source_urn is null then 'missing' else 'complete' end as traversal,
      case when r.source_urn is null then 'missing' when exists (select 1 from gate_enriched e
        where e.run_key = r.run_key and e.change_id = r.change_id and not e.found) then 'missing'
        else 'complete' end as ownership,
      case when r.source_urn is null then 'missing' when exists (select 1 from gate_link l
        where l.run_key = r.run_key and l.change_id = r.change_id and l.unknown_columns) then 'ambiguous'
        else 'complete' end as assertions from gate_resolved r""",
}


def sql(statement: str, extra: dict[str, str] | None = None) -> str:
    return with_clause(statement, {**TRACE_VIEWS, **(extra or {})})


_SUPPLIERS = _entity_reach("select 'supplier:' || s_suppkey as source_urn from supplier")
_PARTS = _entity_reach("select 'part:' || p_partkey as source_urn from part")

ORACLES = {
    "resolve_dataset": sql("""
with c as (select run_key, change_id, cast(substr(run_key, 5) as bigint) % 5 as k, regexp_extract(relation, '[^.]*$') as last from gate_change),
n as (select urn, full_name, regexp_extract(full_name, '[^.]*$') as last from gate_named),
s as (select c.*, case when k in (0, 4) then (select count(*) from n where full_name = 'shop.' || c.last) else 0 end as n_exact,
    (select min(urn) from n where full_name = 'shop.' || c.last) as exact_urn,
    (select count(*) from n where n.last = c.last) as n_near from c),
t as (select *, case when k = 2 then 'complete' when k = 3 then 'ambiguous' when n_exact = 1 then 'complete'
    when n_exact + n_near > 0 then 'ambiguous' else 'missing' end as catalog_status from s)
select run_key, change_id, case when k = 2 then 'urn:li:dataset:(urn:li:dataPlatform:lake,x.' || last || ',PROD)'
  when catalog_status = 'complete' then exact_urn end as source_urn, catalog_status,
  case when catalog_status <> 'complete' then 'catalog.dataset_' || catalog_status end as catalog_reason from t"""),
    "check_baseline": sql(
        "select run_key, change_id, source_urn, checked_column, catalog_status, catalog_reason from gate_resolved"
    ),
    "downstream_reach": sql(
        """select source_urn, hop_count, count(*) as n_assets, min(urn) as first_urn, max(urn) as last_urn
from entity_reach group by source_urn, hop_count""",
        _SUPPLIERS,
    ),
    "downstream_reach_parts": sql("select * from entity_reach", _PARTS),
    "reach_truncated": sql("select distinct source_urn from h3", _SUPPLIERS),
    "column_reach": sql('select source_urn, start_column, urn, col as "column", hop_count from col_reach'),
    "tag_signals": sql("select * from gate_tagged"),
    "owners_state": sql("select * from gate_owned"),
    "enrich_assets": sql("select * from gate_enriched"),
    "link_assertions": sql("select * from gate_link"),
    "assertion_assets": sql("select * from gate_own_assertion"),
    "impacted_assets": sql("select * from gate_impacted"),
    "evidence_states": sql("select * exclude (source_urn) from gate_state"),
    "audit_pages": sql("""
select request_id, n_pages, (select count(*) from result_item i where i.request_id = r.request_id) as n_items, total, case when reason is null then 'complete' else 'truncated' end as status, reason
from (select request_id, count(*) as n_pages, sum(n_items) as n_items, max(total) as total,
  case when min(total) <> max(total) then 'total_changed'
    when exists (select 1 from result_item i where i.request_id = q.request_id
      and not exists (select 1 from result_page o where o.request_id = i.request_id and o.page_no = i.page_no)) then 'page_missing'
    when min(page_no) <> 0 or min(page_offset) <> 0
      or bool_or(prev_no is not null and (page_no <> prev_no + 1 or page_offset <> prev_end)) then 'offset_gap'
    when bool_or(returned <> n_items or page_offset + returned > total
      or has_more <> (page_offset + returned < total)) then 'page_invalid'
    when bool_or(truncated_children <> 0) then 'children_truncated'
    when bool_or(bad_item) then 'item_invalid'
    when max(n_distinct) <> sum(n_items) then 'item_repeated'
    when sum(n_items) <> max(total) then 'incomplete' end as reason
  from (select p.*, lag(page_no) over w as prev_no, lag(page_offset + returned) over w as prev_end,
      (select count(*) from result_item i where i.request_id = p.request_id and i.page_no = p.page_no) as n_items,
      (select coalesce(bool_or(degree > 3), false) from result_item i where i.request_id = p.request_id
        and i.page_no = p.page_no) as bad_item,
      (select count(distinct item_urn) from result_item i where i.request_id = p.request_id) as n_distinct
    from result_page p window w as (partition by request_id order by page_no)) q
  group by request_id) r"""),
}
