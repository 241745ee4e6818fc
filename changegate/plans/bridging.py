"""Queries of the interface proof, attached tests and node digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from changegate.functions import text
from changegate.operators import evidence, interface
from changegate.plans.views import table, view, with_clause


def _columns(spark, sf_dir):
    rows = view(spark, sf_dir, "bridge_column").withColumn(
        "expr_fingerprint", text.expression_fingerprint(F.col("expression"))
    )
    return interface.column_contracts(rows, ["column_name", "data_type", "nullable"])


def _renames(spark, sf_dir):
    return view(spark, sf_dir, "bridge_rename")


def _nodes(spark, sf_dir):
    return view(spark, sf_dir, "bridge_node")


def _tests(spark, sf_dir):
    """Order lines as model tests: which sides a test exists on follows its line status."""
    return view(spark, sf_dir, "bridge_model_test")


def _checks(spark, sf_dir):
    return interface.interface_check(
        _columns(spark, sf_dir), _renames(spark, sf_dir), _nodes(spark, sf_dir), _tests(spark, sf_dir)
    )


def q_interface_check(spark, sf_dir):
    return _checks(spark, sf_dir)


def q_interface_proof(spark, sf_dir):
    return interface.interface_proof(_checks(spark, sf_dir))


def q_missing_evidence(spark, sf_dir):
    """Renames of which a side's node is nowhere to be seen."""
    return evidence.missing_evidence(_checks(spark, sf_dir))


def q_residual_changes(spark, sf_dir):
    found = interface.residual_diff(_columns(spark, sf_dir)).changes
    return found.select(
        "run_key", "relation", "change_type", "old_column", "new_column", "new_type", "new_nullable", "source_path"
    )


def _attached(spark, sf_dir):
    """Order lines as tests of the relation their part belongs to."""
    lines = table(spark, sf_dir, "lineitem")
    k = F.floor(F.col("l_partkey") / 8)
    node = F.concat(F.lit("model.shop.t"), k)
    tests = lines.select(
        F.concat(F.lit("run:"), k).alias("run_key"),
        F.when(F.col("l_linestatus") == "O", "before").otherwise("patched").alias("side"),
        F.concat_ws("-", F.lit("test"), "l_orderkey", "l_linenumber", "l_suppkey").alias("test_id"),
        F.when(F.col("l_suppkey") % 7 != 0, node).alias("attached_node"),
        F.when(
            F.col("l_linenumber") < 6,
            F.concat(F.when(F.col("l_tax") > 0.07, "X").otherwise("C"), F.col("l_partkey")),
        ).alias("column_name"),
        F.when(F.col("l_suppkey") % 5 == 0, F.array(node, F.lit("model.shop.t0")))
        .when(F.col("l_suppkey") % 11 == 0, F.array(node, node))
        .otherwise(F.array(node))
        .alias("depends_on"),
        F.when(F.col("l_quantity") > 2, F.sha2(F.concat_ws("/", "l_returnflag", F.col("l_linenumber")), 256)).alias(
            "signature"
        ),
    )
    columns = view(spark, sf_dir, "bridge_column").select(
        "run_key", "side", F.concat(F.lit("model.shop."), F.substring("relation", 6, 100)).alias("unique_id"), "column_name"
    )
    nodes = columns.select("run_key", "side", "unique_id").distinct()
    return interface.attach_tests(tests, nodes, columns)


def q_attach_tests(spark, sf_dir):
    return _attached(spark, sf_dir)[0]


def q_attach_test_rejections(spark, sf_dir):
    return _attached(spark, sf_dir)[1].distinct()


def q_interface_snapshot(spark, sf_dir):
    """Node digests of all three sides, compared: which sides of a run look alike?"""
    moved = (F.substring("run_key", 5, 20).cast("bigint") % 67 == 0) & (F.col("side") == "patched")
    keys = F.when(F.col("side") == "before", F.concat(F.lit('{"to": "'), "relation", F.lit('", "type": "Foreign Key"}'))).otherwise(
        F.concat(F.lit('{"type":"Foreign Key","to":"'), "relation", F.when(moved, "_x").otherwise(""), F.lit('"}'))
    )
    constraint = F.array(F.when(F.col("nullable"), "unique").otherwise("NOT NULL"), keys)
    columns = view(spark, sf_dir, "bridge_column").select(
        "run_key",
        "side",
        F.col("relation").alias("unique_id"),
        "column_name",
        "data_type",
        "nullable",
        F.lit(None).cast("boolean").alias("not_null"),
        F.lit(False).alias("quote"),
        constraint.alias("constraints"),
    )
    nodes = view(spark, sf_dir, "bridge_node_whole").select(
        "run_key", "side", F.col("relation").alias("unique_id"), "config_sha256", "query_context_sha256"
    )
    digests = interface.snapshot_digest(interface.interface_snapshot(nodes, columns))
    sides = {s: F.max(F.when(F.col("side") == s, F.col("sha256"))) for s in interface.SIDES}
    return digests.groupBy("run_key").agg(
        (sides["before"] == sides["patched"]).alias("before_is_patched"),
        (sides["before"] == sides["proposed"]).alias("before_is_proposed"),
        (sides["proposed"] == sides["patched"]).alias("proposed_is_patched"),
    )


QUERIES = {
    "interface_check": q_interface_check,
    "interface_proof": q_interface_proof,
    "missing_evidence": q_missing_evidence,
    "residual_changes": q_residual_changes,
    "attach_tests": q_attach_tests,
    "attach_test_rejections": q_attach_test_rejections,
    "interface_snapshot": q_interface_snapshot,
}

_SAME = "(b.data_type is not distinct from {0}.data_type and b.nullable is not distinct from {0}.nullable)"
BRIDGE_VIEWS = {
    "bridge_side": """select distinct run_key, relation, side from bridge_column""",
    "bridge_wide": """select r.*, n.column_name, n.column_name = r.old_column as is_old, n.column_name = r.new_column as is_new,
        b.data_type as b_type, b.nullable as b_null, b.ordinal as b_ord, b.expression as b_expr,
        p.data_type as p_type, p.nullable as p_null, p.ordinal as p_ord, p.expression as p_expr,
        q.data_type as q_type, q.nullable as q_null, q.ordinal as q_ord, q.expression as q_expr
      from (select distinct run_key, relation, column_name from bridge_column) n
      join bridge_rename r on r.run_key = n.run_key and r.relation = n.relation
      left join bridge_column b on b.run_key = n.run_key and b.relation = n.relation and b.column_name = n.column_name and b.side = 'before'
      left join bridge_column p on p.run_key = n.run_key and p.relation = n.relation and p.column_name = n.column_name and p.side = 'proposed'
      left join bridge_column q on q.run_key = n.run_key and q.relation = n.relation and q.column_name = n.column_name and q.side = 'patched'""",
    "bridge_fact": """select run_key, relation, count(b_expr) as n_cols, count(q_expr) as n_q,
        bool_and(is_new or (b_type is not distinct from q_type and b_null is not distinct from q_null
          and (b_expr is null) = (q_expr is null))) as other_contracts_kept,
        bool_and(is_new or (b_ord is not distinct from q_ord and b_expr is not distinct from q_expr)) as in_order,
        bool_and(is_old or (p_type is not distinct from q_type and p_null is not distinct from q_null
          and (p_expr is null) = (q_expr is null))) as proposed_contracts,
        bool_and(is_old or is_new or (b_ord is not distinct from p_ord and b_expr is not distinct from p_expr)) as others,
        max(case when is_old then b_type end) as ob_type, max(case when is_old then q_type end) as oq_type,
        bool_or(is_old and b_null) as ob_null, bool_or(is_old and q_null) as oq_null,
        max(case when is_old then b_expr end) as ob_expr, max(case when is_old then q_expr end) as oq_expr,
        max(case when is_new then q_expr end) as nq_expr, max(case when is_new then p_expr end) as np_expr,
        max(case when is_new then q_ord end) as nq_ord, max(case when is_new then p_ord end) as np_ord,
        max(case when is_old then b_ord end) as ob_ord, max(case when is_new then q_type end) as nq_type,
        bool_or(is_new and q_null) as nq_null, max(new_type) as new_type, bool_or(new_nullable) as new_nullable,
        count(case when is_new then b_expr end) as new_before, count(case when is_old then p_expr end) as old_proposed
      from bridge_wide group by run_key, relation""",
    "bridge_rule": " union all ".join(
        f"select run_key, relation, '{name}' as rule, coalesce({cond}, false) as ok from bridge_fact"
        for name, cond in {
            "columns_unambiguous": "true",
            "projection_evidence": "true",
            "old_contract_kept": "ob_type = oq_type and ob_null = oq_null",
            "other_contracts_kept": "other_contracts_kept",
            "old_expression_kept": "ob_expr = oq_expr",
            "bridge_expression": "oq_expr = nq_expr",
            "replacement_last": "nq_ord = n_cols and n_q = n_cols + 1",
            "earlier_columns_in_order": "in_order",
            "single_intended_addition": "new_before = 0 and nq_expr is not null",
            "intended_type": "new_type = nq_type",
            "intended_nullability": "new_nullable = nq_null",
            "proposed_contracts_kept": "proposed_contracts",
            "proposed_expression_kept": "np_expr = nq_expr",
            "proposed_replaces_in_place": "others and np_ord = ob_ord and old_proposed = 0",
        }.items()
    )
    + """ union all select run_key, relation, 'positions_unique', max(n) = 1 from (select run_key, relation, side, ordinal,
        count(*) as n from bridge_column group by all) x group by run_key, relation"""
    + " union all select run_key, relation, 'single_rename', count(*) = 1 from bridge_rename group by run_key, relation"
    + """ union all select r.run_key, r.relation, unnest(['three_sides', 'evidence_nodes']),
        (select count(*) from bridge_node b where b.run_key = r.run_key and b.relation = r.relation) = 3 from bridge_rename r"""
    + " union all select run_key, relation, 'evidence_columns', true from bridge_rename"
    + "".join(
        f""" union all select r.run_key, r.relation, '{fact}_{word}', coalesce(b.{fact} = q.{fact}, false) from bridge_rename r
          left join bridge_node b on b.run_key = r.run_key and b.relation = r.relation and b.side = '{side}'
          left join bridge_node q on q.run_key = r.run_key and q.relation = r.relation and q.side = 'patched'"""
        for fact in interface.NODE_FACTS
        for word, side in (("kept", "before"), ("as_proposed", "proposed"))
    )
    + """ union all select r.run_key, r.relation, 'test_evidence_complete', coalesce(bool_and(b.tests_complete), false)
        from bridge_rename r left join bridge_node b on b.run_key = r.run_key and b.relation = r.relation group by r.run_key, r.relation"""
    + "".join(
        f""" union all select r.run_key, r.relation, '{rule}', not exists (select 1 from bridge_model_test t
          where t.run_key = r.run_key and t.relation = r.relation and t.side = '{side}' and not exists (
            select 1 from bridge_model_test q where q.run_key = t.run_key and q.relation = t.relation
              and q.side = 'patched' and q.test_sha256 = t.test_sha256)) from bridge_rename r"""
        for rule, side in (("model_tests_kept", "before"), ("proposed_tests_kept", "proposed"))
    ),
    "line_test": """select 'run:' || k as run_key, case when l_linestatus = 'O' then 'before' else 'patched' end as side,
        'test-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey as test_id, 'model.shop.t' || k as node,
        l_suppkey % 7 <> 0 as attached, l_linenumber < 6 as on_column,
        case when l_tax > 0.07 then 'x' else 'c' end || l_partkey as col, l_suppkey,
        case when l_quantity > 2 then sha256(l_returnflag || '/' || l_linenumber) end as signature
      from (select *, cast(floor(l_partkey / 8) as bigint) as k from lineitem) l""",
    "bridge_unit": """select distinct run_key, side, 'model.shop.' || substr(relation, 6) as unique_id from bridge_column""",
    "bridge_unit_column": """select run_key, side, 'model.shop.' || substr(relation, 6) as unique_id, column_name
      from bridge_column""",
}


def sql(statement: str) -> str:
    return with_clause(statement, BRIDGE_VIEWS)


ORACLES = {
    "interface_check": sql("select run_key, relation, rule, ok from bridge_rule"),
    "interface_proof": sql("""select run_key, bool_and(ok) as proven,
count(*) filter (where not ok) as n_broken_rules from bridge_rule group by run_key"""),
    "missing_evidence": sql("""
select run_key, relation, 'nodes' as evidence from bridge_rename
where cast(substr(run_key, 5) as bigint) % 67 = 0 or cast(substr(run_key, 5) as bigint) % 71 = 0"""),
    "residual_changes": sql("""
with b as (select * from bridge_column where side = 'before'), q as (select * from bridge_column where side = 'patched'),
gone as (select b.* from b left join q using (run_key, relation, column_name) where q.side is null),
come as (select q.* from q left join b using (run_key, relation, column_name) where b.side is null)
select run_key, relation, change_type, old_column, new_column, new_type, new_nullable,
  '<verified-counterfactual>' as source_path from (
select run_key, relation, 'drop_column' as change_type, column_name as old_column, null as new_column,
  null as new_type, null as new_nullable from gone
union all select run_key, relation, 'add_column', null, column_name, data_type, nullable from come
union all select b.run_key, b.relation, 'type_change', column_name, column_name, q.data_type, null
  from b join q using (run_key, relation, column_name) where b.data_type <> q.data_type
union all select b.run_key, b.relation, 'nullability_change', column_name, column_name, null, q.nullable
  from b join q using (run_key, relation, column_name) where b.nullable <> q.nullable) x"""),
    "attach_tests": sql("""
select t.run_key, t.side, t.node as unique_id, c.column_name, t.signature, count(*) as n
from line_test t join bridge_unit_column c on c.run_key = t.run_key and c.side = t.side and c.unique_id = t.node
  and c.column_name = t.col where t.attached and t.on_column group by all
union all
select distinct t.run_key, t.side, u.unique_id, null, t.signature, 1 from line_test t join bridge_unit u
  on u.run_key = t.run_key and u.side = t.side and (u.unique_id = t.node or (t.l_suppkey % 5 = 0 and u.unique_id = 'model.shop.t0'))
  where not (t.attached and t.on_column)"""),
    "attach_test_rejections": sql("""
select distinct t.run_key, 'test_points_to_missing_column' as reason, t.test_id as detail
from line_test t join bridge_unit u on u.run_key = t.run_key and u.side = t.side and u.unique_id = t.node
where t.attached and t.on_column and not exists (select 1 from bridge_unit_column c where c.run_key = t.run_key
  and c.side = t.side and c.unique_id = t.node and c.column_name = t.col)
union all
select distinct run_key, 'test_dependencies_invalid', test_id from line_test
where (l_suppkey % 5 = 0 and node = 'model.shop.t0') or (l_suppkey % 5 <> 0 and l_suppkey % 11 = 0)"""),
    "interface_snapshot": sql("""
with c as (select run_key, side, string_agg(column_name || '/' || data_type || '/' || nullable, ',' order by column_name)
  || case when cast(substr(run_key, 5) as bigint) % 67 = 0 and side = 'patched' then 'moved' else '' end as body
  from bridge_column group by run_key, side),
s as (select c.run_key, c.side, c.body || n.config_sha256 || n.query_context_sha256 as body from c join bridge_node_whole n
  on n.run_key = c.run_key and n.side = c.side)
select run_key, max(case when side = 'before' then body end) = max(case when side = 'patched' then body end) as before_is_patched,
  max(case when side = 'before' then body end) = max(case when side = 'proposed' then body end) as before_is_proposed,
  max(case when side = 'proposed' then body end) = max(case when side = 'patched' then body end) as proposed_is_patched
from s group by run_key"""),
}
