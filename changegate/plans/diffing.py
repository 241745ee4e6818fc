"""Queries of the comparison operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegate.functions import text
from changegate.functions.identity import change_id
from changegate.operators import diff, score
from changegate.plans.staging import staged
from changegate.plans.views import table, view, with_clause
from changegate.policy import Policy


def snapshot(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived snapshot with the fingerprint of each column's expression."""
    columns = view(spark, sf_dir, name)
    if "constraint_text" in columns.columns:
        columns = columns.withColumn("constraints", F.array_compact(F.array("constraint_text"))).drop("constraint_text")
    return columns.withColumn("expr_fingerprint", text.expression_fingerprint(F.col("expression")))


def snap_diff(spark: SparkSession, sf_dir: str) -> diff.Diff:
    return diff.schema_diff(snapshot(spark, sf_dir, "snap_before"), snapshot(spark, sf_dir, "snap_after"))


def gate_diff(spark: SparkSession, sf_dir: str) -> diff.Diff:
    return diff.schema_diff(snapshot(spark, sf_dir, "gate_before"), snapshot(spark, sf_dir, "gate_after"))


def gate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of the many-run snapshots, as input of later operators."""
    return staged(spark, sf_dir, "changes", lambda: gate_diff(spark, sf_dir).changes)


def _flat(changes: DataFrame) -> DataFrame:
    return changes.withColumn("evidence_refs", F.array_join("evidence_refs", ","))


def q_schema_diff(spark, sf_dir):
    return _flat(snap_diff(spark, sf_dir).changes)


def q_schema_diff_many_runs(spark, sf_dir):
    return _flat(gate_diff(spark, sf_dir).changes)


def q_diff_rejections(spark, sf_dir):
    return gate_diff(spark, sf_dir).rejections


def q_infer_renames(spark, sf_dir):
    pairs = diff.pair_columns(snapshot(spark, sf_dir, "snap_before"), snapshot(spark, sf_dir, "snap_after"))
    return diff.infer_renames(pairs).select("run_key", "relation", "old_column", "new_column")


def q_attribute_changes(spark, sf_dir):
    """Attribute changes of the columns both sides keep, and of the renamed ones."""
    before, after = (snapshot(spark, sf_dir, n) for n in ("snap_before", "snap_after"))
    pairs = diff.pair_columns(before, after)
    kept = pairs.filter((F.col("n_old") > 0) & (F.col("n_new") > 0)).select(
        "run_key",
        "relation",
        F.col("column_name").alias("old_column"),
        F.col("column_name").alias("new_column"),
        "old",
        "new",
    )
    renamed = diff.infer_renames(pairs).select(*kept.columns)
    return diff.attribute_changes(kept.unionByName(renamed)).drop("evidence_refs")


def q_removed_relations(spark, sf_dir):
    return diff.removed_relations(view(spark, sf_dir, "gate_before"), view(spark, sf_dir, "gate_after"))


def q_change_ids(spark, sf_dir):
    changes = gate_diff(spark, sf_dir).changes
    return changes.select("run_key", "change_type", "old_column", "new_column", "change_id")


def q_severity(spark, sf_dir):
    policy = Policy()
    key = diff.severity_key()
    return gate_changes(spark, sf_dir).select(
        "change_id", key.alias("severity_key"), policy.severity_points(key).alias("severity_points")
    )


def q_worst_change(spark, sf_dir):
    return score.worst_change(gate_changes(spark, sf_dir), Policy())


def q_remediation_scope(spark, sf_dir):
    return score.remediation_scope(gate_changes(spark, sf_dir))


def q_duplicates(spark, sf_dir):
    """Lines whose (order, line number) repeats: the data's own duplicate keys."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("run:"), "l_returnflag").alias("run_key"), "l_orderkey", "l_linenumber"
    )
    return diff.duplicates(lines, ["run_key", "l_orderkey", "l_linenumber"], "duplicate_line")


def q_validate_changes(spark, sf_dir):
    """Change records read from order lines, many of them malformed on purpose."""
    lines = table(spark, sf_dir, "lineitem")
    kinds = F.array(*[F.lit(k) for k in VALIDATED_KINDS])
    some = lambda cond, value: F.when(cond, value)
    changes = lines.select(
        F.concat(F.lit("order:"), "l_orderkey").alias("run_key"),
        F.concat_ws("-", F.lit("line"), "l_linenumber", "l_partkey", "l_suppkey").alias("change_id"),
        diff.change_type_of(kinds[(F.col("l_partkey") % len(VALIDATED_KINDS)).cast("int")]).alias("change_type"),
        some(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("c"), F.col("l_suppkey") % 2)).alias("old_column"),
        some(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("c"), F.col("l_linenumber") % 2)).alias("new_column"),
        some(F.col("l_quantity") > 5, F.col("l_returnflag")).alias("old_type"),
        some(F.col("l_quantity") < 45, F.lower("l_linestatus")).alias("new_type"),
        some(F.col("l_tax") > 0, F.col("l_discount") > 0.05).alias("old_nullable"),
        some(F.col("l_tax") < 0.08, F.col("l_discount") > 0.02).alias("new_nullable"),
    )
    return diff.validate_changes(changes)


VALIDATED_KINDS = (
    "add",
    "drop",
    "rename",
    "type",
    "nullability",
    "incompatible_type",
    "widening_type",
    "nullable_to_required",
    "add_required_column",
    "add_nullable_column",
    "truncate",
)


def ddl_actions(spark, sf_dir):
    """An ALTER log read from the event stream: one batch per user and hour."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("batch:"), "user_id", F.lit("/"), F.date_format("ts", "yyyy-MM-dd HH")).alias("run_key"),
        F.concat(F.lit("shop.u"), "user_id").alias("relation"),
        F.when(kind == "click", "RENAME")
        .when(kind == "purchase", "type")
        .when(kind == "signup", "add")
        .when(kind == "view", F.when(F.col("value") > 5, "drop").otherwise("set_not_null"))
        .otherwise("truncate")
        .alias("action"),
        F.concat(F.lit("Col_"), "event_id").alias("column_name"),
        (F.col("event_id") % 4 == 0).alias("column_quoted"),
        F.concat(F.lit("Col_"), "event_id", F.lit("_v2")).alias("new_name"),
        F.lit(False).alias("new_quoted"),
        F.when(F.col("event_id") % 10 != 0, "BIGINT").alias("data_type"),
        (F.col("event_id") % 3 == 0).alias("not_null"),
        F.when((kind == "view") & (F.col("event_id") % 7 == 0), "cascade").alias("modifier"),
    )


def q_changes_from_ddl_log(spark, sf_dir):
    return _flat(diff.changes_from_ddl_log(ddl_actions(spark, sf_dir)).changes)


def q_ddl_rejections(spark, sf_dir):
    return diff.changes_from_ddl_log(ddl_actions(spark, sf_dir)).rejections


def q_check_adapter(spark, sf_dir):
    """Orders as change sets, the return flags of their lines as adapters of the sides."""
    nodes = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order:"), "l_orderkey").alias("run_key"),
        F.when(F.col("l_returnflag") == "A", "postgres")
        .when(F.col("l_returnflag") == "N", "PostgreSQL")
        .otherwise(F.when(F.col("l_linestatus") == "O", "duckdb").otherwise(""))
        .alias("adapter_type"),
    )
    return diff.check_adapter(nodes)


def q_normalize(spark, sf_dir):
    """Names, types and expressions of every part in canonical form."""
    name = F.concat(F.lit("  "), F.initcap("p_name"), F.lit('"x" '))
    raw_type = F.when(F.col("p_size") % 4 == 0, "character varying( 20 )").when(
        F.col("p_size") % 4 == 1, "numeric(12 ,2)"
    ).when(F.col("p_size") % 4 == 2, "  integer").otherwise(F.col("p_type"))
    node = F.struct(
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('"Shop"."'), "p_name", F.lit('"'))).alias("relation_name"),
        F.when(F.col("p_size") % 5 != 0, F.lit("Warehouse")).alias("database"),
        F.lit("Sales").alias("schema"),
        F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.lit("Alias")).alias("alias"),
        F.lit(None).cast("string").alias("identifier"),
        F.col("p_brand").alias("name"),
    )
    kind = F.when(F.col("p_size") % 7 == 0, "NOT NULL").otherwise("unique")
    constraint = F.array(F.when(F.col("p_size") % 2 == 0, kind).otherwise(F.to_json(F.struct(kind.alias("type")))))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.normalize_identifier(name, F.col("p_size") % 2 == 0).alias("identifier"),
        text.relation_name(node).alias("relation"),
        text.canonical_type(raw_type, text.one_text_type(F.when(F.col("p_size") % 3 == 0, "postgres").otherwise("duckdb"))).alias(
            "canonical_type"
        ),
        text.type_fingerprint(raw_type).alias("type_fingerprint"),
        text.derive_nullable(
            F.when(F.col("p_size") % 11 == 0, F.lit(True)), F.when(F.col("p_size") % 13 == 0, F.lit(True)), constraint
        ).alias("nullable"),
        text.expression_fingerprint(
            F.concat(F.lit("CAST( Src."), "p_name", F.lit("  AS text ) || 'Keep  Case'"))
        ).alias("fingerprint"),
        text.posix_path(F.concat(F.lit(".\\models//"), "p_brand", F.lit("\\./x.sql/"))).alias("path"),
        F.array_join(text.sorted_unique(F.array("p_type", F.lower("p_type"), "p_type")), ",").alias("refs"),
        text.clean_detail(F.when(F.col("p_size") % 2 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), "p_name"))).alias(
            "detail"
        ),
    )


def q_classify_urns(spark, sf_dir):
    """Kind, validity and dataset name of every page address written as an entity name."""
    urn = (
        F.when(
            F.col("page_id") % 5 == 0,
            F.concat(
                F.lit("urn:li:dataset:(urn:li:dataPlatform:web,"),
                F.replace(F.col("url"), F.lit("?"), F.lit("%3F")),
                F.lit("+x,PROD)"),
            ),
        )
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("urn:li:chart:"), "url"))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("urn:li:dataJob: "), "url"))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("urn:li:assertion:"), "page_id"))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.asset_type(urn).alias("asset_type"),
        text.valid_urn(urn).alias("valid"),
        text.dataset_name(urn).alias("dataset_name"),
    )


_J = lambda name, col: f"'\"{name}\":' || coalesce('\"' || {col} || '\"', 'null')"
_B = lambda name, col: f"'\"{name}\":' || coalesce(cast({col} as varchar), 'null')"
CHANGE_ID_SQL = (
    "'change-' || substr(sha256('{' || "
    + " || ',' || ".join(
        [
            _J("change_type", "change_type"),
            _J("new_column", "new_column"),
            _B("new_nullable", "new_nullable"),
            _J("new_type", "new_type"),
            _J("old_column", "old_column"),
            _B("old_nullable", "old_nullable"),
            _J("old_type", "old_type"),
            _J("relation", "relation"),
            _J("source_path", "source_path"),
        ]
    )
    + " || '}'), 1, 16)"
)


def diff_views(prefix: str) -> dict[str, str]:
    """The comparison written once more in SQL, with joins instead of grouping."""
    fp = "sha256(sha256(expression))"
    return {
        f"{prefix}_gone": f"""select b.* from {prefix}_before b
          where not exists (select 1 from {prefix}_after a where a.run_key = b.run_key and a.relation = b.relation
            and a.column_name = b.column_name)""",
        f"{prefix}_come": f"""select a.* from {prefix}_after a
          where not exists (select 1 from {prefix}_before b where a.run_key = b.run_key and a.relation = b.relation
            and a.column_name = b.column_name)
          and exists (select 1 from {prefix}_before b where b.run_key = a.run_key and b.relation = a.relation)""",
        f"{prefix}_candidate": f"""select g.run_key, g.relation, g.column_name as old_column, c.column_name as new_column,
            count(*) over (partition by g.run_key, g.relation, g.column_name) as n_new,
            count(*) over (partition by c.run_key, c.relation, c.column_name) as n_old,
            g.data_type as old_type, c.data_type as new_type, g.nullable as old_nullable, c.nullable as new_nullable,
            g.expression as old_expression, c.expression as new_expression
          from {prefix}_gone g join {prefix}_come c
            on g.run_key = c.run_key and g.relation = c.relation and g.expression = c.expression""",
        f"{prefix}_rename": f"select * from {prefix}_candidate where n_new = 1 and n_old = 1",
        f"{prefix}_kept": f"""select b.run_key, b.relation, b.column_name as old_column, b.column_name as new_column,
            b.data_type as old_type, a.data_type as new_type, b.nullable as old_nullable, a.nullable as new_nullable,
            b.expression as old_expression, a.expression as new_expression
          from {prefix}_before b join {prefix}_after a on a.run_key = b.run_key and a.relation = b.relation
            and a.column_name = b.column_name
          union all select run_key, relation, old_column, new_column, old_type, new_type, old_nullable, new_nullable,
            old_expression, new_expression from {prefix}_rename""",
        f"{prefix}_rejection": f"""select distinct run_key, 'removed_relation' as reason, relation as detail
          from {prefix}_before b where not exists
            (select 1 from {prefix}_after a where a.run_key = b.run_key and a.relation = b.relation)
          union all
          select run_key, 'untyped_expression_change', relation || '.' || old_column from {prefix}_kept
          where old_expression <> new_expression and (old_type is null or new_type is null)""",
        f"{prefix}_found": f"""
          select run_key, relation, 'rename_column' as change_type, old_column, new_column, old_type, new_type,
            old_nullable, new_nullable, 'dbt:column-set:removed-and-added,dbt:compiled-expression:' ||
            substr({fp.replace('expression', 'old_expression')}, 1, 16) as evidence_refs from {prefix}_rename
          union all
          select g.run_key, g.relation, 'drop_column', g.column_name, null, g.data_type, null, g.nullable, null,
            'dbt:column-removed' from {prefix}_gone g left join {prefix}_rename r
            on r.run_key = g.run_key and r.relation = g.relation and r.old_column = g.column_name
          where r.old_column is null
          union all
          select c.run_key, c.relation, 'add_column', null, c.column_name, null, c.data_type, null, c.nullable,
            'dbt:column-added' from {prefix}_come c left join {prefix}_rename r
            on r.run_key = c.run_key and r.relation = c.relation and r.new_column = c.column_name
          where r.new_column is null
          union all
          select run_key, relation, 'type_change', old_column, new_column, old_type, new_type, null, null,
            'dbt:data-type-changed' from {prefix}_kept where old_type <> new_type
          union all
          select run_key, relation, 'nullability_change', old_column, new_column, null, null, old_nullable, new_nullable,
            'dbt:nullability-changed' from {prefix}_kept where old_nullable <> new_nullable""",
        f"{prefix}_change": f"""select run_key, {CHANGE_ID_SQL} as change_id, relation, change_type, old_column,
            new_column, old_type, new_type, old_nullable, new_nullable, evidence_refs, source_path, 'high' as confidence
          from (select *, '<after>' as source_path from {prefix}_found
            where run_key not in (select run_key from {prefix}_rejection)) f""",
        f"{prefix}_severity": f"""select run_key, change_id, severity_key, case severity_key when 'drop_column' then 45
            when 'incompatible_type' then 40 when 'rename_column' then 35 when 'nullable_to_required' then 30
            when 'widening_type' then 15 when 'add_required_column' then 12 else 2 end as severity_points
          from (select run_key, change_id, case change_type when 'type_change' then 'incompatible_type'
            when 'add_column' then case when new_nullable then 'add_nullable_column' else 'add_required_column' end
            when 'nullability_change' then case when old_nullable and not new_nullable then 'nullable_to_required'
            else 'widening_type' end else change_type end as severity_key from {prefix}_change) c""",
        f"{prefix}_worst": f"""select run_key, change_id as worst_change_id, severity_key, severity_points, n_changes
          from (select *, row_number() over (partition by run_key order by severity_points desc, change_id) as rn,
            count(*) over (partition by run_key) as n_changes from {prefix}_severity) s where rn = 1""",
    }


DIFF_VIEWS = {**diff_views("snap"), **diff_views("gate")}


def sql(statement: str) -> str:
    return with_clause(statement, DIFF_VIEWS)


QUERIES = {
    "schema_diff": q_schema_diff,
    "schema_diff_many_runs": q_schema_diff_many_runs,
    "diff_rejections": q_diff_rejections,
    "infer_renames": q_infer_renames,
    "attribute_changes": q_attribute_changes,
    "removed_relations": q_removed_relations,
    "change_ids": q_change_ids,
    "severity": q_severity,
    "worst_change": q_worst_change,
    "remediation_scope": q_remediation_scope,
    "duplicates": q_duplicates,
    "validate_changes": q_validate_changes,
    "changes_from_ddl_log": q_changes_from_ddl_log,
    "ddl_rejections": q_ddl_rejections,
    "check_adapter": q_check_adapter,
    "normalize": q_normalize,
    "classify_urns": q_classify_urns,
}

_KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in VALIDATED_KINDS) + "]"
_DDL = """
select 'batch:' || user_id || '/' || strftime(ts, '%Y-%m-%d %H') as run_key, 'shop.u' || user_id as relation,
  case event_type when 'click' then 'rename' when 'purchase' then 'type' when 'signup' then 'add'
    when 'view' then case when value > 5 then 'drop' else 'set_not_null' end else 'truncate' end as action,
  case when event_id % 4 = 0 then '"Col_' || event_id || '"' else 'col_' || event_id end as col,
  'col_' || event_id || '_v2' as target, event_id % 10 <> 0 as typed, event_id % 3 = 0 as not_null,
  event_type = 'view' and event_id % 7 = 0 as modified
from events"""
_DDL_BAD = "action = 'truncate' or modified or (action in ('add', 'type') and not typed)"

ORACLES = {
    "schema_diff": sql("select * from snap_change"),
    "schema_diff_many_runs": sql("select * from gate_change"),
    "diff_rejections": sql("select * from gate_rejection"),
    "infer_renames": sql("select run_key, relation, old_column, new_column from snap_rename"),
    "attribute_changes": sql("""
with m as (select b.run_key, b.relation, b.column_name as old_column, a.column_name as new_column, b.data_type as old_type,
    a.data_type as new_type, b.nullable as old_nullable, a.nullable as new_nullable
  from snap_before b join snap_after a on a.run_key = b.run_key and a.relation = b.relation and (a.column_name = b.column_name
    or exists (select 1 from snap_rename r where r.run_key = b.run_key and r.relation = b.relation
      and r.old_column = b.column_name and r.new_column = a.column_name)))
select run_key, relation, 'type_change' as change_type, old_column, new_column, old_type, new_type,
  cast(null as boolean) as old_nullable, cast(null as boolean) as new_nullable from m where old_type <> new_type
union all
select run_key, relation, 'nullability_change', old_column, new_column, null, null, old_nullable, new_nullable
from m where old_nullable <> new_nullable"""),
    "removed_relations": sql("select * from gate_rejection where reason = 'removed_relation'"),
    "change_ids": sql("select run_key, change_type, old_column, new_column, change_id from gate_change"),
    "severity": sql("select change_id, severity_key, severity_points from gate_severity"),
    "worst_change": sql("select * from gate_worst"),
    "remediation_scope": sql("""select run_key from gate_change group by run_key
having count(*) = 1 and min(change_type) = 'rename_column'"""),
    "duplicates": """select 'run:' || l_returnflag as run_key, 'duplicate_line' as reason,
  l_orderkey || '.' || l_linenumber as detail from lineitem group by l_returnflag, l_orderkey, l_linenumber
having count(*) > 1""",
    "validate_changes": f"""
with raw as (select 'order:' || l_orderkey as run_key,
  'line-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as change_id,
  {_KINDS_SQL}[l_partkey % {len(VALIDATED_KINDS)} + 1] as raw_kind,
  case when l_suppkey % 3 <> 0 then 'c' || (l_suppkey % 2) end as oc,
  case when l_suppkey % 5 <> 0 then 'c' || (l_linenumber % 2) end as nc,
  case when l_quantity > 5 then l_returnflag end as ot, case when l_quantity < 45 then lower(l_linestatus) end as nt,
  case when l_tax > 0 then l_discount > 0.05 end as old_n, case when l_tax < 0.08 then l_discount > 0.02 end as new_n
  from lineitem),
c as (select *, case raw_kind when 'add' then 'add_column' when 'drop' then 'drop_column'
  when 'rename' then 'rename_column' when 'type' then 'type_change' when 'nullability' then 'nullability_change'
  when 'truncate' then null else raw_kind end as change_type from raw),
v as (
  select *, 'unknown_change_type' as violation from c where change_type is null
  union all select *, 'add_needs_new_column' from c
    where change_type in ('add_column', 'add_required_column', 'add_nullable_column') and nc is null
  union all select *, 'drop_needs_old_column' from c where change_type = 'drop_column' and oc is null
  union all select *, 'rename_needs_both_columns' from c
    where change_type = 'rename_column' and (oc is null or nc is null)
  union all select *, 'rename_needs_distinct_columns' from c where change_type = 'rename_column' and oc = nc
  union all select *, 'type_change_needs_both_types' from c
    where change_type in ('type_change', 'incompatible_type', 'widening_type') and (ot is null or nt is null)
  union all select *, 'type_change_needs_distinct_types' from c
    where change_type in ('type_change', 'incompatible_type', 'widening_type') and lower(ot) = lower(nt)
  union all select *, 'nullability_needs_both_flags' from c
    where change_type in ('nullability_change', 'nullable_to_required') and (old_n is null or new_n is null)
  union all select *, 'nullability_needs_a_change' from c
    where change_type in ('nullability_change', 'nullable_to_required') and old_n = new_n
  union all select *, 'required_needs_true_to_false' from c
    where change_type = 'nullable_to_required' and not coalesce(old_n and not new_n, false))
select run_key, change_id, change_type, violation from v""",
    "changes_from_ddl_log": f"""
with a as ({_DDL}), bad as (select distinct run_key from a where {_DDL_BAD}),
f as (select run_key, relation, case action when 'add' then 'add_column' when 'drop' then 'drop_column'
    when 'rename' then 'rename_column' when 'type' then 'type_change' else 'nullability_change' end as change_type,
  case when action <> 'add' then col end as old_column,
  case action when 'drop' then null when 'rename' then target else col end as new_column,
  case when action = 'type' then 'UNKNOWN' end as old_type,
  case when action in ('add', 'type') then 'BIGINT' end as new_type,
  case when action = 'set_not_null' then true end as old_nullable,
  case when action = 'set_not_null' then false when action = 'add' then not not_null end as new_nullable,
  case action when 'add' then 'sqlglot:ColumnDef' when 'drop' then 'sqlglot:Drop'
    when 'rename' then 'sqlglot:RenameColumn' else 'sqlglot:AlterColumn' end as evidence_refs,
  '<sql>' as source_path, 'high' as confidence
  from a where run_key not in (select run_key from bad))
select *, {CHANGE_ID_SQL.replace("old_column || '", "replace(old_column, '\"', '\\\"') || '").replace(
    "new_column || '", "replace(new_column, '\"', '\\\"') || '")} as change_id from f""",
    "ddl_rejections": f"""
with a as ({_DDL}) select run_key, 'unsupported_action' as reason, cast(count(*) as varchar) as detail
from a where {_DDL_BAD} group by run_key""",
    "check_adapter": """
with a as (select 'order:' || l_orderkey as run_key, case when l_returnflag in ('A', 'N') then 'postgres'
    when l_linestatus = 'O' then 'duckdb' end as adapter from lineitem)
select run_key, 'adapter_mismatch' as reason, min(adapter) || ',' || max(adapter) as detail from a
group by run_key having count(distinct adapter) > 1""",
    "normalize": """
with p as (select *, case p_size % 4 when 0 then 'character varying( 20 )' when 1 then 'numeric(12 ,2)'
    when 2 then '  integer' else p_type end as raw_type from part)
select p_partkey,
  case when p_size % 2 = 0 then '"' || replace(initcap_name || '"x"', '"', '""') || '"'
       else lower(initcap_name || '"x"') end as identifier,
  case when p_size % 3 = 0 then '"Shop"."' || p_name || '"'
    else lower(case when p_size % 5 <> 0 then 'Warehouse.' else '' end || 'Sales.' ||
      case when p_size % 2 = 0 then p_brand else 'Alias' end) end as relation,
  case p_size % 4 when 0 then case when p_size % 3 = 0 then 'VARCHAR(20)' else 'TEXT' end when 1 then 'DECIMAL(12, 2)' when 2 then 'INT' else upper(p_type) end as canonical_type,
  lower(replace(raw_type, ' ', '')) as type_fingerprint,
  case when p_size % 11 = 0 then true when p_size % 13 = 0 then false when p_size % 7 = 0 then false end as nullable,
  sha256('cast(src.' || lower(p_name) || ' as text)||' || '''Keep  Case''') as fingerprint,
  'models/' || p_brand || '/x.sql' as path,
  case when p_type = lower(p_type) then p_type else p_type || ',' || lower(p_type) end as refs,
  case when p_size % 2 <> 0 then p_name end as detail
from (select *, array_to_string(list_transform(string_split(p_name, ' '),
  lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as initcap_name from p) q""",
    "classify_urns": r"""
with u as (select page_id, case page_id % 5
    when 0 then 'urn:li:dataset:(urn:li:dataPlatform:web,' || replace(url, '?', '%3F') || '+x,PROD)'
    when 1 then 'urn:li:chart:' || url when 2 then 'urn:li:dataJob: ' || url
    when 3 then 'urn:li:assertion:' || page_id else url end as urn, url from pages)
select page_id, case page_id % 5 when 0 then 'dataset' when 1 then 'chart' when 2 then 'data_job'
    when 3 then 'assertion' else 'other' end as asset_type,
  regexp_full_match(urn, 'urn:li:[A-Za-z][A-Za-z0-9]*:\S+') as valid,
  case when page_id % 5 = 0 then url || '+x' end as dataset_name from u""",
}
