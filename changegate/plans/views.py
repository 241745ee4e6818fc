"""Input tables of the queries, derived from the given parquet tables.

Each view is one SELECT in the SQL both engines understand; ``with_clause``
lists the views a statement needs, in order.  Nothing is generated: every row
comes from a row of a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_GATE_PART = "(select *, cast(floor(p_partkey / 8) as bigint) as k, cast(p_partkey % 8 as int) as i from part) p"
_REFERS = """'{"type": "foreign_key", "to": "shop.part_' || p_partkey % 7 || '"}'"""
_PLACE = "cast(row_number() over (partition by k order by p_partkey) - 1 as int)"
_ORDER_URN = "'urn:li:dataset:(urn:li:dataPlatform:warehouse,shop.order_' || {} || ',PROD)'"
_TABLE_URN = "'urn:li:dataset:(urn:li:dataPlatform:warehouse,shop.t' || {} || ',PROD)'"
_NATION_URN = "'urn:li:dataset:(urn:li:dataPlatform:warehouse,shop.nation_' || {} || ',PROD)'"
_CUSTOMER_URN = """case when c_mktsegment = 'MACHINERY' then 'urn:li:dashboard:(board,customer_' || c_custkey || ')'
  when c_mktsegment = 'BUILDING' then 'urn:li:dataJob:(flow,customer_' || c_custkey || ')'
  when c_mktsegment = 'FURNITURE' then 'urn:li:chart:(board,customer_' || c_custkey || ')'
  else 'urn:li:dataset:(urn:li:dataPlatform:warehouse,shop.customer_' || c_custkey || ',PROD)' end"""



def _bridge_rows(side: str, role: str, where: str = "true") -> str:
    """Columns of one side of a rename bridge, with one broken rule in some runs."""
    new, patched = role == "new", side == "patched"
    name = "'c' || p_partkey" + (" || '_v2'" if new else "")
    kind, null_flag, ordinal, expression = "p_type", "p_size % 2 = 0", "i", "'src.' || p_partkey"
    if patched and new:
        kind = "p_type || case when k % 23 = 0 then '_X' else '' end"
        null_flag = "case when k % 29 = 0 then p_size % 2 <> 0 else p_size % 2 = 0 end"
        ordinal = "8"
    elif patched:
        kind = "p_type || case when k % 19 = 0 and i = 5 then '_X' else '' end"
        ordinal = "case when k % 31 = 0 then (i + 1) % 8 else i end"
        expression = "case when k % 17 = 0 and i = 3 then 'other.' else 'src.' end || p_partkey"
    elif side == "proposed":
        expression = "case when k % 37 = 0 and i = 6 then 'other.' else 'src.' end || p_partkey"
    return f"""select 'run:' || k as run_key, 'shop.t' || k as relation, '{side}' as side, {name} as column_name,
  {kind} as data_type, {null_flag} as nullable, {ordinal} as ordinal, {expression} as expression
from {_GATE_PART} where {where}"""


def _bridge_nodes(side: str, whole: bool = False) -> str:
    """Facts of one side of a rename bridge, with one changed fact in some runs; unless ``whole``, some runs lack a side or all of them."""
    lacking = "" if whole else " and k % 67 <> 0" + (" and k % 71 <> 0" if side == "patched" else "")
    odd = lambda n, base: f"'{base}' || case when k % {n} = 0 then '{side}' else '' end"
    return f"""select 'run:' || k as run_key, 'shop.t' || k as relation, '{side}' as side,
  {odd(41, 'shop.t')} as relation_identity, {odd(43, 'context')} as query_context_sha256,
  {odd(47, 'config')} as config_sha256, {odd(53, 'constraint')} as model_constraints_sha256,
  {odd(59, 'duckdb')} as adapter_type, k % 61 <> 0 as tests_complete from {_GATE_PART}
where i = 3{lacking}"""


VIEWS: dict[str, str] = {
    # Two snapshots of 25 relations, one per brand.
    "snap_before": """
select p_brand as run_key, p_brand as relation, replace(p_name, ' ', '_') || '_' || p_partkey as column_name,
  p_type as data_type, p_size % 2 = 0 as nullable, cast(p_partkey as int) as ordinal,
  case when p_size <= 2 then 'shared_expr' else 'src.' || p_partkey end as expression
from part where p_partkey % 13 <> 0""",
    "snap_after": """
select p_brand as run_key, p_brand as relation,
  replace(p_name, ' ', '_') || '_' || p_partkey || case when p_partkey % 7 = 0 then '_v2' else '' end as column_name,
  case when p_partkey % 5 = 0 then p_type || '_WIDE' else p_type end as data_type,
  case when p_partkey % 17 = 0 then p_size % 2 <> 0 else p_size % 2 = 0 end as nullable,
  cast(p_partkey as int) as ordinal,
  case when p_size <= 2 then 'shared_expr' else 'src.' || p_partkey end as expression
from part where p_partkey % 11 <> 0""",
    # Many small change sets: one run and one relation per eight parts.
    "gate_before": f"""
select 'run:' || k as run_key, 'shop.t' || k as relation, 'c' || p_partkey as column_name, {_REFERS} as constraint_text,
  case when p_partkey % 53 = 0 then null else p_type end as data_type, p_size % 2 = 0 as nullable, {_PLACE} as ordinal,
  case when p_size <= 2 then 'shared_expr' else 'src.' || p_partkey end as expression
from {_GATE_PART} where p_partkey % 29 <> 0 and k % 43 <> 0""",
    "gate_after": f"""
select 'run:' || k as run_key, 'shop.t' || k as relation,
  'c' || p_partkey || case when p_partkey % 31 = 0 then '_v2' else '' end as column_name, {_REFERS} as constraint_text,
  case when p_partkey % 53 = 0 then null when p_partkey % 37 = 0 then p_type || '_WIDE' else p_type end as data_type,
  case when p_partkey % 17 = 0 then p_size % 2 <> 0 else p_size % 2 = 0 end as nullable, {_PLACE} as ordinal,
  case when p_size <= 2 then 'shared_expr' when p_partkey % 53 = 0 and p_size > 40 then 'other.' || p_partkey
       else 'src.' || p_partkey end as expression
from {_GATE_PART} where p_partkey % 23 <> 0 and k % 41 <> 0""",
    # What the bridges of two thirds of the runs were built to: every column before, and the renamed ones under their new
    # names too, at the end; in odd runs the new column has another type than intended, and some runs lose a constraint.
    "gate_patched": """
select run_key, relation, column_name, case when cast(substr(run_key, 5) as bigint) % 5 <> 3 then constraint_text end as constraint_text,
  data_type, nullable, ordinal, expression from gate_before where cast(substr(run_key, 5) as bigint) % 3 <> 0
union all
select a.run_key, a.relation, a.column_name, a.constraint_text,
  a.data_type || case when cast(substr(a.run_key, 5) as bigint) % 2 = 1 then '_X' else '' end, a.nullable, cast(b.n as int), a.expression
from gate_after a join (select run_key, count(*) as n from gate_before group by run_key) b on b.run_key = a.run_key
where a.column_name like '%~_v2' escape '~' and cast(substr(a.run_key, 5) as bigint) % 3 <> 0""",
    # The evidence of the bridges: nodes, which some runs lack, and test runs, of which some failed, are missing or skipped a test.
    "gate_node": " union all ".join(
        f"""select distinct 'run:' || k as run_key, 'shop.t' || k as relation, '{side}' as side, 'shop.t' || k as relation_identity,
  'context' as query_context_sha256, 'config' as config_sha256, 'constraint' as model_constraints_sha256, 'duckdb' as adapter_type,
  k % 26 <> 0 as tests_complete from {_GATE_PART} where k % 8 <> 4"""
        for side in ("before", "proposed", "patched")
    ),
    "gate_result": f"""
select distinct 'run:' || k as run_key, 'model.shop.t' || k as unique_id, 'success' as status, '' as message
from {_GATE_PART} where k % 9 <> 5
union all
select distinct 'run:' || k, 'test.shop.bridge_t' || k || '.' || k, case when k % 10 = 0 then 'fail' when k % 7 = 3 then 'skipped' else 'pass' end,
  '' from {_GATE_PART} where k % 9 <> 5""",
    "gate_expectation": f"""
select distinct 'run:' || k as run_key, 't' || k as model, 'bridge_t' || k as test, 'failure' as text, 'none' as downstream from {_GATE_PART}""",
    "gate_catalog": f"""
select distinct {_TABLE_URN.format('k')} as urn from {_GATE_PART} where k % 13 <> 0
union all
select distinct 'urn:li:dataset:(urn:li:dataPlatform:lake,SHOP.T' || k || ',PROD)' as urn from {_GATE_PART} where k % 47 = 0""",
    "gate_field": f"""
select {_TABLE_URN.format('k')} as urn, upper('c' || p_partkey) as field_path,
  case when p_partkey % 67 = 0 then null when p_partkey % 71 = 0 then p_type || ' X' else lower(p_type) || ' ' end as native_type
from {_GATE_PART} where p_partkey % 61 <> 0 and (p_partkey % 29 <> 0 or p_partkey % 58 = 0)""",
    "gate_edge": f"""
select {_TABLE_URN.format("cast(floor(l_partkey / 8) as bigint)")} as src_urn, 'c' || l_partkey as src_column,
  {_ORDER_URN.format('l_orderkey')} as dst_urn, 'line_' || l_linenumber as dst_column from lineitem
union all
select {_ORDER_URN.format('o_orderkey')}, cast(null as varchar(10)), {_CUSTOMER_URN}, cast(null as varchar(10))
from orders join customer on o_custkey = c_custkey
union all
select {_CUSTOMER_URN}, cast(null as varchar(10)), {_NATION_URN.format('c_nationkey')}, cast(null as varchar(10)) from customer
union all
select {_TABLE_URN.format('k')}, 'c' || p_partkey, {_NATION_URN.format('p_size % 25')}, 'size' from {_GATE_PART} where p_partkey % 9 = 0""",
    "gate_asset": f"""
select {_CUSTOMER_URN} as urn, c_name as name, c_custkey % 211 <> 0 as ownership_known from customer
union all
select {_ORDER_URN.format('o_orderkey')}, 'order ' || o_orderkey, true from orders where o_orderkey % 997 <> 0
union all
select {_NATION_URN.format('n_nationkey')}, n_name, true from nation""",
    "gate_owner": f"""
select {_CUSTOMER_URN} as urn, 'urn:li:corpGroup:' || n_name as owner
from customer join nation on c_nationkey = n_nationkey where c_nationkey % 5 <> 0
union all
select {_ORDER_URN.format('o_orderkey')}, 'urn:li:corpGroup:priority_' || substr(o_orderpriority, 1, 1)
from orders where o_orderpriority not like '5%'
union all
select {_NATION_URN.format('n_nationkey')}, 'urn:li:corpuser:steward_' || n_regionkey from nation""",
    "gate_tag": f"""
select {_CUSTOMER_URN} as urn, 'urn:li:tag:finance_core' as tag, 'Finance' as tag_name from customer where c_acctbal > 9000
union all
select {_CUSTOMER_URN}, 'urn:li:tag:Contains_PII', cast(null as varchar(10)) from customer where c_acctbal < 0
union all
select {_CUSTOMER_URN}, 'urn:li:tag:internal', 'Internal' from customer
union all
select {_ORDER_URN.format('o_orderkey')}, 'urn:li:tag:business_critical', cast(null as varchar(10))
from orders where o_orderpriority = '1-URGENT'""",
    "gate_assertion": f"""
select 'urn:li:assertion:order_' || o_orderkey as assertion_urn, {_ORDER_URN.format('o_orderkey')} as dataset_urn,
  'order check ' || o_orderkey as name,
  case when o_orderkey % 12 = 0 then null else 'LINE_' || (o_orderkey % 7 + 1) end as field
from orders where o_orderkey % 4 = 0
union all
select distinct 'urn:li:assertion:table_' || k, {_TABLE_URN.format('k')}, 'table check ' || k, 'c' || (8 * k + 3)
from {_GATE_PART} where k % 5 = 0
union all
select 'urn:li:assertion:customer_' || c_custkey,
  'urn:li:dataset:(urn:li:dataPlatform:warehouse,shop.customer_' || c_custkey || ',PROD)', 'balance check', 'balance'
from customer where c_custkey % 500 = 0""",
    # Entity-level lineage and reports of the same asset by several changes.
    "lineage_edge": """
select distinct 'supplier:' || l_suppkey as src_urn, 'part:' || l_partkey as dst_urn from lineitem
union all
select distinct 'part:' || l_partkey, 'order:' || l_orderkey from lineitem
union all
select 'order:' || o_orderkey, 'customer:' || o_custkey from orders""",
    "asset_report": """
select 'run:' || l_returnflag as run_key,
  'change-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey || '-' || cast(l_shipdate as date) as change_id,
  'order:' || l_orderkey as urn,
  case when l_quantity > 49 then 'dashboard' when l_quantity > 47 then 'chart' when l_discount > 0.09 then 'data_job'
       else 'dataset' end as asset_type,
  case when l_tax > 0.07 then null else 'order ' || l_orderkey end as name,
  cast(l_quantity as int) % 3 + 1 as hop_count,
  case when l_linenumber = 7 then null when l_linenumber > 1 then true else false end as has_owners,
  case when l_linenumber > 1 then 'urn:li:corpGroup:ship_' || (l_linenumber % 2) else null end as owner,
  case when l_linestatus = 'O' then true when l_discount = 0 then null else false end as critical_asset,
  case when l_tax = 0 then null else l_quantity > 45 end as sensitive_data,
  l_discount > 0.05 as direct_column_lineage,
  case when l_tax > 0.05 then cast(l_quantity as int) else null end as recent_query_usage_score,
  case when l_tax > 0.06 then 'stale' when l_tax > 0.04 then 'truncated' else 'complete' end as traversal
from lineitem""",
    "result_page": """
select conv_id as request_id, cast(turn as int) as page_no, turn as page_offset, cast(1 as bigint) as returned,
  total, turn + 1 < total as has_more, cast(case when conv_id % 31 = 0 and turn = 2 then 1 else 0 end as int) as truncated_children
from (select c.conv_id, c.turn, t.total from conversations c
  join (select conv_id, count(*) as total from conversations group by conv_id) t on t.conv_id = c.conv_id) c
where not (conv_id % 10 = 0 and turn = 1)""",
    "result_item": """
select conv_id as request_id, cast(turn as int) as page_no,
  'urn:li:dataset:' || case when conv_id % 17 = 0 then role else role || turn end as item_urn,
  cast(case when conv_id % 23 = 0 then 4 else turn % 3 + 1 end as int) as degree
from conversations where not (conv_id % 20 = 10 and turn = 1)""",
    "staged_orders": """
select cast(o_orderkey as bigint) as order_id, cast(o_custkey as varchar(30)) as customer_id,
  cast(o_orderdate as date) as order_date,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'cancelled' end as status,
  cast(o_totalprice as decimal(12, 2)) as order_total, substr(o_orderpriority, 1, 1) as currency
from orders""",
    # Three snapshots of one renamed column per relation; some break a rule.
    "bridge_column": "\nunion all\n".join(
        [
            _bridge_rows("before", "old"),
            _bridge_rows("proposed", "old", "i <> 3"),
            _bridge_rows("proposed", "new", "i = 3"),
            _bridge_rows("patched", "old", "not (k % 13 = 0 and i = 7)"),
            _bridge_rows("patched", "new", "i = 3"),
        ]
    ),
    "bridge_rename": f"""
select 'run:' || k as run_key, 'shop.t' || k as relation, 'c' || p_partkey as old_column, 'c' || p_partkey || '_v2' as new_column,
  p_type as new_type, p_size % 2 = 0 as new_nullable from {_GATE_PART} where i = 3""",
    "bridge_node": "\nunion all\n".join(_bridge_nodes(side) for side in ("before", "proposed", "patched")),
    # The nodes of every run and side.
    "bridge_node_whole": "\nunion all\n".join(_bridge_nodes(side, whole=True) for side in ("before", "proposed", "patched")),
    # Order lines as model tests; some disappear from the patched side.
    "bridge_model_test": """
select distinct 'run:' || k as run_key, 'shop.t' || k as relation, s.side, sha256_of as test_sha256
from (select *, cast(floor(l_partkey / 8) as bigint) as k, l_returnflag || l_linenumber as sha256_of from lineitem) l
join (select 'O' as status, 'before' as side union all select 'O', 'proposed' union all select 'O', 'patched'
  union all select 'F', 'patched') s on s.status = l.l_linestatus
where not (s.side = 'patched' and k % 11 = 0)""",
}

_WORD = re.compile(r"\b[a-z_][a-z_0-9]*\b")


def needed(statement: str, views: dict[str, str] | None = None) -> list[str]:
    """Views a statement refers to, dependencies first."""
    known = VIEWS if views is None else views
    order: list[str] = []

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in known and word not in order:
                if word not in TABLES:
                    visit(known[word])
                order.append(word)

    visit(statement)
    return order


def with_clause(statement: str, extra: dict[str, str] | None = None) -> str:
    """The statement with every view it needs written out before it."""
    known = {**VIEWS, **(extra or {})}
    names = needed(statement, known)
    if not names:
        return statement
    body = statement.strip()
    head = "with " + ",\n".join(f"{n} as ({known[n].strip()})" for n in names)
    if body.lower().startswith("with "):
        return head + ",\n" + body[len("with ") :]
    return head + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the parquet files."""
    sources = {t: f"select * from parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(with_clause(f"select * from {name}", sources))
