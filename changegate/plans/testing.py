"""Queries of the typed staging, the revenue mart, table tests and run verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from changegate.operators import interface, quality
from changegate.plans.views import table, view, with_clause


def _staged(spark, sf_dir):
    return view(spark, sf_dir, "staged_orders")


def _doubles(df, *names):
    """Decimals as doubles, the type both engines print alike."""
    for n in names:
        df = df.withColumn(n, F.col(n).cast("double"))
    return df


def q_stage_orders(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("order_total"),
        F.col("o_orderpriority").alias("currency"),
    )
    return _doubles(quality.stage_orders(raw), "order_total")


def q_daily_revenue(spark, sf_dir):
    return _doubles(quality.daily_revenue(_staged(spark, sf_dir)), "gross_revenue")


def q_reconcile(spark, sf_dir):
    """The mart against a copy that lost its refund days and rounds large sums."""
    mart = quality.daily_revenue(_staged(spark, sf_dir))
    stored = mart.filter(F.dayofmonth("order_date") != 13).withColumn(
        "gross_revenue",
        F.when(F.col("order_count") > 2, F.round("gross_revenue", 0)).otherwise(F.col("gross_revenue")).cast("decimal(14,2)"),
    )
    out = quality.reconcile(mart, stored, ["order_date", "currency"], ["order_count", "gross_revenue"])
    return _doubles(out, "expected_gross_revenue", "actual_gross_revenue")


def q_columns_equal(spark, sf_dir):
    """Lines whose return flag, null for N, is not their line status."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("old_flag"),
        F.when(F.col("l_linestatus") != "F", F.lit("A")).alias("new_flag"),
    )
    return quality.columns_equal(lines, "old_flag", "new_flag")


def q_not_null(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("amount")
    )
    return quality.not_null(events, "amount").select("event_id")


def q_unique(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))
    )
    return quality.unique(lines, ["l_orderkey", "l_linenumber"])


def q_accepted_values(spark, sf_dir):
    staged = _staged(spark, sf_dir).withColumn("status", F.when(F.col("currency") != "5", F.col("status")))
    return quality.accepted_values(staged, "status", ["completed", "pending", "refunded"]).select("order_id", "status")


def q_row_rule(spark, sf_dir):
    """Completed orders must have totals above a floor of their own priority."""
    staged = _staged(spark, sf_dir)
    floor = F.col("currency").cast("int") * 10000
    broken = quality.row_rule(staged, (F.col("status") != "completed") | (F.col("order_total") > floor))
    return _doubles(broken.select("order_id", "order_total"), "order_total")


def q_contract(spark, sf_dir):
    """Declared columns of every relation against the ones that exist afterwards."""
    return quality.contract(
        view(spark, sf_dir, "gate_before"), view(spark, sf_dir, "gate_after"), ["run_key", "relation"]
    )


def q_test_report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    checks = [
        quality.Check("not_null_l_shipdate", F.col("l_shipdate").isNull()),
        quality.Check("accepted_l_returnflag", ~F.col("l_returnflag").isin("A", "R")),
        quality.Check("discount_below_tenth", F.col("l_discount") >= 0.1),
        quality.Check("positive_quantity", F.col("l_quantity") <= 0),
        quality.Check("unique_order_line", unique_on=("l_orderkey", "l_linenumber")),
        quality.Check("unique_all", unique_on=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")),
    ]
    return quality.test_report(lines, checks)


def _run_results(spark, sf_dir):
    """Events as results of test runs, one run per user and hour."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat_ws("/", F.lit("user"), "user_id", F.date_format("ts", "dd HH")).alias("run_key"),
        F.when(kind == "click", "model.shop.stg_orders")
        .when(kind == "view", "model.shop.fct_daily_revenue")
        .when(kind == "error", "test.shop.assert_totals")
        .when(kind == "signup", F.concat(F.lit("test.shop.assert_totals.h"), F.col("event_id") % 3))
        .otherwise(F.concat(F.lit("seed.shop.s"), "event_id"))
        .alias("unique_id"),
        F.when(kind == "error", "Fail")
        .when(kind == "view", F.when(F.col("value") > 20, "skipped").otherwise("success"))
        .when(kind == "signup", "pass")
        .otherwise("success")
        .alias("status"),
        F.when(F.col("value") > 1, "column ORDER_TOTAL not found").alias("message"),
    )


def q_gate_run_results(spark, sf_dir):
    results = _run_results(spark, sf_dir)
    expected = results.select("run_key").distinct().select(
        "run_key",
        F.lit("stg_orders").alias("model"),
        F.lit("assert_totals").alias("test"),
        F.lit("order_total").alias("text"),
        F.lit("fct_daily_revenue").alias("downstream"),
    )
    return quality.gate_run_results(results, expected)


def q_compat_column(spark, sf_dir):
    """The renamed total under both names: equal sums, no differing row, old place kept."""
    renamed = _staged(spark, sf_dir).withColumnRenamed("order_total", "gross_amount")
    bridged = interface.compat_column(renamed, "order_total", "gross_amount")
    order = ",".join(bridged.columns)
    return bridged.groupBy("status").agg(
        F.sum("order_total").cast("double").alias("old_total"),
        F.sum("gross_amount").cast("double").alias("new_total"),
        F.count_if(~F.col("order_total").eqNullSafe(F.col("gross_amount"))).alias("n_differing"),
        F.lit(order).alias("column_order"),
    )


QUERIES = {
    "stage_orders": q_stage_orders,
    "daily_revenue": q_daily_revenue,
    "reconcile": q_reconcile,
    "columns_equal": q_columns_equal,
    "not_null": q_not_null,
    "unique": q_unique,
    "accepted_values": q_accepted_values,
    "row_rule": q_row_rule,
    "contract": q_contract,
    "test_report": q_test_report,
    "gate_run_results": q_gate_run_results,
    "compat_column": q_compat_column,
}

_MART = """select order_date, currency, count(*) as order_count, cast(sum(order_total) as decimal(14, 2)) as gross_revenue
from staged_orders where status = 'completed' group by order_date, currency"""
_STORED = """select order_date, currency, order_count,
  case when order_count > 2 then cast(round(gross_revenue, 0) as decimal(14, 2)) else gross_revenue end as gross_revenue
from mart where day(order_date) <> 13"""
_UNIQUE = """select count(*) from (select 1 from lineitem group by {0} having count(*) > 1) x"""

ORACLES = {
    "stage_orders": """select o_orderkey as order_id, cast(o_custkey as varchar) as customer_id,
cast(o_orderdate as date) as order_date, o_orderstatus as status,
cast(cast(o_totalprice as decimal(12, 2)) as double) as order_total, o_orderpriority as currency from orders""",
    "daily_revenue": with_clause(
        f"select order_date, currency, order_count, cast(gross_revenue as double) as gross_revenue from ({_MART}) m"
    ),
    "reconcile": with_clause(
        """select coalesce(e.order_date, a.order_date) as order_date, coalesce(e.currency, a.currency) as currency,
  e.order_count as expected_order_count, cast(e.gross_revenue as double) as expected_gross_revenue,
  a.order_count as actual_order_count, cast(a.gross_revenue as double) as actual_gross_revenue
from mart e full outer join stored a on e.order_date = a.order_date and e.currency = a.currency
where e.order_count is distinct from a.order_count or e.gross_revenue is distinct from a.gross_revenue""",
        {"mart": _MART, "stored": _STORED},
    ),
    "columns_equal": """select * from (select l_orderkey, l_linenumber, l_partkey,
  case when l_returnflag <> 'N' then l_returnflag end as old_flag,
  case when l_linestatus <> 'F' then 'A' end as new_flag from lineitem) x where old_flag is distinct from new_flag""",
    "not_null": "select event_id from events where event_type = 'error' or value is null",
    "unique": """select l_orderkey, l_linenumber, count(*) as n from lineitem where l_returnflag <> 'R'
group by l_orderkey, l_linenumber having count(*) > 1""",
    "accepted_values": with_clause("""select order_id, status from staged_orders
where currency <> '5' and status not in ('completed', 'pending', 'refunded')"""),
    "row_rule": with_clause("""select order_id, cast(order_total as double) as order_total from staged_orders
where status = 'completed' and order_total <= cast(currency as int) * 10000"""),
    "contract": with_clause("""select * from (select coalesce(b.run_key, a.run_key) as run_key,
  coalesce(b.relation, a.relation) as relation, coalesce(b.column_name, a.column_name) as column_name,
  b.data_type as declared, a.data_type as found,
  case when a.data_type is null then 'missing' when b.data_type is null then 'undeclared'
    when lower(b.data_type) <> lower(a.data_type) then 'type_differs' end as problem
  from gate_before b full outer join gate_after a on a.run_key = b.run_key and a.relation = b.relation
    and a.column_name = b.column_name) x where problem is not null"""),
    "test_report": f"""select test, failures, case when failures = 0 then 'pass' else 'fail' end as status from (
select 'not_null_l_shipdate' as test, (select count(*) from lineitem where l_shipdate is null) as failures
union all select 'accepted_l_returnflag', (select count(*) from lineitem where l_returnflag not in ('A', 'R'))
union all select 'discount_below_tenth', (select count(*) from lineitem where l_discount >= 0.1)
union all select 'positive_quantity', (select count(*) from lineitem where l_quantity <= 0)
union all select 'unique_order_line', ({_UNIQUE.format('l_orderkey, l_linenumber')})
union all select 'unique_all', ({_UNIQUE.format('l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate')})) t""",
    "gate_run_results": """
with r as (select 'user/' || user_id || '/' || strftime(ts, '%d %H') as run_key, event_id, event_type, value,
  case event_type when 'click' then 'model.shop.stg_orders' when 'view' then 'model.shop.fct_daily_revenue'
    when 'error' then 'test.shop.assert_totals' when 'signup' then 'test.shop.assert_totals.h' || (event_id % 3)
    else 'seed.shop.s' || event_id end as unique_id from events)
select run_key, not bool_or(event_type = 'error') as clean,
  bool_or(event_type = 'click') and bool_or(event_type = 'error' and value > 1)
    and bool_or(event_type = 'view' and value > 20) as failed_as_expected,
  bool_or(event_type = 'click') and count(distinct case when event_type = 'signup' then unique_id end) = 1 as verified
from r group by run_key""",
    "compat_column": with_clause("""select status, cast(sum(order_total) as double) as old_total,
cast(sum(order_total) as double) as new_total, 0 as n_differing,
'order_id,customer_id,order_date,status,order_total,currency,gross_amount' as column_order
from staged_orders group by status"""),
}
