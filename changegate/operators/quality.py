"""Typed staging, the revenue mart, table data tests and test-run verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegate.functions.text import type_fingerprint
from changegate.operators.skew import even_join

# The typed columns of the staging table.
STAGED_ORDER_TYPES = {
    "order_id": "bigint",
    "customer_id": "string",
    "order_date": "date",
    "status": "string",
    "order_total": "decimal(12,2)",
    "currency": "string",
}


def stage_orders(orders: DataFrame) -> DataFrame:
    return orders.select(*[F.col(c).cast(t).alias(c) for c, t in STAGED_ORDER_TYPES.items()])


def daily_revenue(staged: DataFrame) -> DataFrame:
    """Completed orders per date and currency."""
    return (
        staged.filter(F.col("status") == "completed")
        .groupBy("order_date", "currency")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("order_total").cast("decimal(14,2)").alias("gross_revenue"),
        )
    )


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Keys whose recomputed and stored measures differ; a missing side differs."""
    left = expected.select(*keys, *[F.col(m).alias(f"expected_{m}") for m in measures])
    right = actual.select(*keys, *[F.col(m).alias(f"actual_{m}") for m in measures])
    differs = F.lit(False)
    for m in measures:
        differs = differs | ~F.col(f"expected_{m}").eqNullSafe(F.col(f"actual_{m}"))
    return left.join(right, keys, "full_outer").filter(differs)


def columns_equal(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows in which two columns differ; two nulls are equal."""
    return df.filter(~F.col(left).eqNullSafe(F.col(right)))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once; keys with a null are no keys."""
    usable = df
    for c in columns:
        usable = usable.filter(F.col(c).isNotNull())
    return usable.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is outside the list; null passes."""
    return df.filter(~F.col(column).isin(*values))


def row_rule(df: DataFrame, rule: Column) -> DataFrame:
    """Rows that break a rule; an unknown result is not a failure."""
    return df.filter(~rule)


def contract(expected: DataFrame, actual: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Declared against existing columns: missing, undeclared, or of another type.

    Both sides list columns as rows (keys..., column_name, data_type), so any
    number of tables is checked in one join.
    """
    by = [*(keys or []), "column_name"]
    left = expected.select(*by, F.col("data_type").alias("declared"))
    right = actual.select(*by, F.col("data_type").alias("found"))
    same = type_fingerprint(F.col("declared")) == type_fingerprint(F.col("found"))
    problem = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("declared").isNull(), "undeclared")
        .when(~same, "type_differs")
    )
    joined = left.join(right, by, "full_outer").withColumn("problem", problem)
    return joined.filter(F.col("problem").isNotNull())


@dataclass(frozen=True)
class Check:
    """One table test: ``failing`` marks bad rows, or ``unique_on`` names a key."""

    name: str
    failing: Column | None = None
    unique_on: tuple[str, ...] = ()


def test_report(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Failures and status of every test: one pass for row tests, one per key."""
    row_checks = [c for c in checks if not c.unique_on]
    entry = lambda name, n: F.struct(F.lit(name).alias("test"), n.alias("failures"))
    parts = []
    if row_checks:
        counted = df.agg(*[F.count_if(c.failing).alias(f"n{i}") for i, c in enumerate(row_checks)])
        parts.append(
            counted.select(F.inline(F.array(*[entry(c.name, F.col(f"n{i}")) for i, c in enumerate(row_checks)])))
        )
    for c in checks:
        if c.unique_on:
            n = unique(df, list(c.unique_on)).agg(F.count(F.lit(1)).alias("n"))
            parts.append(n.select(F.inline(F.array(entry(c.name, F.col("n"))))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumn("status", F.when(F.col("failures") == 0, "pass").otherwise("fail"))


test_report.__test__ = False  # not a test case

# Statuses of a test run.
FAILED = ("error", "fail", "failed")
BLOCKED = ("error", "fail", "failed", "skipped")
SUCCEEDED = ("pass", "success")


def gate_run_results(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """Verdicts of test runs: clean, failing as expected, and verified.

    ``results``: run_key, unique_id, status, message.  ``expectations``, one row
    per run: model, test, text, downstream.  A run is verified when exactly one
    node of the model and exactly one of the test succeeded.
    """
    joined = even_join(results, expectations, ["run_key"], "inner")
    status = F.lower("status")
    uid = F.col("unique_id")
    is_model = uid.startswith("model.")
    ends = lambda name: F.endswith(uid, F.concat(F.lit("."), F.col(name)))
    parts = F.split(uid, r"\.")
    is_test = uid.startswith("test.") & F.coalesce(F.try_element_at(parts, F.lit(3)) == F.col("test"), F.lit(False))
    message = F.lower(F.coalesce("message", F.lit("")))
    per_node = joined.groupBy("run_key", "unique_id").agg(
        F.bool_or(status.isin(*FAILED)).alias("failed"),
        F.bool_or(is_model & ends("model") & (status == "success")).alias("model_ok"),
        F.bool_or(ends("test") & status.isin(*FAILED) & F.contains(message, F.lower("text"))).alias("test_failed"),
        F.bool_or(is_model & ends("downstream") & status.isin(*BLOCKED)).alias("blocked"),
        F.bool_or(is_model & ends("model") & status.isin(*SUCCEEDED)).alias("model_done"),
        F.bool_or(is_test & status.isin(*SUCCEEDED)).alias("test_done"),
    )
    return per_node.groupBy("run_key").agg(
        (~F.bool_or("failed")).alias("clean"),
        (F.bool_or("model_ok") & F.bool_or("test_failed") & F.bool_or("blocked")).alias("failed_as_expected"),
        ((F.count_if("model_done") == 1) & (F.count_if("test_done") == 1)).alias("verified"),
    )
