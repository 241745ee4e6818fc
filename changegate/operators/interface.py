"""Does a compatibility bridge keep the old interface?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegate.functions import text
from changegate.functions.identity import content_digest, row_digest
from changegate.functions.text import type_fingerprint
from changegate.operators import evidence
from changegate.operators.diff import Diff, schema_diff
from changegate.operators.skew import even_join

SIDES = ("before", "proposed", "patched")
RELATION_KEY = ["run_key", "relation"]
# Node facts that a bridge must leave as they are.
NODE_FACTS = (
    "relation_identity",
    "query_context_sha256",
    "config_sha256",
    "model_constraints_sha256",
    "adapter_type",
)


def compat_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Publish a renamed column under its old name too.

    The old name takes the place the column has in ``df`` and the new name goes
    last, so readers by name and by position see what they saw before.
    """
    if new not in df.columns or old in df.columns:
        raise ValueError("the new name must be a column, and the old name must be free")
    kept = [F.col(new).alias(old) if c == new else F.col(c) for c in df.columns]
    return df.select(*kept, F.col(new))


def column_contracts(columns: DataFrame, fields: list[str]) -> DataFrame:
    """Digest of everything a column promises, from the named contract fields."""
    return columns.withColumn("contract_sha256", row_digest(fields))


def pivot_sides(columns: DataFrame) -> DataFrame:
    """One row per column with its state before, as proposed and as patched."""
    state = F.struct("contract_sha256", "expr_fingerprint", "ordinal", "data_type", "nullable")
    aggs = []
    for side in SIDES:
        here = F.col("side") == side
        aggs.append(F.max(F.when(here, state)).alias(side))
        aggs.append(F.count_if(here).alias(f"n_{side}"))
    return columns.groupBy(*RELATION_KEY, "column_name").agg(*aggs)


def interface_check(
    columns: DataFrame,
    renames: DataFrame,
    nodes: DataFrame | None = None,
    tests: DataFrame | None = None,
) -> DataFrame:
    """One row per rule and relation: (run_key, relation, rule, ok).

    ``columns``: run_key, relation, side, column_name, contract_sha256,
    expr_fingerprint, ordinal (0-based position), data_type, nullable.
    ``renames``: run_key, relation, old_column, new_column, new_type,
    new_nullable.  ``nodes``: one row per run, relation and side with the node
    facts and ``tests_complete``; ``tests``: run_key, relation, side,
    test_sha256.  All rules of a relation come from one grouped pass over its
    columns; position rules use ordinals, so no column list is gathered.

    Every rename needs evidence: its relation's columns and, where ``nodes``
    is given, one node row on each side.  What is absent is a broken rule.
    """
    one = F.struct("old_column", "new_column", "new_type", "new_nullable")
    counted = renames.groupBy(*RELATION_KEY).agg(F.count(F.lit(1)).alias("n_renames"), F.max(one).alias("rename"))
    # A relation with two renames has no bridge to check: it fails, and its columns are not mixed.
    single = counted.filter(F.col("n_renames") == 1).select(*RELATION_KEY, "rename.*")
    sided = even_join(pivot_sides(columns), single, RELATION_KEY, "inner")
    b, p, q = (F.col(s) for s in SIDES)
    is_old = F.col("column_name") == F.col("old_column")
    is_new = F.col("column_name") == F.col("new_column")
    other = ~is_old & ~is_new

    def same(left: Column, right: Column, *names: str) -> Column:
        out = F.lit(True)
        for name in names:
            out = out & left[name].eqNullSafe(right[name])
        return out

    def every(cond: Column, where: Column) -> Column:
        return F.bool_and(F.when(where, F.coalesce(cond, F.lit(False))).otherwise(True))

    def value(where: Column, what: Column) -> Column:
        return F.max(F.when(where, what))

    facts = sided.groupBy(*RELATION_KEY).agg(
        F.bool_and((F.col("n_before") < 2) & (F.col("n_proposed") < 2) & (F.col("n_patched") < 2)).alias(
            "columns_unambiguous"
        ),
        F.bool_and(
            (b.isNull() | b["expr_fingerprint"].isNotNull())
            & (p.isNull() | p["expr_fingerprint"].isNotNull())
            & (q.isNull() | q["expr_fingerprint"].isNotNull())
        ).alias("projection_evidence"),
        every(same(b, q, "contract_sha256"), ~is_new).alias("contracts_kept"),
        every(same(b, q, "ordinal", "expr_fingerprint"), ~is_new).alias("order_kept"),
        every(same(p, q, "contract_sha256"), ~is_old).alias("proposed_contracts_kept"),
        every(same(b, p, "ordinal", "expr_fingerprint"), other).alias("others_as_proposed"),
        F.count(F.when(b.isNotNull(), 1)).alias("n_cols"),
        F.count(F.when(q.isNotNull(), 1)).alias("n_patched_cols"),
        value(is_old, b["contract_sha256"]).alias("old_contract"),
        value(is_old, q["contract_sha256"]).alias("patched_old_contract"),
        value(is_old, b["expr_fingerprint"]).alias("old_expr"),
        value(is_old, q["expr_fingerprint"]).alias("patched_old_expr"),
        value(is_new, q["expr_fingerprint"]).alias("patched_new_expr"),
        value(is_new, p["expr_fingerprint"]).alias("proposed_new_expr"),
        value(is_new, q["ordinal"]).alias("new_ordinal"),
        value(is_new, p["ordinal"]).alias("proposed_ordinal"),
        value(is_old, b["ordinal"]).alias("old_ordinal"),
        F.count(F.when(is_new & b.isNotNull(), 1)).alias("new_before"),
        F.count(F.when(is_old & p.isNotNull(), 1)).alias("old_proposed"),
        value(is_new, type_fingerprint(q["data_type"])).alias("new_type_found"),
        F.max(type_fingerprint(F.col("new_type"))).alias("new_type_wanted"),
        value(is_new, q["nullable"]).alias("new_nullable_found"),
        F.max("new_nullable").alias("new_nullable_wanted"),
    )
    c = F.col
    rules = {
        "columns_unambiguous": c("columns_unambiguous"),
        "projection_evidence": c("projection_evidence"),
        "old_contract_kept": c("old_contract") == c("patched_old_contract"),
        "other_contracts_kept": c("contracts_kept"),
        "old_expression_kept": c("old_expr") == c("patched_old_expr"),
        "bridge_expression": c("patched_old_expr") == c("patched_new_expr"),
        "replacement_last": (c("new_ordinal") == c("n_cols")) & (c("n_patched_cols") == c("n_cols") + 1),
        "earlier_columns_in_order": c("order_kept"),
        "single_intended_addition": (c("new_before") == 0) & c("patched_new_expr").isNotNull(),
        "intended_type": c("new_type_wanted").isNull() | (c("new_type_found") == c("new_type_wanted")),
        "intended_nullability": c("new_nullable_wanted").isNull()
        | (c("new_nullable_found") == c("new_nullable_wanted")),
        "proposed_contracts_kept": c("proposed_contracts_kept"),
        "proposed_expression_kept": c("proposed_new_expr") == c("patched_new_expr"),
        "proposed_replaces_in_place": c("others_as_proposed")
        & (c("proposed_ordinal") == c("old_ordinal"))
        & (c("old_proposed") == 0),
    }
    out = _long(facts, rules).unionByName(_long(counted, {"single_rename": F.col("n_renames") == 1}))
    positions = (
        columns.groupBy(*RELATION_KEY, "side", "ordinal")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*RELATION_KEY)
        .agg((F.max("n") == 1).alias("positions_unique"))
    )
    wanted = counted.select(*RELATION_KEY)
    out = out.unionByName(_long(wanted.join(positions, RELATION_KEY, "left"), {"positions_unique": c("positions_unique")}))
    kinds, observed = [evidence.COLUMNS], evidence.sides_observed(columns, evidence.COLUMNS, SIDES)
    if nodes is not None:
        kinds.append(evidence.NODES)
        observed = observed.unionByName(evidence.sides_observed(nodes, evidence.NODES, SIDES, one_row=True))
        out = out.unionByName(_node_rules(nodes, wanted))
    if tests is not None:
        out = out.unionByName(_test_rules(tests, wanted))
    return out.unionByName(evidence.evidence_check(evidence.requirements(wanted, tuple(kinds)), observed))


def _long(facts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    entries = [
        F.struct(F.lit(name).alias("rule"), F.coalesce(ok, F.lit(False)).alias("ok")) for name, ok in rules.items()
    ]
    return facts.select(*RELATION_KEY, F.inline(F.array(*entries)))


def _node_rules(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts that must be as before and as proposed; a relation without a node on a side keeps none of them."""
    aggs = [F.count_distinct("side").alias("n_sides"), F.count(F.lit(1)).alias("n_rows")]
    for fact in NODE_FACTS:
        for side in SIDES:
            aggs.append(F.max(F.when(F.col("side") == side, F.col(fact))).alias(f"{side}_{fact}"))
    aggs.append(F.bool_and("tests_complete").alias("tests_complete"))
    facts = wanted.join(nodes.groupBy(*RELATION_KEY).agg(*aggs), RELATION_KEY, "left")
    rules = {"three_sides": (F.col("n_sides") == 3) & (F.col("n_rows") == 3)}
    for fact in NODE_FACTS:
        rules[f"{fact}_kept"] = F.col(f"before_{fact}") == F.col(f"patched_{fact}")
        rules[f"{fact}_as_proposed"] = F.col(f"proposed_{fact}") == F.col(f"patched_{fact}")
    rules["test_evidence_complete"] = F.col("tests_complete")
    return _long(facts, rules)


def _test_rules(tests: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every test of the old and of the proposed side is still there when patched."""
    sides = tests.groupBy(*RELATION_KEY, "test_sha256").agg(
        *[F.bool_or(F.col("side") == s).alias(s) for s in SIDES]
    )
    facts = sides.groupBy(*RELATION_KEY).agg(
        F.bool_and(~F.col("before") | F.col("patched")).alias("old_kept"),
        F.bool_and(~F.col("proposed") | F.col("patched")).alias("proposed_kept"),
    )
    # A relation without any test has lost none.
    every = wanted.join(facts, RELATION_KEY, "left")
    true = F.lit(True)
    return _long(
        every,
        {
            "model_tests_kept": F.coalesce("old_kept", true),
            "proposed_tests_kept": F.coalesce("proposed_kept", true),
        },
    )


def interface_proof(checks: DataFrame) -> DataFrame:
    """A run is proven when every rule of every relation holds."""
    return checks.groupBy("run_key").agg(
        F.bool_and("ok").alias("proven"), F.count_if(~F.col("ok")).alias("n_broken_rules")
    )


def residual_diff(columns: DataFrame) -> Diff:
    """Changes that remain between the old and the patched side."""
    plain = columns.drop("side")
    return schema_diff(
        plain.filter(columns["side"] == "before"),
        plain.filter(columns["side"] == "patched"),
        source_path="<verified-counterfactual>",
    )


def attach_tests(tests: DataFrame, nodes: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach test signatures to columns or to whole nodes, in long form.

    ``tests``: run_key, side, test_id, attached_node, column_name, depends_on
    (array), signature (null when the test was not compiled).  ``nodes``:
    run_key, side, unique_id.  ``columns``: run_key, side, unique_id,
    column_name.  Returns digests (run_key, side, unique_id, column_name or
    null, signature, n) and rejections (run_key, reason, detail).
    """
    node_key = ["run_key", "side", "unique_id"]
    is_column = F.col("attached_node").isNotNull() & F.col("column_name").isNotNull()
    on_column = tests.filter(is_column).select(
        "run_key",
        "side",
        F.col("attached_node").alias("unique_id"),
        F.lower("column_name").alias("column_key"),
        "test_id",
        "signature",
    )
    on_column = on_column.join(nodes.select(*node_key).distinct(), node_key, "left_semi")
    keyed = columns.groupBy(*node_key, F.lower("column_name").alias("column_key")).agg(
        F.min("column_name").alias("column_name")
    )
    matched = on_column.join(keyed, [*node_key, "column_key"], "left")
    lost = matched.filter(F.col("column_name").isNull()).select(
        "run_key", F.lit("test_points_to_missing_column").alias("reason"), F.col("test_id").alias("detail")
    )
    targets = F.array_distinct(
        F.array_compact(F.concat(F.coalesce("depends_on", F.array().cast("array<string>")), F.array("attached_node")))
    )
    on_node = (
        tests.filter(~is_column)
        .select("run_key", "side", F.explode(targets).alias("unique_id"), "signature")
        .join(nodes.select(*node_key).distinct(), node_key, "left_semi")
    )
    repeated = tests.filter(
        F.size(F.array_distinct(F.array_compact("depends_on"))) != F.size("depends_on")
    ).select("run_key", F.lit("test_dependencies_invalid").alias("reason"), F.col("test_id").alias("detail"))

    per_column = matched.filter(F.col("column_name").isNotNull()).groupBy(
        *node_key, "column_name", "signature"
    ).agg(F.count(F.lit(1)).alias("n"))
    # A node keeps each signature once, a column keeps its number of tests.
    per_node = on_node.select(*node_key, "signature").distinct().select(
        *node_key, F.lit(None).cast("string").alias("column_name"), "signature", F.lit(1).cast("bigint").alias("n")
    )
    return per_column.unionByName(per_node), lost.unionByName(repeated)


def test_evidence(digests: DataFrame) -> DataFrame:
    """Whether all tests of a node or column were compiled, and their digest."""
    key = ["run_key", "side", "unique_id", "column_name"]
    complete = digests.groupBy(*key).agg(F.bool_and(F.col("signature").isNotNull()).alias("complete"))
    known = content_digest(digests.filter(F.col("signature").isNotNull()), key, ["signature", "n"])
    on = [complete[k].eqNullSafe(known[k]) for k in key]
    cond = on[0] & on[1] & on[2] & on[3]
    return complete.join(known, cond, "left").select(
        *[complete[k] for k in key], "complete", F.col("sha256").alias("tests_sha256")
    )


test_evidence.__test__ = False  # not a test case

CONTRACT_FIELDS = ["column_name", "data_type", "nullable", "not_null", "quote", "constraints", "tests_sha256"]


def constraint_digests(constraints: Column) -> Column:
    """Sorted (kind, digest) pairs of a column's constraints; null stays null.

    ``constraints`` are texts, as for ``text.constraint_kind``.  The digest is over the whole constraint in canonical form, so
    another referenced table, expression or name is another constraint.
    """
    # Constraint kinds kept by name.
    kinds = ("not_null", "unique", "primary_key", "foreign_key", "check", "custom")
    kind = text.constraint_kind
    named = lambda c: F.when(kind(c).isin(*kinds), kind(c)).otherwise("other")
    return F.array_sort(
        F.transform(
            constraints,
            lambda c: F.struct(named(c).alias("type"), F.sha2(text.canonical_json_text(c), 256).alias("sha256")),
        )
    )


def interface_snapshot(nodes: DataFrame, columns: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Digest per node, over its column contracts and node facts.

    ``columns``: run_key, side, unique_id, column_name, data_type, nullable,
    not_null, quote, constraints; ``tests`` is the result of ``test_evidence``.
    """
    node_key = ["run_key", "side", "unique_id"]
    prepared = columns.withColumn("constraints", constraint_digests(F.col("constraints")))
    if tests is not None:
        per_column = tests.filter(F.col("column_name").isNotNull()).select(
            *node_key, "column_name", "tests_sha256"
        )
        prepared = prepared.join(per_column, [*node_key, "column_name"], "left")
    else:
        prepared = prepared.withColumn("tests_sha256", F.lit(None).cast("string"))
    contracts = column_contracts(prepared, CONTRACT_FIELDS)
    digests = content_digest(contracts, node_key, ["column_name", "contract_sha256"]).select(
        *node_key, F.col("sha256").alias("columns_sha256"), F.col("row_count").alias("n_columns")
    )
    out = nodes.join(digests, node_key, "left")
    facts = [
        c
        for c in ("resource_type", "relation", "config_sha256", "model_constraints_sha256", "query_context_sha256")
        if c in nodes.columns
    ]
    return out.withColumn("node_sha256", row_digest([*facts, "columns_sha256"])).select(
        *node_key, F.coalesce("n_columns", F.lit(0)).alias("n_columns"), "columns_sha256", "node_sha256"
    )


def snapshot_digest(node_digests: DataFrame) -> DataFrame:
    """One digest per run and side over its nodes; node names do not count."""
    return content_digest(node_digests, ["run_key", "side"], ["node_sha256"])
