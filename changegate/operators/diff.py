"""Column-level comparison of two sets of table descriptions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegate.constants import (
    ADDITIVE_TYPES,
    CHANGE_TYPE_ALIASES,
    GENERIC_CHANGE_TYPES,
    NULLABILITY_TYPES,
    SPECIFIC_CHANGE_TYPES,
    TYPE_CHANGE_TYPES,
)
from changegate.functions.identity import change_id
from changegate.functions.text import normalize_identifier, posix_path
from changegate.operators.skew import even_join, exclude_runs
from changegate.session import cut_lineage

COLUMN_KEY = ["run_key", "relation", "column_name"]
STATE_FIELDS = ["data_type", "data_type_from_projection", "nullable", "has_projection", "expr_fingerprint"]
CHANGE_FIELDS = [
    "change_type",
    "old_column",
    "new_column",
    "old_type",
    "new_type",
    "old_nullable",
    "new_nullable",
    "evidence_refs",
]
CHANGE_COLUMNS = ["run_key", "change_id", "relation", *CHANGE_FIELDS, "source_path", "confidence"]


@dataclass(frozen=True)
class Diff:
    """Changes of accepted change sets, and why the other sets were rejected."""

    changes: DataFrame
    rejections: DataFrame


def _with_state(columns: DataFrame) -> DataFrame:
    """Fill optional state columns, so a plain column listing can be compared too."""
    out = columns
    if "expr_fingerprint" not in out.columns:
        out = out.withColumn("expr_fingerprint", F.lit(None).cast("string"))
    if "has_projection" not in out.columns:
        out = out.withColumn("has_projection", F.col("expr_fingerprint").isNotNull())
    if "data_type_from_projection" not in out.columns:
        out = out.withColumn("data_type_from_projection", F.lit(False))
    return out.select(*COLUMN_KEY, F.struct(*STATE_FIELDS).alias("state"))


def pair_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per (run, relation, column) with its state on either side.

    A grouped union instead of a full outer join: one shuffle, map-side
    combining, duplicate detection in the same pass, and an output that stays
    hash-partitioned by the column key for the steps that follow.
    """
    sides = (
        _with_state(before)
        .withColumn("is_old", F.lit(True))
        .unionByName(_with_state(after).withColumn("is_old", F.lit(False)))
    )
    return sides.groupBy(*COLUMN_KEY).agg(
        F.max(F.when(F.col("is_old"), F.col("state"))).alias("old"),
        F.max(F.when(~F.col("is_old"), F.col("state"))).alias("new"),
        F.count_if(F.col("is_old")).alias("n_old"),
        F.count_if(~F.col("is_old")).alias("n_new"),
    )


def infer_renames(pairs: DataFrame) -> DataFrame:
    """Removed and added columns whose output expression matches one to one.

    Per (run, relation, fingerprint) only two counts and two states are kept.
    A fingerprint shared by many columns is therefore one small group, not a
    product of pairs, and by being ambiguous yields no rename.
    """
    moved = pairs.filter((F.col("n_old") == 0) != (F.col("n_new") == 0)).select(
        "run_key",
        "relation",
        F.coalesce("old.expr_fingerprint", "new.expr_fingerprint").alias("fingerprint"),
        F.when(F.col("n_new") == 0, F.struct("column_name", "old")).alias("gone"),
        F.when(F.col("n_old") == 0, F.struct("column_name", "new")).alias("come"),
    )
    return (
        moved.filter(F.col("fingerprint").isNotNull())
        .groupBy("run_key", "relation", "fingerprint")
        .agg(
            F.count("gone").alias("n_gone"),
            F.count("come").alias("n_come"),
            F.max("gone").alias("gone"),
            F.max("come").alias("come"),
        )
        .filter((F.col("n_gone") == 1) & (F.col("n_come") == 1))
        .select(
            "run_key",
            "relation",
            "fingerprint",
            F.col("gone.column_name").alias("old_column"),
            F.col("come.column_name").alias("new_column"),
            F.col("gone.old").alias("old"),
            F.col("come.new").alias("new"),
        )
    )


def _relation_sides(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which sides know a relation: one small row per relation."""
    sides = (
        before.select("run_key", "relation")
        .withColumn("is_old", F.lit(True))
        .unionByName(after.select("run_key", "relation").withColumn("is_old", F.lit(False)))
    )
    return sides.groupBy("run_key", "relation").agg(
        F.bool_or("is_old").alias("in_before"), F.bool_or(~F.col("is_old")).alias("in_after")
    )


def _rejection(df: DataFrame, reason: Column | str, detail: Column) -> DataFrame:
    text = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("run_key", text.alias("reason"), detail.alias("detail"))


def removed_relations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Relations that vanish reject their whole change set; new ones are ignored."""
    gone = _relation_sides(before, after).filter(F.col("in_before") & ~F.col("in_after"))
    return _rejection(gone, "removed_relation", F.col("relation"))


def duplicates(df: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Keys that occur more than once inside a change set."""
    repeated = df.groupBy(*keys).count().filter(F.col("count") > 1)
    others = [k for k in keys if k != "run_key"]
    detail = F.concat_ws(".", *[F.col(k).cast("string") for k in others])
    return _rejection(repeated, reason, detail)


def check_adapter(nodes: DataFrame, explicit: str | None = None) -> DataFrame:
    """All sides of a change set, and an explicit choice, must name one adapter."""
    lowered = F.lower("adapter_type")
    named = nodes.select(
        "run_key",
        F.when(lowered == "postgresql", "postgres").when(lowered != "", lowered).alias("adapter"),
    )
    seen = named.groupBy("run_key").agg(F.min("adapter").alias("low"), F.max("adapter").alias("high"))
    bad = F.col("low") != F.col("high")
    if explicit is not None:
        wanted = "postgres" if explicit.lower() == "postgresql" else explicit.lower()
        bad = bad | (F.col("low") != wanted)
    return _rejection(seen.filter(bad), "adapter_mismatch", F.concat_ws(",", "low", "high"))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _change(kind: str, refs: Column, **given: Column) -> Column:
    defaults = {
        "old_column": "string",
        "new_column": "string",
        "old_type": "string",
        "new_type": "string",
        "old_nullable": "boolean",
        "new_nullable": "boolean",
    }
    fields = [given.get(name, _null(t)).alias(name) for name, t in defaults.items()]
    return F.struct(F.lit(kind).alias("change_type"), *fields, refs.alias("evidence_refs"))


def _refs(*refs: Column | str) -> Column:
    return F.array(*[F.lit(r) if isinstance(r, str) else r for r in refs])


# Evidence references recorded with each kind of change.
REF_COLUMN_SET = "dbt:column-set:removed-and-added"
REF_EXPRESSION = "dbt:compiled-expression:"
REF_REMOVED = "dbt:column-removed"
REF_ADDED = "dbt:column-added"
REF_TYPE = "dbt:data-type-changed"
REF_CAST_TYPE = "dbt:compiled-direct-cast-type-changed"
REF_NULLABILITY = "dbt:nullability-changed"


def _type_change(old: Column, new: Column, old_name: Column, new_name: Column) -> Column:
    from_cast = old["data_type_from_projection"] | new["data_type_from_projection"]
    return F.when(
        old["data_type"] != new["data_type"],
        _change(
            "type_change",
            _refs(F.when(from_cast, F.lit(REF_CAST_TYPE)).otherwise(F.lit(REF_TYPE))),
            old_column=old_name,
            new_column=new_name,
            old_type=old["data_type"],
            new_type=new["data_type"],
        ),
    )


def _nullability_change(old: Column, new: Column, old_name: Column, new_name: Column) -> Column:
    return F.when(
        old["nullable"] != new["nullable"],
        _change(
            "nullability_change",
            _refs(REF_NULLABILITY),
            old_column=old_name,
            new_column=new_name,
            old_nullable=old["nullable"],
            new_nullable=new["nullable"],
        ),
    )


def _untyped_rewrite(old: Column, new: Column) -> Column:
    """A kept column whose expression changed or is unproven while a type is unknown."""
    proven = (~old["has_projection"] & ~new["has_projection"]) | F.coalesce(
        old["expr_fingerprint"] == new["expr_fingerprint"], F.lit(False)
    )
    return ~proven & (old["data_type"].isNull() | new["data_type"].isNull())


def attribute_changes(matched: DataFrame) -> DataFrame:
    """Type and nullability changes of kept or renamed columns.

    ``matched`` carries run_key, relation, old_column, new_column, old and new.
    """
    o, n, on, nn = (F.col(c) for c in ("old", "new", "old_column", "new_column"))
    found = F.array(_type_change(o, n, on, nn), _nullability_change(o, n, on, nn))
    return matched.select("run_key", "relation", F.inline(F.array_compact(found)))


def classify_columns(pairs: DataFrame) -> DataFrame:
    """Changes and rejections of paired columns in one pass.

    Each rename is attached to its old and its new column by their own unique
    keys, which is the partitioning ``pairs`` already has; one explode then
    emits everything a column gives rise to.  Rejections carry ``reason``.
    """
    renames = infer_renames(pairs)
    partner = F.struct(F.col("new_column").alias("name"), F.col("new").alias("state"))
    members = renames.select(
        "run_key",
        "relation",
        F.inline(
            F.array(
                F.struct(F.col("old_column").alias("column_name"), F.lit("gone").alias("role"), partner.alias("to")),
                F.struct(F.col("new_column").alias("column_name"), F.lit("come").alias("role"), partner.alias("to")),
            )
        ),
    )
    joined = pairs.join(members, COLUMN_KEY, "left")
    renamed = F.col("role").eqNullSafe("gone")
    alone = F.col("role").isNull()
    matched = renamed | ((F.col("n_old") > 0) & (F.col("n_new") > 0))
    joined = joined.select(
        "run_key",
        "relation",
        F.col("column_name").alias("old_column"),
        F.when(renamed, F.col("to.name")).otherwise(F.col("column_name")).alias("new_column"),
        "old",
        F.when(renamed, F.col("to.state")).otherwise(F.col("new")).alias("new"),
        renamed.alias("renamed"),
        matched.alias("matched"),
        (alone & (F.col("n_new") == 0)).alias("dropped"),
        (alone & (F.col("n_old") == 0)).alias("added"),
        ((F.col("n_old") > 1) | (F.col("n_new") > 1)).alias("repeated"),
    )
    o, n, on, nn = (F.col(c) for c in ("old", "new", "old_column", "new_column"))
    digest = F.substring(F.sha2(o["expr_fingerprint"], 256), 1, 16)
    rename = _change(
        "rename_column",
        _refs(REF_COLUMN_SET, F.concat(F.lit(REF_EXPRESSION), digest)),
        old_column=on,
        new_column=nn,
        old_type=o["data_type"],
        new_type=n["data_type"],
        old_nullable=o["nullable"],
        new_nullable=n["nullable"],
    )
    drop = _change(
        "drop_column",
        _refs(REF_REMOVED),
        old_column=on,
        old_type=o["data_type"],
        old_nullable=o["nullable"],
    )
    add = _change(
        "add_column",
        _refs(REF_ADDED),
        new_column=nn,
        new_type=n["data_type"],
        new_nullable=n["nullable"],
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("renamed"), rename),
            F.when(F.col("dropped"), drop),
            F.when(F.col("added"), add),
            F.when(F.col("matched"), _type_change(o, n, on, nn)),
            F.when(F.col("matched"), _nullability_change(o, n, on, nn)),
        )
    )
    no_change = F.lit(None).cast(_CHANGE_TYPE)
    entry = lambda change, reason: F.struct(change.alias("change"), reason.alias("reason"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("repeated"), entry(no_change, F.lit("duplicate_column"))),
            F.when(
                F.col("matched") & _untyped_rewrite(o, n), entry(no_change, F.lit("untyped_expression_change"))
            ),
        )
    )
    every = F.concat(F.transform(found, lambda c: entry(c, F.lit(None).cast("string"))), problems)
    return joined.select(
        "run_key", "relation", F.concat_ws(".", "relation", "old_column").alias("detail"), F.inline(every)
    )


_CHANGE_TYPE = (
    "struct<change_type:string,old_column:string,new_column:string,old_type:string,new_type:string,"
    "old_nullable:boolean,new_nullable:boolean,evidence_refs:array<string>>"
)


def classified_rows(
    before: DataFrame, after: DataFrame, before_nodes: DataFrame | None = None, after_nodes: DataFrame | None = None
) -> DataFrame:
    """Every change and every reason for rejection, before whole sets are rejected."""
    relations = _relation_sides(
        before if before_nodes is None else before_nodes,
        after if after_nodes is None else after_nodes,
    )
    # Columns of a relation that only exists afterwards are no change.
    only_new = relations.filter(~F.col("in_before")).select("run_key", "relation")
    classified = even_join(classify_columns(pair_columns(before, after)), only_new, ["run_key", "relation"], "left_anti")
    gone = relations.filter(F.col("in_before") & ~F.col("in_after")).select(
        "run_key",
        "relation",
        F.col("relation").alias("detail"),
        F.lit(None).cast(_CHANGE_TYPE).alias("change"),
        F.lit("removed_relation").alias("reason"),
    )
    return classified.unionByName(gone)


def schema_diff(
    before: DataFrame,
    after: DataFrame,
    source_path: Column | str = "<after>",
    before_nodes: DataFrame | None = None,
    after_nodes: DataFrame | None = None,
    rejections: DataFrame | None = None,
    staged: bool = True,
) -> Diff:
    """All changes of every change set, with whole-set rejection.

    ``before_nodes``/``after_nodes`` list the relations of each side when some
    have no column at all; ``rejections`` adds reasons found earlier.  Changes
    and rejections have several readers, so by default the (small) classified
    rows are written once to the shared folder instead of comparing twice.
    """
    classified = classified_rows(before, after, before_nodes, after_nodes)
    if staged:
        classified = cut_lineage(classified)

    rejected = _rejection(classified.filter(F.col("reason").isNotNull()), F.col("reason"), F.col("detail"))
    if rejections is not None:
        rejected = rejected.unionByName(rejections.select("run_key", "reason", "detail"))
    found = classified.filter(F.col("reason").isNull()).select("run_key", "relation", "change.*")
    accepted = exclude_runs(found, rejected)
    path = F.lit(source_path) if isinstance(source_path, str) else source_path
    return Diff(finish_changes(accepted.withColumn("source_path", posix_path(path))), rejected)


def finish_changes(changes: DataFrame) -> DataFrame:
    """Fill identifier and confidence and order the columns."""
    given = F.col("change_id") if "change_id" in changes.columns else None
    out = changes.withColumn("change_id", change_id(given))
    if "confidence" not in out.columns:
        out = out.withColumn("confidence", F.lit("high"))
    return out.select(*CHANGE_COLUMNS)


def canonical_order(changes: DataFrame) -> DataFrame:
    """Order for presentation: relation, kind, old column, new column."""
    rank = F.array_position(
        F.array(*[F.lit(t) for t in GENERIC_CHANGE_TYPES]), F.col("change_type")
    )
    return changes.orderBy(
        "run_key",
        "relation",
        F.when(rank == 0, 99).otherwise(rank),
        F.coalesce("old_column", F.lit("")),
        F.coalesce("new_column", F.lit("")),
    )


def change_type_of(raw: Column) -> Column:
    """Resolve short aliases; an unknown type gives null."""
    text = F.lower(F.trim(raw))
    aliases = F.create_map(*[F.lit(x) for pair in CHANGE_TYPE_ALIASES.items() for x in pair])
    known = F.when(raw.isin(*GENERIC_CHANGE_TYPES, *SPECIFIC_CHANGE_TYPES), raw)
    return F.coalesce(known, F.try_element_at(aliases, text))


def severity_key() -> Column:
    """Policy key of a change; unknown compatibility is never the milder class."""
    kind = F.col("change_type")
    tightened = F.col("old_nullable") & ~F.col("new_nullable")
    return (
        F.when(kind == "type_change", "incompatible_type")
        .when(
            kind == "add_column",
            F.when(F.col("new_nullable"), "add_nullable_column").otherwise("add_required_column"),
        )
        .when(
            kind == "nullability_change",
            F.when(tightened, "nullable_to_required").otherwise("widening_type"),
        )
        .otherwise(kind)
    )


def validate_changes(changes: DataFrame) -> DataFrame:
    """Rule violations of change records, one row per broken rule."""
    kind = F.col("change_type")
    old_c, new_c = F.col("old_column"), F.col("new_column")
    old_t, new_t = F.col("old_type"), F.col("new_type")
    old_n, new_n = F.col("old_nullable"), F.col("new_nullable")
    known = kind.isin(*GENERIC_CHANGE_TYPES, *SPECIFIC_CHANGE_TYPES)
    rules = {
        "unknown_change_type": ~F.coalesce(known, F.lit(False)),
        "add_needs_new_column": kind.isin(*ADDITIVE_TYPES) & new_c.isNull(),
        "drop_needs_old_column": (kind == "drop_column") & old_c.isNull(),
        "rename_needs_both_columns": (kind == "rename_column") & (old_c.isNull() | new_c.isNull()),
        "rename_needs_distinct_columns": (kind == "rename_column") & (old_c == new_c),
        "type_change_needs_both_types": kind.isin(*TYPE_CHANGE_TYPES) & (old_t.isNull() | new_t.isNull()),
        "type_change_needs_distinct_types": kind.isin(*TYPE_CHANGE_TYPES) & (F.lower(old_t) == F.lower(new_t)),
        "nullability_needs_both_flags": kind.isin(*NULLABILITY_TYPES) & (old_n.isNull() | new_n.isNull()),
        "nullability_needs_a_change": kind.isin(*NULLABILITY_TYPES) & (old_n == new_n),
        "required_needs_true_to_false": (kind == "nullable_to_required")
        & ~F.coalesce(old_n & ~new_n, F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return changes.select("run_key", "change_id", "change_type", F.explode(broken).alias("violation"))


# Evidence reference per accepted action of a change log.
DDL_REFS = {
    "add": "sqlglot:ColumnDef",
    "drop": "sqlglot:Drop",
    "rename": "sqlglot:RenameColumn",
    "type": "sqlglot:AlterColumn",
    "set_not_null": "sqlglot:AlterColumn",
    "drop_not_null": "sqlglot:AlterColumn",
}


def changes_from_ddl_log(actions: DataFrame, source_path: str = "<sql>") -> Diff:
    """Normalise a tokenised ALTER log; one unsupported action rejects its batch.

    ``actions``: run_key, relation, action, column_name, column_quoted,
    new_name, new_quoted, data_type, not_null, modifier.  A non-empty modifier
    (cascade, purge, using, collate, default, other constraint) is unsupported.
    """
    action = F.lower(F.trim("action"))
    column = normalize_identifier(F.col("column_name"), F.col("column_quoted"))
    target = normalize_identifier(F.col("new_name"), F.col("new_quoted"))
    typed = F.when(F.trim("data_type") != "", F.col("data_type"))
    supported = (
        F.coalesce(F.trim("modifier"), F.lit("")).eqNullSafe("")
        & column.isNotNull()
        & F.when(action == "rename", target.isNotNull() & (target != column))
        .when(action.isin("add", "type"), typed.isNotNull())
        .otherwise(action.isin("drop", "set_not_null", "drop_not_null"))
    )
    staged = actions.withColumn("_ok", F.coalesce(supported, F.lit(False)))
    rejected = _rejection(
        staged.filter(~F.col("_ok")).groupBy("run_key").agg(F.count(F.lit(1)).alias("n")),
        "unsupported_action",
        F.col("n").cast("string"),
    )
    refs = F.create_map(*[F.lit(x) for pair in DDL_REFS.items() for x in pair])
    ref = F.array(F.try_element_at(refs, action))
    not_null = F.coalesce("not_null", F.lit(False))
    change = (
        F.when(
            action == "add",
            _change("add_column", ref, new_column=column, new_type=typed, new_nullable=~not_null),
        )
        .when(action == "drop", _change("drop_column", ref, old_column=column))
        .when(action == "rename", _change("rename_column", ref, old_column=column, new_column=target))
        .when(
            action == "type",
            _change(
                "type_change",
                ref,
                old_column=column,
                new_column=column,
                old_type=F.lit("UNKNOWN"),
                new_type=typed,
            ),
        )
        .otherwise(
            _change(
                "nullability_change",
                ref,
                old_column=column,
                new_column=column,
                old_nullable=action == "set_not_null",
                new_nullable=action == "drop_not_null",
            )
        )
    )
    good = staged.filter("_ok").select("run_key", "relation", F.inline(F.array(change)))
    accepted = exclude_runs(good, rejected)
    return Diff(finish_changes(accepted.withColumn("source_path", posix_path(F.lit(source_path)))), rejected)


__all__ = [
    "Diff",
    "attribute_changes",
    "canonical_order",
    "change_type_of",
    "changes_from_ddl_log",
    "check_adapter",
    "duplicates",
    "infer_renames",
    "pair_columns",
    "removed_relations",
    "schema_diff",
    "severity_key",
    "validate_changes",
]
