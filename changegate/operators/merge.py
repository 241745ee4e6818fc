"""Merging what several changes of one run say about the same assets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegate.constants import ASSET_TYPE_RANK, CONFLICT_FACTS, EVIDENCE_FIELDS, STATUS_RANK
from changegate.operators.score import with_fact_states
from changegate.session import cut_lineage

ASSET_KEY = ["run_key", "urn"]
SET_FACTS = {"owners": "has_owners", "assertion_urns": "has_assertions"}
SCALAR_FACTS = (
    "asset_type",
    "hop_count",
    "critical_asset",
    "sensitive_data",
    "direct_column_lineage",
    "recent_query_usage_score",
)


def _rank(value: Column, ranks: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), value)


def _named(rank: Column, ranks: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, r in ranks.items() for x in (r, n)]), rank)


def three_valued_or(value: Column) -> Column:
    """True if any is true, else null if any is null, else false."""
    return (
        F.when(F.bool_or(value), F.lit(True))
        .when(F.count(value) < F.count(F.lit(1)), F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def all_or_null(value: Column) -> Column:
    """Three-valued state of a merged list: null if any list is unknown."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.bool_or(value))


def _disagree(value: Column) -> Column:
    """Values of a group are not all equal; null equals null only."""
    some_null = F.count(value) < F.count(F.lit(1))
    all_null = F.count(value) == 0
    return ~all_null & (some_null | (F.min(value) != F.max(value)))


EVIDENCE_FACT = "evidence_refs"


def members_of(impacted: DataFrame) -> DataFrame:
    """Long form of the list columns, evidence references included: (run, change, urn, fact, member)."""
    parts = [
        impacted.select(
            "run_key", "change_id", "urn", F.lit(fact).alias("fact"), F.explode(fact).alias("member")
        ).distinct()
        for fact in (*SET_FACTS, EVIDENCE_FACT)
        if fact in impacted.columns
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@dataclass(frozen=True)
class Merged:
    """One row per (run, asset), the conflicts found, the merged lists, and the assets whose reports differ in anything."""

    assets: DataFrame
    conflicts: DataFrame
    members: DataFrame
    differing: DataFrame | None = None


def merge_assets(impacted: DataFrame, members: DataFrame | None = None, staged: bool = False) -> Merged:
    """Merge the reports of all changes of a run conservatively.

    One grouped pass keeps the riskiest type, the nearest hop and three-valued
    flags, and tests all scalar facts for disagreement by minimum, maximum and
    null count.  The list facts stay in long form (``members``): two changes
    agree on a list exactly when every member is reported by all of them.
    ``staged`` writes the merged rows once for the readers of the three results.  Without it, the assets come from the grouped
    pass alone: who reads only them moves no list.
    """
    rows = with_fact_states(impacted)
    if members is None:
        members = members_of(impacted)
    rows = rows.withColumn("type_rank", _rank(F.col("asset_type"), ASSET_TYPE_RANK))
    column_of = {"asset_type": "type_rank", **{f: f for f in SCALAR_FACTS if f != "asset_type"}, **SET_FACTS}
    grouped = rows.groupBy(*ASSET_KEY).agg(
        F.max("type_rank").alias("type_rank"),
        F.min("name").alias("name"),
        F.min("hop_count").alias("hop_count"),
        all_or_null(F.col("has_owners")).alias("has_owners"),
        all_or_null(F.col("has_assertions")).alias("has_assertions"),
        three_valued_or(F.col("critical_asset")).alias("critical_asset"),
        three_valued_or(F.col("sensitive_data")).alias("sensitive_data"),
        three_valued_or(F.col("direct_column_lineage")).alias("direct_column_lineage"),
        F.max("recent_query_usage_score").alias("recent_query_usage_score"),
        F.count(F.lit(1)).alias("n_reports"),
        *[_disagree(F.col(col)).alias(f"differs_{fact}") for fact, col in column_of.items()],
        _disagree(F.col("name")).alias("differs_name"),
    )
    shared = (
        members.groupBy(*ASSET_KEY, "fact", "member")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*ASSET_KEY)
        .agg(*[F.min(F.when(F.col("fact") == f, F.col("n"))).alias(f"shared_{f}") for f in (*SET_FACTS, EVIDENCE_FACT)])
    )
    merged = grouped.join(shared, ASSET_KEY, "left")
    for fact in SET_FACTS:
        partial = F.coalesce(F.col(f"shared_{fact}") < F.col("n_reports"), F.lit(False))
        merged = merged.withColumn(f"differs_{fact}", F.col(f"differs_{fact}") | partial)
    # Reports are the same as a whole if they agree on every fact, the name and all evidence.
    differs = F.coalesce(F.col(f"shared_{EVIDENCE_FACT}") < F.col("n_reports"), F.lit(False))
    for fact in (*column_of, "name"):
        differs = differs | F.col(f"differs_{fact}")
    merged = merged.withColumn("differs", differs)
    if staged:
        merged = cut_lineage(merged)

    entries = [
        F.when(
            F.col(f"differs_{fact}"),
            F.struct(
                F.lit(fact).alias("field"), F.lit(kind).alias("kind"), F.lit(state).alias("state_field")
            ),
        )
        for fact, kind, state in CONFLICT_FACTS
    ]
    conflicts = merged.select(*ASSET_KEY, F.inline(F.array_compact(F.array(*entries))))
    assets = (merged if staged else grouped).select(
        *ASSET_KEY,
        _named(F.col("type_rank"), ASSET_TYPE_RANK).alias("asset_type"),
        "name",
        "hop_count",
        "has_owners",
        "has_assertions",
        "critical_asset",
        "sensitive_data",
        "direct_column_lineage",
        "recent_query_usage_score",
        "n_reports",
    )
    # A list that is unknown in any report is unknown as a whole; evidence is only ever added to.
    known = assets.select(
        *ASSET_KEY,
        F.explode(
            F.array_compact(
                F.array(
                    F.lit(EVIDENCE_FACT), *[F.when(F.col(flag).isNotNull(), F.lit(fact)) for fact, flag in SET_FACTS.items()]
                )
            )
        ).alias("fact"),
    )
    merged_members = (
        members.select(*ASSET_KEY, "fact", "member").distinct().join(known, [*ASSET_KEY, "fact"], "left_semi")
    )
    return Merged(assets, conflicts, merged_members, merged.filter("differs").select(*ASSET_KEY))


def conflict_records(conflicts: DataFrame) -> DataFrame:
    """One critical, ambiguous evidence record per disagreeing fact."""
    short = F.substring(F.sha2("urn", 256), 1, 12)
    return conflicts.select(
        "run_key",
        F.concat_ws(".", F.lit("context.asset_fact_conflict"), "field", short).alias("id"),
        "kind",
        F.lit("ambiguous").alias("status"),
        F.lit(True).alias("critical"),
    )


def merge_reasons(merged: Merged, record_errors: DataFrame | None = None) -> DataFrame:
    """(run_key, reason): assets whose reports differed in anything, facts they disagreed on, and runs with conflicting records.

    ``record_errors`` is the result of ``record_conflicts``.
    """
    short = F.substring(F.sha2("urn", 256), 1, 12)
    reasons = merged.differing.select("run_key", F.concat_ws(".", F.lit("context.asset_merged"), short).alias("reason")).unionByName(
        merged.conflicts.select("run_key", F.concat_ws(".", F.lit("context.asset_fact_conflict"), "field", short).alias("reason"))
    )
    if record_errors is not None:
        odd = record_errors.select("run_key", F.lit("context.evidence_record_conflict").alias("reason")).distinct()
        reasons = reasons.unionByName(odd)
    return reasons


def record_conflicts(records: DataFrame, content: list[str]) -> DataFrame:
    """An error record for every id that stands for different contents in a run."""
    body = F.struct(*content)
    odd = (
        records.groupBy("run_key", "id")
        .agg(F.min(body).alias("low"), F.max(body).alias("high"))
        .filter(~F.col("low").eqNullSafe(F.col("high")))
    )
    return odd.select(
        "run_key",
        F.concat(F.lit("merge-conflict:"), F.substring(F.sha2("id", 256), 1, 16)).alias("id"),
        F.lit("other").alias("kind"),
        F.lit("error").alias("status"),
        F.lit(True).alias("critical"),
    )


def worst_status(states: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Worst status per evidence field over all changes of a run."""
    ranks = states.select(
        "run_key",
        *[_rank(F.coalesce(f, F.lit("missing")), STATUS_RANK).alias(f) for f in EVIDENCE_FIELDS],
    )
    if conflicts is not None:
        raised = conflicts.select(
            "run_key",
            *[
                F.when(F.col("state_field") == f, F.lit(STATUS_RANK["ambiguous"])).alias(f)
                for f in EVIDENCE_FIELDS
            ],
        )
        ranks = ranks.unionByName(raised)
    worst = ranks.groupBy("run_key").agg(*[F.max(f).alias(f) for f in EVIDENCE_FIELDS])
    return worst.select("run_key", *[_named(F.col(f), STATUS_RANK).alias(f) for f in EVIDENCE_FIELDS])
