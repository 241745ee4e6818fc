import hashlib

from helpers import STATE_SCHEMA, collect
from pyspark.sql import functions as F

from changegate.operators import merge

SCHEMA = ("run_key string, change_id string, urn string, asset_type string, name string, hop_count int, owners array<string>, "
          "assertion_urns array<string>, critical_asset boolean, sensitive_data boolean, direct_column_lineage boolean, "
          "recent_query_usage_score int")


def report(cid, urn="u", kind="dataset", name=None, hop=1, owners=("o",), assertions=(), critical=False, usage=None):
    as_list = lambda v: None if v is None else list(v)
    return ("r", cid, urn, kind, name, hop, as_list(owners), as_list(assertions), critical, False, False, usage)


def test_three_valued_or_for_all_pairs(rows):
    values = [True, False, None]
    data = [report(c, urn=f"{a}/{b}", critical=v) for a in values for b in values for c, v in (("1", a), ("2", b))]
    got = dict(collect(merge.merge_assets(rows(SCHEMA, data)).assets, "urn", "critical_asset"))
    for a in values:
        for b in values:
            want = True if a or b else (None if a is None or b is None else False)
            assert got[f"{a}/{b}"] is want, (a, b)


def test_conservative_facts(rows):
    data = [report("1", kind="dataset", name="zeta", hop=3, usage=2), report("2", kind="dashboard", name="alpha", hop=1),
            report("3", kind="other", hop=2, usage=7)]
    first = merge.merge_assets(rows(SCHEMA, data)).assets.first()
    assert (first.asset_type, first.name, first.hop_count, first.recent_query_usage_score) == ("dashboard", "alpha", 1, 7)


def test_lists_null_is_not_empty(rows):
    data = [report("1", urn="null", owners=None), report("2", urn="null", owners=("a",)),
            report("1", urn="empty", owners=()), report("2", urn="empty", owners=()),
            report("1", urn="union", owners=("a",)), report("2", urn="union", owners=("b",))]
    merged = merge.merge_assets(rows(SCHEMA, data))
    assert collect(merged.assets, "urn", "has_owners") == [("empty", False), ("null", None), ("union", True)]
    assert collect(merged.members.filter("fact = 'owners'"), "urn", "member") == [("union", "a"), ("union", "b")]
    assert collect(merged.conflicts, "urn", "field") == [("null", "owners"), ("union", "owners")]


def test_equal_reports_do_not_conflict_and_null_equals_null(rows):
    data = [report(c, critical=None, owners=("a", "b"), assertions=("x",)) for c in "123"]
    assert merge.merge_assets(rows(SCHEMA, data)).conflicts.count() == 0


def test_subset_of_a_list_is_a_conflict(rows):
    data = [report("1", assertions=("x", "y")), report("2", assertions=("x",))]
    assert collect(merge.merge_assets(rows(SCHEMA, data)).conflicts, "field", "state_field") == [("assertion_urns", "assertions")]


def test_conflicts_make_the_state_ambiguous(rows):
    merged = merge.merge_assets(rows(SCHEMA, [report("1", hop=1), report("2", hop=2)]))
    states = rows(STATE_SCHEMA, [("r", "complete", "complete", "complete", "complete", None),
                                 ("r", "missing", "complete", "truncated", "complete", "complete")])
    got = merge.worst_status(states, merged.conflicts).first()
    assert tuple(got)[1:] == ("missing", "complete", "ambiguous", "complete", "missing")
    assert merge.conflict_records(merged.conflicts).first().status == "ambiguous"


def test_record_conflicts(rows):
    data = rows("run_key string, id string, status string", [("r", "a", "x"), ("r", "a", "x"), ("r", "b", "x"), ("r", "b", None), ("s", "a", "y")])
    got = merge.record_conflicts(data, ["status"])
    assert collect(got, "run_key", "status") == [("r", "error")]


def test_hot_asset_with_many_reports(rows):
    data = [report(str(i), owners=(f"o{i % 3}",)) for i in range(600)]
    merged = merge.merge_assets(rows(SCHEMA, data))
    assert merged.assets.first().n_reports == 600
    assert merged.members.filter(F.col("fact") == "owners").count() == 3


def test_evidence_is_united_whatever_is_known(rows):
    data = [(*report("1", owners=None), ["a", "b"]), (*report("2"), ["b", "c"]), (*report("3", urn="v"), None)]
    merged = merge.merge_assets(rows(SCHEMA + ", evidence_refs array<string>", data))
    assert collect(merged.members.filter("fact = 'evidence_refs'"), "urn", "member") == [("u", "a"), ("u", "b"), ("u", "c")]


def test_a_report_is_the_same_only_as_a_whole(rows):
    """Equal facts with another name or other evidence are a merged asset without a conflict of facts."""
    refs = {"same": ("e", "e"), "evidence": ("e", "f"), "named": ("e", "e"), "owned": ("e", "e"), "none": (None, None), "gone": ("e", None)}
    data = []
    for urn, pair in refs.items():
        for n, ref in enumerate(pair):
            name = f"name {n}" if urn == "named" else "name"
            owners = (f"o{n}",) if urn == "owned" else ("o",)
            data.append((*report(str(n), urn=urn, name=name, owners=owners), [] if ref is None else [ref]))
    merged = merge.merge_assets(rows(f"{SCHEMA}, evidence_refs array<string>", data))
    assert collect(merged.differing, "urn") == [("evidence",), ("gone",), ("named",), ("owned",)]
    short = lambda urn: hashlib.sha256(urn.encode()).hexdigest()[:12]
    errors = merge.record_conflicts(rows("run_key string, id string, status string", [("r", "x", "a"), ("r", "x", "b"), ("q", "x", "a")]), ["status"])
    want = [f"context.asset_merged.{short(u)}" for u in ("evidence", "gone", "named", "owned")]
    want += [f"context.asset_fact_conflict.owners.{short('owned')}", "context.evidence_record_conflict"]
    assert [r for _, r in collect(merge.merge_reasons(merged, errors))] == sorted(want)
    assert collect(merge.merge_assets(rows(SCHEMA, [report("1")])).differing) == []


def test_assets_alone_move_no_list(rows):
    """Without staging, the assets need one grouped pass: no member is counted or joined, and the result is that of the staged merge."""
    data = [report("1", owners=("a", "b"), assertions=("x",)), report("2", owners=None, hop=2), report("1", urn="v", owners=())]
    lazy, staged = (merge.merge_assets(rows(SCHEMA, data), staged=s).assets for s in (False, True))
    assert collect(lazy) == collect(staged)
    assert "Join" not in lazy._jdf.queryExecution().optimizedPlan().toString()
