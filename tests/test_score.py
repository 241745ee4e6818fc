import json
import math

import pytest
from helpers import ASSET_SCHEMA, CHANGE_SCHEMA, COMPLETE, STATE_SCHEMA, asset, change, collect
from pyspark.sql import functions as F

from changegate import policy as pol
from changegate.constants import EVIDENCE_FIELDS
from changegate.operators import score

POLICY = pol.Policy()


def run(rows, changes, assets, state=COMPLETE, records=None):
    states = rows(STATE_SCHEMA, [] if state is None else [("r", *state)])
    return score.assess(rows(CHANGE_SCHEMA, changes), rows(ASSET_SCHEMA, assets), states, POLICY, records)


def test_golden_demo_scores(rows):
    demo = asset(assertions=["check"], critical=True, direct=True)
    got = run(rows, [change()], [demo]).runs.first()
    assert (got.score, got.decision) == (88, "BLOCK")
    residual = change(kind="add_column", old_column=None, new_nullable=False)
    got = score.residual_assess(rows(CHANGE_SCHEMA, [residual]), rows(ASSET_SCHEMA, []), rows(STATE_SCHEMA, [("r", *COMPLETE)]), POLICY)
    assert (got.first().score, got.first().decision) == (12, "PASS")


def test_breadth(rows):
    wanted = {0: 0, 1: 3, 2: 5, 3: 6, 7: 9, 31: 15, 1023: 15}
    changes = [change(run=f"r{n}", kind="add_column", old_column=None, new_nullable=True) for n in wanted]
    assets = [asset(run=f"r{n}", urn=f"u{i}") for n in wanted for i in range(n)]
    states = rows(STATE_SCHEMA, [(f"r{n}", *COMPLETE) for n in wanted])
    got = score.assess(rows(CHANGE_SCHEMA, changes), rows(ASSET_SCHEMA, assets), states, POLICY).runs
    assert collect(got, "run_key", "breadth_points", "score") == sorted((f"r{n}", p, 2 + p) for n, p in wanted.items())


def test_breadth_never_meets_an_exact_half():
    assert all(abs((3 * math.log2(1 + n)) % 1 - 0.5) > 1e-9 for n in range(1, 2000))


def test_hops_and_clamp(rows):
    drop = change(kind="drop_column", new_column=None)
    near, far = (run(rows, [drop], [asset(hop=h)]) for h in (1, 3))
    assert near.scored.first().score == 45 and far.scored.first().score == 37
    low = run(rows, [change(kind="add_column", old_column=None, new_nullable=True)], [asset(hop=3)])
    assert low.scored.first().score == 0 and low.runs.first().score == 3
    assert low.runs.first().score == 3
    parts = score.asset_contributions(low.scored)
    assert parts.agg(F.sum("points")).first()[0] == 0
    assert collect(parts.filter("category = 'clamp'"), "points") == [(6,)]


def test_incomplete_evidence_raises_pass_to_review_and_keeps_the_score(rows):
    cases = {f"{f}/{s}": (f, s) for f in EVIDENCE_FIELDS for s in ("missing", "truncated", "error", None)}
    changes = [change(run=k, kind="add_column", old_column=None, new_nullable=True) for k in cases]
    states = [(k, *(s if f == g else "complete" for g in EVIDENCE_FIELDS)) for k, (f, s) in cases.items()]
    got = score.assess(rows(CHANGE_SCHEMA, changes), rows(ASSET_SCHEMA, []), rows(STATE_SCHEMA, states), POLICY)
    facts = collect(got.runs, "run_key", "score", "score_decision", "decision")
    assert facts == sorted((k, 2, "PASS", "REVIEW") for k in cases)
    want = sorted((k, f"critical_evidence.{f}.{s or 'missing'}") for k, (f, s) in cases.items())
    assert collect(got.reasons, "run_key", "reason") == want


def test_no_state_means_everything_is_missing(rows):
    got = run(rows, [change(kind="drop_column")], [], state=None)
    assert got.runs.first().n_override_reasons == 5


def test_reasons(rows):
    changes = [change(cid="low", confidence="low"), change(cid="req", kind="add_column", old_column=None),
               change(cid="typ", kind="type_change", old_type="a", new_type="b")]
    assets = [asset(urn="none", owners=None), asset(urn="empty", owners=()), asset(urn="noassert", assertions=None)]
    records = rows("run_key string, id string, kind string, status string, critical boolean", [
        ("r", "x", "k", "stale", True), ("r", "x", "k", "stale", True), ("r", "y", "k", "stale", False), ("r", "z", "k", "complete", True)])
    got = run(rows, changes, assets, records=records)
    assert [r[0] for r in collect(got.reasons, "reason")] == [
        "critical_record.x.stale", "impacted_asset.noassert.assertion_evidence_missing",
        "impacted_asset.none.ownership_missing", "schema_change.low.low_confidence",
        "schema_change.req.requiredness_missing", "schema_change.typ.type_compatibility_ambiguous"]


def test_missing_owner_counts_only_when_established_empty(rows):
    got = run(rows, [change()], [asset(urn="none", owners=None), asset(urn="empty", owners=())])
    assert collect(got.scored, "urn", "score") == [("empty", 40), ("none", 35)]


def test_ties_and_worst_change(rows):
    changes = [change(cid="b", kind="drop_column"), change(cid="a", kind="drop_column"), change(cid="0")]
    first = run(rows, changes, [asset(urn="z"), asset(urn="y")]).runs.first()
    assert (first.worst_change_id, first.score_basis_asset_urn) == ("a", "y")


def test_usage_is_capped(rows):
    got = run(rows, [change()], [asset(urn="a", usage=99), asset(urn="b", usage=3), asset(urn="c", usage=0)])
    assert collect(got.scored, "urn", "score") == [("a", 45), ("b", 38), ("c", 35)]


def test_basis_of_a_run_without_assets_is_its_worst_change(rows):
    changes = rows(CHANGE_SCHEMA, [change(), change(run="none", cid="c2", kind="drop_column", new_column=None), change(run="none", cid="c3")])
    worst = score.worst_change(changes, POLICY)
    scored = score.score_assets(rows(ASSET_SCHEMA, [asset(urn="b"), asset(urn="a"), asset(urn="far", hop=3)]), worst, POLICY)
    got = score.score_basis(scored, worst)
    assert collect(got, "run_key", "score_basis_asset_urn", "asset_base", "n_assets") == [("none", None, 45, 0), ("r", "a", 35, 3)]


def test_duplicates_reject_the_run(rows):
    got = run(rows, [change(), change()], [asset(), asset(run="other")])
    assert got.runs.count() == 0 and collect(got.rejections, "reason") == [("duplicate_change_id",)]


@pytest.mark.parametrize(("value", "decision"), [(24, "PASS"), (25, "REVIEW"), (59, "REVIEW"), (60, "BLOCK")])
def test_thresholds(rows, value, decision):
    df = rows("score int, n_override_reasons bigint", [(value, 0)])
    assert score.risk_decision(df, POLICY).first().decision == decision


OUTCOME = ("n_override_reasons int, decision string, remediation_status string, counterfactual_verified boolean, "
           "interface_preserved boolean, counterfactual_condition string, residual_decision string")


@pytest.mark.parametrize(("row", "final"), [
    ((0, "BLOCK", "TESTED", True, True, "RESIDUAL_CHANGES", "PASS"), "PASS_WITH_REMEDIATION"),
    ((0, "BLOCK", "TESTED", True, True, "NO_RESIDUAL_CHANGES", None), "PASS_WITH_REMEDIATION"),
    ((0, "BLOCK", "TESTED", True, True, "RESIDUAL_CHANGES", "REVIEW"), "BLOCK"),
    ((0, "BLOCK", "TESTED", True, True, "RESIDUAL_CHANGES", None), "BLOCK"),
    ((1, "BLOCK", "TESTED", True, True, "RESIDUAL_CHANGES", "PASS"), "BLOCK"),
    ((0, "REVIEW", "TESTED", True, False, "RESIDUAL_CHANGES", "PASS"), "REVIEW"),
    ((0, "PASS", "GENERATED", None, None, None, None), "PASS"),
])
def test_gate_decision(rows, row, final):
    assert rows(OUTCOME, [row]).select(score.gate_decision()).first()[0] == final


def test_policy_is_validated():
    good = dict(version="1.0.0", thresholds=dict(pass_max=24, review_max=59), change_severity=dict(pol.SEVERITY_POINTS),
                signals=dict(pol.SIGNAL_POINTS), breadth=dict(multiplier=3, maximum=15), hop_penalty=4, maximum_score=100)
    assert pol.policy_from_mapping(good) == pol.Policy()
    for change_ in (dict(maximum_score=90), dict(thresholds=dict(pass_max=30, review_max=59)), dict(extra=1),
                    dict(hop_penalty=-1), dict(change_severity={**pol.SEVERITY_POINTS, "drop_column": 101})):
        with pytest.raises(pol.PolicyError):
            pol.policy_from_mapping({**good, **change_})


def test_policy_is_read_from_a_file(tmp_path):
    """The layout of a policy file, as JSON, which is YAML too; other contents are refused with a reason."""
    good = dict(version="2.1.0", thresholds=dict(pass_max=24, review_max=59), change_severity={**pol.SEVERITY_POINTS, "drop_column": 50},
                signals=dict(pol.SIGNAL_POINTS), breadth=dict(multiplier=2, maximum=10), hop_penalty=3, maximum_score=100)
    path = tmp_path / "policy.json"
    path.write_text(json.dumps(good), encoding="utf-8")
    read = pol.load_policy(path)
    assert read == pol.policy_from_mapping(good) and read.version == "2.1.0" and read.hop_penalty == 3
    assert pol.load_policy(str(path)) == read
    for text in ("[]", json.dumps({**good, "extra": 1}), json.dumps({k: v for k, v in good.items() if k != "signals"}), "not: [a policy"):
        path.write_text(text, encoding="utf-8")
        with pytest.raises(Exception):  # noqa: B017  a YAML reader has errors of its own
            pol.load_policy(path)
    with pytest.raises(FileNotFoundError):
        pol.load_policy(tmp_path / "missing.json")
