"""The whole gate on small change sets, from snapshots to the decision."""

import pytest
from helpers import collect
from pyspark.sql import functions as F

from changegate.operators import diff
from changegate.plans import gate

COLUMNS = "run_key string, relation string, column_name string, data_type string, nullable boolean, ordinal int, expr_fingerprint string"
URN = "urn:li:dataset:(urn:li:dataPlatform:w,{},PROD)"
BEFORE = [("id", 0, "id"), ("total", 1, "total"), ("day", 2, "day")]
AFTER = [("id", 0, "id"), ("gross", 1, "total"), ("day", 2, "day")]
PATCHED = [*BEFORE, ("gross", 3, "total")]


def side(rows, runs):
    return rows(COLUMNS, [(run, "shop.orders", c, "DECIMAL(12, 2)", False, i, e) for run, cols in runs.items() for c, i, e in cols])


@pytest.fixture()
def catalog(rows):
    orders, mart, board = URN.format("shop.orders"), URN.format("shop.mart"), "urn:li:dashboard:board"
    return gate.Catalog(
        datasets=rows("urn string", [(orders,)]),
        fields=rows("urn string, field_path string, native_type string", [(orders, c, "decimal(12, 2)") for c, *_ in BEFORE]),
        edges=rows("src_urn string, src_column string, dst_urn string, dst_column string", [
            (orders, "total", mart, "revenue"), (orders, "day", mart, "day"), (mart, "day", board, "d")]),
        assets=rows("urn string, name string, ownership_known boolean", [(mart, "mart", True), (board, "board", True)]),
        owners=rows("urn string, owner string", [(mart, "urn:li:corpGroup:finance"), (board, "urn:li:corpGroup:finance")]),
        tags=rows("urn string, tag string, tag_name string", [(mart, "urn:li:tag:critical", None)]),
        assertions=rows("assertion_urn string, dataset_urn string, field string, name string", [("urn:li:assertion:a", mart, "revenue", "a")]),
    )


def evidence(rows, runs, nodes=(), tests=(), results=()):
    """Nodes, tests and test runs that speak for the bridges of ``runs``; the other arguments replace rows of some runs."""
    facts = ("shop.orders", "context", "config", "constraints", "duckdb", True)
    node_rows = [(r, "shop.orders", s, *facts) for r in runs for s in ("before", "proposed", "patched")]
    test_rows = [(r, "shop.orders", s, "not_null_id") for r in runs for s in ("before", "proposed", "patched")]
    ran = [x for r in runs for x in ((r, "model.shop.orders", "success", ""), (r, "test.shop.bridge.1", "pass", ""))]
    replaced = lambda old, new: [x for x in old if x[0] not in {n[0] for n in new}] + [n for n in new if len(n) > 1]
    return {
        "nodes": rows(gate.NODE_SCHEMA, replaced(node_rows, nodes)),
        "tests": rows(gate.TEST_SCHEMA, replaced(test_rows, tests)),
        "results": rows(gate.RESULT_SCHEMA, replaced(ran, results)),
        "expectations": rows(gate.EXPECTATION_SCHEMA, [(r, "orders", "bridge", "failure", "none") for r in runs]),
    }


def test_a_proven_bridge_passes_and_a_broken_one_does_not(rows, catalog):
    """The golden scores: the rename is blocked with 88, what its bridge leaves passes with 12."""
    runs = ("proven", "broken", "unbuilt", "gone")
    before = side(rows, dict.fromkeys(runs, BEFORE))
    after = side(rows, {r: AFTER for r in runs[:3]})
    patched = side(rows, {"proven": PATCHED, "broken": [*BEFORE[:2], ("gross", 3, "total")], "gone": PATCHED})
    found = gate.run_gate(before, after, catalog, bridge=gate.Bridge(patched, **evidence(rows, runs)))
    shown = ("run_key", "score", "decision", "remediation_status", "residual_score", "final_decision", "status", "passing")
    assert collect(found.decisions, *shown) == [
        ("broken", 88, "BLOCK", "VERIFICATION_ERROR", None, "BLOCK", "INCOMPLETE", False),
        ("gone", None, None, "UNSUPPORTED", None, "BLOCK", "REJECTED", False),
        ("proven", 88, "BLOCK", "TESTED", 12, "PASS_WITH_REMEDIATION", "COMPLETE", True),
        ("unbuilt", 88, "BLOCK", "GENERATED", None, "BLOCK", "COMPLETE", False),
    ]
    assert collect(found.rejections, "run_key", "reason") == [("gone", "removed_relation")]


def test_a_bridge_without_its_evidence_never_passes(rows, catalog):
    """Whatever is absent, failed or changed, a run is not proven; the others beside it are."""
    runs = ("good", "no_nodes", "one_side", "failed", "no_results", "skipped", "model_only", "lost_test", "half_listed")
    one_side = [("one_side", "shop.orders", "patched", "shop.orders", "context", "config", "constraints", "duckdb", True)]
    half = [("half_listed", "shop.orders", s, "shop.orders", "context", "config", "constraints", "duckdb", s != "patched") for s in ("before", "proposed", "patched")]
    given = evidence(
        rows, runs, nodes=[("no_nodes",), *one_side, *half], tests=[("lost_test", "shop.orders", "before", "unique_id")],
        results=[("failed", "model.shop.orders", "success", ""), ("failed", "test.shop.bridge.1", "FAIL", "3 rows"), ("no_results",),
                 ("skipped", "model.shop.orders", "success", ""), ("skipped", "test.shop.bridge.1", "skipped", ""), ("model_only", "model.shop.orders", "success", "")],
    )
    sides = [side(rows, dict.fromkeys(runs, c)) for c in (BEFORE, AFTER, PATCHED)]
    found = gate.run_gate(*sides[:2], catalog, bridge=gate.Bridge(sides[2], **given))
    status = {r["run_key"]: (r["remediation_status"], r["final_decision"], r["residual_score"]) for r in found.decisions.collect()}
    assert status.pop("good") == ("TESTED", "PASS_WITH_REMEDIATION", 12)
    assert status.pop("failed") == ("TEST_FAILED", "BLOCK", None)
    assert set(status) == set(runs) - {"good", "failed"} and set(status.values()) == {("VERIFICATION_ERROR", "BLOCK", None)}
    proofs = gate.prove_bridges(_changes(rows, runs), *sides[:2], gate.Bridge(sides[2], **given))
    assert collect(proofs.missing) == [("no_nodes", "shop.orders", "nodes"), ("one_side", "shop.orders", "nodes")]


def _changes(rows, runs):
    sides = [side(rows, dict.fromkeys(runs, c)) for c in (BEFORE, AFTER)]
    return diff.schema_diff(*sides).changes


def test_each_kind_of_evidence_is_required(rows, catalog):
    before, after, patched = (side(rows, {"r": c}) for c in (BEFORE, AFTER, PATCHED))
    whole = evidence(rows, ["r"])
    cases = [whole, {}, *({k: v for k, v in whole.items() if k != left_out} for left_out in whole), *({**whole, k: whole[k].limit(0)} for k in ("nodes", "results", "expectations"))]
    changes = _changes(rows, ["r"])
    got = [collect(gate.prove_bridges(changes, before, after, gate.Bridge(patched, **c)).proofs, "proven", "remediation_status") for c in cases]
    assert got == [[(True, "TESTED")]] + [[(False, "VERIFICATION_ERROR")]] * (len(cases) - 1)


def test_a_lost_constraint_breaks_the_proof(rows):
    """A patched side that no longer has a column's foreign key, or says nothing of constraints, keeps no contract."""
    keys = ['{"type": "foreign_key", "to": "shop.days"}']
    changes = _changes(rows, ["r"])

    def with_keys(columns, constraints):
        return side(rows, {"r": columns}).withColumn("constraints", F.when(F.col("column_name") == "day", constraints).otherwise(F.array()))

    held = F.array(*map(F.lit, keys))
    spaced = F.array(F.lit('{"to":"shop.days",   "type":"foreign_key"}'))
    other = F.array(F.lit('{"type": "foreign_key", "to": "shop.weeks"}'))
    before, after = with_keys(BEFORE, held), with_keys(AFTER, held)
    got = []
    for patched in (with_keys(PATCHED, held), with_keys(PATCHED, spaced), with_keys(PATCHED, F.array()), with_keys(PATCHED, other), side(rows, {"r": PATCHED})):
        proofs = gate.prove_bridges(changes, before, after, gate.Bridge(patched, **evidence(rows, ["r"]))).proofs
        got.append(proofs.first()["proven"])
    assert got == [True, True, False, False, False]


def test_what_a_bridge_changes_besides_is_scored(rows, catalog):
    """A patched side that drops another column keeps no interface."""
    patched = side(rows, {"r": [("id", 0, "id"), ("total", 1, "total"), ("gross", 2, "total")]})
    bridge = gate.Bridge(patched, **evidence(rows, ["r"]))
    found = gate.run_gate(side(rows, {"r": BEFORE}), side(rows, {"r": AFTER}), catalog, bridge=bridge)
    assert collect(found.decisions, "remediation_status", "final_decision") == [("VERIFICATION_ERROR", "BLOCK")]


def test_a_bound_that_cuts_the_trace_is_told(rows, catalog):
    moved = [("id", 0, "id"), ("total", 1, "total"), ("date", 2, "day")]
    sides = side(rows, {"r": BEFORE}), side(rows, {"r": moved})
    whole, cut = gate.run_gate(*sides, catalog), gate.run_gate(*sides, catalog, max_hops=1)
    assert collect(whole.state, "lineage", "traversal") == [("complete", "complete")]
    assert collect(cut.state, "lineage", "traversal") == [("truncated", "truncated")]
    assert cut.decisions.first().status == "INCOMPLETE" and whole.decisions.first().n_assets > cut.decisions.first().n_assets


def test_without_a_bridge_nothing_is_proven(rows, catalog):
    found = gate.run_gate(side(rows, {"r": BEFORE}), side(rows, {"r": AFTER}), catalog)
    assert collect(found.decisions, "remediation_status", "final_decision", "status") == [("GENERATED", "BLOCK", "COMPLETE")]
