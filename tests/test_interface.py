import pytest
from helpers import collect
from pyspark.sql import functions as F

from changegate.operators import interface
from changegate.plans import bridging
from changegate.plans.views import TABLES

SCHEMA = ("run_key string, relation string, side string, column_name string, data_type string, nullable boolean, "
          "ordinal int, expr_fingerprint string")
NODE = ("run_key string, relation string, side string, relation_identity string, query_context_sha256 string, "
        "config_sha256 string, model_constraints_sha256 string, adapter_type string, tests_complete boolean")


def bridge(**edits):
    """A correct bridge; edits map (side, column) to replaced fields or None."""
    sides = {
        "before": [("id", 0), ("total", 1), ("day", 2)],
        "proposed": [("id", 0), ("gross", 1), ("day", 2)],
        "patched": [("id", 0), ("total", 1), ("day", 2), ("gross", 3)],
    }
    source = {"gross": "total"}
    out = []
    for side, cols in sides.items():
        for name, pos in cols:
            row = dict(data_type="INT", nullable=False, ordinal=pos, expr_fingerprint=source.get(name, name))
            change = edits.get(f"{side}_{name}", {})
            if change is None:
                continue
            row.update(change)
            out.append((name, side, row))
    return out


MUTATIONS = {
    "good": ({}, set()),
    "old type": ({"patched_total": {"data_type": "TEXT"}}, {"old_contract_kept", "other_contracts_kept"}),
    "other type": ({"patched_id": {"data_type": "TEXT"}}, {"other_contracts_kept", "proposed_contracts_kept"}),
    "old expression": ({"patched_total": {"expr_fingerprint": "x"}},
                       {"old_expression_kept", "bridge_expression", "earlier_columns_in_order"}),
    "new expression": ({"patched_gross": {"expr_fingerprint": "x"}}, {"bridge_expression", "proposed_expression_kept"}),
    "not last": ({"patched_gross": {"ordinal": 0}, "patched_id": {"ordinal": 3}},
                 {"replacement_last", "earlier_columns_in_order"}),
    "new missing": ({"patched_gross": None}, {"bridge_expression", "replacement_last", "single_intended_addition",
                                              "intended_type", "intended_nullability", "proposed_contracts_kept",
                                              "proposed_expression_kept"}),
    "old missing": ({"patched_total": None}, {"old_contract_kept", "other_contracts_kept", "old_expression_kept",
                                              "bridge_expression", "replacement_last", "earlier_columns_in_order"}),
    "type": ({"patched_gross": {"data_type": "TEXT"}}, {"intended_type", "proposed_contracts_kept"}),
    "nullable": ({"patched_gross": {"nullable": True}}, {"intended_nullability", "proposed_contracts_kept"}),
    "proposed place": ({"proposed_gross": {"ordinal": 2}, "proposed_day": {"ordinal": 1}}, {"proposed_replaces_in_place"}),
    "no evidence": ({"patched_day": {"expr_fingerprint": None}}, {"projection_evidence", "earlier_columns_in_order"}),
    "same place": ({"before_day": {"ordinal": 1}, "patched_day": {"ordinal": 1}, "proposed_day": {"ordinal": 1}}, {"positions_unique"}),
}


def test_each_mutation_breaks_its_rules(rows):
    data = [(run, "t", side, name, r["data_type"], r["nullable"], r["ordinal"], r["expr_fingerprint"])
            for run, (edits, _) in MUTATIONS.items() for name, side, r in bridge(**edits)]
    columns = interface.column_contracts(rows(SCHEMA, data), ["column_name", "data_type", "nullable"])
    renames = rows("run_key string, relation string, old_column string, new_column string, new_type string, new_nullable boolean",
                   [(run, "t", "total", "gross", "int", False) for run in MUTATIONS])
    checks = interface.interface_check(columns, renames)
    broken = {run: set() for run in MUTATIONS}
    for run, rule in collect(checks.filter(~F.col("ok")), "run_key", "rule"):
        broken[run].add(rule)
    assert broken == {run: rules for run, (_, rules) in MUTATIONS.items()}
    proven = dict(collect(interface.interface_proof(checks), "run_key", "proven"))
    assert [run for run, ok in proven.items() if ok] == ["good"]


@pytest.mark.parametrize("fact", interface.NODE_FACTS)
def test_node_facts_and_tests(rows, fact):
    names = list(interface.NODE_FACTS)
    node = lambda run, side, odd: (run, "t", side, *[("odd" if odd and n == fact else "same") for n in names], True)
    nodes = rows(NODE, [node("kept", s, False) for s in interface.SIDES] + [node("bad", s, s == "patched") for s in interface.SIDES])
    data = [(run, "t", side, n, r["data_type"], r["nullable"], r["ordinal"], r["expr_fingerprint"])
            for run in ("kept", "bad") for n, side, r in bridge()]
    columns = interface.column_contracts(rows(SCHEMA, data), ["column_name", "data_type", "nullable"])
    renames = rows("run_key string, relation string, old_column string, new_column string, new_type string, new_nullable boolean",
                   [(r, "t", "total", "gross", None, None) for r in ("kept", "bad")])
    tests = rows("run_key string, relation string, side string, test_sha256 string", [
        ("kept", "t", "before", "a"), ("kept", "t", "patched", "a"), ("kept", "t", "patched", "b"), ("bad", "t", "before", "a")])
    checks = interface.interface_check(columns, renames, nodes, tests)
    bad = collect(checks.filter(~F.col("ok")), "run_key", "rule")
    assert bad == sorted([("bad", f"{fact}_kept"), ("bad", f"{fact}_as_proposed"), ("bad", "model_tests_kept")])


def test_compat_column_keeps_places(rows):
    df = rows("id int, gross int, day int", [(1, 2, 3)])
    bridged = interface.compat_column(df, "total", "gross")
    assert bridged.columns == ["id", "total", "day", "gross"] and tuple(bridged.first()) == (1, 2, 3, 2)
    with pytest.raises(ValueError):
        interface.compat_column(df, "id", "gross")


def test_snapshot_ignores_order_and_sees_constraints(rows):
    schema = ("run_key string, side string, unique_id string, column_name string, data_type string, nullable boolean, "
              "not_null boolean, quote boolean, constraints array<string>")
    base = [("n", "a", "INT", ["unique", "not null"]), ("n", "b", "INT", None)]
    make = lambda run, items: [(run, "s", u, c, t, None, None, False, k) for u, c, t, k in items]
    data = make("one", base) + make("two", [base[1], ("n", "a", "INT", ["not null", "unique"])]) + make(
        "three", [base[0], ("n", "b", "INT", [])])
    nodes = rows("run_key string, side string, unique_id string, config_sha256 string", [(r, "s", "n", "c") for r in ("one", "two", "three")])
    got = dict(collect(interface.snapshot_digest(interface.interface_snapshot(nodes, rows(schema, data))), "run_key", "sha256"))
    assert got["one"] == got["two"] != got["three"]


def test_attached_tests(rows):
    tests = rows("run_key string, side string, test_id string, attached_node string, column_name string, "
                 "depends_on array<string>, signature string", [
                     ("r", "s", "1", "n", "COL", ["n"], "x"), ("r", "s", "2", "n", "col", ["n"], "x"), ("r", "s", "3", None, None, ["n", "m"], None),
                     ("r", "s", "4", "n", "zz", ["n"], "x"), ("r", "s", "5", "gone", "col", [], "x"), ("r", "s", "6", None, None, ["n", "n"], "y")])
    nodes = rows("run_key string, side string, unique_id string", [("r", "s", "n"), ("r", "s", "m")])
    columns = rows("run_key string, side string, unique_id string, column_name string", [("r", "s", "n", "Col")])
    digests, rejected = interface.attach_tests(tests, nodes, columns)
    assert collect(digests, "unique_id", "column_name", "signature", "n") == sorted(
        [("n", "Col", "x", 2), ("n", None, None, 1), ("m", None, None, 1), ("n", None, "y", 1)], key=repr)
    assert collect(rejected, "reason", "detail") == [("test_dependencies_invalid", "6"), ("test_points_to_missing_column", "4")]
    evidence = {(u, c): ok for u, c, ok in collect(interface.test_evidence(digests), "unique_id", "column_name", "complete")}
    assert evidence == {("n", "Col"): True, ("n", None): False, ("m", None): False}


def test_two_renames_of_one_relation_fail(rows):
    columns = rows(SCHEMA, [("r", "t", side, name, row["data_type"], row["nullable"], row["ordinal"], row["expr_fingerprint"])
                            for name, side, row in bridge()])
    contracts = interface.column_contracts(columns, ["column_name", "data_type", "nullable"])
    renames = rows("run_key string, relation string, old_column string, new_column string, new_type string, new_nullable boolean", [
        ("r", "t", "total", "gross", "INT", False), ("r", "t", "day", "date", "INT", False)])
    one = interface.interface_proof(interface.interface_check(contracts, renames.limit(1)))
    two = interface.interface_proof(interface.interface_check(contracts, renames))
    assert collect(one, "proven") == [(True,)] and collect(two, "proven") == [(False,)]


def test_snapshot_query_looks_at_every_run(spark, rows, tmp_path):
    """A run whose nodes other queries leave out is compared too, on all three sides."""
    part = rows("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int", [
        (k, f"n{k}", "b", "INT", 1) for run in (67, 70, 71) for k in range(8 * run, 8 * run + 8)])
    part.write.parquet(str(tmp_path / "part.parquet"))
    for other in set(TABLES) - {"part"}:
        (tmp_path / f"{other}.parquet").symlink_to(f"/root/testdata/sf0.001/{other}.parquet")
    found = {r.run_key: r.before_is_patched for r in bridging.q_interface_snapshot(spark, str(tmp_path)).collect()}
    assert set(found) == {"run:67", "run:70", "run:71"} and None not in found.values()
