import json

import pytest
from pyspark.sql import functions as F
from helpers import CHANGE_SCHEMA, COLUMN_SCHEMA, change, collect

from changegate.functions import identity, text
from changegate.operators import diff, interface
from changegate.sources import manifests

FACTS = ["change_type", "old_column", "new_column", "old_type", "new_type", "old_nullable", "new_nullable"]


def snapshot(rows, data):
    return rows(COLUMN_SCHEMA, data).withColumn("expr_fingerprint", text.expression_fingerprint(F.col("expression")))


def test_change_id_golden_vector(rows):
    df = rows(CHANGE_SCHEMA, [change(
        relation='"acme_commerce"."analytics_staging"."stg_orders"', old_column="order_total",
        new_column="gross_amount", old_type="DECIMAL(12, 2)", new_type="DECIMAL(12, 2)", old_nullable=False,
        new_nullable=False, source_path="proposed-manifest.json")])
    assert df.select(identity.change_id()).first()[0] == "change-03dc073d2b881401"


@pytest.mark.parametrize("name", ["größe", "名前", "smile😀", 'quo"te\\back', "tab\tnew\n"])
def test_change_id_matches_canonical_json_for_any_text(rows, name):
    import hashlib

    facts = dict(change_type="drop_column", relation="t", old_column=name, new_column=None, old_type=None,
                 new_type=None, old_nullable=None, new_nullable=None, source_path=None)
    want = hashlib.sha256(json.dumps(facts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    df = rows(CHANGE_SCHEMA, [change(kind="drop_column", old_column=name, new_column=None, source_path=None)])
    assert df.select(identity.change_id()).first()[0] == f"change-{want}"


def manifest(columns, adapter="duckdb", **node):
    return json.dumps({
        "metadata": {"adapter_type": adapter},
        "nodes": {"model.lake.trips": {
            "resource_type": "model", "name": "trips", "database": "Lake", "schema": "City", "columns": columns, **node,
        }},
    })


def trips(rows, sides, outputs=()):
    """Parsed manifests of both sides, and the columns of the query's outputs (side, name, expression, cast)."""
    docs = rows("run_key string, side string, json string", [("r", s, j) for s, j in sides.items()])
    projections = rows("run_key string, side string, unique_id string, ordinal int, name string, quoted boolean, "
                       "expression string, cast_type string", [("r", s, "model.lake.trips", i, n, False, e, c) for i, (s, n, e, c) in enumerate(outputs)])
    parsed = manifests.parse_manifests(docs)
    columns = manifests.manifest_columns(parsed.nodes, projections)
    assert parsed.rejections.count() == 0
    return parsed, columns


def test_changes_between_two_manifests(rows):
    """A renamed, a dropped, an added, a retyped and a newly required column of one model."""
    before = manifest({"fare": {"data_type": "float8"}, "tip": {"data_type": "real"}, "day": {"data_type": "date", "nullable": True}})
    after = manifest({"price": {"data_type": "double precision"}, "day": {"data_type": "timestamp", "nullable": False}, "zone": {"data_type": "int2"}})
    outputs = [("before", "fare", "t.fare", None), ("after", "price", "T.FARE", None), ("before", "tip", "t.tip", None),
               ("before", "day", "t.day", None), ("after", "day", "t.day", None), ("after", "zone", "t.zone", None)]
    _, columns = trips(rows, {"before": before, "after": after}, outputs)
    assert columns.rejections.count() == 0
    sides = columns.columns
    found = diff.schema_diff(sides.filter("side = 'before'"), sides.filter("side = 'after'"))
    assert [tuple(r) for r in diff.canonical_order(found.changes).select("relation", *FACTS).collect()] == [
        ("lake.city.trips", "rename_column", "fare", "price", "DOUBLE", "DOUBLE", None, None),
        ("lake.city.trips", "drop_column", "tip", None, "REAL", None, None, None),
        ("lake.city.trips", "add_column", None, "zone", None, "SMALLINT", None, None),
        ("lake.city.trips", "type_change", "day", "day", "DATE", "TIMESTAMP", None, None),
        ("lake.city.trips", "nullability_change", "day", "day", None, None, True, False),
    ]


@pytest.mark.parametrize(("adapter", "n"), [("postgres", 1), ("duckdb", 0), (None, 1)])
def test_types_are_read_in_the_adapters_dialect(rows, adapter, n):
    sides = {s: manifest({"c": {"data_type": t}}, adapter) for s, t in (("before", "varchar(10)"), ("after", "varchar(500)"))}
    _, columns = trips(rows, sides)
    found = diff.schema_diff(*(columns.columns.filter(f"side = '{s}'") for s in ("before", "after")))
    assert found.changes.filter("change_type = 'type_change'").count() == n


def test_digests_do_not_depend_on_layout_but_on_every_field(rows):
    same = [{"a": 1, "b": {"d": [1, 2], "c": None}}, {"b": {"c": None, "d": [1, 2]}, "a": 1}]
    parsed, _ = trips(rows, {"before": manifest({}, config=same[0], constraints=[{"type": "foreign_key", "to": "x"}]),
                             "after": manifest({}, config=same[1], constraints=[{"to": "y", "type": "foreign_key"}])})
    rows_ = parsed.nodes.select("config_sha256", "model_constraints_sha256").collect()
    assert len({r[0] for r in rows_}) == 1 and len({r[1] for r in rows_}) == 2
    kinds = rows("c array<string>", [(['{"type":"foreign_key","to":"x"}'],), (['{"to": "x", "type": "foreign_key"}'],), (['{"type":"foreign_key","to":"y"}'],),
                                     (["foreign_key"],), (None,)])
    got = [r[0] for r in kinds.select(interface.constraint_digests(F.col("c"))).collect()]
    assert got[0] == got[1] and len({str(g) for g in got}) == 4 and got[4] is None


@pytest.mark.parametrize(("column", "nullable"), [
    ({"constraints": ["not_null"]}, False), ({"constraints": [" Not Null "]}, False), ({"constraints": [{"type": "not_null"}]}, False),
    ({"constraints": ["unique", {"type": "check"}]}, None), ({"not_null": False}, True), ({"nullable": True, "constraints": ["not_null"]}, True), ({}, None)])
def test_nullability_of_manifest_columns(rows, column, nullable):
    _, columns = trips(rows, {"before": manifest({"c": {"data_type": "int", **column}})})
    assert collect(columns.columns, "column_name", "nullable") == [("c", nullable)]


def test_columns_that_cannot_be_judged(rows):
    _, columns = trips(rows, {"before": manifest({"c": {"data_type": "int"}, "C": {}, "": {"name": " "}, "two": {}})},
                       [("before", "c", "x", "text"), ("before", "two", "x", None), ("before", "two", "y", None)])
    assert collect(columns.rejections, "reason", "detail") == [
        ("column_name_missing", "model.lake.trips"), ("conflicting_types", "model.lake.trips.c"), ("duplicate_column", "model.lake.trips.c")]
    assert [r.has_projection for r in columns.columns.filter("column_name = 'two'").collect()] == [False]


@pytest.mark.parametrize(("document", "reason", "detail"), [
    ('{"nodes": {"m": {"resource_type": "model", "name": "t", "columns": []}}}', "columns_invalid", "m"),
    ('{"nodes": {"m": {"resource_type": "model", "name": "t", "columns": "c"}}}', "columns_invalid", "m"),
    ('{"nodes": {"m": {"resource_type": "model", "name": "t", "columns": {"c": []}}}}', "column_invalid", "m.c"),
    ('{"nodes": {"m": {"resource_type": "model", "name": "t", "columns": {"c": {"nullable": "yes"}}}}}', "column_invalid", "m.c.nullable"),
    ('{"nodes": {"m": {"resource_type": "model", "name": "t", "columns": {"c": {"quote": 1}}}}}', "column_invalid", "m.c.quote"),
    ('{"nodes": {"m": {"resource_type": "model", "name": "t", "columns": {"c": {"data_type": 5}}}}}', "column_invalid", "m.c.data_type"),
    ('{"nodes": {"m": {"resource_type": "model", "name": "t", "columns": {"c": {"constraints": "unique"}}}}}', "column_invalid", "m.c.constraints"),
    ('{"nodes": {"m": {"resource_type": "model", "name": "t"}, "m": {"resource_type": "model", "name": "t"}}}', "manifest_invalid", "before"),
    ('{"nodes": {"m": {"resource_type": "model", "name": "t"}, "n": {"resource_type": "seed", "name": "T"}}}', "duplicate_relation", "before.t"),
    ('{"nodes": {"m": "text"}}', "node_invalid", "m"),
    ('{"nodes": {"m": {"resource_type": ["model"], "name": "t"}}}', "node_field_invalid", "m.resource_type"),
    ('{"nodes": {"m": {"resource_type": "model", "relation_name": 7, "name": "t"}}}', "node_field_invalid", "m.relation_name"),
    ('{"nodes": {"m": {"resource_type": "model"}}}', "relation_name_missing", "m"),
    ('{"nodes": []}', "manifest_invalid", "before"), ("[]", "manifest_invalid", "before"), (None, "manifest_invalid", "before"),
])
def test_damaged_manifests_are_rejected_with_a_reason(rows, document, reason, detail):
    parsed = manifests.parse_manifests(rows("run_key string, side string, json string", [("r", "before", document)]))
    assert collect(parsed.rejections) == [("r", reason, detail)]


def test_what_is_null_or_of_other_types_is_no_damage(rows):
    document = """{"nodes": {"m": {"resource_type": "model", "name": "t", "alias": null, "config": "x", "columns": null},
      "n": {"resource_type": "test", "columns": []}, "o": {"resource_type": "seed", "name": "o", "columns": {"c":
      {"name": null, "quote": null, "constraints": [{"type": "Not Null"}, "unique", 5], "extra": [1]}}}}}"""
    parsed = manifests.parse_manifests(rows("run_key string, side string, json string", [("r", "before", document)]))
    assert collect(parsed.rejections) == [] and collect(parsed.nodes, "unique_id", "relation") == [("m", "t"), ("o", "o")]
    columns = manifests.manifest_columns(parsed.nodes, rows("run_key string, side string, unique_id string, ordinal int, name string, quoted boolean, expression string, cast_type string", []))
    assert collect(columns.columns, "unique_id", "column_name", "nullable") == [("o", "c", False)]


def test_manifest_files_become_runs(spark, tmp_path):
    for name, body in (("one", manifest({"id": {"data_type": "bigint"}})), ("two", '{"metadata": {}}'), ("three", "[1]")):
        (tmp_path / f"{name}.json").write_text(body)
    docs = manifests.read_manifests(spark, str(tmp_path), r"regexp_extract(path, '([a-z]+)[.]json$', 1)", "before")
    parsed = manifests.parse_manifests(docs)
    assert collect(parsed.nodes, "run_key", "relation") == [("one", "lake.city.trips")]
    assert collect(parsed.rejections, "run_key", "reason") == [("three", "manifest_invalid"), ("two", "manifest_invalid")]


def test_ambiguous_expressions_stay_drops_and_adds(rows):
    before = snapshot(rows, [("r", "t", c, "int", None, i, "x") for i, c in enumerate(["a1", "a2"])])
    after = snapshot(rows, [("r", "t", c, "int", None, i, "x") for i, c in enumerate(["b1", "b2"])])
    kinds = [r[0] for r in collect(diff.schema_diff(before, after).changes, "change_type")]
    assert kinds == ["add_column", "add_column", "drop_column", "drop_column"]


def test_no_rename_without_expression(rows):
    before = snapshot(rows, [("r", "t", "a", "int", None, 0, None)])
    after = snapshot(rows, [("r", "t", "b", "int", None, 0, None)])
    assert collect(diff.schema_diff(before, after).changes, "change_type") == [("add_column",), ("drop_column",)]


def test_hot_expression_is_counted_not_paired(rows):
    before = snapshot(rows, [("r", "t", f"a{i}", "int", None, i, "hot") for i in range(400)])
    after = snapshot(rows, [("r", "t", f"b{i}", "int", None, i, "hot") for i in range(400)])
    assert diff.infer_renames(diff.pair_columns(before, after)).count() == 0
    assert diff.schema_diff(before, after).changes.count() == 800


def test_removed_relation_rejects_the_whole_run_and_new_relation_is_ignored(rows):
    before = snapshot(rows, [("bad", "gone", "a", "int", None, 0, "a"), ("bad", "t", "a", "int", None, 0, "a"),
                             ("good", "t", "a", "int", None, 0, "a")])
    after = snapshot(rows, [("bad", "t", "b", "int", None, 0, "z"), ("good", "t", "a", "text", None, 0, "a"),
                            ("good", "new", "x", "int", None, 0, "x")])
    found = diff.schema_diff(before, after)
    assert collect(found.changes, "run_key", "change_type") == [("good", "type_change")]
    assert collect(found.rejections, "run_key", "reason", "detail") == [("bad", "removed_relation", "gone")]


def test_changed_expression_with_unknown_type_rejects(rows):
    before = snapshot(rows, [("r", "t", "a", None, None, 0, "x"), ("ok", "t", "a", None, None, 0, "x")])
    after = snapshot(rows, [("r", "t", "a", "int", None, 0, "y"), ("ok", "t", "a", None, None, 0, "x")])
    found = diff.schema_diff(before, after)
    assert collect(found.rejections, "run_key", "reason") == [("r", "untyped_expression_change")]
    assert found.changes.count() == 0


def test_duplicate_column_rejects(rows):
    before = snapshot(rows, [("r", "t", "a", "int", None, 0, "x"), ("r", "t", "a", "int", None, 1, "x")])
    after = snapshot(rows, [("r", "t", "a", "text", None, 0, "x")])
    found = diff.schema_diff(before, after)
    assert collect(found.rejections, "reason") == [("duplicate_column",)] and found.changes.count() == 0


def test_result_does_not_depend_on_order_or_on_other_runs(rows):
    data = [(f"r{k}", "t", f"c{i}", "int", i % 2 == 0, i, f"e{i}") for k in range(3) for i in range(6)]
    later = [(r, t, c + ("_v2" if c == "c3" else ""), "text" if c == "c1" else ty, n, o, e) for r, t, c, ty, n, o, e in data]
    whole = diff.schema_diff(snapshot(rows, data), snapshot(rows, later)).changes
    mixed = diff.schema_diff(snapshot(rows, data[::-1]), snapshot(rows, later[::-1])).changes
    assert collect(whole) == collect(mixed)
    one = lambda d: [x for x in d if x[0] == "r1"]
    alone = diff.schema_diff(snapshot(rows, one(data)), snapshot(rows, one(later))).changes
    assert collect(alone) == collect(whole.filter("run_key = 'r1'"))


@pytest.mark.parametrize(("kind", "kw", "key"), [
    ("drop_column", {}, "drop_column"),
    ("type_change", {}, "incompatible_type"),
    ("add_column", {"new_nullable": True}, "add_nullable_column"),
    ("add_column", {"new_nullable": None}, "add_required_column"),
    ("nullability_change", {"old_nullable": True, "new_nullable": False}, "nullable_to_required"),
    ("nullability_change", {"old_nullable": False, "new_nullable": True}, "widening_type"),
])
def test_severity_key(rows, kind, kw, key):
    assert rows(CHANGE_SCHEMA, [change(kind=kind, **kw)]).select(diff.severity_key()).first()[0] == key


def test_ddl_log_rejects_a_whole_batch(rows):
    schema = ("run_key string, relation string, action string, column_name string, column_quoted boolean, new_name string, "
              "new_quoted boolean, data_type string, not_null boolean, modifier string")
    log = rows(schema, [
        ("a", "t", "drop", "X", False, None, None, None, None, None),
        ("a", "t", "drop", "Y", False, None, None, None, None, "cascade"),
        ("b", "t", "RENAME", "Old", False, "New", True, None, None, None),
        ("b", "t", "add", "z", False, None, None, "INT", True, None),
        ("b", "t", "set_not_null", "w", False, None, None, None, None, None),
    ])
    found = diff.changes_from_ddl_log(log)
    assert collect(found.rejections, "run_key", "reason") == [("a", "unsupported_action")]
    assert collect(found.changes, *FACTS) == sorted([
        ("rename_column", "old", '"New"', None, None, None, None),
        ("add_column", None, "z", None, "INT", None, False),
        ("nullability_change", "w", "w", None, None, True, False),
    ], key=repr)


def test_adapters_must_agree(rows):
    nodes = rows("run_key string, adapter_type string", [
        ("same", "PostgreSQL"), ("same", "postgres"), ("same", None), ("mixed", "duckdb"), ("mixed", "postgres")])
    assert collect(diff.check_adapter(nodes), "run_key") == [("mixed",)]
    assert collect(diff.check_adapter(nodes, "duckdb"), "run_key") == [("mixed",), ("same",)]
