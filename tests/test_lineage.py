import uuid
from collections import Counter

import pytest
from helpers import CHANGE_SCHEMA, change, collect
from pyspark.sql import functions as F

from changegate.operators import lineage

URN = "urn:li:dataset:(urn:li:dataPlatform:w,{},PROD)"


def test_resolution(rows):
    changes = rows(CHANGE_SCHEMA, [change(cid=c, relation=r) for c, r in (
        ("one", '"Shop"."Orders"'), ("two", "shop.twice"), ("none", "shop.unknown"), ("near", "other.orders"),
        ("urn", URN.format("x.y")), ("badurn", "urn:li:dataset:nothing"))])
    catalog = rows("urn string", [(URN.format(n),) for n in ("shop.orders", "shop.twice", "SHOP.Twice", "a%20b.c")])
    got = lineage.resolve_dataset(changes, catalog)
    assert collect(got, "change_id", "catalog_status", "source_urn") == [
        ("badurn", "ambiguous", None), ("near", "ambiguous", None), ("none", "missing", None),
        ("one", "complete", URN.format("shop.orders")), ("two", "ambiguous", None), ("urn", "complete", URN.format("x.y"))]


def test_baseline(rows):
    urn = URN.format("shop.orders")
    cases = [change(cid="ok", old_column="A", old_type="DECIMAL(12, 2)"), change(cid="stale", old_column="A", old_type="INT"),
             change(cid="untyped", old_column="B", old_type="INT"), change(cid="gone", old_column="zz"),
             change(cid="exists", kind="add_column", old_column=None, new_column="a"),
             change(cid="free", kind="add_column", old_column=None, new_column="new")]
    changes = lineage.resolve_dataset(rows(CHANGE_SCHEMA, [(*c[:2], "shop.orders", *c[3:]) for c in cases]), rows("urn string", [(urn,)]))
    fields = rows("urn string, field_path string, native_type string", [(urn, "a", "decimal(12,2)"), (urn, "b", None)])
    got = collect(lineage.check_baseline(changes, fields), "change_id", "catalog_status")
    assert got == [("exists", "stale"), ("free", "complete"), ("gone", "stale"), ("ok", "complete"), ("stale", "stale"), ("untyped", "missing")]
    half = rows("urn string, exhausted boolean", [(urn, False)])
    got = dict(collect(lineage.check_baseline(changes, fields, half), "change_id", "catalog_status"))
    assert got["free"] == "truncated" and got["exists"] == "stale"


def brute_reach(edges, sources, hops):
    out = set()
    for s in sources:
        seen, front = {s}, {s}
        for h in range(1, hops + 1):
            front = {d for a, d in edges if a in front} - seen
            seen |= front
            out |= {(s, d, h) for d in front}
    return out


def test_reach_on_a_cyclic_graph_matches_brute_force(rows):
    edges = [(f"n{i}", f"n{(i * 7 + j) % 40}") for i in range(40) for j in (1, 5)] + [("n0", f"x{i}") for i in range(200)]
    sources = [f"n{i}" for i in range(0, 40, 3)]
    e, s = rows("src_urn string, dst_urn string", edges + edges), rows("source_urn string", [(x,) for x in sources])
    for hops in (1, 3, 5, None):
        got = lineage.downstream_reach(s, e, hops)
        assert set(collect(got.rows, "source_urn", "urn", "hop_count")) == brute_reach(edges, sources, hops or 50)
        left = {a for a in sources if len(brute_reach(edges, [a], hops or 50)) < len(brute_reach(edges, [a], 50))}
        assert {r.source_urn for r in got.truncated.collect()} == left
    assert lineage.downstream_reach(s.limit(0), e).rows.count() == 0


def test_reach_folded_in_parts_keeps_no_rows_of_a_part(rows, spark, tmp_path, monkeypatch):
    """Counts by parts of the sources are those of the whole trace, layered or not, and a part's hops are gone afterwards."""
    layered = [(f"a{i}", f"b{(i * j) % 7}") for i in range(9) for j in (1, 3)] + [(f"b{i}", f"c{i % 3}") for i in range(7)]
    monkeypatch.setattr(lineage, "SOURCES_A_PART", 2, raising=False)
    monkeypatch.setattr(lineage, "fresh_path", lambda spark, label: f"{tmp_path}/{label}-{uuid.uuid4().hex}")
    for more in ([], [("c0", "d"), ("d", "b1"), ("c1", "a2")]):
        sources = [f"a{i}" for i in range(9)] + [s for s, _ in more]
        reach = lineage.downstream_reach(rows("source_urn string", [(s,) for s in sources]), rows("src_urn string, dst_urn string", layered + more))
        counted = reach.folded(lambda ids: ids.groupBy("source", "hop_count").count())
        assert not list(tmp_path.glob("reach-*"))
        got = reach.names.join(counted, F.col("id") == F.col("source"))
        want = Counter((s, hop) for s, _, hop in brute_reach(layered + more, sources, 50))
        assert {(s, hop): n for s, hop, n in collect(got, "urn", "hop_count", "count")} == want
        assert reach._layered is (not more)


def test_column_reach_follows_columns_and_unknown_follows_all(rows):
    schema = "src_urn string, src_column string, dst_urn string, dst_column string"
    edges = rows(schema, [("t", "a", "m", "X"), ("t", "b", "n", "y"), ("m", "x", "d", "p"), ("m", "z", "e", "q"),
                          ("t", None, "board", None), ("board", "any", "f", "r"), ("m", "x", "t", "c"), ("t", "c", "g", "s")])
    got = lineage.column_reach(rows("source_urn string, start_column string", [("t", "A")]), edges).rows
    assert collect(got, "urn", "column", "hop_count") == sorted([
        ("m", "x", 1), ("board", None, 1), ("d", "p", 2), ("f", "r", 2), ("t", "c", 2), ("g", "s", 3)], key=repr)
    assets = collect(lineage.reached_assets(got), "urn", "hop_count", "has_columns")
    assert ("board", 1, False) in assets and not any(u == "t" for u, _, _ in assets)


def test_assertions_unknown_columns_keep(rows):
    datasets = rows("run_key string, change_id string, dataset_urn string, has_columns boolean", [
        ("r", "c", "known", True), ("r", "c", "unknown", False)])
    columns = rows("run_key string, change_id string, dataset_urn string, column string", [("r", "c", "known", "A")])
    assertions = rows("assertion_urn string, dataset_urn string, field string", [
        ("hit", "known", "a"), ("hit", "known", "b"), ("miss", "known", "b"), ("whole", "known", None),
        ("kept", "unknown", "b"), ("whole2", "unknown", None), ("elsewhere", "other", "a")])
    got = lineage.link_assertions(datasets, columns, assertions)
    assert collect(got, "assertion_urn", "unknown_columns") == [("hit", False), ("kept", True), ("whole", False), ("whole2", False)]
    status = lineage.assertion_status(rows("run_key string, change_id string", [("r", "c"), ("r", "none")]), got)
    assert collect(status, "change_id", "assertions") == [("c", "ambiguous"), ("none", "complete")]


def test_tags_and_owners(rows):
    tags = rows("urn string, tag string, tag_name string", [
        ("a", "urn:li:tag:x", "Business Critical"), ("b", "urn:li:tag:PII_data", None), ("c", "urn:li:tag:plain", None),
        ("d", "oops", None), ("e", "urn:li:tag:x", None), ("e", "urn:li:tag:x", None)])
    assert collect(lineage.tag_signals(tags)) == [
        ("a", True, False, False), ("b", False, True, False), ("c", False, False, False), ("d", False, False, True), ("e", False, False, True)]
    owners = rows("urn string, owner string", [("a", "urn:li:corpuser:x"), ("b", "someone"), ("c", "urn:li:corpGroup:g"), ("c", "urn:li:corpGroup:g")])
    assert collect(lineage.owners_state(owners)) == [("a", 1, False), ("b", 1, True), ("c", 1, True)]
    assets = rows("urn string, name string, ownership_known boolean", [("a", "A", True), ("n", "N", True), ("u", "U", False)])
    assert collect(lineage.asset_facts(assets, owners, tags), "urn", "has_owners") == [("a", True), ("n", False), ("u", None)]


PAGE = "request_id string, page_no int, page_offset bigint, returned bigint, total bigint, has_more boolean"


def test_page_audit(rows):
    good = [(0, 0, 2, 5, True), (1, 2, 2, 5, True), (2, 4, 1, 5, False)]
    cases = {
        "good": good, "empty": [(0, 0, 0, 0, False)], "late": good[1:], "gap": [good[0], good[2]],
        "total": [good[0], (1, 2, 2, 6, True), good[2]], "more": [good[0], good[1], (2, 4, 1, 5, True)],
        "short": [(0, 0, 2, 5, True)], "wide": [(0, 0, 101, 101, False)], "over": [(0, 0, 6, 5, False)],
    }
    pages = rows(PAGE, [(k, *p) for k, ps in cases.items() for p in ps])
    items = rows("request_id string, page_no int, item_urn string, degree int", [
        (k, p[0], f"urn:li:dataset:{p[0]}-{i}", 1) for k, ps in cases.items() for p in ps for i in range(p[2])])
    got = {k: (s, r) for k, s, r in collect(lineage.audit_pages(pages, items), "request_id", "status", "reason")}
    assert got["good"] == got["empty"] == ("complete", None)
    reasons = {k: v[1] for k, v in got.items() if v[0] == "truncated"}
    assert reasons == {"late": "offset_gap", "gap": "offset_gap", "total": "total_changed", "more": "page_invalid",
                       "short": "incomplete", "over": "page_invalid"}
    limited = dict(collect(lineage.audit_pages(pages, items, window=100, max_pages=2), "request_id", "reason"))
    assert limited["wide"] == "window_exceeded" and limited["good"] == "too_many_pages"


def test_page_audit_items(rows):
    pages = rows(PAGE, [(k, 0, 0, 2, 2, False) for k in ("twice", "shape", "deep")])
    items = rows("request_id string, page_no int, item_urn string, degree int", [
        ("twice", 0, "urn:li:dataset:a", 1), ("twice", 0, "urn:li:dataset:a", 1), ("shape", 0, "urn:li:dataset:a", 1),
        ("shape", 0, "nothing", 1), ("deep", 0, "urn:li:dataset:a", 1), ("deep", 0, "urn:li:dataset:b", 4)])
    got = collect(lineage.audit_pages(pages, items), "request_id", "reason")
    assert got == [("deep", None), ("shape", "item_invalid"), ("twice", "item_repeated")]
    assert collect(lineage.audit_pages(pages, items, max_hops=3), "request_id", "reason")[0] == ("deep", "item_invalid")
    more = items.unionByName(rows("request_id string, page_no int, item_urn string, degree int", [
        ("deep", 1, "urn:li:dataset:c", 1), ("lost", 0, "urn:li:dataset:c", 1)]))
    found = dict(collect(lineage.audit_pages(pages, more), "request_id", "reason"))
    assert found["deep"] == found["lost"] == "page_missing"
    cut = pages.withColumn("truncated_children", F.when(F.col("request_id") == "deep", 3))
    assert dict(collect(lineage.audit_pages(cut, items), "request_id", "reason"))["deep"] == "children_truncated"


def test_truncated_sources_need_no_rows(rows):
    """Sources with something left after the bound, whether found by nodes or by their own trace, which gives the same."""
    edges = rows("src_urn string, dst_urn string", [
        ("a", "b"), ("b", "c"), ("c", "d"),  # left after two hops: d, which nothing else reaches
        ("x", "y"), ("y", "z"), ("z", "w"), ("v", "w"),  # w is reached within the bound by v only
        ("e", "f"), ("f", "e"), ("g", None), ("h", "i"), ("i", "g")])
    sources = rows("source_urn string", [(s,) for s in "axvegh"] + [("a",), (None,), ("gone",)])
    cut = lineage.downstream_reach(sources, edges, max_hops=2)
    assert collect(cut.truncated) == [("a",), ("h",), ("x",)]
    assert "_traced" not in cut.__dict__
    assert collect(cut.rows.filter("hop_count = 2"), "source_urn", "urn") == [("a", "c"), ("h", "g"), ("x", "z")]
    assert collect(cut.truncated) == [("a",), ("h",), ("x",)]
    whole = lineage.downstream_reach(sources, edges)
    assert collect(whole.truncated) == [] and collect(whole.rows.filter("source_urn = 'x'"), "urn", "hop_count") == [("w", 3), ("y", 1), ("z", 2)]
    ordered = [r.urn for r in whole.names.orderBy("id").collect()]
    assert ordered == sorted(ordered)
    assert {tuple(r) for r in whole.ids.dtypes} == {("source", "bigint"), ("node", "bigint"), ("hop_count", "int")}


def _edges_of_columns(rows):
    return rows(
        "src_urn string, src_column string, dst_urn string, dst_column string",
        [
            ("t", "a", "u", "x"), ("t", "b", "u", "y"), ("t", None, "v", None), ("u", "x", "w", "z"), ("u", "y", "w", None),
            ("v", None, "t", None), ("w", "z", "s", "a"), ("s", "a", "t", "b"), ("w", "q", "r", "a"), ("t", "a", None, "n"),
            (None, "a", "u", "x"), ("far", "a", "away", "a"),
        ],
    )


def _columns_below(edges, starts):
    """Breadth-first, row by row: {(source, start, urn, column): hop}."""
    found = {}
    for source, column in {(s, c.lower()) for s, c in starts}:
        seen, frontier, hop = {(source, column)}, {(source, column)}, 0
        while frontier:
            hop += 1
            step = {
                (dst, dst_column if src_column is not None else None)
                for urn, col in frontier for src, src_column, dst, dst_column in edges
                if src is not None and src == urn and (col is None or src_column is None or src_column == col)
            }
            frontier = step - seen
            seen |= frontier
            found.update({(source, column, urn, col): hop for urn, col in frontier})
    return found


def test_column_reach_traces_without_numbering_the_names(rows, monkeypatch):
    starts = [("t", "A"), ("t", "b"), ("s", "a"), ("w", "q"), ("lost", "a")]
    edges = _edges_of_columns(rows)
    want = _columns_below([tuple(r) for r in edges.collect()], starts)
    shown = ("source_urn", "start_column", "urn", "column", "hop_count")

    def trace():
        return {tuple(r[:4]): r[4] for r in lineage.column_reach(rows("source_urn string, start_column string", starts), edges).rows.select(*shown).collect()}

    with monkeypatch.context() as patched:
        patched.setattr(lineage, "_numbered", lambda urns: pytest.fail("names are numbered"))
        assert trace() == want
    # Two names of one hash: numbers are made then, and the result is the same.
    monkeypatch.setattr(lineage, "_hashed", lambda urn: F.when(F.col(urn).isNotNull(), F.length(urn).cast("bigint")))
    assert trace() == want
    # All columns of one mark: the join by names still tells them apart.
    monkeypatch.setattr(lineage, "_mark", lambda column: F.lit(1).cast("bigint"))
    assert trace() == want


def test_failed_enrichments_are_left_out_without_moving_the_assets(spark, rows):
    many = spark.range(20_000).selectExpr(
        "concat('run:', id) as run_key", "'c' as change_id", "concat('urn:', id) as urn", "true as found", "id = 7 as malformed"
    )
    changes = many.select("run_key", "change_id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000b")
    try:
        kept = lineage.drop_unavailable(many, lineage.ownership_status(changes, many))
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert kept.count() == 19_999 and kept.filter("urn = 'urn:7'").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
