import hashlib
from decimal import Decimal

import pytest
from helpers import collect
from pyspark.sql import functions as F

from changegate.functions import identity, text
from changegate.operators import publish, quality, scan
from changegate.plans import publishing
from changegate.session import cut_lineage, exists, fresh_path, run_dir, shared_dir
from changegate.sources import manifests, tables

# One sample of every shape, built from parts so that no scan of this file finds them.
FLAGGED = [
    "-----BEGIN " + "OPENSSH PRIVATE KEY-----",
    "see sk-" + "proj-" + "0123456789abcdef",
    "(gh" + "p_" + "Z" * 20 + ")",
    "DH" + "PAT-" + "q" * 20,
    "AS" + "IA" + "0" * 16 + ".",
    "ey" + "J" + "h" * 10 + "." + "p" * 10 + "." + "s" * 10,
    "proxy-authorization: BEARER\t" + "m" * 16,
    "db_pass" + "word: '" + "k" * 20 + "'",
    "x-api-" + "key = " + "v" * 22,
    "my_client_" + "secret=" + "w" * 21,
    "aws-secret-access-" + "key=r\"" + "y" * 20,
]
CLEAN = [
    "plain words", "", None, "pass" + "word=" + "k" * 19, "pass" + "words: " + "k" * 30, "__to" + "ken=" + "k" * 30, "a__to" + "ken=" + "k" * 30,
    "to" + "ken: sample-" + "k" * 20, "basic authorization only", "gh" + "p_short", "AK" + "IA" + "0" * 15, "ops@db.internal.test", "privacy@firm.io",
    "x@deep.example.net", "@nobody",
]


def test_verdicts(rows):
    docs = [(f"s{i}", t) for i, t in enumerate(FLAGGED)] + [(f"c{i}", t) for i, t in enumerate(CLEAN)]
    docs += [("mail", "<k.v+z" + "@" + "post.firm.io>"), ("path", "D:" + "\\\\Users\\\\kv\\\\x and key " + FLAGGED[4])]
    got = dict(collect(scan.scan_verdict(rows("id string, body string", docs), "id", "body")))
    assert all(got[f"s{i}"] == "credential-shaped content" for i in range(len(FLAGGED)))
    assert all(got[f"c{i}"] is None for i in range(len(CLEAN)))
    assert got["mail"] == "a personal email-shaped address" and got["path"] == "a local absolute path"


def test_long_runs_do_not_end_the_job(rows):
    """No pattern may use stack with the length of what it matches."""
    parts = "token" + "-ab_cd" * 50_000
    value = "=" + "k" * 20
    docs = [("none", parts), ("kept", parts + "-pass" + "word" + value), ("run", "_".join(["ab"] * 50_000) + "_to" + "ken" + value),
            ("quoted", "'" * 100_001 + '"' * 100_001), ("mails", "a.b-" * 50_000 + "@" + "c.d-" * 50_000)]
    got = dict(collect(scan.scan_secrets(rows("id string, body string", docs), "id", "body"), "id", "kept_hits"))
    assert got == {"none": 0, "kept": 1, "run": 1, "quoted": 0, "mails": 0}
    assert dict(collect(scan.scan_verdict(rows("id string, body string", docs), "id", "body")))["run"] == "credential-shaped content"
    literal = "'" + "x''" * 300_000 + "y" * 100_000 + "'"
    exprs = rows("e string", [(f"F( {literal} )",), (f"f({literal})",), ('"' + 'A""' * 300_000 + '" . b',)])
    first, second, third = (r[0] for r in exprs.select(text.normalize_expression(F.col("e"))).collect())
    assert first == second and literal in first and third.count('""') == 300_000
    assert exprs.select(F.length(text.canonical_relation(F.col("e")))).collect()[2][0] > 900_000


def test_hits_at_the_end_of_a_long_text_count(rows):
    body = "words and more words. " * 20000 + FLAGGED[7]
    assert scan.scan_secrets(rows("id int, body string", [(1, body)]), "id", "body").first().kept_hits == 1


def test_paths_and_checksums(rows):
    paths = rows("path string", [(p,) for p in ("/a", "a\\b", "a/../b", "Target/x", "a/.env", "x.PYC", "a/.pyc", "ok/x.sql", "mine/x")])
    got = dict(collect(scan.unsafe_paths(paths, extra_segments=("mine",))))
    assert got == {"/a": "absolute", "a\\b": "backslash", "a/../b": "parent_segment", "Target/x": "build_state",
                   "a/.env": "secret_state", "x.PYC": "local_database_or_bytecode", "mine/x": "build_state"}
    digest = hashlib.sha256(b"body").hexdigest()
    lines = rows("value string", [(f"{digest}  ok",), (f"{digest}  bad",), (f"{digest}  lost",), (f"{digest}  p.png",), (f"{digest} one",)])
    listed = scan.parse_checksums(lines)
    assert listed.filter("path is null").count() == 1
    actual = rows("path string, content string", [("ok", "body"), ("bad", "other"), ("extra", "x"), ("p.png", "body")])
    got = collect(scan.verify_checksums(listed, actual))
    assert got == sorted([("bad", "mismatch"), ("extra", "unexpected"), ("lost", "missing"), ("p.png", "not_png"), (f"{digest} one", "malformed_line")], key=repr)
    required = rows("path string", [("b/c.txt",), ("c.txt",), ("zz",)])
    present = rows("name string", [("a/b/c.txt",), ("c.txt",)])
    assert collect(scan.required_assets(required, present)) == [("c.txt", 2), ("zz", 0)]
    assert collect(scan.required_assets(required, present, exact=True)) == [("b/c.txt", 0), ("zz", 0)]


def states(rows, risk=5, **bad):
    base = dict(source="urn:li:dataset:a", run="run-1", decision="PASS", text="# ok")
    base.update(bad)
    return rows("source_urn string, run_id string, original_risk int, residual_risk int, decision string, remediation_status string, "
                "evidence_hash string, commit_sha string, markdown string, document_urn string",
                [(base["source"], base["run"], risk, risk, base["decision"], "TESTED", "e", "c", base["text"], None)])


def test_two_phase_publish(spark, rows):
    store = publish.Store(fresh_path(spark, "publish-test"))
    go = lambda df, name: tuple(publish.verified_publish(spark, df, store, name).first())[2:]
    assert go(states(rows), "1") == ("VERIFIED", None)
    assert go(states(rows), "2") == ("VERIFIED", "already_published")
    assert go(states(rows, risk=7), "3") == ("VERIFIED", None)
    assert go(states(rows, decision="MAYBE"), "4") == ("WRITEBACK_PENDING", "invalid_state")
    twice = states(rows).unionByName(states(rows, run="run-2"))
    assert collect(publish.verified_publish(spark, twice, store, "5"), "reason") == [("several_states_for_source",)] * 2
    assert publish.published(spark, store).first().original_risk == 7


@pytest.mark.parametrize(("bad", "rule"), [
    (dict(text=""), "document_size_invalid"), (dict(text="é" * 4097), "document_size_invalid"), (dict(run="a b"), "run_id_invalid"),
    (dict(run="a\n"), "run_id_invalid"), (dict(source="urn:li:chart:x"), "source_not_a_dataset"), (dict(decision=None), "decision_invalid")])
def test_publish_rules(rows, bad, rule):
    assert [v for *_, v in collect(publish.validate_publish(states(rows, **bad), max_document_bytes=8192))] == [rule]
    assert publish.validate_publish(states(rows)).count() == 0
    assert publish.validate_publish(states(rows, text="é" * 100_000)).count() == 0


def test_ledger_is_immutable(spark, rows):
    store = publish.Store(fresh_path(spark, "ledger-test"))
    make = lambda *items: rows("run_id string, created_at string, artifact_hash string", list(items))
    a, b = ("r1", "2024-01-01 00:00:00", "a" * 64), ("r2", "2024-02-01 00:00:00", "b" * 64)
    assert collect(tables.append_ledger(spark, make(a, a), store), "outcome") == [("appended",)] * 2
    other = (a[0], a[1], "a" * 12 + "c" * 52)  # the same run under another seal that starts alike
    got = collect(tables.append_ledger(spark, make(a, b), store), "run_id", "outcome")
    assert got == [("r1", "identical"), ("r2", "appended")]
    assert collect(tables.append_ledger(spark, make(other, ("r3", a[1], "x")), store), "run_id", "outcome") == [
        ("r1", "appended"), ("r3", "refused_malformed_seal")]
    assert collect(tables.append_ledger(spark, make(other, ("r4", "no time", "d" * 64)), store), "run_id", "outcome") == [("r1", "identical"), ("r4", "appended")]
    ledger = tables.read_ledger(spark, store)
    assert ledger.count() == 4 and tables.latest_run(ledger).first().run_id == "r2"


def test_digest_is_order_free_and_counts_copies(rows):
    data = [("k", 1, "a"), ("k", 2, "b"), ("k", 2, "b"), ("m", 1, "a"), ("m", 2, "b")]
    df = rows("k string, n int, t string", data * 50)
    one = collect(identity.content_digest(df, ["k"], ["n", "t"]))
    assert one == collect(identity.content_digest(df.orderBy(F.rand(1)), ["k"], ["n", "t"]))
    assert one[0][1] != one[1][1] and [n for *_, n in one] == [150, 100]


def test_text_functions(rows):
    df = rows("a string", [("  Ab ",), ('q"x',), ("",), (None,)])
    assert [r[0] for r in df.select(text.normalize_identifier(F.col("a"))).collect()] == ["ab", 'q"x', None, None]
    quoted = text.normalize_identifier(F.col("a"), F.lit(True))
    assert [r[0] for r in df.select(quoted).collect()] == ['"Ab"', '"q""x"', None, None]
    types = rows("t string", [("varchar",), ("varchar(3)",), ("decimal(12,2)",), (" numeric ( 5 ) ",), ("bigint",), ("timestamp  with time zone",)])
    assert [r[0] for r in types.select(text.canonical_type(F.col("t"), text.one_text_type(F.lit("duckdb")))).collect()] == [
        "TEXT", "TEXT", "DECIMAL(12, 2)", "DECIMAL(5)", "BIGINT", "TIMESTAMP WITH TIME ZONE"]
    assert [r[0] for r in types.select(text.canonical_type(F.col("t"), text.one_text_type(F.lit("postgres")))).collect()][:2] == ["VARCHAR", "VARCHAR(3)"]
    urns = rows("u string", [("urn:li:dataset:(urn:li:dataPlatform:x,a%2Fb+c,PROD)",), ("urn:li:dataset:(x,PROD)",), ("urn:li:chart:1",)])
    assert [r[0] for r in urns.select(text.dataset_name(F.col("u"))).collect()] == ["a/b+c", None, None]
    paths = rows("p string", [("a\\b//c/./d/",), ("/x//y",), (".",), ("",), (None,)])
    assert [r[0] for r in paths.select(text.posix_path(F.col("p"))).collect()] == ["a/b/c/d", "/x/y", ".", ".", None]
    exprs = rows("e string", [("CAST( A  AS int )",), ("cast(a as INT)",), ("f('X  y')",), ("F('x  y')",)])
    got = [r[0] for r in exprs.select(text.normalize_expression(F.col("e"))).collect()]
    assert got[0] == got[1] and got[2] != got[3]


def test_quality(rows):
    staged = rows("order_date string, currency string, status string, order_total decimal(12,2)", [
        ("d1", "GBP", "completed", None), ("d1", "GBP", "completed", Decimal(3)), ("d2", "GBP", "pending", Decimal(9))])
    mart = quality.daily_revenue(staged)
    assert collect(mart, "order_date", "order_count") == [("d1", 2)]
    assert quality.reconcile(mart, mart, ["order_date", "currency"], ["order_count", "gross_revenue"]).count() == 0
    assert quality.reconcile(mart, mart.limit(0), ["order_date", "currency"], ["order_count"]).count() == 1
    keys = rows("k int", [(1,), (1,), (None,), (None,), (2,)])
    assert collect(quality.unique(keys, ["k"])) == [(1, 2)]
    assert quality.accepted_values(keys, "k", [1]).count() == 1 and quality.not_null(keys, "k").count() == 2
    report = quality.test_report(keys, [quality.Check("nn", F.col("k").isNull()), quality.Check("uq", unique_on=("k",))])
    assert collect(report) == [("nn", 2, "fail"), ("uq", 1, "fail")]


class Named:
    """A session that names a shared folder, on a cluster or not."""

    def __init__(self, folder, master):
        self.folder, self.sparkContext, self.conf = folder, self, self
        self.master, self.applicationId = master, "app"

    def get(self, key, default):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_stages_go_to_the_named_folder(spark, rows):
    assert shared_dir(Named("hdfs:///shared", "yarn")) == "hdfs:///shared"
    local = Named(None, "local[2]")
    assert shared_dir(local) == shared_dir(local) == local.folder
    with pytest.raises(ValueError):
        shared_dir(Named(None, "spark://host:7077"))
    staged = cut_lineage(rows("k int", [(1,), (2,)]))
    assert staged.count() == 2 and shared_dir(spark) in staged.inputFiles()[0]
    assert exists(spark, run_dir(spark))


def test_stages_follow_the_tables(spark, rows, tmp_path):
    from changegate.plans.staging import staged

    rows("k int", [(1,)]).write.parquet(str(tmp_path / "t.parquet"))
    read = lambda: staged(spark, str(tmp_path), "copy", lambda: spark.read.parquet(str(tmp_path / "t.parquet")))
    assert read().count() == 1 and read().inputFiles() == read().inputFiles()
    rows("k int", [(2,), (3,)]).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert read().count() == 3


def test_readback_folds_rows_in_map_tasks(rows):
    """Nothing sorted by text, and odd rows judged as ever."""
    state = ("run_id string, source_urn string, original_risk int, residual_risk int, decision string, remediation_status string, "
             "evidence_hash string, commit_sha string, writeback_state string")
    names = ("fine", "twice", "value", "kind", "number", "null", "more", "tags", "other")
    data = [("r", n, 7, 3, "PASS", "TESTED", None if n == "null" else "h", "c", "VERIFIED") for n in (*names, "twice")] + [("r", None, 7, 3, "PASS", "TESTED", "h", "c", "VERIFIED")]
    states = rows(state, data)
    risk, name = F.col("property").endswith("originalRisk"), F.col("property").endswith("runId")
    seen = publish.expected_properties(rows(state, list(dict.fromkeys(data))))
    seen = seen.withColumn("value", F.when((F.col("urn") == "number") & risk, "7.000").when((F.col("urn") == "value") & name, "x").otherwise(F.col("value")))
    seen = seen.withColumn("value_type", F.when((F.col("urn") == "kind") & name, "number").otherwise(F.col("value_type")))
    seen = seen.unionByName(seen.filter((F.col("urn") == "more") & name)).unionByName(rows("urn string, property string, value_type string, value string", [("fine", "elsewhere", "string", "x")]))
    tag = publish.DECISION_TAG_PREFIX
    tags = rows("urn string, tag string", [(n, tag + "PASS") for n in (*names[:-1], None)] + [("other", tag + "BLOCK"), ("tags", tag + "REVIEW"), ("fine", "urn:li:tag:x")])
    judged = publish.readback_match(states, seen, tags)
    assert dict(collect(judged)) == {n: n in ("fine", "number", None) for n in (*names, None)}
    assert "SortAggregate" not in judged._jdf.queryExecution().executedPlan().toString()


def test_readback_wants_one_row_a_state(rows):
    """What is wanted is no longer a row for each property, and no part of a digest goes through another number base."""
    wanted = rows("run_id string, source_urn string, original_risk int, residual_risk int, decision string, remediation_status string, "
                  "evidence_hash string, commit_sha string, writeback_state string", [("r", "u", 7, 3, "PASS", "TESTED", "h", "c", "VERIFIED")])
    seen = rows("urn string, property string, value_type string, value string", [tuple(r) for r in publish.expected_properties(wanted).collect()])
    judged = publish.readback_match(wanted, seen, rows("urn string, tag string", [("u", publish.DECISION_TAG_PREFIX + "PASS")]))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert collect(judged) == [("u", True)] and "Generate" not in plan and "conv(" not in plan


def test_manifests_are_parsed_once_from_folders_of_any_depth(spark, rows, tmp_path):
    document = '{"nodes": {"m.%s": {"resource_type": "model", "schema": "s", "name": "t", "columns": {}}}}'
    texts = {"a/name=p1": document % 1, "name=p2": document % 2, "a/b/c": "{", "empty": '{"nodes": {}}'}
    for place, text_ in texts.items():
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / "f.json").write_text(text_)
    docs = manifests.read_manifests(spark, str(tmp_path), "regexp_extract(path, '([^/]+)/f.json', 1)", "before")
    parsed = manifests.parse_manifests(docs)
    assert collect(parsed.nodes, "run_key", "unique_id", "relation") == [("name=p1", "m.1", "s.t"), ("name=p2", "m.2", "s.t")]
    assert collect(parsed.rejections) == [("c", "manifest_invalid", "before")]
    assert "parse_json" not in parsed.rejections._jdf.queryExecution().optimizedPlan().toString()


def test_manifest_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One file a change set, spread over tasks however few bytes they are; all of them are read back."""
    spark.range(40).selectExpr("id as p_partkey", "concat('Part ', id) as p_name").write.parquet(f"{tmp_path}/in/part.parquet")
    monkeypatch.setattr(publishing, "FILES_A_TASK", 4, raising=False)
    monkeypatch.setattr(publishing, "fresh_path", lambda spark, label: f"{tmp_path}/{label}")
    got = publishing.q_read_manifests(spark, f"{tmp_path}/in")
    files = list((tmp_path / "manifests").rglob("name=part-*/*.txt"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 5
    # No test kind (every seventh), unless its manifest is damaged.
    assert {r["run_key"] for r in got.select("run_key").collect()} == {f"run:{k}" for k in range(40) if k % 7 or k % 17 == 0}
