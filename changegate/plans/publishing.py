"""Queries of sealing, read-back, publication and the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from changegate.functions import identity
from changegate.operators import publish
from changegate.plans import scoring
from changegate.plans.diffing import DIFF_VIEWS, gate_changes
from changegate.plans.views import table, view, with_clause
from changegate.session import fresh_path
from changegate.sources import manifests, tables


def passports(spark, sf_dir):
    """Orders as publishable states; some break a rule."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 101 == 0, F.concat(F.lit("table:"), k))
        .otherwise(F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:warehouse,shop.order_"), k, F.lit(",PROD)")))
        .alias("source_urn"),
        F.when(k % 103 == 0, F.concat(F.lit("run "), k)).otherwise(F.concat(F.lit("run-"), k)).alias("run_id"),
        (k % 110).cast("int").alias("original_risk"),
        (k % 90).cast("int").alias("residual_risk"),
        F.when(k % 4 == 0, "PASS")
        .when(k % 4 == 1, "REVIEW")
        .when(k % 4 == 2, "BLOCK")
        .otherwise(F.when(k % 107 == 0, "MAYBE").otherwise("PASS_WITH_REMEDIATION"))
        .alias("decision"),
        F.lit("TESTED").alias("remediation_status"),
        F.sha2(k.cast("string"), 256).alias("evidence_hash"),
        F.substring(F.sha2("o_orderstatus", 256), 1, 40).alias("commit_sha"),
        F.when(k % 109 == 0, F.lit("")).when(k % 113 == 0, F.repeat(F.lit("é"), 5000)).otherwise(
            F.concat(F.lit("# Decision of "), k)
        ).alias("markdown"),
        F.when(k % 3 == 0, F.concat(F.lit("urn:li:document:"), F.when(k % 127 == 0, F.lit("a b")).otherwise(k.cast("string")))).alias(
            "document_urn"
        ),
    )


def _verified(spark, sf_dir):
    return passports(spark, sf_dir).withColumn("writeback_state", F.lit("VERIFIED"))


def q_validate_publish(spark, sf_dir):
    return publish.validate_publish(passports(spark, sf_dir))


def _key(column: str):
    return F.regexp_extract(column, r"(\d+)(,PROD\))?$", 1).cast("bigint")


def q_readback_match(spark, sf_dir):
    """Read back what was written, after damage to some properties and tags."""
    states = _verified(spark, sf_dir)
    k = _key("urn")
    name = F.substring_index("property", ".", -1)
    written = publish.expected_properties(states).withColumn(
        "value",
        F.when((k % 5 == 0) & (name == "originalRisk"), F.concat("value", F.lit(".0")))
        .when((k % 7 == 0) & (name == "decision"), F.lit("PASS"))
        .otherwise(F.col("value")),
    ).filter(~((k % 11 == 0) & (name == "commitSha")))
    again = written.filter((k % 13 == 0) & (name == "runId"))
    tags = states.select(
        F.col("source_urn").alias("urn"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        _key("source_urn") % 17 != 0, F.concat(F.lit(publish.DECISION_TAG_PREFIX), "decision")
                    ),
                    F.when(_key("source_urn") % 19 == 0, F.lit(publish.DECISION_TAG_PREFIX + "PASS")),
                    F.lit("urn:li:tag:internal"),
                )
            )
        ).alias("tag"),
    )
    return publish.readback_match(states, written.unionByName(again), tags)


def q_match_document(spark, sf_dir):
    states = passports(spark, sf_dir).filter(F.col("document_urn").isNotNull())
    k = _key("source_urn")
    titled = states.withColumn("title", F.concat(F.lit(publish.DOCUMENT_TITLE), "run_id"))
    related = titled.filter(k % 5 != 0).select(
        "source_urn", "document_urn", F.when(k % 7 == 0, F.lit("draft")).otherwise(F.col("title")).alias("title")
    )
    contents = titled.select(
        "document_urn", "title", F.when(k % 11 == 0, F.concat("markdown", F.lit(" "))).otherwise(F.col("markdown")).alias("content")
    )
    return publish.match_document(states, related, contents)


def q_verified_publish(spark, sf_dir):
    """Publish all states, then all again with some changed: the rest is a no-op."""
    store = publish.Store(fresh_path(spark, "published"))
    first = passports(spark, sf_dir)
    publish.verified_publish(spark, first, store, "first")
    k = _key("source_urn")
    second = first.withColumn(
        "residual_risk", F.when(k % 10 == 0, F.lit(1)).otherwise(F.col("residual_risk"))
    )
    return publish.verified_publish(spark, second, store, "second")


PAYLOAD = ["run_id", "created_at", "decision", "score", "analyzed_input_state", "schema_version"]


def _ledger(spark, sf_dir):
    """Orders as run records, sealed; some are then altered."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run-"), F.substring(F.sha2(k.cast("string"), 256), 1, 16)).alias("run_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.when(k % 2 == 0, "PASS").otherwise("BLOCK").alias("decision"),
        (k % 100).cast("int").alias("score"),
        F.when(k % 6 != 0, "SUPPLIED_MANIFESTS").alias("analyzed_input_state"),
        F.when(k % 3 == 0, "1.0").when(k % 31 == 0, "2.0").otherwise("1.1").alias("schema_version"),
        k.alias("k"),
    )
    return publish.seal(runs, PAYLOAD)


def q_verify_seal(spark, sf_dir):
    runs = _ledger(spark, sf_dir)
    damaged = runs.withColumn("score", F.when(F.col("k") % 7 == 0, F.lit(0)).otherwise(F.col("score"))).withColumn(
        "artifact_hash",
        F.when(F.col("k") % 11 == 0, F.upper("artifact_hash")).otherwise(F.col("artifact_hash")),
    )
    return publish.verify_seal(damaged, PAYLOAD)


def q_append_ledger(spark, sf_dir):
    """Record two thirds of the runs, then all, some with a damaged seal."""
    store = publish.Store(fresh_path(spark, "ledger"))
    runs = _ledger(spark, sf_dir).drop("k")
    k = F.substring("created_at", 9, 2).cast("int")
    tables.append_ledger(spark, runs.filter(k % 3 != 0), store)
    again = runs.withColumn(
        "artifact_hash", F.when(k % 10 == 0, F.lit("none")).otherwise(F.col("artifact_hash"))
    )
    return tables.append_ledger(spark, again, store).select("run_id", "outcome")


def q_latest_run(spark, sf_dir):
    store = publish.Store(fresh_path(spark, "ledger"))
    tables.append_ledger(spark, _ledger(spark, sf_dir).drop("k"), store)
    return tables.latest_run(tables.read_ledger(spark, store)).select("run_id", "created_at", "decision", "score")


def q_upsert_catalog(spark, sf_dir):
    """Order lines as catalog observations: the last value per order and aspect."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order:"), "l_orderkey").alias("urn"),
        F.concat(F.lit("flag_"), F.lower("l_linestatus")).alias("aspect"),
        F.concat_ws("/", "l_returnflag", "l_linenumber", "l_partkey").alias("value"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("observed_at"),
    )
    return tables.upsert_catalog(
        lines.filter(~F.col("value").startswith("R")), lines.filter(F.col("value").startswith("R"))
    )


def q_read_seed(spark, sf_dir):
    """Orders written as CSV and read back with the seed's types."""
    path = fresh_path(spark, "seed")
    view(spark, sf_dir, "staged_orders").write.option("header", True).csv(path)
    return tables.read_seed(spark, path).withColumn("order_total", F.col("order_total").cast("double"))


def q_materialize(spark, sf_dir):
    """Staging as a view and the mart as a stored table, read by name."""
    from changegate.operators.quality import daily_revenue

    tables.materialize(view(spark, sf_dir, "staged_orders"), "changegate_stg_orders")
    mart = daily_revenue(spark.table("changegate_stg_orders"))
    tables.materialize(mart, "changegate_daily_revenue", fresh_path(spark, "mart"))
    return spark.table("changegate_daily_revenue").groupBy("currency").agg(
        F.sum("order_count").alias("n_orders"), F.sum("gross_revenue").cast("double").alias("revenue")
    )


def _documents(spark, sf_dir):
    """Parts as model manifests in JSON, one node and one column each, of two adapters; some are damaged.

    Equal settings are written in two orders and layouts; constraints are objects or names.  The damage: half a document, a
    list of columns, a type that is a number, flags that are texts, a node that is a text or is there twice.
    """
    k = F.col("p_partkey")
    column = F.struct(
        F.initcap("p_name").alias("name"),
        F.when(k % 5 != 0, "varchar(10)").alias("data_type"),
        F.when(k % 3 == 0, k % 2 == 0).alias("nullable"),
        F.when(k % 3 == 1, F.lit(True)).alias("not_null"),
        (k % 4 == 0).alias("quote"),
        F.when(k % 3 == 2, F.lit("@CONSTRAINTS@")).alias("constraints"),
    )
    node = F.struct(
        F.when(k % 7 == 0, "test").when(k % 2 == 0, "model").otherwise("seed").alias("resource_type"),
        F.when(k % 6 == 0, F.concat(F.lit('"Shop".T'), k)).alias("relation_name"),
        F.lit("Main").alias("schema"),
        F.concat(F.lit("t"), k).alias("name"),
        F.when(k % 11 != 0, F.lit("@CONFIG@")).alias("config"),
        F.lit("@KEYS@").alias("constraints"),
        F.create_map(F.lit("c"), column).alias("columns"),
    )
    manifest = F.struct(
        F.struct(F.when(k % 8 == 0, "postgres").otherwise("duckdb").alias("adapter_type")).alias("metadata"),
        F.create_map(F.concat(F.lit("model.shop.t"), k), node).alias("nodes"),
    )
    config = F.when(k % 2 == 0, '{"b": {"y": 1, "x": [1, 2]},  "a": "t"}').otherwise('{"a":"t","b":{"x":[1,2],"y":1}}')
    keys = F.concat(F.lit('[{"type": "foreign_key", "to": "t'), k % 4, F.lit('"}]'))
    columns = F.when(k % 2 == 0, '["Not Null"]').otherwise('[{"name": "n", "type": "not_null"}]')
    body = F.to_json(manifest)
    for mark, value in (("CONFIG", config), ("KEYS", keys), ("CONSTRAINTS", columns)):
        body = F.replace(body, F.lit(f'"@{mark}@"'), value)
    named = F.concat(F.lit('"model.shop.t'), k, F.lit('":'))
    damaged = (
        F.when(k % 17 == 0, F.lit('{"nodes": 1'))
        .when(k % 67 == 0, F.regexp_replace(body, '"columns":[{].*', '"columns":[]}}}'))
        .when(k % 71 == 0, F.regexp_replace(body, '"data_type":"[^"]*"', '"data_type":5'))
        .when(k % 73 == 0, F.regexp_replace(body, '"quote":(true|false)', '"quote":"yes"'))
        .when(k % 79 == 0, F.replace(body, F.lit('"not_null":true'), F.lit('"not_null":"no"')))
        .when(k % 83 == 0, F.concat(F.lit('{"metadata":{},"nodes":{'), named, F.lit('"a text"}}')))
        .when(k % 89 == 0, F.concat(F.substring_index(body, '"nodes":{', 1), F.lit('"nodes":{'), named, F.lit("{},"), F.substring_index(body, '"nodes":{', -1)))
        .otherwise(body)
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("run:"), k).alias("run_key"), F.lit("before").alias("side"), damaged.alias("json"), F.col("p_partkey")
    )


def _projections(spark, sf_dir):
    k = F.col("p_partkey")
    twice = F.when(k % 19 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    base = table(spark, sf_dir, "part").select(
        F.concat(F.lit("run:"), k).alias("run_key"),
        F.lit("before").alias("side"),
        F.concat(F.lit("model.shop.t"), k).alias("unique_id"),
        F.explode(twice).alias("ordinal"),
        F.initcap("p_name").alias("name"),
        (k % 4 == 0).alias("quoted"),
        F.concat(F.lit("src."), "p_name").alias("expression"),
        F.when(k % 10 == 0, "int").when(k % 23 == 0, "bigint").alias("cast_type"),
    )
    extra = base.filter(F.col("ordinal") == 0).withColumn("name", F.lit("Extra")).withColumn("quoted", F.lit(False)).withColumn("ordinal", F.lit(1))
    return base.unionByName(extra.withColumn("cast_type", F.lit("date")))


def q_parse_manifests(spark, sf_dir):
    return manifests.parse_manifests(_documents(spark, sf_dir)).nodes.select(
        "run_key", "unique_id", "resource_type", "relation", "adapter_type", "config_sha256", "model_constraints_sha256"
    )


FILES_A_TASK = 256  # manifests, each a file of its own, that a task writes


def q_read_manifests(spark, sf_dir):
    """All manifests, the damaged ones too, written as one file a change set, read back and parsed: nodes and rejections."""
    path = fresh_path(spark, "manifests")
    # The documents are few bytes and many files: without a number, Spark would join the partitions into one task that writes all.
    n = -(-table(spark, sf_dir, "part").count() // FILES_A_TASK) or 1
    named = _documents(spark, sf_dir).select(F.concat(F.lit("part-"), "p_partkey").alias("name"), F.col("json").alias("value"))
    # Folders of folders are listed by a task each, a flat one by the driver.
    folder = F.coalesce(F.pmod(F.xxhash64("name"), F.lit(n)), F.lit(0))
    named.withColumn("folder", folder).repartition(n, "folder", "name").write.option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2"
    ).partitionBy("folder", "name").text(path)
    docs = manifests.read_manifests(spark, path, r"concat('run:', regexp_extract(path, 'name=part-([0-9]+)/', 1))", "before")
    parsed = manifests.parse_manifests(docs)
    nodes = parsed.nodes.select("run_key", F.col("resource_type").alias("outcome"), F.col("relation").alias("detail"))
    return nodes.unionByName(parsed.rejections.withColumnRenamed("reason", "outcome"))


def q_manifest_rejections(spark, sf_dir):
    parsed = manifests.parse_manifests(_documents(spark, sf_dir))
    columns = manifests.manifest_columns(parsed.nodes, _projections(spark, sf_dir))
    return parsed.rejections.unionByName(columns.rejections)


def q_manifest_columns(spark, sf_dir):
    parsed = manifests.parse_manifests(_documents(spark, sf_dir))
    return manifests.manifest_columns(parsed.nodes, _projections(spark, sf_dir)).columns.drop("side")


def q_content_digest(spark, sf_dir):
    """Order-free digest of each order's lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return identity.content_digest(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_returnflag"])


def q_change_summary(spark, sf_dir):
    return publish.change_summary(gate_changes(spark, sf_dir))


def q_blast_radius_summary(spark, sf_dir):
    merged = scoring._merged(spark, sf_dir)
    return publish.blast_radius_summary(merged.assets, merged.members)


QUERIES = {
    "validate_publish": q_validate_publish,
    "readback_match": q_readback_match,
    "match_document": q_match_document,
    "verified_publish": q_verified_publish,
    "verify_seal": q_verify_seal,
    "append_ledger": q_append_ledger,
    "latest_run": q_latest_run,
    "upsert_catalog": q_upsert_catalog,
    "read_seed": q_read_seed,
    "materialize": q_materialize,
    "parse_manifests": q_parse_manifests,
    "read_manifests": q_read_manifests,
    "manifest_rejections": q_manifest_rejections,
    "manifest_columns": q_manifest_columns,
    "content_digest": q_content_digest,
    "change_summary": q_change_summary,
    "blast_radius_summary": q_blast_radius_summary,
}

_PASS = """select k, case when k % 101 = 0 then 'table:' || k
    else 'urn:li:dataset:(urn:li:dataPlatform:warehouse,shop.order_' || k || ',PROD)' end as source_urn,
  case when k % 103 = 0 then 'run ' else 'run-' end || k as run_id, k % 110 as original_risk, k % 90 as residual_risk,
  case k % 4 when 0 then 'PASS' when 1 then 'REVIEW' when 2 then 'BLOCK'
    else case when k % 107 = 0 then 'MAYBE' else 'PASS_WITH_REMEDIATION' end end as decision,
  case when k % 109 = 0 then 'empty' when k % 113 = 0 then 'large' else 'fine' end as body,
  case when k % 3 = 0 then 'urn:li:document:' || case when k % 127 = 0 then 'a b' else cast(k as varchar) end end as document_urn
  from (select o_orderkey as k from orders) o"""
_INVALID = """select run_id, source_urn, 'run_id_invalid' as violation from p where k % 103 = 0
union all select run_id, source_urn, 'source_not_a_dataset' from p where k % 101 = 0
union all select run_id, source_urn, 'decision_invalid' from p where decision = 'MAYBE'
union all select run_id, source_urn, 'risk_score_invalid' from p where original_risk > 100
union all select run_id, source_urn, 'document_size_invalid' from p where body = 'empty'
union all select run_id, source_urn, 'document_urn_invalid' from p where document_urn like '% %'"""

# What is damaged in the manifest of part k.
_DAMAGE = """case when {k} % 17 = 0 then 'json' when {k} % 67 = 0 then 'columns' when {k} % 71 = 0 then case when {k} % 5 <> 0 then 'data_type' end
  when {k} % 73 = 0 then 'quote' when {k} % 79 = 0 then case when {k} % 3 = 1 then 'not_null' end when {k} % 83 = 0 then 'node'
  when {k} % 89 = 0 then 'json' end"""
_PART_DAMAGE = _DAMAGE.format(k="p_partkey")
_REJECTED = f"""select run_key, case damage when 'json' then 'manifest_invalid' when 'node' then 'node_invalid' when 'columns' then 'columns_invalid'
    else 'column_invalid' end as reason, case damage when 'json' then 'before' when 'node' then unique_id when 'columns' then unique_id
    else unique_id || '.c.' || damage end as detail
  from (select 'run:' || p_partkey as run_key, 'model.shop.t' || p_partkey as unique_id, p_partkey % 7 as kind, {_PART_DAMAGE} as damage from part) d
  where damage in ('json', 'node') or (damage is not null and kind <> 0)"""

ORACLES = {
    "validate_publish": f"with p as ({_PASS}) {_INVALID}",
    "readback_match": f"""with p as ({_PASS})
select source_urn as urn, not ((k % 7 = 0 and decision <> 'PASS') or k % 11 = 0 or k % 13 = 0 or decision = 'MAYBE'
  or (k % 17 = 0 and (k % 19 <> 0 or decision <> 'PASS')) or (k % 17 <> 0 and k % 19 = 0)) as ok from p""",
    "match_document": f"""with p as ({_PASS} ), d as (select *, count(*) over (partition by document_urn) as n from p
  where document_urn is not null)
select source_urn, document_urn, k % 5 <> 0 and k % 7 <> 0 and k % 11 <> 0 and n = 1 as ok from d""",
    "verified_publish": f"""with p as ({_PASS}), bad as ({_INVALID})
select run_id, source_urn, case when invalid then 'WRITEBACK_PENDING' else 'VERIFIED' end as state,
  case when invalid then 'invalid_state' when k % 10 <> 0 or residual_risk = 1 then 'already_published' end as reason
from (select p.*, exists (select 1 from bad where bad.run_id = p.run_id and bad.source_urn = p.source_urn) as invalid from p) x""",
    "verify_seal": """
with r as (select o_orderkey as k, 'run-' || substr(sha256(cast(o_orderkey as varchar)), 1, 16) as run_id,
  o_orderkey % 6 <> 0 as has_state, case when o_orderkey % 3 = 0 then '1.0' when o_orderkey % 31 = 0 then '2.0' else '1.1' end as v
  from orders),
s as (select run_id, case when v = '2.0' then 'unsupported_version' when v = '1.0' and has_state then 'provenance_not_allowed'
  when v = '1.1' and not has_state then 'provenance_missing' when k % 11 = 0 then 'seal_malformed'
  when k % 7 = 0 and k % 100 <> 0 then 'seal_mismatch' end as reason from r)
select run_id, reason is null as ok, reason from s""",
    "append_ledger": """select 'run-' || substr(sha256(cast(o_orderkey as varchar)), 1, 16) as run_id,
case when day(o_orderdate) % 10 = 0 then 'refused_malformed_seal' when day(o_orderdate) % 3 <> 0 then 'identical'
  else 'appended' end as outcome from orders""",
    "latest_run": """select 'run-' || substr(sha256(cast(o_orderkey as varchar)), 1, 16) as run_id,
strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as created_at, case when o_orderkey % 2 = 0 then 'PASS' else 'BLOCK' end as decision,
o_orderkey % 100 as score from orders order by o_orderdate desc, run_id desc limit 1""",
    "upsert_catalog": """
select urn, aspect, value, observed_at from (select *, row_number() over (partition by urn, aspect
  order by observed_at desc, newer desc, value desc) as rn from (select 'order:' || l_orderkey as urn,
  'flag_' || lower(l_linestatus) as aspect, l_returnflag || '/' || l_linenumber || '/' || l_partkey as value,
  strftime(l_shipdate, '%Y-%m-%d') as observed_at, case when l_returnflag = 'R' then 1 else 0 end as newer from lineitem) x) y
where rn = 1""",
    "read_seed": with_clause("select * exclude (order_total), cast(order_total as double) as order_total from staged_orders"),
    "materialize": with_clause("""select currency, count(*) as n_orders, cast(sum(order_total) as double) as revenue
from staged_orders where status = 'completed' group by currency"""),
    "parse_manifests": """
select 'run:' || p_partkey as run_key, 'model.shop.t' || p_partkey as unique_id,
  case when p_partkey % 2 = 0 then 'model' else 'seed' end as resource_type,
  case when p_partkey % 6 = 0 then '"Shop".t' || p_partkey else 'main.t' || p_partkey end as relation,
  case when p_partkey % 8 = 0 then 'postgres' else 'duckdb' end as adapter_type,
  sha256(case when p_partkey % 11 = 0 then '{}' else '{"a":"t","b":{"x":[1,2],"y":1}}' end) as config_sha256,
  sha256('[{"to":"t' || p_partkey % 4 || '","type":"foreign_key"}]|null') as model_constraints_sha256
from part where p_partkey % 7 <> 0 and """ + _PART_DAMAGE + " is null",
    "read_manifests": f"""select 'run:' || p_partkey as run_key, case when p_partkey % 2 = 0 then 'model' else 'seed' end as outcome,
  case when p_partkey % 6 = 0 then '"Shop".t' || p_partkey else 'main.t' || p_partkey end as detail
from part where p_partkey % 7 <> 0 and {_PART_DAMAGE} is null
union all {_REJECTED}""",
    "manifest_rejections": """
with p as (select p_partkey as k, 'run:' || p_partkey as run_key, array_to_string(list_transform(string_split(p_name, ' '),
  lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as nice from part),
n as (select *, 'model.shop.t' || k || '.' || case when k % 4 = 0 then '"' || nice || '"' else lower(nice) end as place
  from p where k % 7 <> 0 and """ + _DAMAGE.format(k="k") + """ is null)
""" + _REJECTED + """
union all
select run_key, 'conflicting_types', place from n where k % 5 <> 0 and k % 23 = 0 and k % 19 <> 0 and k % 10 <> 0""",
    "manifest_columns": """
with n as (select p_partkey as k, p_name, array_to_string(list_transform(string_split(p_name, ' '),
  lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as nice from part where p_partkey % 7 <> 0 and """ + _PART_DAMAGE + """ is null),
b as (select 'run:' || k as run_key, 'model.shop.t' || k as unique_id,
  case when k % 6 = 0 then '"Shop".t' || k else 'main.t' || k end as relation, * from n)
select run_key, unique_id, relation, case when k % 4 = 0 then '"' || nice || '"' else lower(nice) end as column_name,
  case when k % 5 <> 0 then case when k % 8 = 0 then 'VARCHAR(10)' else 'TEXT' end when k % 19 = 0 then null when k % 10 = 0 then 'INT' when k % 23 = 0 then 'BIGINT' end as data_type,
  k % 5 = 0 and k % 19 <> 0 and (k % 10 = 0 or k % 23 = 0) as data_type_from_projection,
  case k % 3 when 0 then k % 2 = 0 else false end as nullable,
  case when k % 19 <> 0 then 0 end as ordinal, k % 19 <> 0 as has_projection,
  case when k % 19 <> 0 then sha256('src.' || lower(p_name)) end as expr_fingerprint from b
union all
select run_key, unique_id, relation, 'extra', 'DATE', true, null, 1, true, sha256('src.' || lower(p_name)) from b""",
    "content_digest": """
with h as (select l_orderkey, sha256('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || ',"l_returnflag":"'
  || l_returnflag || '"}') as h from lineitem),
s as (select l_orderkey, count(*) as row_count, """
    + ", ".join(f"sum(cast('0x' || substr(h, {8 * i + 1}, 8) as bigint)) as lane{i}" for i in range(identity.LANES))
    + """ from h group by l_orderkey)
select l_orderkey, sha256(row_count || ':' || """
    + " || ':' || ".join(f"lane{i}" for i in range(identity.LANES))
    + """) as sha256, row_count from s""",
    "change_summary": with_clause("""select run_key, relation, change_type as change,
coalesce(old_column, old_type, '-') as existing, coalesce(new_column, new_type, '-') as proposed from gate_change""", DIFF_VIEWS),
    "blast_radius_summary": with_clause("""
select a.run_key, coalesce(a.name, a.urn) as asset, a.asset_type as type, a.hop_count as hops,
  case when a.has_owners is null then 'not established' else coalesce(o.owner, 'none recorded') end as owner,
  case when a.has_assertions is null then 'not established' else cast((select count(distinct assertion_urns)
    from report_rows r where r.run_key = a.run_key and r.urn = a.urn) as varchar) end as assertions
from report_assets a left join (select distinct run_key, urn, owner from report_rows where owner is not null) o
  on o.run_key = a.run_key and o.urn = a.urn and a.has_owners is not null""", scoring.SCORE_VIEWS),
}
