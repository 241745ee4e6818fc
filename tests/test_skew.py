import hashlib

import pytest
from helpers import CHANGE_SCHEMA, change, collect
from pyspark.sql import functions as F

from changegate.operators import diff, lineage
from changegate.operators.skew import even_join, exclude_runs

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.shuffle.partitions": "12",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
}
URN = "urn:li:dataset:(urn:li:dataPlatform:w,shop.{},PROD)"


@pytest.fixture()
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def splits(df):
    """Runs a plan and says whether a join in it was split for skew."""
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def spread(rows, schema, data):
    """Enough map tasks for a hot partition to be cut between them."""
    return rows(schema, data).repartition(8)


def test_hot_key_join_equals_plain_join(rows):
    left = rows("run_key string, n int", [("hot", i) for i in range(500)] + [(f"r{i}", i) for i in range(20)] + [(None, 1)])
    right = rows("run_key string, v int", [("hot", 1)] + [(f"r{i}", i) for i in range(10)])
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert collect(even_join(left, right, ["run_key"], how)) == collect(left.join(right, ["run_key"], how))


def test_hot_key_of_an_aggregate_is_split(rows, small_partitions):
    left = spread(rows, "k string, n string", [("hot", f"{i:040d}") for i in range(6000)] + [(f"k{i}", "x") for i in range(600)])
    right = left.groupBy("k").agg(F.count("*").alias("c"))
    joined = even_join(left, right, ["k"], "left")
    assert splits(joined) and joined.filter("c = 6000").count() == 6000
    assert not splits(left.join(right, "k", "left"))


def hot_changes(rows):
    return spread(rows, CHANGE_SCHEMA, [
        change(run=f"r{i}", cid=f"{i:060d}", relation="shop.orders" if i % 3 else f"shop.t{i}", old_column="a", old_type="INT") for i in range(6000)
    ])


def test_resolution_and_baseline_split_a_hot_dataset(rows, small_partitions):
    names = ["orders", *(f"t{i}" for i in range(0, 6000, 3))]
    resolved = lineage.resolve_dataset(hot_changes(rows), rows("urn string", [(URN.format(n),) for n in names]))
    assert splits(resolved) and resolved.filter("catalog_status = 'complete'").count() == 6000
    fields = rows("urn string, field_path string, native_type string", [(URN.format(n), "a", "int") for n in names])
    checked = lineage.check_baseline(resolved, fields)
    assert splits(checked) and checked.filter("catalog_status = 'complete'").count() == 6000


def test_enrichment_splits_a_hub(rows, small_partitions):
    reached = spread(rows, "run_key string, change_id string, urn string, hop_count int, has_columns boolean", [
        (f"r{i}", f"{i:060d}", "urn:li:dataset:hub" if i % 3 else f"urn:li:dataset:{i}", 1, True) for i in range(6000)])
    assets = rows("urn string, name string, ownership_known boolean", [("urn:li:dataset:hub", "hub", True)])
    none = rows("urn string, owner string", []), rows("urn string, tag string, tag_name string", [])
    enriched = lineage.enrich_assets(reached, lineage.asset_facts(assets, *none))
    assert splits(enriched) and enriched.filter("found").count() == 4000


def test_diff_splits_a_hot_relation(rows, small_partitions):
    schema = "run_key string, relation string, column_name string, data_type string, nullable boolean, ordinal int, expr_fingerprint string"
    name = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    before = spread(rows, schema, [("r", "wide" if i % 3 else f"t{i}", name(i), "INT", True, i, f"f{i}") for i in range(6000)])
    after = before.withColumn("data_type", F.lit("TEXT")).unionByName(rows(schema, [("r", "fresh", "x", "INT", True, 0, "f")]))
    found = diff.classified_rows(before, after)
    assert splits(found) and found.filter("change is not null").count() == 6000


def test_rejection_removes_whole_runs(rows):
    left = rows("run_key string, n int", [("a", i) for i in range(50)] + [("b", 1)])
    rejected = rows("run_key string, reason string, detail string", [("a", "x", "1"), ("a", "y", "2")])
    assert collect(exclude_runs(left, rejected)) == [("b", 1)]
