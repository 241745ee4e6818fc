"""Seeds, materialised models, catalog upserts and the run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegate.operators.publish import SEAL_SHAPE, Store
from changegate.session import exists

# The typed columns of the order seed.
SEED_SCHEMA = (
    "order_id bigint, customer_id string, order_date date, status string, "
    "order_total decimal(12,2), currency string"
)


NO_MONTH = "0000-00"  # of records without a readable time


def read_seed(spark: SparkSession, path: str, schema: str = SEED_SCHEMA) -> DataFrame:
    """Typed CSV load; a row that does not fit the types fails the load."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """A view, or with a path a stored table, that later models read by name."""
    if path is None:
        df.createOrReplaceTempView(name)
        return df
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.createOrReplaceTempView(name)
    return stored


def upsert_catalog(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest value per (urn, aspect); of equal times the incoming value wins.

    Rows: urn, aspect, value, observed_at.
    """
    both = current.withColumn("_newer", F.lit(0)).unionByName(incoming.withColumn("_newer", F.lit(1)))
    order = F.struct("observed_at", "_newer", "value")
    return (
        both.groupBy("urn", "aspect")
        .agg(F.max(order).alias("last"))
        .select("urn", "aspect", F.col("last.value").alias("value"), F.col("last.observed_at").alias("observed_at"))
    )


def ledger_key() -> F.Column:
    """A run may be recorded once per seal: the run and its whole seal."""
    return F.concat_ws("-", "run_id", "artifact_hash")


def read_ledger(spark: SparkSession, store: Store) -> DataFrame | None:
    path = store.file("ledger")
    return spark.read.parquet(path) if exists(spark, path) else None


def append_ledger(spark: SparkSession, runs: DataFrame, store: Store) -> DataFrame:
    """Add sealed run records; stored ones are immutable.

    Returns the outcome per record: appended, identical (the run is stored with
    this seal), or refused because the seal is malformed.  Files are partitioned
    by month, not by run: a folder per run would not survive many runs.  Only the
    months of the batch are looked up; the rebalance lets AQE split a month that
    holds most of a batch and join small ones, so files stay well sized.
    """
    month = F.coalesce(F.date_format(F.col("created_at").try_cast("timestamp"), "yyyy-MM"), F.lit(NO_MONTH))
    rows = runs.withColumn("record_key", ledger_key()).withColumn("run_month", month)
    stored = read_ledger(spark, store)
    if stored is None:
        judged = rows.withColumn("known", F.lit(False))
    else:
        known = stored.select("run_month", "record_key").withColumn("known", F.lit(True))
        judged = rows.join(known, ["run_month", "record_key"], "left")
    outcome = (
        F.when(~F.coalesce(F.col("artifact_hash").rlike(SEAL_SHAPE), F.lit(False)), "refused_malformed_seal")
        .when(F.col("known"), "identical")
        .otherwise("appended")
    )
    judged = judged.withColumn("outcome", outcome).drop("known")
    path = store.file(f"ledger-batches/{_batch_name()}")
    judged.write.parquet(path)
    written = spark.read.schema(judged.schema).parquet(path)
    new = written.filter(F.col("outcome") == "appended").drop("outcome").dropDuplicates(["record_key"])
    new.hint("rebalance", "run_month").write.mode("append").partitionBy("run_month").parquet(store.file("ledger"))
    return written.select("run_id", "artifact_hash", "outcome")


def latest_run(ledger: DataFrame) -> DataFrame:
    """The newest record; computed from the ledger's last month, so never out of step with it."""
    last = ledger.agg(F.max("run_month")).first()[0]
    return ledger.filter(F.col("run_month") == last).orderBy(F.col("created_at").desc(), F.col("record_key").desc()).limit(1)


def _batch_name() -> str:
    import uuid

    return uuid.uuid4().hex
