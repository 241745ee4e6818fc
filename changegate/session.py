"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are planned for.  All are plain Spark
# settings: AQE sizes the shuffle, splits skewed join partitions and turns a
# join into a broadcast only after the side's size is known.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

CHECKPOINT_CONF = "spark.checkpoint.dir"
STAGE_CODEC = "zstd"  # of written stages, which are read soon and seldom


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller already has."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, app: str = "changegate", shared: str | None = None
) -> SparkSession:
    """A single-machine session for tests and the benchmark, with its own folder for stages unless one is named."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config(CHECKPOINT_CONF, shared or tempfile.mkdtemp(prefix="changegate-"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        # Do not record a Python call site for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder, remembered by its context; on a cluster a machine-local path would
    lose data with the executor that wrote it, so there the setting is required.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="changegate-"))
    return spark.sparkContext.getCheckpointDir()


def run_dir(spark: SparkSession) -> str:
    """Where this application writes its stages."""
    return f"{shared_dir(spark).rstrip('/')}/changegate-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path of this application below the shared folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_status(spark: SparkSession, path: str):
    """Hadoop's (file system, path) of a path in any store that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = file_status(spark, path)
    return system.exists(hadoop)


def clean_up(spark: SparkSession) -> None:
    """Remove the stages of this application, once its results have been read or written elsewhere."""
    system, hadoop = file_status(spark, run_dir(spark))
    system.delete(hadoop, True)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a written stage that nothing will read again."""
    system, hadoop = file_status(spark, path)
    system.delete(hadoop, True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when the stage that needed them is written, not when the driver's memory is next cleared."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy."""
    spark = df.sparkSession
    path = fresh_path(spark, "step")
    df.write.parquet(path, compression=STAGE_CODEC)
    return spark.read.schema(df.schema).parquet(path)
