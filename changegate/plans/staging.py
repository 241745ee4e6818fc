"""Inputs of single-operator queries, built once for each state of the given tables.

The pipeline of ``gate`` has many steps, and most queries exercise one of them.
Their inputs are written to the shared folder on first use and read from there
afterwards, as a warehouse would keep them.  A stage is named after the files it
was built from, with their sizes and times, and belongs to one application: when a
table changes the stage is built anew, so no result depends on what ran before.
The flagship query does not use this: it always runs the whole pipeline from the
given tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changegate.session import STAGE_CODEC, exists, file_status, run_dir


def table_state(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the names, sizes and times of all files below a folder."""
    system, hadoop = file_status(spark, sf_dir)
    files, found = system.listFiles(hadoop, True), []
    while files.hasNext():
        status = files.next()
        found.append(f"{status.getPath().toString()}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    path = f"{run_dir(spark)}/input-{name}-{table_state(spark, sf_dir)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path, compression=STAGE_CODEC)
    return spark.read.parquet(path)
