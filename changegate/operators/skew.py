"""Joins and exclusions that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def even_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join whose hot keys adaptive execution can split.

    Spark splits a hot partition of a join only where both sides arrive by a shuffle made for that join.  A side that is an
    aggregate by the key, or another join, is partitioned already and would be taken as it is, hot partition and all.
    Joining on copies of the keys makes Spark shuffle both sides; it then measures the partitions, splits the hot ones over
    tasks and repeats only the few rows of the other side that belong to them.  A side that turns out small is still
    broadcast instead.  The keys compare as text, a null matches nothing, and the left side's keys are returned.
    """
    copies = {f"_key{i}": F.concat(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    joined = left.withColumns(copies).join(right.withColumns(copies).drop(*keys), list(copies), how)
    return joined.drop(*copies)


def exclude_runs(df: DataFrame, rejections: DataFrame) -> DataFrame:
    """Remove every row of a rejected change set; rejection is never partial."""
    rejected = rejections.select("run_key").distinct()
    return even_join(df, rejected, ["run_key"], "left_anti")
