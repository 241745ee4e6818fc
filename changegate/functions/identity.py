"""Canonical JSON and content identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE_IDENTITY = (
    "change_type",
    "relation",
    "old_column",
    "new_column",
    "old_type",
    "new_type",
    "old_nullable",
    "new_nullable",
    "source_path",
)


def ascii_json(text: Column) -> Column:
    r"""Escape every non-ASCII character as ``\uXXXX`` (UTF-16 units, lower case)."""

    def escape(run: Column) -> Column:
        units = F.lower(F.hex(F.encode(run, "UTF-16BE")))
        return F.when(run.rlike(r"^[^\x00-\x7F]"), F.regexp_replace(units, "(.{4})", r"\\u$1")).otherwise(run)

    # A run of either kind is one element, so the work does not follow the number of characters.
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), 0)
    return F.when(
        text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(runs, escape), "")
    ).otherwise(text)


def canonical_json(**values: Column) -> Column:
    """Compact JSON with sorted keys, explicit nulls and ASCII escapes."""
    fields = [values[name].alias(name) for name in sorted(values)]
    return ascii_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def change_id(given: Column | None = None) -> Column:
    """Reproducible identifier of a change from its nine semantic fields."""
    digest = F.sha2(canonical_json(**{name: F.col(name) for name in CHANGE_IDENTITY}), 256)
    derived = F.concat(F.lit("change-"), F.substring(digest, 1, 16))
    if given is None:
        return derived
    stripped = F.trim(given)
    return F.when(stripped != "", stripped).otherwise(derived)


def row_digest(columns: list[str]) -> Column:
    return F.sha2(canonical_json(**{name: F.col(name) for name in columns}), 256)


LANES = 8  # 32-bit parts of a row's digest


def content_digest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One SHA-256 per key over an unordered multiset of rows, in one shuffle.

    The eight 32-bit lanes of every row's SHA-256 are summed on their own, exactly, and the digest is taken over the row count
    and the eight sums.  Sums do not depend on the order, count copies, and combine in the map tasks, so a hot key costs no
    more than one small row per task.  Lists of sums of different multisets that are equal would need a collision of the
    summed digests.
    """
    lane = lambda i: F.conv(F.substring("_row", 8 * i + 1, 8), 16, 10).cast("decimal(28,0)")
    rows = df.select(*keys, row_digest(columns).alias("_row"))
    summed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *[F.sum(lane(i)).alias(f"_lane{i}") for i in range(LANES)])
    parts = [F.col("row_count").cast("string"), *[F.col(f"_lane{i}").cast("string") for i in range(LANES)]]
    return summed.select(*keys, F.sha2(F.concat_ws(":", *parts), 256).alias("sha256"), "row_count")
