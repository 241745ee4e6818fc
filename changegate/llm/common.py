"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from changegate.session import cut_lineage, fresh_path

__all__ = ["arrow_map", "bounded_batches", "cut_lineage", "fresh_path", "give_back", "read_table", "row_digest", "text_bytes"]

# A batch that crosses to Python holds about this much, however long the texts are (a single longer text is a batch of its own).
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound the bytes of an Arrow batch, so that a worker's memory does not follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # not the GNU C library
        return None


def give_back() -> None:
    """Return to the machine what a batch used and freed.

    A worker process serves one stage after another.  The allocators would keep the peak of each for the next, beside the memory
    of the executor.
    """
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[..., list], schema: str, args: tuple = ()) -> DataFrame:
    """Apply ``fn(batch, *args)``, which returns one list or array per output column, to every Arrow batch of ``df``.

    Row-local and free of shuffles: a lost task is repeated from its input.
    """
    spark = bounded_batches(df.sparkSession)
    target = spark.createDataFrame([], schema).schema
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in target.fields]
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch, *args)
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)
                columns = arrays = None
                give_back()

    return df.mapInArrow(run, target)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of every text of a batch; a null is the empty text."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _has(kind: DataType, wanted: tuple[type, ...]) -> bool:
    if isinstance(kind, wanted):
        return True
    if isinstance(kind, ArrayType):
        return _has(kind.elementType, wanted)
    return isinstance(kind, StructType) and any(_has(f.dataType, wanted) for f in kind.fields)


def row_digest(docs: DataFrame) -> Column:
    """A hash of all columns of a row; where the nulls are is hashed too, and columns that cannot be hashed are hashed as text."""
    cells = []
    for field in docs.schema.fields:
        cell = F.col(f"`{field.name}`")
        cells.append(F.to_json(F.struct(cell)) if _has(field.dataType, (MapType, VariantType)) else cell)
    return F.xxhash64(*cells, *[F.col(f"`{c}`").isNull() for c in docs.columns])
