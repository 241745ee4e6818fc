"""Sharding by Karmarkar-Karp differencing.

Documents of equal text are one indivisible item, so copies stay together.  A *partial partition* is one number per shard:
the bytes that some items put there.  Differencing starts from one partial partition per item and repeatedly combines the
two with the largest spread, the largest part of one with the smallest of the other, until one is left.  Spreads cancel
instead of adding up, so shards of indivisible items come out far closer than by filling the emptiest shard.

*At scale* the items are dealt into blocks of bounded size by a hash.  A task combines its block's items into one partial
partition and hands its columns up as new, nearly equal items; items larger than a column's fair share go up as they are, and
so does a small share of all items, which later closes the last gaps.  Rounds repeat until at most ``TOP_ITEMS`` items are
left; one last bounded task combines those, and its columns are the shards.  A document's shard is found by following its
item up the rounds.  (Handing up *tied* columns instead would leave no room beside a group of copies that nearly fills a
shard.)  Nothing larger than a block, or than the last round, meets in one task.

A group of copies can be larger than a shard.  Fewer than ``shards`` groups exceed the mean, so they are named in a small
list, and each is cut by a hash into pieces of about a ``CUT``-th of the mean, small enough to level what the hash leaves uneven.

The slot of a document numbers the documents of its shard from 0 without gaps.  Documents are dealt into cells of a shard and
a hash bucket, cells are counted, and the counts of the buckets before are added: no shard is sorted in one task.

Defined results: a null text has no bytes, is equal to other nulls, not to the empty text, and has the checksum of the empty
text.  Repeated rows are documents of their own.  Null and repeated ids are kept and placed like any other: rows are told apart
by a number that they get when they are first written.  No documents give no rows.  Ties between items of one size may be broken
either way.  Extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changegate.llm.common import cut_lineage

SHARDS = 40
OVERHEAD = 16  # bytes that every document costs besides its text
BLOCK_ITEMS = 4_000
TOP_ITEMS = 20_000
FINE_ITEMS = 4_000
CELL_ROWS = 500
CUT = 4

UP_SCHEMA = "id bigint, up bigint, bytes bigint"


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows) into one.

    Returns the column of the result that each column of each row goes to, and the result.  Equal spreads are taken in the
    order of the rows.
    """
    count, shards = parts.shape
    values = [row for row in parts]
    # A tree: leaves are rows, an inner node orders its two children's columns.
    heap = [(-int(row.max() - row.min()), i) for i, row in enumerate(values)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, np.ndarray, int, np.ndarray]] = {}
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        up, down = np.argsort(values[a], kind="stable"), np.argsort(-values[b], kind="stable")
        merged = values[a][up] + values[b][down]
        node = len(values)
        values[a] = values[b] = None
        values.append(merged)
        children[node] = (a, up, b, down)
        heapq.heappush(heap, (-int(merged.max() - merged.min()), node))
    goes = np.empty((count, shards), dtype=np.int32)
    stack = [(heap[0][1], np.arange(shards, dtype=np.int32))] if heap else []
    while stack:
        node, place = stack.pop()
        if node < count:
            goes[node] = place
            continue
        a, up, b, down = children[node]
        for child, order in ((a, up), (b, down)):
            mine = np.empty(shards, dtype=np.int32)
            mine[order] = place  # column order[k] of the child is column k of the node
            stack.append((child, mine))
    return goes, values[heap[0][1]]


def _columns(block: pd.DataFrame, shards: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The block in a fixed order, and the column of each item by differencing one-item partitions."""
    block = block.sort_values(["id"], kind="stable")
    parts = np.zeros((len(block), shards), dtype=np.int64)
    parts[:, 0] = block["bytes"].to_numpy(np.int64)
    return block, difference(parts)[0][:, 0]


def _combine_block(shards: int):
    def combine(block: pd.DataFrame) -> pd.DataFrame:
        """Items of one block to the items handed up."""
        whole = block["fine"] | (block["bytes"] * shards > block["bytes"].sum())  # fewer than ``shards`` besides the fine ones
        kept = block[whole].assign(up=lambda d: d["id"])
        rest, column = _columns(block[~whole], shards) if not whole.all() else (block[~whole], np.zeros(0, dtype=int))
        # A column is named after one of its items, so names stay unique.
        rest = rest.assign(column=column)
        rest["up"] = rest.groupby("column")["id"].transform("min")
        return pd.concat([kept, rest])[["id", "up", "bytes"]]

    return combine


def _combine_top(shards: int):
    def combine(top: pd.DataFrame) -> pd.DataFrame:
        top, column = _columns(top, shards)
        return pd.DataFrame({"id": top["id"], "shard": column})

    return combine


def _items_to_shards(items: DataFrame, n_items: int, shards: int, block_items: int, top_items: int) -> DataFrame:
    """(id, shard) for items (id, bytes)."""
    way, level = None, items.select("id", "bytes")
    while n_items > top_items:
        n_blocks = -(-n_items // block_items)
        fine = F.pmod(F.xxhash64("id", F.lit(n_items)), F.lit(n_items)) < min(FINE_ITEMS, top_items // 4)
        step = cut_lineage(
            level.withColumn("fine", fine)
            .groupBy(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"))
            .applyInPandas(_combine_block(shards), UP_SCHEMA)
        )
        hop = step.select("id", "up")
        way = hop if way is None else cut_lineage(way.withColumnRenamed("up", "at").join(hop.withColumnRenamed("id", "at"), "at").select("id", "up"))
        level = cut_lineage(step.groupBy(F.col("up").alias("id")).agg(F.sum("bytes").alias("bytes")))
        smaller = level.count()
        if smaller >= n_items:
            block_items *= 2  # blocks of so few items that nothing was combined
        n_items = smaller
    last = level.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_combine_top(shards), "id bigint, shard int")
    return last if way is None else way.join(last.withColumnRenamed("id", "up"), "up").select("id", "shard")


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    block_items: int = BLOCK_ITEMS, top_items: int = TOP_ITEMS,
) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null under this law) of every document."""
    text = F.col(text_col).cast("string")
    rows = cut_lineage(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            # Equal texts have equal items; a null is an item of its own.
            F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(text.cast("binary"), 256))).alias("item"),
            # Tells rows apart whatever their ids are; written with the row, so that every reader sees the same number.
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = cut_lineage(rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, n_groups, n_rows = groups.agg(F.sum("bytes"), F.count("*"), F.sum("n")).first()
    n_rows, mean = int(n_rows or 0), -(-int(total or 0) // shards)
    # Fewer than ``shards`` groups can be larger than the mean of the shards.
    large = [(r["item"], -(-CUT * r["bytes"] // mean)) for r in groups.filter(F.col("bytes") > mean).select("item", "bytes").collect()] if n_rows else []
    in_pieces = _pieces(rows, large)
    sized = in_pieces.groupBy("item", "piece").agg(F.sum("size").alias("bytes")) if large else groups.select("item", F.lit(0).alias("piece"), "bytes")
    # Numbered once and written, so that every reader sees the same numbers.
    items = cut_lineage(sized.withColumn("id", F.monotonically_increasing_id()))
    n_items = int(n_groups) + sum(pieces for _, pieces in large)
    shard_of = _items_to_shards(items, n_items, shards, block_items, top_items)
    item_shard = cut_lineage(items.join(shard_of, "id").select("item", "piece", "shard"))
    placed = cut_lineage(in_pieces.join(item_shard, ["item", "piece"]).drop("item", "piece"))
    return _with_slots(placed, n_rows, shards)


def _pieces(rows: DataFrame, large: list[tuple[bytes, int]]) -> DataFrame:
    piece = F.lit(0)
    for item, pieces in large:
        piece = F.when(F.col("item") == F.lit(bytes(item)), F.pmod(F.xxhash64("row"), F.lit(pieces)).cast("int")).otherwise(piece)
    return rows.withColumn("piece", piece)


def _with_slots(placed: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """Number the rows of every shard from 0 by cells of bounded size."""
    buckets = max(1, n_rows // (shards * CELL_ROWS))
    celled = placed.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit("cell")), F.lit(buckets)))
    counts = celled.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # one row per cell, not per document
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("doc_id", "text_crc32", "size", "row")
    numbered = celled.withColumn("in_cell", F.row_number().over(inside))
    return numbered.join(offsets, ["bucket", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("in_cell") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
