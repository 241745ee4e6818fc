"""Near copies by SimHash candidates and an exact check: the near-dedup stage of the pipeline.

Two texts are near copies if their sets of lower-cased ``shingle_words``-word shingles have a Jaccard similarity of at least
``similarity``.  The fingerprints of ``simhash`` on long shingles miss most pairs of 0.8, since one changed word changes five
shingles.  So the parameters here are the stage's own:

1. *Fingerprint* on single words, each counted at most ``MAX_COUNT`` times, so that frequent words do not make all texts alike.
   Near copies differ in few bits: at most ``RADIUS`` for about 95 of 100 pairs of similarity 0.8 to 0.85, and for more above.
2. *Candidates* are all pairs of fingerprints within the radius, found by the same search as ``simhash``: three agreeing bands,
   bit planes and carry-save counters in large buckets.  A pair that shares several buckets belongs to the first of them, so
   it is named once.  A bucket names the pairs of every row that has up to ``NEIGHBOURS`` near ones there, and instead of the
   pairs of its other rows, the dense ones, those rows themselves: what leaves it grows with its rows, not with their pairs.
3. *Exact check*: the shingle sets of named pairs meet in two joins.  The dense rows of a bucket are brought together with their
   sets, in blocks of bounded bytes, where all their near pairs are checked, except those that links of the block connect
   already.  Only pairs that reach the similarity are links.
4. *Groups* are the connected components of links; the row of the smallest id stays.

Texts equal but for case and white space are one from the start.  Buckets larger than ``chunk`` are cut into pairs of chunks
by a hash, so a bucket of any size is many bounded tasks.

Defined results: null and empty texts are equal; a text of fewer words than a shingle is one shingle.  Of a group's rows that
repeat its smallest id, or that all have none, the one with the smallest hash of its columns stays; of wholly equal rows, one.
Columns of any type are kept.  No documents give no rows.  Candidates are not complete: a pair is missed if it differs in more
than ``RADIUS`` bits, and only then.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegate.llm.common import arrow_map, cut_lineage, give_back, row_digest, text_bytes
from changegate.llm.components import connected_components
from changegate.llm.simhash import AGREE, CHUNK, SEED, band_masks, bands, bit_planes

SHINGLE_WORDS, SIMILARITY = 5, 0.8
MAX_COUNT, RADIUS = 3, 6
DENSE, BLOCK_ROWS = 64, 64  # slots that are compared at every distance of places; rows that are compared at once with a larger one
NEIGHBOURS = 1  # near ones of a row in a bucket up to which its pairs are named one by one
PIECE_ROWS, PIECE_BYTES = 1024, 8 << 20  # dense rows, and bytes of their sets, that are one side of a block
WHICH = 1023  # the bits of a slot that hold the number of its choice of bands

PRINT_SCHEMA = "doc_id bigint, digest bigint, bits bigint, item binary"
FOUND_SCHEMA = "a bigint, b bigint, bits bigint, slot bigint, side int"

Belongs = Callable[[np.ndarray, np.ndarray], np.ndarray]


# ---------------------------------------------------------------------------------------------------------------- texts


def fingerprint(words: list[bytes]) -> int:
    """64 bits, each set if it is set in more than half of the words' hashes; a word counts at most ``MAX_COUNT`` times."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    counted = Counter(words)
    hashes = np.array([xxh64_intdigest(w, SEED) for w in counted], dtype="<u8")
    weights = np.minimum(np.fromiter(counted.values(), dtype=np.int64, count=len(counted)), MAX_COUNT)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * (weights @ bits) > weights.sum(), bitorder="little").view("<u8")[0])


def shingles(words: list[bytes], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype="<u8")
    runs = range(max(1, len(words) - shingle_words + 1))
    return np.unique(np.array([xxh64_intdigest(b" ".join(words[i : i + shingle_words]), SEED) for i in runs], dtype="<u8"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _prints(batch: pa.RecordBatch) -> list:
    from xxhash import xxh3_128_digest

    bits, items = [], []
    for data in text_bytes(batch.column(1)):
        words = data.lower().split()
        bits.append(fingerprint(words))
        items.append(xxh3_128_digest(b" ".join(words)))
    return [batch.column(0), batch.column(2), np.array(bits, dtype=np.uint64).view(np.int64), items]


def _sets(batch: pa.RecordBatch, shingle_words: int) -> list:
    return [batch.column(0), [shingles(data.lower().split(), shingle_words).tobytes() for data in text_bytes(batch.column(1))]]


# --------------------------------------------------------------------------------------------------------------- search


def _first_choices(radius: int) -> np.ndarray:
    """For every set of agreeing bands, as a number, the first choice of ``AGREE`` bands in it; -1 if there is none."""
    n = radius + AGREE
    number = {choice: i for i, choice in enumerate(combinations(range(n), AGREE))}
    agreeing = ([k for k in range(n) if which >> k & 1] for which in range(1 << n))
    return np.array([number.get(tuple(found[:AGREE]), -1) for found in agreeing])


def _belonging(bits: np.ndarray, which: np.ndarray, sides: list[np.ndarray], radius: int, table: np.ndarray) -> Belongs:
    """Is a pair of positions in the first bucket that it shares, and of the two parts that this task compares?

    A side is 2 in a task within one part, where all pairs count, and else 0 or 1.
    """
    masks = [np.uint64(m) for m in bands(radius)]

    def belongs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differ, agree = bits[i] ^ bits[j], np.zeros(len(i), dtype=np.int64)
        for k, mask in enumerate(masks):
            agree |= ((differ & mask) == 0).astype(np.int64) << k
        mine = table[agree] == which[i]
        for side in sides:
            mine &= (side[i] != side[j]) | (side[i] == 2)
        return mine

    return belongs


def within_block(planes: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``values``, position in ``planes``) of all pairs within the radius, as ``simhash.within`` for many rows at once.

    A word of 64 positions is abandoned once all of them exceed the radius for all rows.
    """
    alive = np.arange(planes.shape[1])
    digits = radius.bit_length()
    counters = [np.zeros((len(values), len(alive)), dtype=np.uint64) for _ in range(digits)]
    over = np.zeros((len(values), len(alive)), dtype=np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k in range(64):
        flip = np.where(values >> np.uint64(k) & np.uint64(1), full, np.uint64(0))
        carry = planes[k, alive][None, :] ^ flip[:, None]  # where the bit differs
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over |= carry
        if k % 8 == 7:
            # Past the radius: larger than it in binary, digit by digit from the top.
            larger, equal = np.zeros_like(over), np.full_like(over, full)
            for d in reversed(range(digits)):
                if radius >> d & 1:
                    equal &= counters[d]
                else:
                    larger |= equal & counters[d]
                    equal &= ~counters[d]
            over |= larger
            live = (over != full).any(axis=0)
            if not live.all():
                alive, over, counters = alive[live], over[:, live], [c[:, live] for c in counters]
                if not len(alive):
                    break
    hits = np.unpackbits(np.ascontiguousarray(~over).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    row, bit = np.nonzero(hits)
    return row, alive[bit // 64] * 64 + bit % 64 if len(bit) else bit


def _large_slot(values: np.ndarray, radius: int, belongs: Belongs | None, neighbours: int | None) -> tuple[list, np.ndarray]:
    """Pairs of a large slot, and which rows are dense; pairs of two of them are left out.  Without ``neighbours`` none is dense."""
    planes, found, dense = bit_planes(values), [], np.zeros(len(values), dtype=bool)
    for first in range(0, len(values), BLOCK_ROWS):
        row, other = within_block(planes, values[first : first + BLOCK_ROWS], radius)
        row = row + first
        real = (other < len(values)) & (other != row)
        row, other = row[real], other[real]
        if belongs is not None:
            mine = belongs(row, other)
            row, other = row[mine], other[mine]
        if neighbours is None:
            keep = row < other
        else:
            dense |= np.bincount(row, minlength=len(values)) > neighbours
            keep = ~dense[row]
        found.append(np.column_stack([row[keep], other[keep]]))
    return found, dense


def nearest(
    slots: np.ndarray, bits: np.ndarray, radius: int, neighbours: int = NEIGHBOURS,
    dense: list[np.ndarray] | None = None, belongs: Belongs | None = None,
) -> np.ndarray:
    """Pairs of positions in one slot whose fingerprints are within the radius, all of them; rows are sorted by slot.

    ``belongs`` tells the pairs that count.  If ``dense`` is given, it gets the rows with more than ``neighbours`` such pairs in
    their slot, and the pairs of two such rows are left out.
    """
    n = len(slots)
    cuts = np.flatnonzero(slots[1:] != slots[:-1]) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
    sizes = np.repeat(ends - starts, ends - starts)
    found = [np.zeros((0, 2), dtype=np.int64)]
    rows = np.flatnonzero(sizes <= DENSE)
    for lag in range(1, DENSE):
        rows = rows[rows + lag < n]
        rows = rows[slots[rows] == slots[rows + lag]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(bits[rows] ^ bits[rows + lag]) <= radius]
        if belongs is not None:
            near = near[belongs(near, near + lag)]
        found.append(np.column_stack([near, near + lag]))
    if dense is not None:
        pairs = np.concatenate(found)
        many = np.bincount(pairs.ravel(), minlength=n) > neighbours
        dense.append(np.flatnonzero(many))
        found = [pairs[~many[pairs].all(axis=1)]]
    large = ends - starts > DENSE
    for first, last in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
        mine = None if belongs is None else lambda i, j, first=first: belongs(i + first, j + first)
        pairs, many = _large_slot(bits[first:last], radius, mine, None if dense is None else neighbours)
        found += [first + p for p in pairs]
        if dense is not None:
            dense.append(first + np.flatnonzero(many))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def _by_group(keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame]):
    """``work`` on whole groups of a partition, which arrive sorted by ``keys``; memory is a batch and one group."""

    def run(frames):
        rest: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            same = (frame[keys].to_numpy() == frame[keys].iloc[-1:].to_numpy()).all(axis=1) if len(frame) else np.zeros(0, dtype=bool)
            cut = int(np.argmax(same)) if len(same) else 0
            rest = frame.iloc[cut:].reset_index(drop=True)
            if cut:
                yield work(frame.iloc[:cut])
        if rest is not None and len(rest):
            yield work(rest)

    return run


def _search(radius: int):
    """Pairs (a, b) of all slots, and dense rows (a, bits, slot, side)."""
    table = _first_choices(radius)

    def pairs_of(frame):
        node, slots, side = (frame[c].to_numpy() for c in ("node", "slot", "side"))
        bits, dense = frame["bits"].to_numpy().view(np.uint64), []
        belongs = _belonging(bits, slots & WHICH, [side], radius, table)
        pairs = node[nearest(slots, bits, radius, dense=dense, belongs=belongs)]
        many = np.concatenate(dense)
        nothing = lambda n: np.zeros(n, dtype=np.int64)
        out = pd.DataFrame({
            "a": np.concatenate([pairs[:, 0], node[many]]),
            "b": pd.array(np.concatenate([pairs[:, 1], nothing(len(many))]), "Int64"),
            **{c: pd.array(np.concatenate([nothing(len(pairs)), frame[c].to_numpy()[many]]), kind) for c, kind in (("bits", "Int64"), ("slot", "Int64"), ("side", "Int32"))},
        })
        out.loc[len(pairs) :, "b"] = pd.NA
        return out

    return _by_group(["slot"], pairs_of)


def _in_parts(rows: DataFrame, part: str, parts: str, group: str, name: str, side: str) -> DataFrame:
    """Each row with the number ``name`` of every task, a pair of parts of its group, that it takes part in, and its side there."""
    c, mine = F.col("_other"), F.col(part)
    every = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    task = F.when(F.col(parts) == 1, F.col(group)).otherwise(F.xxhash64(group, F.least(c, mine), F.greatest(c, mine)))
    place = F.when(c == mine, 2).otherwise((mine > c).cast("int"))
    return every.withColumn(name, task).withColumn(side, place).drop("_other")


def near_pairs(items: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """All pairs (a, b) of nodes of items (node, bits) within the radius, each named once, but for the pairs of two dense rows of a
    bucket: those rows (a, bits, slot, side) are given instead, with ``b`` null."""
    masks = band_masks(radius)
    numbered = lambda slot, which: slot.bitwiseAND(F.lit(~WHICH)).bitwiseOR(which)
    slots = F.array(*[numbered(F.xxhash64(F.lit(i), F.col("bits").bitwiseAND(F.lit(m))), F.lit(i)) for i, m in enumerate(masks)])
    keyed = items.select("node", "bits", F.explode(slots).alias("slot"))
    # Written, so that its size is known: Spark broadcasts it only where it is small.
    large = cut_lineage(keyed.groupBy("slot").agg(F.count("*").alias("n")).filter(F.col("n") > chunk))
    met = keyed.join(large, "slot", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") / chunk).cast("int"), F.lit(1)))
    met = met.withColumn("mine", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int"))
    # A slot is a hash; two buckets in one slot cost comparisons and lose no pair.
    tasks = _in_parts(met, "mine", "chunks", "slot", "task", "side")
    tasks = tasks.select("node", "bits", numbered(F.col("task"), F.col("slot").bitwiseAND(F.lit(WHICH))).alias("slot"), "side")
    return tasks.repartition("slot").sortWithinPartitions("slot").mapInPandas(_search(radius), FOUND_SCHEMA)


# --------------------------------------------------------------------------------------------------------------- groups


def _checked(similarity: float):
    def check(batches):
        for batch in batches:
            keep = [
                jaccard(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) >= similarity
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])
            give_back()

    return check


def block_links(bits: np.ndarray, sets: list[np.ndarray], belongs: Belongs, radius: int, similarity: float) -> np.ndarray:
    """A spanning forest of the links among the rows of a block: near pairs that belong to it and are similar enough.

    Shared shingles are counted through the rows that hold each; a pair that earlier links connect needs no count.
    """
    n, sizes = len(bits), np.array([len(s) for s in sets], dtype=np.int64)
    _, words = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(words, kind="stable")]
    counts = np.bincount(words)
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    planes, tree, found = bit_planes(bits), np.arange(n), [np.zeros((0, 2), dtype=np.int64)]
    for first in range(0, n, BLOCK_ROWS):
        row, other = within_block(planes, bits[first : first + BLOCK_ROWS], radius)
        row = row + first
        later = (other < n) & (other > row)
        row, other = row[later], other[later]
        mine = belongs(row, other)
        row, other = row[mine], other[mine]
        for i in np.unique(row).tolist():
            near = other[row == i]
            near = near[tree[near] != tree[i]]
            if not len(near):
                continue
            held = words[ends[i] - sizes[i] : ends[i]]
            each = counts[held]
            at = np.repeat(starts[held] - np.cumsum(each) + each, each) + np.arange(each.sum())
            both = np.bincount(holders[at], minlength=n)[near]
            either = sizes[i] + sizes[near] - both
            near = near[(both / np.maximum(either, 1) >= similarity) | (either == 0)]
            joined, place = np.unique(tree[near], return_index=True)
            found.append(np.column_stack([np.full(len(place), i), near[place]]))
            tree[np.isin(tree, joined)] = tree[i]
    return np.concatenate(found)


def _dense_links(radius: int, similarity: float):
    """Links (a, b) of blocks of dense rows, which arrive sorted by block."""
    table = _first_choices(radius)

    def links_of(frame):
        found = [np.zeros((0, 2), dtype=np.int64)]
        for _, block in frame.groupby(["block", "slot"], sort=False):
            bits = block["bits"].to_numpy().view(np.uint64)
            sides = [block[c].to_numpy() for c in ("side", "piece_side")]
            belongs = _belonging(bits, block["slot"].to_numpy() & WHICH, sides, radius, table)
            sets = [np.frombuffer(s, "<u8") for s in block["shingles"]]
            found.append(block["node"].to_numpy()[block_links(bits, sets, belongs, radius, similarity)])
        pairs = np.sort(np.concatenate(found), axis=1)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return _by_group(["block"], links_of)


def dense_links(dense: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) that span what the pairs of dense rows (node, bits, slot, side) of one slot connect; ``sets``: node, shingles.

    A slot is cut into pieces of bounded rows and bytes, and every pair of pieces is a block of its own.
    """
    size = F.octet_length("shingles")
    sized = dense.join(sets.select("node", size.alias("size")), "node")
    pieces = F.greatest(F.ceil(F.count("*") / PIECE_ROWS), F.ceil(F.sum("size") / PIECE_BYTES)).cast("int")
    cut = cut_lineage(sized.groupBy("slot").agg(pieces.alias("pieces")).filter("pieces > 1"))
    met = dense.join(cut, "slot", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    met = met.withColumn("piece", F.pmod(F.xxhash64("node", F.lit("piece")), F.col("pieces")).cast("int"))
    blocks = _in_parts(met, "piece", "pieces", "slot", "block", "piece_side").drop("piece", "pieces")
    whole = blocks.join(sets, "node").select("node", "bits", "slot", "side", "block", "piece_side", "shingles")
    return whole.repartition("block").sortWithinPartitions("block").mapInPandas(_dense_links(radius, similarity), "a bigint, b bigint")


def similar_links(
    docs: DataFrame, items: DataFrame, shingle_words: int, radius: int, similarity: float, text_col: str, chunk: int = CHUNK
) -> DataFrame:
    """Links (a, b) between nodes of written ``items`` (node, bits, first) that connect all whose texts are similar enough."""
    found = cut_lineage(near_pairs(items.select("node", "bits"), radius, chunk))
    pairs = found.filter("b is not null").select("a", "b")
    dense = found.filter("b is null").select(F.col("a").alias("node"), "bits", "slot", "side")
    asked = found.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
    wanted = items.join(asked, "node").select("node", F.col("first.digest").alias("digest"))
    texts = docs.select(row_digest(docs).alias("digest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    one = texts.join(wanted, "digest").dropDuplicates(["digest", "node"]).select("node", "text")
    sets = cut_lineage(arrow_map(one, _sets, "node bigint, shingles binary", (shingle_words,)))
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return met.mapInArrow(_checked(similarity), "a bigint, b bigint").unionByName(dense_links(dense, sets, radius, similarity))


def keep_distinct(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, similarity: float = SIMILARITY,
    id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
) -> DataFrame:
    """One row of ``docs``, with all its columns, of every group of near copies: that of the smallest id."""
    digest = row_digest(docs)
    marked = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), digest.alias("digest")
    )
    prints = cut_lineage(arrow_map(marked, _prints, PRINT_SCHEMA))
    # Ids come before nulls; the struct orders by id, then by digest.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")
    items = prints.groupBy("item").agg(F.min("bits").alias("bits"), first)
    # Numbered once and written, so that every reader sees the same numbers.
    items = cut_lineage(items.drop("item").withColumn("node", F.monotonically_increasing_id()))
    links = cut_lineage(similar_links(docs, items, shingle_words, radius, similarity, text_col, chunk))
    rooted = items.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.digest", "first.doc_id")
    row_id = F.col(f"`{id_col}`").cast("bigint")
    kept = docs.select(
        row_id.alias("_stay_id"), digest.alias("_stay_digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    ).join(stay, F.col("_stay_id").eqNullSafe(F.col("doc_id")) & (F.col("_stay_digest") == F.col("digest")), "left_semi")
    return kept.dropDuplicates(["_stay_id", "_stay_digest"]).select("_row.*")
