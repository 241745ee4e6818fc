"""Near-duplicates by SimHash, compared bit-sliced.

*Fingerprint.*  Every shingle of ``shingle_words`` lower-cased words is hashed to 64 bits; a bit of the fingerprint is set if
it is set in more than half of the hashes.  Near copies differ in few bits.

*Search.*  The 64 bits are cut into ``radius + 3`` bands.  Fingerprints within the radius differ in at most ``radius`` bands
and so agree in three whole ones; every choice of three bands is a bucket key, and each pair of linked fingerprints meets in
a bucket.  Only different fingerprints are compared: equal ones are one class from the start.

*Comparison.*  A bucket's fingerprints are stored as 64 bit planes, so that one machine word holds one bit of 64 of them.  To
compare with one fingerprint, each plane is flipped where that has a bit, and the planes are added by carry-save counters:
bitwise sums and carries update 64 distances at once.  A counter that passes the radius sticks, and a block of fingerprints
whose counters all stick is abandoned for the planes that are left.

*Skew.*  A bucket larger than ``chunk`` is cut into chunks by a hash, and every pair of chunks is a task of its own, so
no bucket is one task however many copies of one text it holds.  What leaves a task are the links of a spanning forest, at most
one for each fingerprint, never all pairs.

Defined results: a null or empty text has fingerprint zero and is linked like any other; texts of fewer words than a shingle
are one shingle.  Repeated rows fall into one component.  Null ids take part but never name a component, unless no other id
is there, and then the component is null.  No documents give no rows.  Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegate.llm.common import arrow_map, cut_lineage, row_digest, text_bytes
from changegate.llm.components import connected_components
from changegate.operators.skew import even_join

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
AGREE = 3  # whole bands that linked fingerprints share
CHUNK = 4096
_SLICE = 1 << 14  # shingle hashes whose bits are counted at a time

FINGERPRINT_SCHEMA = "doc_id bigint, bits bigint"
LINK_SCHEMA = "a bigint, b bigint"


def shingle_hashes(data: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # bytes: A-Z and the six ASCII white-space characters
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= shingle_words:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    firsts = np.concatenate([[0], ends[:-shingle_words]]).tolist()
    lasts = (ends[shingle_words - 1 :] - 1).tolist()
    hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(firsts, lasts, strict=True)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(data: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    hashes = shingle_hashes(data, shingle_words)
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _SLICE):
        part = np.ascontiguousarray(hashes[i : i + _SLICE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def bands(radius: int = RADIUS) -> list[int]:
    """Masks of ``radius + AGREE`` bands of nearly equal width, in order."""
    edges = np.linspace(0, 64, radius + AGREE + 1).astype(int).tolist()
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def band_masks(radius: int = RADIUS) -> list[int]:
    """The bits that every choice of ``AGREE`` bands covers, as signed numbers."""
    masks = [sum(choice) for choice in combinations(bands(radius), AGREE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words: bit ``j % 64`` of word ``j // 64`` of row ``k`` is bit ``k`` of value ``j``."""
    width = -(-len(values) // 64)
    padded = np.zeros(width * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").copy().view("<u8")


def within(planes: np.ndarray, value: int, radius: int, first: int = 0) -> np.ndarray:
    """Positions from ``64 * (first // 64)`` on whose distance to ``value`` is at most ``radius``.

    ``ones``, ``twos``, ... hold one binary digit of 64 distances each; ``over`` marks those past the radius.
    """
    alive = np.arange(first // 64, planes.shape[1])
    digits = radius.bit_length()
    counters = [np.zeros(len(alive), dtype=np.uint64) for _ in range(digits)]
    over = np.zeros(len(alive), dtype=np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k in range(64):
        plane = planes[k, alive]
        carry = ~plane if value >> k & 1 else plane  # where the bit differs
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over |= carry
        if k >= radius and k % 4 == 3:
            # Past the radius: larger than it in binary, digit by digit from the top.
            larger, equal = np.zeros_like(over), np.full_like(over, full)
            for d in reversed(range(digits)):
                if radius >> d & 1:
                    equal &= counters[d]
                else:
                    larger |= equal & counters[d]
                    equal &= ~counters[d]
            over |= larger
            live = over != full
            if not live.all():
                alive, over, counters = alive[live], over[live], [c[live] for c in counters]
                if not len(alive):
                    return alive
    hits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(hits)
    return alive[word] * 64 + bit


class _Forest:
    """Union-find over positions of a bucket; remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


SMALL = 24  # below this many fingerprints, whole distances are quicker than planes


def bucket_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``left``, or between ``left`` and ``right`` if that is given."""
    values = left if right is None else np.concatenate([left, right])
    n, m = len(left), len(values)
    forest = _Forest(m)
    if m <= SMALL:
        distance = np.bitwise_count(left[:, None] ^ (values if right is None else right)[None, :])
        found = np.argwhere(distance <= radius)
        if right is None:
            found = found[found[:, 0] < found[:, 1]]
        for i, j in found.tolist():
            forest.join(i, j if right is None else n + j)
        return forest.links
    others = left if right is None else right
    planes, shift = bit_planes(others), 0 if right is None else n
    for i, value in enumerate(left.tolist()):
        near = within(planes, value, radius, i if right is None else 0)
        near = near[near < len(others)]
        for j in (near[near > i] if right is None else near).tolist():
            forest.join(i, shift + j)
    return forest.links


def _link_buckets(radius: int):
    """Links of all buckets of a partition, which arrive sorted by bucket; memory is one bucket of two chunks at most."""
    order = ["key", "which", "chunk_a", "chunk_b"]

    def run(batches):
        rest: pd.DataFrame | None = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = frame[order].to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if not len(cut):
                rest = frame
                continue
            rest = frame.iloc[cut[-1] :].reset_index(drop=True)
            yield _links_of(frame.iloc[: cut[-1]], cut[:-1], radius)
        if rest is not None and len(rest):
            keys = rest[order].to_numpy()
            yield _links_of(rest, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, radius)

    return run


def _links_of(frame: pd.DataFrame, cuts: np.ndarray, radius: int) -> pd.DataFrame:
    bits = frame["bits"].to_numpy().view(np.uint64)
    chunk, a, b = (frame[c].to_numpy() for c in ("chunk", "chunk_a", "chunk_b"))
    links: list[np.ndarray] = []
    edges = [0, *cuts.tolist(), len(bits)]
    for first, last in zip(edges, edges[1:], strict=False):
        if last - first < 2:
            continue
        mine = bits[first:last]
        if a[first] == b[first]:
            found, values = bucket_links(mine, None, radius), mine
        else:
            is_left = chunk[first:last] == a[first]
            left, right = mine[is_left], mine[~is_left]
            found, values = bucket_links(left, right, radius), np.concatenate([left, right])
        if found:
            links.append(values[np.array(found)])
    pairs = np.concatenate(links).view(np.int64) if links else np.zeros((0, 2), dtype=np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _fingerprints(batch: pa.RecordBatch, shingle_words: int) -> list:
    bits = np.array([fingerprint(data, shingle_words) for data in text_bytes(batch.column(1))], dtype=np.uint64)
    return [batch.column(0), bits.view(np.int64)]


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the 64 bits of every document as a signed number."""
    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return arrow_map(narrow, _fingerprints, FINGERPRINT_SCHEMA, (shingle_words,))


def near_links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between different fingerprints ``bits`` that span every component of the graph of all links."""
    masks = band_masks(radius)
    keyed = distinct.select("bits", F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m)) for m in masks])).alias("which", "key"))
    sizes = keyed.groupBy("which", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # A bucket of one fingerprint has no pair; the join drops it.  Spark sizes ``keyed`` as if every fingerprint had one key and
    # would send it whole to the driver to broadcast it, so the join is asked to sort both sides.
    met = keyed.join(sizes.hint("merge"), ["which", "key"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda c: F.struct(F.least(c, F.col("chunk")).alias("chunk_a"), F.greatest(c, F.col("chunk")).alias("chunk_b")),
    )
    tasks = met.select("bits", "which", "key", "chunk", F.explode(pairs).alias("pair")).select(
        "bits", "which", "key", "chunk", "pair.chunk_a", "pair.chunk_b"
    )
    order = ["key", "which", "chunk_a", "chunk_b"]
    return tasks.repartition(*order).sortWithinPartitions(*order).mapInPandas(_link_buckets(radius), LINK_SCHEMA)


def classes(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(bits, root, component_id) of every fingerprint of written ``prints`` (doc_id, bits).

    ``root``, the smallest fingerprint of the component, tells components apart; ids do not, since they may be null or repeated.
    """
    distinct = cut_lineage(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    links = cut_lineage(near_links(distinct.select("bits"), radius, chunk))
    roots = connected_components(links)
    rooted = distinct.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    rooted = cut_lineage(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut_lineage(even_join(rooted, least, ["root"], "inner").select("bits", "root", "component_id"))


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    prints = cut_lineage(fingerprints(docs, shingle_words, id_col, text_col))
    found = prints.join(classes(prints, radius), "bits")
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs``, with all its columns, of every component: that of the smallest id.

    The texts are shuffled once, by id, to meet the short table of rows to keep.  Of a component's rows that repeat its smallest
    id, or that all have none, the one with the smallest hash of its columns stays; of wholly equal rows, one.
    """
    columns = docs.columns
    digest = row_digest(docs)
    marked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), digest.alias("digest"))
    prints = cut_lineage(arrow_map(marked, _marked_fingerprints, "doc_id bigint, bits bigint, digest bigint", (shingle_words,)))
    found = prints.join(classes(prints.select("doc_id", "bits"), radius), "bits")
    # Ids come before nulls; the struct orders by id, then by digest.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")
    stay = found.groupBy("root").agg(first).select("first.digest", "first.doc_id")
    row_id = F.col(f"`{id_col}`").cast("bigint")
    kept = docs.select(row_id.alias("_stay_id"), digest.alias("_stay_digest"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")).join(
        stay, F.col("_stay_id").eqNullSafe(F.col("doc_id")) & (F.col("_stay_digest") == F.col("digest")), "left_semi"
    )
    return kept.dropDuplicates(["_stay_id", "_stay_digest"]).select("_row.*")


def _marked_fingerprints(batch: pa.RecordBatch, shingle_words: int) -> list:
    return [*_fingerprints(batch.select([0, 1]), shingle_words), batch.column(2)]
