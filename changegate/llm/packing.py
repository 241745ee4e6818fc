"""Packing along a space-filling curve.

A document's tokens are hashed into a vector of ``BINS`` counts, whose logarithms, scaled to length one, are projected to
``DIMS`` dimensions by a fixed random matrix.  The projections are put on a grid and the cell's index along a Hilbert curve is
the document's key: documents with like vocabularies have near keys.  Sorted by that key, all documents form one stream of
tokens, which is cut every ``CONTEXT`` tokens.  Neighbours along the curve so share sequences, no token is lost or repeated, and
only the very last sequence of the whole corpus is padded.

*At scale* the order is found on narrow rows (key, row number, length): a range shuffle, a running sum in each partition, and
the sum of the partitions before.  Rows of equal keys are told apart by the row number, so a group of copies spreads over
partitions.  The ids of a document, two bytes each, are written once and meet its position in one shuffle.

Tokens are those of the ``tokenizers`` library without added special tokens, then ``END_ID``.  The vocabulary drops white space
and splits there, so a text's tokens are those of its pieces, which are remembered in a memory of bounded size.

Defined results: a null or empty text is the one token ``END_ID``.  Repeated rows are packed each; null ids are kept; no
documents give no rows.  Equal keys are in the order in which Spark read the rows.  Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changegate.llm.common import arrow_map, cut_lineage, text_bytes

CONTEXT, END_ID = 4096, 2
BINS, DIMS, GRID_BITS, PROJECTION_SEED = 256, 3, 10, 20240
MAX_PIECES, MAX_PIECE_CHARS = 600_000, 64

TOKEN_SCHEMA = "doc_id bigint, key bigint, n bigint, ids binary"
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Printable ASCII, plain Latin letters and ASCII white space: composed already, lower-cased letter by letter, and split the same
# way in every Unicode version.  Other texts are taken word by word, and words with other characters by the whole tokenizer.
_EASY = re.compile(r"[!-~À-ÖØ-öø-įı-ſ\t-\r ]*")
# Letters come first, being the most frequent; only the contractions must come before the last choice.
_SPLIT = re.compile(r"[a-zÀ-ÖØ-öø-ſ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9À-ÖØ-öø-ſ\t-\r ]+")
_WORD = re.compile(r"[^\t-\r ]+")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte inside a byte-level vocabulary: printable Latin-1 bytes for themselves, the
    others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(other)}


class _Pieces(dict):
    """Packed ids by lower-case piece, made at first sight; emptied when full, and without long pieces, so its size is bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        packed = self.make(piece)
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class WordTokenizer:
    """Packed ids of texts, piece by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of Spark are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.tokenize, self.end = self.tokenizer.model.tokenize, self._pack([END_ID])
        # Texts can take the short way only through the pipeline it was written for.
        normalizers, splitters = (
            json.loads(part.__getstate__()) if part else {} for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        )
        self.by_piece = [n["type"] for n in normalizers.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [
            s["type"] for s in splitters.get("pretokenizers", [])
        ] == ["Split", "ByteLevel"]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = _byte_characters()
        self.pieces, self.odd = _Pieces(self._piece), _Pieces(self._odd)

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
        return self._pack([t.id for t in self.tokenize(text)])

    def _odd(self, word: str) -> bytes:
        return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _is_easy(self, text: str) -> bool:
        return self.by_piece and _EASY.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def _ids(self, text: str) -> bytes:
        if self._is_easy(text):
            return b"".join(map(self.pieces.__getitem__, _SPLIT.findall(text.lower())))
        words = _WORD.findall(text)
        return b"".join([self._ids(w) if self._is_easy(w) else self.odd[w] for w in words])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of every text, with the end id."""
        return [self._ids(text.decode("utf-8", "replace")) + self.end for text in texts]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(PROJECTION_SEED).standard_normal((BINS, DIMS))


def project(ids: list[np.ndarray]) -> np.ndarray:
    """Grid cells, one row of ``DIMS`` coordinates per document."""
    counts = np.zeros((len(ids), BINS))
    for row, tokens in enumerate(ids):
        hashed = (tokens.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)  # the top bits of a product
        counts[row] = np.bincount(hashed, minlength=BINS)
    vectors = np.log1p(counts)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    points = (vectors / np.where(lengths == 0, 1, lengths)) @ _projection()
    # Coordinates are about normal with deviation one; the logistic curve spreads them evenly over the grid.
    return np.minimum((1 << GRID_BITS) - 1, ((1 << GRID_BITS) / (1 + np.exp(-1.7 * points)))).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Index of every cell along the Hilbert curve of the grid, all rows at once.

    From the coarsest bit down, a set bit of a dimension mirrors the finer bits of the first one, an unset bit exchanges
    them; a Gray code over the bits so turned gives the place along the curve.
    """
    x = cells.T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        finer = (1 << level) - 1
        for d in range(dims):
            mirrored = x[d] >> level & 1 == 1
            swapped = np.where(mirrored, 0, (x[0] ^ x[d]) & finer)
            x[0] = np.where(mirrored, x[0] ^ finer, x[0] ^ swapped)
            if d:
                x[d] ^= swapped
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[dims - 1] >> level & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level & 1)
    return key


def _tokens(batch: pa.RecordBatch, path: str) -> list:
    words = tokenizer(path)
    packed = words.encode(list(text_bytes(batch.column(1))))
    ids = [np.frombuffer(p, words.dtype) for p in packed]
    return [batch.column(0), hilbert_keys(project(ids)), [len(i) for i in ids], packed]


def _running(frames):
    """The tokens before each row, within its partition; rows arrive in order."""
    total = 0
    for frame in frames:
        before = total + frame["n"].cumsum() - frame["n"]
        total += int(frame["n"].sum())
        yield pd.DataFrame({"row": frame["row"], "part": frame["part"], "before": before, "n": frame["n"]})


def positions(rows: DataFrame) -> DataFrame:
    """(row, position) for rows (row, key, n): the tokens before each row in the order of (key, row)."""
    sorted_rows = rows.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    running = sorted_rows.withColumn("part", F.spark_partition_id()).mapInPandas(_running, "row bigint, part int, before bigint, n bigint")
    running = cut_lineage(running)
    totals = running.groupBy("part").agg(F.sum("n").alias("n"))  # one row per partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return running.join(offsets, "part").select("row", (F.col("before") + F.col("offset")).alias("position"))


def cut(position: int, length: int, context: int = CONTEXT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document whose first token has this position in the stream."""
    edges = [0, *range(context - position % context, length, context), length]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _pieces(batch: pa.RecordBatch, context: int) -> list:
    columns = [batch.column(k).to_pylist() for k in range(4)]
    out: list[list] = [[] for _ in range(7)]
    for doc_id, packed, n, position in zip(*columns, strict=True):
        ids = np.frombuffer(packed, f"<u{len(packed) // n}").astype("<u4")
        for start, length in cut(position, len(ids), context):
            at = position + start
            crc = zlib.crc32(ids[start : start + length].tobytes())
            for column, value in zip(out, (doc_id, start, length, crc, len(ids), at // context, at % context), strict=True):
                column.append(value)
    return out


def pack_documents(
    docs: DataFrame, path: str | None = None, context: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: document, place in it, checksum of its ids, and place in a sequence."""
    path = path or vocabulary_path()
    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    # Numbered once and written, so that every reader sees the same numbers.
    tokens = cut_lineage(arrow_map(narrow, _tokens, TOKEN_SCHEMA, (path,)).withColumn("row", F.monotonically_increasing_id()))
    placed = tokens.select("row", "doc_id", "ids", "n").join(positions(tokens.select("row", "key", "n")), "row")
    return arrow_map(placed.select("doc_id", "ids", "n", "position"), _pieces, PIECE_SCHEMA, (context,))
