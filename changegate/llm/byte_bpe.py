"""Byte-level BPE encoding and decoding as reductions of a monoid tree.

Encoding halves a piece until a half is one token, and joins neighbours upwards.  A join keeps all tokens of both sides if
the two that meet are compatible; otherwise it encodes a window around the seam anew and lets the window grow on the side
whose outer neighbour is not compatible with the window's edge.  Once both edges are compatible, every two neighbours of the
joined sequence are, which proves that it is the encoding (see ``bpe_core``).  Joining is associative, so any tree gives the
same tokens; pieces of the splitting pattern are joined by plain concatenation.

Decoding looks tokens up at the leaves and concatenates up the tree, which is exact for any ids, also where a token holds
part of a character.

Defined results: a null or empty text has no ids and decodes to no bytes.  Rows are encoded one by one, so repeated rows and
null ids are kept; extra columns are not read; memory per text is linear in its length.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changegate.llm import bpe_core
from changegate.llm.common import arrow_map, text_bytes

LEAF_IDS = 2048
MAX_CACHED_BYTES = 12  # halves are remembered up to here; pieces as a whole are remembered packed
DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class _Packed(dict):
    """Packed ids by piece, encoded at first sight; emptied when full, and without long pieces, so its size is bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encode(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        packed = ids.tobytes()
        if len(piece) <= bpe_core.MAX_CACHED_CHARS:
            if len(self) >= bpe_core.MAX_CACHE:
                self.clear()
            self[piece] = packed
        return packed


class TreeCodec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        import public_tokenizers

        self.vocabulary = bpe_core.load_ranks(path)
        self.pattern = public_tokenizers.PATTERN
        self._packed, self._pieces, self._seams = _Packed(self.encode_piece), bpe_core.Cache(), bpe_core.Cache()
        # All tokens end to end, and where each starts, for the leaves of decoding.
        tokens = self.vocabulary.tokens
        self._flat = np.frombuffer(b"".join(tokens), np.uint8)
        self._starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def _seam(self, a: int, b: int) -> list[int]:
        """The encoding of two tokens' bytes; empty if they are compatible."""
        known = self._seams.get((a, b))
        if known is None:
            tokens = self.vocabulary.tokens
            known = self.vocabulary.encode_plain(tokens[a] + tokens[b])
            if known == [a, b]:
                known = []
            self._seams.put((a, b), known)
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right:
            return left + right
        window, i, j = self._seam(left[-1], right[0]), 1, 1
        if not window:
            return left + right
        tokens = self.vocabulary.tokens
        while True:
            left_open = i < len(left) and self._seam(left[-i - 1], window[0])
            right_open = j < len(right) and self._seam(window[-1], right[j])
            if not left_open and not right_open:
                return left[:-i] + window + right[j:]
            i = min(len(left), 2 * i) if left_open else i
            j = min(len(right), 2 * j) if right_open else j
            window = self.vocabulary.encode_plain(b"".join([tokens[t] for t in [*left[-i:], *right[:j]]]))

    def encode_piece(self, piece: bytes) -> list[int]:
        known = self._pieces.get(piece)
        if known is None:
            token = self.vocabulary.ids.get(piece)
            if token is not None and self.vocabulary.whole(token):
                known = [token]
            else:
                half = len(piece) // 2
                known = self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))
            if len(piece) <= MAX_CACHED_BYTES:
                self._pieces.put(piece, known)
        return known

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._packed.__getitem__, bpe_core.split_text(text, self.pattern, "tiktoken")))

    def _leaf(self, ids: np.ndarray) -> bytes:
        """The bytes of some thousand ids, gathered from the flat array of all tokens."""
        first = self._starts[ids]
        sizes = self._starts[ids + 1] - first
        ends = np.cumsum(sizes)
        return self._flat[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids: leaves of some thousand ids, then pairs of neighbours up to the root."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        level = [self._leaf(ids[i : i + LEAF_IDS]) for i in range(0, len(ids), LEAF_IDS)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=2)
def codec(path: str) -> TreeCodec:
    return TreeCodec(path)


def _encode(batch: pa.RecordBatch, path: str) -> list:
    encode = codec(path).encode
    packed = [encode(data.decode("utf-8", "replace")) for data in text_bytes(batch.column(1))]
    return [batch.column(0), [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]]


def _decode(batch: pa.RecordBatch, path: str) -> list:
    decode = codec(path).decode
    packed = [np.array(ids or [], dtype="<u4").tobytes() for ids in batch.column(1).to_pylist()]
    return [batch.column(0), [decode(p).decode("utf-8", "replace") for p in packed]]


def _digest(batch: pa.RecordBatch, path: str) -> list:
    tree = codec(path)
    counts, ids, decoded = [], [], []
    for data in text_bytes(batch.column(1)):
        packed = tree.encode(data.decode("utf-8", "replace"))
        counts.append(len(packed) // 4)
        ids.append(hashlib.sha256(packed).hexdigest())
        decoded.append(hashlib.sha256(tree.decode(packed)).hexdigest())
    return [batch.column(0), counts, ids, decoded]


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token ids of every text."""
    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return arrow_map(narrow, _encode, "doc_id bigint, ids array<int>", (path or vocabulary_path(),))


def decode_ids(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of every id list; bytes that are no UTF-8 are replaced."""
    narrow = encoded.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{ids_col}` as ids")
    return arrow_map(narrow, _decode, "doc_id bigint, text string", (path or vocabulary_path(),))


def round_trip_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and report the count and the digests of both, in one pass over the texts."""
    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return arrow_map(narrow, _digest, DIGEST_SCHEMA, (path or vocabulary_path(),))
