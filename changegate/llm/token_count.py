r"""Token counts by dynamic programming over prefixes.

For every prefix of a piece the table keeps the last token of that prefix's encoding and the number of tokens.  A prefix
that ends at byte ``i`` is the prefix that ends where its last token starts, and that token; the token is the only one of
those ending at ``i`` that is compatible with the last token before it (see ``bpe_core``).  One automaton pass finds the
tokens ending at each byte, so a piece costs one table row per byte, and the exact count of *every* prefix is known:
truncation and budget questions are answered by looking into the table, never by encoding again.

Counts equal those of the ``tokenizers`` library for the whole text without begin, end or added special tokens; a special
string inside a text counts as the one token the library makes of it.

Defined results: a null or empty text has 0 bytes and 0 tokens.  Repeated rows are counted row by row, a null doc_id is
kept.  Extra columns are not read.  Long texts are processed whole; the memory of repeated chunks is bounded.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from changegate.llm import bpe_core
from changegate.llm.common import arrow_map, text_bytes

DEFAULT_LIMIT = 512
COUNT_SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes for one byte-level vocabulary."""

    def __init__(self, path: str):
        import ahocorasick
        import public_tokenizers

        self.vocabulary, specials = bpe_core.load_json(path)
        self.pattern = public_tokenizers.PATTERN
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocabulary.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        longest_first = sorted(specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if specials else None
        self.special_strings = tuple(specials)
        # Counts of chunks and of pieces, which count alike alone or as a chunk; and tables of chunks.
        self._chunks, self._prefixes = bpe_core.Cache(), bpe_core.Cache()

    def piece_table(self, piece: bytes) -> list[int]:
        """``table[i]`` is the token count of the first ``i`` bytes of a piece."""
        pair, whole, n = self.vocabulary.pair, self.vocabulary.whole, len(piece)
        count, last, settled = [0] * (n + 1), [-1] * (n + 1), 0
        # The automaton names the tokens that end at a byte from the longest to the shortest; one of them fits.
        for at, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            if at < settled:
                continue
            start = at + 1 - length
            if whole(token) if start == 0 else pair(before := last[start], token) == [before, token]:
                settled = at + 1
                count[settled], last[settled] = count[start] + 1, token
        return count

    def _piece_count(self, piece: str) -> int:
        known = self._chunks.get(piece)
        if known is None:
            known = self.piece_table(piece.encode())[-1]
            if len(piece) <= bpe_core.MAX_CACHED_CHARS:
                self._chunks.put(piece, known)
        return known

    def _chunk_count(self, chunk: str) -> int:
        pieces = bpe_core.split(chunk, self.pattern, "tokenizers")
        if len(pieces) == 1:
            return self._piece_count(chunk)
        n = sum(map(self._piece_count, pieces))
        if len(chunk) <= bpe_core.MAX_CACHED_CHARS:
            self._chunks.put(chunk, n)
        return n

    def _segments(self, text: str):
        """(is special, string) in order; the library cuts special strings out before it splits."""
        if not any(s in text for s in self.special_strings):
            if text:
                yield False, text
            return
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def count(self, text: str) -> int:
        """Tokens of a whole text: the table's entry at its last prefix, summed over independent chunks."""
        total, known = 0, self._chunks
        for special, segment in self._segments(text):
            if special:
                total += 1
                continue
            for chunk in bpe_core.CHUNK.findall(segment):
                n = known.get(chunk)
                total += self._chunk_count(chunk) if n is None else n
        return total

    def _chunk_prefixes(self, chunk: str) -> list[int]:
        """The token counts of the 1, 2, ... first characters of a chunk.

        All complete pieces before the cut keep their tokens.  A cut inside white space or inside a contraction can change
        how the open end is split, so the pieces of each cut are found anew and their counts looked up.
        """
        known = self._prefixes.get(chunk)
        if known is None:
            pieces = bpe_core.split(chunk, self.pattern, "tokenizers")
            known, done, base = [], 0, 0
            for n, piece in enumerate(pieces):
                table = self.piece_table(piece.encode())
                previous = pieces[n - 1] if n else ""
                fixed = not previous.isspace() and piece.removeprefix(" ").isalpha()  # splits alike however short it is cut
                ends = list(accumulate(len(c.encode()) for c in piece))
                for i, end in enumerate(ends):
                    if fixed or (i + 1 == len(piece) and not (previous.isspace() and piece.isspace())):
                        known.append(base + table[end])
                    else:
                        head = chunk[max(0, done - len(previous)) : done + i + 1]
                        before = base - (self._piece_count(previous) if previous else 0)
                        cut = bpe_core.split(head, self.pattern, "tokenizers")
                        known.append(before + sum(map(self._piece_count, cut)))
                base, done = base + table[-1], done + len(piece)
            if len(chunk) <= bpe_core.MAX_CACHED_CHARS:
                self._prefixes.put(chunk, known)
        return known

    def prefix_counts(self, text: str) -> list[int]:
        """``counts[i]`` is the exact token count of ``text[:i]``, for every ``i`` from 0 to the length."""
        counts = [0]
        for special, segment in self._segments(text):
            base = counts[-1]
            if special:
                # Until it is complete, a special string is ordinary text that goes on from the segment before it.
                start = len(counts) - 1
                counts.extend(self.count(text[: start + i]) for i in range(1, len(segment)))
                counts.append(base + 1)
                continue
            for chunk in bpe_core.CHUNK.findall(segment):
                base = counts[-1]
                counts.extend(base + n for n in self._chunk_prefixes(chunk))
        return counts

    def truncate(self, counts: list[int], budget: int) -> int:
        """Characters of the longest prefix within a token budget, from its table."""
        highest = list(accumulate(reversed(counts), min))[::-1]  # the least count from here to the end
        return bisect_right(highest, budget) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _count(batch: pa.RecordBatch, path: str, limit: int) -> list:
    count = counter(path).count
    sizes, tokens = [], []
    for data in text_bytes(batch.column(1)):
        sizes.append(len(data))
        tokens.append(count(data.decode("utf-8", "replace")))
    return [batch.column(0), sizes, tokens, [n > limit for n in tokens]]


def _prefixes(batch: pa.RecordBatch, path: str, budget: int) -> list:
    tables = [counter(path).prefix_counts(data.decode("utf-8", "replace")) for data in text_bytes(batch.column(1))]
    cuts = [counter(path).truncate(t, budget) for t in tables]
    return [batch.column(0), tables, cuts]


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = DEFAULT_LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes, tokens and whether the tokens exceed ``limit``, one row per document."""
    return arrow_map(_narrow(docs, id_col, text_col), _count, COUNT_SCHEMA, (path or vocabulary_path(), limit))


def prefix_tables(
    docs: DataFrame, path: str | None = None, budget: int = DEFAULT_LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The whole table of each document, counts[i] for its first i characters, and the characters that fit ``budget``."""
    schema = "doc_id bigint, prefix_counts array<int>, fits_chars int"
    return arrow_map(_narrow(docs, id_col, text_col), _prefixes, schema, (path or vocabulary_path(), budget))
