r"""Periodic runs of words, and texts with each run collapsed to its first period.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q`` apart are identical), at least
``max(MIN_WORDS, MIN_PERIODS * q)`` words long, which no neighbouring word extends with the same period.

*Method.*  A suffix automaton holds all substrings; its suffix links form a tree in which the path from a prefix's state to the
root spells all suffixes of that prefix.  Words are appended one by one: the access operation of a link-cut tree walks that
path and recolours it with the new end.  Before it does, the path falls into segments of one colour each, the end of the
last occurrence so far; the deepest state of a segment, of length ``L``, says that the suffix of length ``L`` was last seen
ending ``d`` words ago and that no longer suffix was.  ``d <= L`` is a square, and ``L`` is exactly how far period ``d`` reaches
to the left, so the square extends to the run of ``L + d`` words as soon as the next word breaks the period.  ``d`` is the
smallest period then: a smaller one would have been the colour.  A text of n words meets O(n log n) segments.

*What need not be appended.*  Every word of a run occurs at least ``MIN_PERIODS`` times inside it.  So no run crosses a word
with fewer occurrences in its stretch of text, and texts fall apart at such words, again and again, until only stretches of
words that are frequent within their own stretch are left.  That loses no run, whatever the text; prose leaves next to nothing.

Words are maximal runs of bytes other than the six ASCII white-space bytes, so any text splits exactly.

Defined results: a null or empty text has no words and no run.  Rows are judged one by one: repeated rows give repeated
results, null ids are kept (and, in the query, leave the text as it is).  No documents give no rows.  Extra columns are not
read.  Texts are processed whole; memory is linear in the longest text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changegate.llm.common import arrow_map, text_bytes

MIN_WORDS, MIN_PERIODS = 6, 4
MAX_SPLITS = 32  # rounds of splitting; what is left then goes to the automaton as it is

RUN_SCHEMA = "doc_id bigint, start bigint, length bigint, period bigint"
DIGEST_SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def suffix_automaton(word_ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, longest length) of every state, and the state of every prefix; state 1 is the root, 0 stands for none."""
    link, length, moves = [0, 0], [0, 0], [{}, {}]
    states, last = [], 1
    for n, word in enumerate(word_ids, 1):
        state = len(link)
        link.append(1)
        length.append(n)
        moves.append({})
        at = last
        while at and word not in moves[at]:
            moves[at][word] = state
            at = link[at]
        if at:
            target = moves[at][word]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                # The target also holds longer strings that do not end here: its short ones become a state of their own.
                copy = len(link)
                link.append(link[target])
                length.append(length[at] + 1)
                moves.append(dict(moves[target]))
                while at and moves[at].get(word) == target:
                    moves[at][word] = copy
                    at = link[at]
                link[target] = link[state] = copy
        states.append(state)
        last = state
    return link, length, states


def runs_of_stretch(word_ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in the order of their ends."""
    parent, length, states = suffix_automaton(word_ids)  # suffix links are the first path parents
    size, last = len(parent), len(word_ids) - 1
    left, right = [0] * size, [0] * size
    # All states of a splay tree have one colour, kept at its root: the last end of their strings, or -1.
    colour = [-1] * size
    runs = []
    for end, state in enumerate(states):
        at, below = state, 0
        while at:
            # Splay: bring the state to the root of its tree, which holds a piece of a path ordered by depth.
            while True:
                p = parent[at]
                if not p or (left[p] != at and right[p] != at):
                    break
                g = parent[p]
                if not g or (left[g] != p and right[g] != p):
                    colour[at] = colour[p]
                    if left[p] == at:
                        left[p] = b = right[at]
                        right[at] = p
                    else:
                        right[p] = b = left[at]
                        left[at] = p
                    if b:
                        parent[b] = p
                    parent[p], parent[at] = at, g
                    break
                above = parent[g]
                inner = bool(above) and (left[above] == g or right[above] == g)
                if left[g] == p:
                    if left[p] == at:
                        left[g] = c = right[p]
                        right[p] = g
                        left[p] = b = right[at]
                        right[at] = p
                        if c:
                            parent[c] = g
                        if b:
                            parent[b] = p
                        parent[g], parent[p] = p, at
                    else:
                        right[p] = b = left[at]
                        left[g] = c = right[at]
                        left[at], right[at] = p, g
                        if b:
                            parent[b] = p
                        if c:
                            parent[c] = g
                        parent[p] = parent[g] = at
                elif right[p] == at:
                    right[g] = c = left[p]
                    left[p] = g
                    right[p] = b = left[at]
                    left[at] = p
                    if c:
                        parent[c] = g
                    if b:
                        parent[b] = p
                    parent[g], parent[p] = p, at
                else:
                    left[p] = b = right[at]
                    right[g] = c = left[at]
                    right[at], left[at] = p, g
                    if b:
                        parent[b] = p
                    if c:
                        parent[c] = g
                    parent[p] = parent[g] = at
                parent[at] = above
                if inner:
                    if left[above] == g:
                        left[above] = at
                    else:
                        right[above] = at
                else:
                    colour[at] = colour[g]
                    break
            seen = colour[at]
            if seen >= 0:
                d, known = end - seen, length[at]
                if (
                    known >= (MIN_PERIODS - 1) * d
                    and known + d >= MIN_WORDS
                    and (end == last or word_ids[end + 1] != word_ids[end + 1 - d])
                ):
                    runs.append((end + 1 - known - d, known + d, d))
            # What hangs deeper keeps the old colour as a tree of its own; the part below takes its place.
            deeper = right[at]
            if deeper:
                colour[deeper] = seen
            right[at] = below
            below, at = at, parent[at]
        colour[below] = end
    return runs


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind last) of the stretches that can hold a run: long enough, all words frequent within the stretch."""
    keep = np.bincount(ids)[ids] >= MIN_PERIODS
    at = np.flatnonzero(keep)
    for _ in range(MAX_SPLITS):
        if len(at) < MIN_WORDS:
            return []
        stretch = np.cumsum(np.append(0, np.diff(at) != 1))
        sizes = np.bincount(stretch)
        long = sizes[stretch] >= MIN_WORDS
        at, stretch = at[long], stretch[long]
        _, place, counts = np.unique(stretch * (len(ids) + 1) + ids[at], return_inverse=True, return_counts=True)
        keep = counts[place] >= MIN_PERIODS
        if keep.all():
            break
        at = at[keep]
    edges = np.flatnonzero(np.diff(at) != 1) + 1
    found = np.split(at, edges) if len(at) else []
    return [(int(s[0]), int(s[-1]) + 1) for s in found if len(s) >= MIN_WORDS]


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a text's words as (start, length, period), by start, then period."""
    if len(words) < MIN_WORDS:
        return []
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    runs = []
    for first, behind in stretches(ids):
        runs += [(first + start, n, q) for start, n, q in runs_of_stretch(ids[first:behind].tolist())]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n, q in runs:
        change[start + q] += 1
        change[start + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def with_planted_run(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the contract's query: one id in ten has the end of its text replaced by repetitions of a part of it."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + period]
    return words[:a] + (part * (-(-(n - a) // period)))[: n - a]


def _digest(batch: pa.RecordBatch) -> list:
    ids = batch.column(0).to_pylist()
    out: list[list] = [[] for _ in range(7)]
    for doc_id, data in zip(ids, text_bytes(batch.column(1)), strict=True):
        words = with_planted_run(data.split(), doc_id)
        runs = find_runs(words)
        longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        row = (
            len(runs),
            *longest,
            1000 * longest[1] // longest[2] if runs else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest(),
        )
        for column, value in zip(out, row, strict=True):
            column.append(value)
    return [batch.column(0), *out]


def _runs(batch: pa.RecordBatch) -> list:
    out: list[list] = [[] for _ in range(4)]
    for doc_id, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
        for run in find_runs(data.split()):
            for column, value in zip(out, (doc_id, *run), strict=True):
                column.append(value)
    return out


def _collapsed(batch: pa.RecordBatch) -> list:
    texts = []
    for data in text_bytes(batch.column(1)):
        words = data.split()
        texts.append(b" ".join(collapse(words, find_runs(words))).decode("utf-8", "replace"))
    return [batch.column(0), texts]


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of every document."""
    return arrow_map(_narrow(docs, id_col, text_col), _runs, RUN_SCHEMA)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's words with each run collapsed to its first period, joined by one space."""
    return arrow_map(_narrow(docs, id_col, text_col), _collapsed, "doc_id bigint, text string")


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's digests: runs of the texts with planted repetitions, the longest one, and the collapsed text."""
    return arrow_map(_narrow(docs, id_col, text_col), _digest, DIGEST_SCHEMA)
