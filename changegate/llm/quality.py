r"""Document quality by weak supervision.

Each rule looks at one property of a text and votes ``good``, ``bad`` or abstains.  No rule decides alone: expectation-
maximisation estimates, from the votes of *all* documents, how often each rule votes bad on bad documents and good on good
ones, and the posterior probability of quality given a document's votes replaces the filter that all rules must pass.

The estimation needs only how many documents cast each combination of votes.  Those counts are summed by Spark with a
partial sum in every task; there are at most ``3 ** len(RULES)`` combinations, whatever the size of the corpus, so the
table of combinations is small by construction and may be collected and broadcast.

Words are maximal runs of characters other than the six ASCII white-space characters; lines are split at ``\n``.

Defined results: a null or empty text has no words, fails the base rules and is not kept.  Repeated rows are judged alike;
null ids are kept; no documents give no rows.  Extra columns are not read.  Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegate.llm.common import arrow_map, cut_lineage, give_back, text_bytes

MIN_WORDS, MAX_REPEATED = 50, 0.5  # base rules: fewer words, or more words in repeated windows, fail
KEEP_AT = 0.5
MIN_LINES = 5  # fewer say nothing about repeated lines

_SPACES = b"\t\n\v\f\r "
_SYMBOLS = b"#*$%&|<>"
_ENDS = (b".", b"!", b"?", b":", b'"', "…".encode(), "”".encode())
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_INNER = bytes(range(0x80, 0xC0))  # the bytes of a character after its first
_NON_ASCII = bytes(range(0x80, 0x100))
_NEITHER = bytes(b for b in range(256) if b not in _SPACES + _SYMBOLS)


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


@dataclass(frozen=True)
class Profile:
    """What the rules look at."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_upper: int
    n_lower: int
    n_digits: int
    n_marks: int
    n_ended_lines: int
    n_symbol_words: int
    n_bytes: int
    n_other: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or self.n_repeat_words > MAX_REPEATED * self.n_words


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found, covered, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def profile(data: bytes) -> Profile:
    words = data.split()
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    filled = len(data) - _count(data, _SPACES)
    upper, lower, digits = _count(data, _UPPER), _count(data, _LOWER), _count(data, b"0123456789")
    return Profile(
        n_words=len(words),
        word_chars=filled - _count(data, _INNER),
        n_symbols=_count(data, _SYMBOLS),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(words),
        n_lines=len(lines),
        n_upper=upper,
        n_lower=lower,
        n_digits=digits,
        n_marks=_count(data, b"!?"),
        n_ended_lines=sum(line.rstrip().endswith(_ENDS) for line in lines),
        n_symbol_words=len(data.translate(None, _NEITHER).split()),
        n_bytes=filled,
        n_other=filled - upper - lower - digits - _count(data, _NON_ASCII),
    )


@dataclass(frozen=True)
class Rule:
    """Votes on one number: good up to ``good``, bad from ``bad``, no vote between or where there is nothing to look at."""

    name: str
    good: float
    bad: float


# The measure of each rule is in ``measures``, in this order.
RULES = (
    Rule("symbols_per_word", 0.05, 0.2),
    Rule("marks_per_word", 0.1, 0.5),
    Rule("upper_share", 0.2, 0.6),
    Rule("digits_per_char", 0.1, 0.3),
    Rule("repeated_word_share", 0.1, 0.3),
    Rule("repeated_line_share", 0.1, 0.3),
    Rule("unended_line_share", 0.3, 0.7),
    Rule("word_length_off", 3.0, 6.0),
    Rule("symbol_word_share", 0.05, 0.25),
    Rule("mark_share", 0.06, 0.1),
)
GOOD, BAD, NONE = 1, 2, 0


def measures(p: Profile) -> list[float | None]:
    def share(part, of):
        return part / of if of else None

    length = share(p.word_chars, p.n_words)
    return [
        share(p.n_symbols, p.n_words),
        share(p.n_marks, p.n_words),
        share(p.n_upper, p.n_upper + p.n_lower),
        share(p.n_digits, p.word_chars),
        share(p.n_repeat_words, p.n_words),
        share(p.n_dup_lines, p.n_lines) if p.n_lines >= MIN_LINES else None,
        share(p.n_lines - p.n_ended_lines, p.n_lines),
        None if length is None else abs(length - 6.0),
        share(p.n_symbol_words, p.n_words),
        share(p.n_other, p.n_bytes),
    ]


def vote(p: Profile) -> int:
    """All votes as one number in base three, first rule in the lowest place."""
    code = 0
    for rule, value in reversed(list(zip(RULES, measures(p), strict=True))):
        code = 3 * code + (NONE if value is None else GOOD if value <= rule.good else BAD if value >= rule.bad else NONE)
    return code


def ballots(codes: np.ndarray) -> np.ndarray:
    """One row of votes per code."""
    return codes[:, None] // 3 ** np.arange(len(RULES)) % 3


@dataclass(frozen=True)
class VoteModel:
    """The share of good documents and each rule's accuracies, given that it votes."""

    prior: float
    good_on_good: np.ndarray
    bad_on_bad: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        votes = ballots(np.asarray(codes, dtype=np.int64))
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        odds += (votes == GOOD) @ np.log(self.good_on_good / (1 - self.bad_on_bad))
        odds += (votes == BAD) @ np.log((1 - self.good_on_good) / self.bad_on_bad)
        return 1 / (1 + np.exp(-odds))


START = VoteModel(0.85, np.full(len(RULES), 0.97), np.full(len(RULES), 0.4))
ROUNDS, TOLERANCE = 200, 1e-9
PSEUDO = 20.0  # documents that the starting accuracies count as; they keep a rule that hardly votes near its start


def estimate(codes: np.ndarray, counts: np.ndarray) -> VoteModel:
    """Expectation-maximisation over the combinations of votes, weighted by how many documents cast them.

    The two classes are told apart by the start, where a bad vote speaks for a bad document, and by the bound that every
    rule must stay better than chance.  Without documents the start is returned.
    """
    model, counts = START, np.asarray(counts, dtype=float)
    if not counts.sum():
        return model
    votes = ballots(np.asarray(codes, dtype=np.int64))
    good, bad = votes == GOOD, votes == BAD
    for _ in range(ROUNDS):
        is_good = model.posterior(codes) * counts
        is_bad = counts - is_good
        prior = (is_good.sum() + PSEUDO * START.prior) / (counts.sum() + PSEUDO)
        on_good = (is_good @ good + PSEUDO * START.good_on_good) / (is_good @ (good | bad) + PSEUDO)
        on_bad = (is_bad @ bad + PSEUDO * START.bad_on_bad) / (is_bad @ (good | bad) + PSEUDO)
        on_good = np.clip(on_good, 0.9, 0.9999)
        on_bad = np.clip(on_bad, np.minimum(1.05 - on_good, 0.5), 0.9999)
        moved = max(abs(prior - model.prior), np.abs(on_good - model.good_on_good).max(), np.abs(on_bad - model.bad_on_bad).max())
        model = VoteModel(float(np.clip(prior, 0.02, 0.98)), on_good, on_bad)
        if moved < TOLERANCE:
            break
    return model


FEATURES = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
FEATURE_SCHEMA = f"{FEATURES}, base_failed boolean, votes int"


def _features(batch: pa.RecordBatch) -> list:
    found = [profile(data) for data in text_bytes(batch.column(1))]
    columns = [[getattr(p, name) for p in found] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return [batch.column(0), *columns, [p.base_failed for p in found], [vote(p) for p in found]]


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base columns and the votes of every document, in one pass over whole texts."""
    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return arrow_map(narrow, _features, FEATURE_SCHEMA)


def posteriors(features: DataFrame) -> dict[int, float]:
    """The posterior quality of every combination of votes that occurs."""
    rows = features.groupBy("votes").count().collect()  # at most 3 ** len(RULES) rows
    codes, counts = np.array([r["votes"] for r in rows], dtype=np.int64), np.array([r["count"] for r in rows])
    return dict(zip(codes.tolist(), estimate(codes, counts).posterior(codes).tolist(), strict=True)) if rows else {}


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base columns, posterior quality and verdict of every document."""
    features = cut_lineage(document_features(docs, id_col, text_col))
    spark = docs.sparkSession
    known = spark.createDataFrame(list(posteriors(features).items()), "votes int, quality double")
    judged = features.join(F.broadcast(known), "votes", "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= KEEP_AT)).alias("kept"), "quality",
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is kept.

    The texts are read twice, once for the counts of votes and once to filter, and never shuffled.
    """
    text = f"cast(`{text_col}` as string) as text"
    quality = posteriors(arrow_map(docs.selectExpr("cast(null as bigint) as doc_id", text), _features, FEATURE_SCHEMA))
    kept = frozenset(code for code, value in quality.items() if value >= KEEP_AT)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        found = (profile((t or "").encode()) for t in texts)
        judged = pd.Series([not p.base_failed and vote(p) in kept for p in found], dtype=bool)
        give_back()
        return judged

    return docs.filter(good(F.expr(f"cast(`{text_col}` as string)")))
