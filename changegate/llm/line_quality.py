r"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is one position with a hidden tag, good or bad.  A line is described by some properties, each put in a
bin: how long it is, how many of its characters are symbols, marks, digits, capitals or from outside ASCII, how often a word
repeats the one before it, how varied its words are, whether the line or its three-word windows occur elsewhere in the text, how it begins and
ends, where it stands.  A position scores by its own bins and by those of the *neighbouring lines*; neighbouring tags score by
a transition table.  Forward-backward gives each line's probability of being good, and a document's quality is the mean of
these marginals weighted by the lines' lengths, put on the scale of the labels by a logistic function of its logarithmic odds.

*Learning.*  Labels exist for documents only.  All lines of good documents are good.  Lines of bad documents start as bad; after
a fit, those that the model finds good become good, but for the worst line of a document, and the model is fitted again.  The
weights maximise the penalised likelihood of the tags.  Learning uses a *bounded* sample of labelled rows outside the held-out
fold: at most about ``MAX_ROWS`` documents, chosen by a hash, and ``MAX_LINES`` lines; documents of more lines than fit are
shortened to one common number of lines, for learning only.  Scoring reads every text whole.  Tasks turn sampled texts into
bins, a few bytes a line, and one task learns from those.

*Speed.*  Properties are computed for all lines of a block of texts at once.  The texts of a block are laid end to end as one
chain in which the first transition of a text forgets the tag before it.  Messages are products of two-by-two matrices,
combined by doubling, which is exact and needs as many steps as the longest text has binary digits of lines.

Words are maximal runs of bytes other than the six ASCII white-space bytes; lines are split at ``\n``, and a text without one
is one line.

Defined results: a null or empty text is one empty line and is scored by it.  Without a label of each kind every score is one
half.  Duplicate or conflicting labels count as one example each; null labels and null ids in ``labels`` are ignored.
Repeated rows are scored alike; null ids are scored (``held_out`` null) and never learned from.  No documents give no rows.
Extra columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from changegate.llm.common import arrow_map, bounded_batches, text_bytes

HELD_OUT_OF = 5  # rows whose crc32 of the id is divisible by this are never learned from
MAX_ROWS, MAX_LINES = 8_000, 200_000  # the bound of the learning sample
MAX_SAMPLE_BYTES = 64 << 20  # and of the text that is turned into bins for it
FITS, STEPS, RATE, PENALTY = 3, 40, 0.3, 1.0
PREDICT_AT = 0.3
DIGITS = 12  # a score's last digits would depend on the texts it is computed beside
BLOCK_BYTES = 1 << 20  # texts that are described together; a longer text is a block of its own
HASH_BYTES = 4 << 20

_LINE, _SPACE, _SYMBOL, _MARK, _STOP, _DIGIT, _UPPER, _LOWER, _OTHER, _INNER = range(10)


def _classes() -> np.ndarray:
    """The class of every byte; bytes of a character after its first are a class of their own."""
    table = np.full(256, _OTHER, dtype=np.uint8)
    table[0x80:0xC0] = _INNER
    for kind, members in (
        (_SPACE, b"\t\v\f\r "), (_SYMBOL, b"#*$%&|<>{}[]\\^_~@=+/`"), (_MARK, b",;'\"()-!"), (_STOP, b".?:"), (_LINE, b"\n"),
    ):
        table[list(members)] = kind
    table[48:58], table[65:91], table[97:123] = _DIGIT, _UPPER, _LOWER
    return table


_CLASS = _classes()
_SHARES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4])  # edges of shares of a line
# Name and lower edges of the bins of every property.
PROPERTIES: list[tuple[str, np.ndarray]] = [
    ("characters", np.array([1, 10, 25, 50, 100, 200, 500, 1500, 5000])),
    ("words", np.array([1, 2, 4, 8, 16, 40, 120, 400])),
    ("word length", np.array([1, 2, 3, 4, 5, 6, 7, 9, 12])),
    ("symbols", _SHARES),
    ("marks", _SHARES),
    ("stops", _SHARES),
    ("digits", _SHARES),
    ("capitals", _SHARES),
    ("not ASCII", _SHARES),
    ("lone words", np.array([0.0, 0.02, 0.1, 0.3, 0.6])),
    ("repeats of the word before", _SHARES),
    ("words met earlier in the line", np.array([0.0, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85])),
    ("windows met elsewhere", np.array([0.0, 0.02, 0.1, 0.25, 0.5, 0.75])),
    ("same line earlier", np.array([1])),
    ("same line just before", np.array([1])),
    ("first character", np.array([1, 2, 3, 4, 5, 6, 7, 8])),
    ("last character", np.array([1, 2, 3, 4, 5, 6, 7, 8])),
    ("first line", np.array([1])),
    ("lines of the text", np.array([2, 3, 5, 10, 30])),
]
_EDGE_BIN = 10  # the bin of a neighbour that does not exist
_BINS = _EDGE_BIN + 1
SIZE = len(PROPERTIES) * _BINS  # weights of one line's bins; the neighbours' bins have as many each
assert max(len(edges) for _, edges in PROPERTIES) < _EDGE_BIN


def _per_line(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the positions of every line."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def _met_before(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    met = np.ones(len(keys), dtype=bool)
    met[np.unique(keys, return_index=True)[1]] = False
    return met


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = keys * np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(32))


_BASE = np.uint64(0x100000001B3)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number, modulo 2 ** 64."""
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), _BASE))])[: max(n, 1)]


def _word_hashes(data: np.ndarray, space: np.ndarray, word_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of every word: its bytes times powers of a number, summed and mixed; in slices of some megabytes."""
    powers = _powers(int(lengths.max()))
    out = np.empty(len(word_at), dtype=np.uint64)
    edges = np.searchsorted(word_at, np.arange(word_at[0], len(data) + HASH_BYTES, HASH_BYTES))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            first, behind = word_at[a], word_at[b] if b < len(word_at) else len(data)
            starts = word_at[a:b] - first
            within = np.arange(behind - first) - np.repeat(starts, np.diff(np.append(starts, behind - first)))
            value = (data[first:behind].astype(np.uint64) + np.uint64(1)) * powers[np.minimum(within, len(powers) - 1)]
            value[space[first:behind]] = 0
            out[a:b] = np.add.reduceat(value, starts)
    return _mixed(out)


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of every line, weight of every line, lines of every text) for texts laid end to end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind = _CLASS[data]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    text_of = np.repeat(np.arange(len(texts)), per_text)
    n = len(starts)
    size = np.maximum(ends - starts, 1)

    space = kind <= _SPACE
    before = np.concatenate([[True], space[:-1]])
    word_at = np.flatnonzero(~space & before)
    word_end = np.flatnonzero(space & ~before)
    lengths = word_end - word_at
    first_word = np.searchsorted(word_at, starts)
    words = np.searchsorted(word_at, ends) - first_word
    line_of = np.repeat(np.arange(n), words)

    def share(*kinds):
        return _per_line(np.isin(kind, kinds), starts, ends) / size

    inner = share(_INNER)
    letters = np.bincount(line_of, lengths, n)
    safe = np.maximum(words, 1)
    if len(word_at):
        word = _word_hashes(data, space, word_at, lengths)
        same = np.zeros(len(word), dtype=bool)
        same[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
        repeats = np.bincount(line_of, same, n) / safe
        earlier = np.bincount(line_of, _met_before(_mixed(word ^ _mixed(line_of.astype(np.uint64)))), n) / safe
        lone = np.bincount(line_of, lengths <= 2, n) / safe
        # Windows of three words of one text that occur again in it.
        of_text = text_of[line_of]
        windows = np.zeros(n)
        whole = np.flatnonzero(of_text[:-2] == of_text[2:])
        if len(whole):
            key = _mixed(_mixed(_mixed(word[whole]) + word[whole + 1]) + word[whole + 2]) ^ _mixed(of_text[whole].astype(np.uint64))
            _, at, count = np.unique(key, return_inverse=True, return_counts=True)
            windows = np.bincount(line_of[whole], count[at] > 1, n) / safe
        # A line is the sequence of its words; the powers tell orders apart.
        step = _powers(int(words.max()))[np.arange(len(word)) - first_word[line_of]]
        contribution = np.concatenate([word * step, [np.uint64(0)]])
        line = np.where(words > 0, np.add.reduceat(contribution, np.minimum(first_word, len(word))), np.uint64(0))
        line = _mixed(line) ^ _mixed(text_of.astype(np.uint64))
        again = _met_before(line) & (words > 0)
        just = np.zeros(n, dtype=bool)
        just[1:] = (line[1:] == line[:-1]) & (words[1:] > 0)
    else:
        repeats = earlier = lone = windows = np.zeros(n)
        again = just = np.zeros(n, dtype=bool)
    full = ends > starts
    first = np.where(full, kind[np.minimum(starts, len(kind) - 1)], _LINE)
    last = np.where(full, kind[np.maximum(ends - 1, 0)], _LINE)
    text_start = np.concatenate([[True], text_of[1:] != text_of[:-1]])
    measured = [
        (ends - starts) * (1 - inner), words, letters / safe, share(_SYMBOL), share(_MARK), share(_STOP), share(_DIGIT), share(_UPPER),
        share(_OTHER), lone, repeats, earlier, windows, again, just, first, last, text_start, np.repeat(per_text, per_text),
    ]
    bins = np.empty((n, len(PROPERTIES)), dtype=np.uint8)
    for column, (values, (_, edges)) in enumerate(zip(measured, PROPERTIES, strict=True)):
        bins[:, column] = np.searchsorted(edges, np.asarray(values, dtype=float), side="right")
    return bins, ends - starts + 1.0, per_text


# ---------------------------------------------------------------------------------------------------------------- chain


def _forward(unary: np.ndarray, starts: np.ndarray, transition: np.ndarray, begin: np.ndarray, longest: int) -> np.ndarray:
    """Log odds of good at every position before its own score, given all positions before it in its text.

    ``m[a][b]`` at a position carries the message past the position before it; where a text starts it gives ``begin`` whatever
    came before.  After the pass with shift ``s`` it is the product over the last ``2 * s`` positions.
    """
    n = len(unary)
    weight = np.exp(np.clip(np.concatenate([[0.0], unary[:-1]]), -30, 30))
    m = [[None, None], [None, None]]
    for b in (0, 1):
        m[0][b] = np.where(starts, begin[b], transition[0, b])
        m[1][b] = np.where(starts, begin[b], weight * transition[1, b])
    shift = 1
    while shift < min(longest, n):
        old = [[x[:-shift] for x in row] for row in m]
        new = [[x[shift:] for x in row] for row in m]
        product = [[old[a][0] * new[0][b] + old[a][1] * new[1][b] for b in (0, 1)] for a in (0, 1)]
        scale = product[0][0] + product[0][1] + product[1][0] + product[1][1]
        m = [[np.concatenate([m[a][b][:shift], product[a][b] / scale]) for b in (0, 1)] for a in (0, 1)]
        shift *= 2
    # The product reaches back to the start of the text, so both rows agree.
    return np.log(m[0][1] + m[1][1]) - np.log(m[0][0] + m[1][0])


def marginals(
    unary: np.ndarray, per_text: np.ndarray, transition: np.ndarray, begin: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log odds of good at every line, forward messages, whether a line starts its text)."""
    n = len(unary)
    starts = np.zeros(n, dtype=bool)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]]).astype(int)
    starts[first] = True
    longest = int(per_text.max(initial=1))
    forward = _forward(unary, starts, transition, begin, longest)
    ends = np.append(starts[1:], True)[::-1]
    backward = _forward(unary[::-1], ends, transition.T, np.array([0.5, 0.5]), longest)[::-1]
    return unary + forward + backward, forward, starts


def neighbours(bins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weight numbers of every line: its own bins, then those of the line before and of the line behind."""
    base = np.arange(bins.shape[1]) * _BINS
    own = bins + base
    edge = base + _EDGE_BIN
    before = np.vstack([edge[None, :], own[:-1]])
    before[starts] = edge
    behind = np.vstack([own[1:], edge[None, :]])
    behind[np.append(starts[1:], True)] = edge
    return np.hstack([own, before + SIZE, behind + 2 * SIZE]).astype(np.int32)


def _starts(per_text: np.ndarray) -> np.ndarray:
    starts = np.zeros(int(per_text.sum()), dtype=bool)
    starts[np.concatenate([[0], np.cumsum(per_text)[:-1]]).astype(int)] = True
    return starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class LineModel:
    """Weights of bins, transition potentials, and the logistic function from a document's log odds to its score."""

    weights: np.ndarray
    bias: float
    transition: np.ndarray
    begin: np.ndarray
    slope: float
    offset: float
    usable: bool = True

    def tag(self, bins: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """The probability of good of every line."""
        return _sigmoid(self._odds(neighbours(bins, _starts(per_text)), per_text))

    def _odds(self, columns: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        unary = self.bias + self.weights[columns].sum(axis=1)
        return marginals(unary, per_text, self.transition, self.begin)[0]

    def score(self, texts: list[bytes]) -> list[float]:
        """The quality of every text, in blocks of bounded size."""
        if not self.usable:
            return [0.5] * len(texts)
        out: list[float] = []
        block, size = [], 0
        for text in texts:
            if block and size + len(text) > BLOCK_BYTES:
                out += self._score_block(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        return out + (self._score_block(block) if block else [])

    def _score_block(self, texts: list[bytes]) -> list[float]:
        bins, weight, per_text = describe(texts)
        scores = _sigmoid(self.slope * document_odds(self.tag(bins, per_text), weight, per_text) + self.offset)
        return scores.round(DIGITS).tolist()


UNUSABLE = LineModel(np.zeros(3 * SIZE), 0.0, np.ones((2, 2)), np.array([0.5, 0.5]), 0.0, 0.0, usable=False)


def document_odds(p: np.ndarray, weight: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean of the lines' probabilities."""
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]]).astype(int)
    q = np.clip(np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first), 1e-6, 1 - 1e-6)
    return np.log(q) - np.log1p(-q)


def gradient(columns: np.ndarray, per_text: np.ndarray, tags: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The gradient of the log-likelihood of the tags: observed less expected counts of all features."""
    size, per_line = 3 * SIZE, columns.shape[1]
    model = _model(theta)
    unary = model.bias + model.weights[columns].sum(axis=1)
    odds, forward, starts = marginals(unary, per_text, model.transition, model.begin)
    p = _sigmoid(odds)
    follows = ~starts[1:]
    # Both of two neighbours good, from what speaks for the first, the transition, and what speaks for the second.
    t = model.transition
    x = np.clip((forward + unary)[:-1][follows], -40, 40)
    y = np.clip((odds - forward)[1:][follows], -40, 40)
    both = (t[1, 1] / (t[1, 1] + t[0, 0] * np.exp(-x - y) + t[0, 1] * np.exp(-x) + t[1, 0] * np.exp(-y))).sum()

    def pairs(tag, both):
        to, of = tag[1:][follows].sum(), tag[:-1][follows].sum()
        return np.array([follows.sum() - to - of + both, to - both, of - both, both])

    both_seen = (tags[1:] * tags[:-1])[follows].sum()
    return np.concatenate([
        np.bincount(columns.ravel(), np.repeat(tags - p, per_line), size), [tags.sum() - p.sum()],
        pairs(tags, both_seen) - pairs(p, both),
        [((1 - tags) * starts).sum() - ((1 - p) * starts).sum(), (tags * starts).sum() - (p * starts).sum()],
    ])


def _fit(columns: np.ndarray, per_text: np.ndarray, tags: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Gradient ascent with per-weight step sizes on the penalised likelihood of the tags, from given parameters."""
    square = np.full(len(theta), 1e-8)
    for _ in range(STEPS):
        step = gradient(columns, per_text, tags, theta)
        step[: 3 * SIZE] -= PENALTY * theta[: 3 * SIZE]
        square += step**2
        theta = theta + RATE * step / np.sqrt(square)
    return theta


def _model(theta: np.ndarray, slope: float = 0.0, offset: float = 0.0) -> LineModel:
    size = 3 * SIZE
    begin = np.exp(theta[size + 5 :])
    return LineModel(
        theta[:size], float(theta[size]), np.exp(theta[size + 1 : size + 5]).reshape(2, 2), begin / begin.sum(), slope, offset
    )


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Penalised logistic regression by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    theta, penalty = np.zeros(2), np.diag([0.1, 1e-6])
    for _ in range(50):
        p = _sigmoid(a @ theta)
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(2), a.T @ (y - p) - penalty @ theta)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def learn(bins: list[np.ndarray], weights: list[np.ndarray], good: list[bool]) -> LineModel:
    """A model from the bins and weights of the lines of labelled documents; every step is deterministic."""
    if len(set(good)) < 2:
        return UNUSABLE
    per_text = np.array([len(b) for b in bins])
    label = np.array(good, dtype=float)
    columns = neighbours(np.vstack(bins), _starts(per_text))
    weight = np.concatenate(weights)
    text_of = np.repeat(np.arange(len(bins)), per_text)
    tags = label[text_of]
    theta = np.zeros(3 * SIZE + 7)
    for round_ in range(FITS):
        theta = _fit(columns, per_text, tags, theta)
        p = _sigmoid(_model(theta)._odds(columns, per_text))
        if round_ + 1 < FITS:
            # Lines of bad documents that look good are good, but every bad document keeps its worst line.
            worst = np.full(len(bins), np.inf)
            np.minimum.at(worst, text_of, p)
            tags = np.where((label[text_of] == 1) | ((p > 0.5) & (p > worst[text_of])), 1.0, 0.0)
    slope, offset = _logistic(document_odds(p, weight, per_text), label)
    return _model(theta, slope, offset)


# ---------------------------------------------------------------------------------------------------------------- Spark


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(HELD_OUT_OF))


def _common(sizes: list[int], most: int) -> int:
    """The size to which the longest are cut so that all together are no longer than ``most``; the longest, if they fit."""
    rest = most
    for left, n in zip(range(len(sizes), 0, -1), sorted(sizes), strict=True):
        if n * left > rest:
            return max(1, rest // left)
        rest -= n
    return max(sizes, default=0)


SAMPLE_SCHEMA = "id bigint, good boolean, bins binary, weights binary"


def labelled_lines(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_SAMPLE_BYTES
) -> DataFrame | None:
    """Bins and weights of the lines of a bounded sample of labelled rows outside the held-out fold; None if there are none.

    Rows that repeat an id or a text can be any number; of ids, labels and digests a bounded number is chosen first, and only
    one text of each is read on, shortened where all together exceed ``max_bytes``.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").cast("int").alias("_quality")).filter(
        "_id is not null and _quality is not null"
    )
    usable = usable.filter(_remainder("_id") != 0).select("_id", (F.col("_quality") > 0).alias("_good")).distinct()
    total = usable.count()
    if total > max_rows:
        usable = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 32)) < int(max_rows / total * (1 << 32)))
    narrow = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("data"))
    narrow = narrow.withColumn("_digest", F.xxhash64("data"))
    sizes = (
        narrow.join(F.broadcast(usable), "_id")  # max_rows ids at most, by the filter above and a hash's evenness
        .select("_id", "_good", "_digest", F.coalesce(F.octet_length("data"), F.lit(0)).alias("_n"))
        .distinct()
    )
    chosen = sizes.orderBy(F.xxhash64("_id", "_digest", "_good"), "_id", "_digest", "_good").limit(max_rows + max_rows // 4).collect()
    if not chosen:
        return None
    length = _common([r["_n"] for r in chosen], max_bytes)
    picked = docs.sparkSession.createDataFrame(
        [(r["_id"], r["_digest"], r["_good"]) for r in chosen], StructType.fromDDL("_id bigint, _digest bigint, _good boolean")
    )
    texts = (
        narrow.join(F.broadcast(picked), ["_id", "_digest"])
        .select("_id", "_good", "_digest", F.substring("data", 1, length).alias("data"))
        .dropDuplicates(["_id", "_good", "_digest"])
        .select("_id", "_good", "data")
    )
    return arrow_map(texts, _describe, SAMPLE_SCHEMA)


def _describe(batch: pa.RecordBatch) -> list:
    bins, weights = [], []
    for text in text_bytes(batch.column(2)):
        b, w, _ = describe([text])
        bins.append(b.tobytes())
        weights.append(w.tobytes())
    return [batch.column(0), batch.column(1), bins, weights]


def _packed(model: LineModel) -> list[float]:
    head = [model.bias, *model.transition.ravel(), *model.begin, model.slope, model.offset, float(model.usable)]
    return [*head, *model.weights.tolist()]


def _unpacked(values: list[float]) -> LineModel:
    return LineModel(
        np.array(values[10:]), values[0], np.array(values[1:5]).reshape(2, 2), np.array(values[5:7]), values[7], values[8], bool(values[9])
    )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS, max_lines: int = MAX_LINES,
) -> LineModel:
    """Learn from the bounded sample inside one task; the driver sees its ids and lengths, and the weights."""
    bounded_batches(docs.sparkSession)
    sample = labelled_lines(docs, labels, id_col, text_col, max_rows)
    if sample is None:
        return UNUSABLE

    def fit(batches):
        rows = [r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
        bins = [np.frombuffer(r[2], np.uint8).reshape(-1, len(PROPERTIES)) for r in rows]
        most = _common([len(b) for b in bins], max_lines)
        weights = [np.frombuffer(r[3])[:most] for r in rows]
        model = learn([b[:most] for b in bins], weights, [r[1] for r in rows]) if rows else UNUSABLE
        yield pa.RecordBatch.from_arrays([pa.array([_packed(model)], pa.list_(pa.float64()))], ["model"])

    found = sample.repartition(1).mapInArrow(fit, "model array<double>").collect()
    return _unpacked(found[0]["model"]) if found else UNUSABLE


SCORE_SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"
LINE_SCHEMA = "doc_id bigint, line int, good double, weight double"


def _score(batch: pa.RecordBatch, model: LineModel) -> list:
    ids = batch.column(0).to_pylist()
    scores = model.score(list(text_bytes(batch.column(1))))
    held = [None if i is None else zlib.crc32(str(i).encode()) % HELD_OUT_OF == 0 for i in ids]
    return [batch.column(0), held, scores, [int(s >= PREDICT_AT) for s in scores]]


def _lines(batch: pa.RecordBatch, model: LineModel) -> list:
    out: list[list] = [[] for _ in range(4)]
    for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
        bins, weight, per_text = describe([text])
        n = len(bins)
        good = model.tag(bins, per_text).tolist() if model.usable else [0.5] * n
        for column, values in zip(out, ([doc_id] * n, range(n), good, weight.tolist()), strict=True):
            column.extend(values)
    return out


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality and prediction of every document; ``held_out`` is null where the id is null."""
    model = train(docs, labels, id_col, text_col)
    return arrow_map(_narrow(docs, id_col, text_col), _score, SCORE_SCHEMA, (model,))


def line_tags(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The probability of good and the weight of every line of every document."""
    return arrow_map(_narrow(docs, id_col, text_col), _lines, LINE_SCHEMA, (model,))
