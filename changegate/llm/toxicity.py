r"""Toxicity by a linear-chain conditional random field over words.

Every word of a text is one position with a hidden tag, clean or toxic.  Positions score by the word itself and by its
beginnings (three to seven characters); neighbours score by a transition table.  Forward-backward gives each word's
probability of being toxic; a document's score is a logistic function of its strongest words, and the words above one half
are the offending spans.

*Learning.*  Labels exist for documents, so tokens are labelled first: a word of a toxic document is toxic if one of its
forms is found in toxic documents far more often than in clean ones, counted once for each pair of neighbouring words so that
copies of a text do not count again.  All words of clean documents are clean.  The weights maximise the penalised likelihood
of those tags.  Learning uses a *bounded* sample of labelled rows, at most about ``max_rows`` documents and ``max_bytes`` of
text, chosen by a hash; scoring reads every text whole.  No sampled row is left out for its length: if the texts together are
longer than ``max_bytes``, the longest are shortened to one common length at which they fit.

*Speed.*  The texts of a batch are laid end to end and treated as one chain: where a text starts, the transition does not
depend on the tag before it.  The chain is cut into columns of equal length that advance together; products of two-by-two
matrices carry the messages from one column to the next.  That is exact and needs no padding.

Defined results: a null or empty text has no words and gets the score of a text without toxic words.  Without a label of
each kind every score is 0 and no span is found.  Duplicate or conflicting labels each count as one example; null labels and
null ids in ``labels`` are ignored.  Repeated rows are scored alike; null ids are scored and never learned from.  Extra
columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from changegate.llm.common import arrow_map, bounded_batches, give_back, text_bytes

HELD_OUT_OF = 5  # rows whose crc32 of the id is divisible by this are never learned from
MAX_ROWS, MAX_BYTES = 3_000, 12 << 20  # the bound of the learning sample
PREFIXES = (3, 4, 5, 6, 7)
MIN_CONTEXTS, MIN_LIFT = 5, 12.0  # what makes a form toxic: distinct neighbourhoods, and how much more often in toxic texts
ROUNDS, RATE, PENALTY = 60, 0.5, 1e-3
MAX_KNOWN_WORDS = 200_000
SLICE_CHARS = 1 << 21  # texts whose words are held at a time while scoring; a longer text is a slice of its own
LIKELY = 0.3  # tags from here on count towards a document's score

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def forms(word: str) -> list[str]:
    """The word and its beginnings; a beginning is marked, so that it is not mistaken for a word."""
    return [word, *(word[:n] + "-" for n in PREFIXES if n <= len(word))]


# ---------------------------------------------------------------------------------------------------------------- chain


def _columns(values: np.ndarray, height: int, fill: float) -> np.ndarray:
    """The chain in columns of ``height`` positions, the last one filled up."""
    padded = np.full(-(-len(values) // height) * height, fill)
    padded[: len(values)] = values
    return padded.reshape(-1, height).T


def _messages(unary: np.ndarray, starts: np.ndarray, transition: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Forward messages into each position: log odds of toxic before the position's own score, given all positions before.

    ``unary`` is the log odds that a position adds; ``transition[a, b]`` the potential of tag ``b`` after ``a``; ``begin`` that
    of the first tag of a text.  One row of steps moves all columns; between columns a two-by-two product carries over.
    """
    n = len(unary)
    height = max(1, math.isqrt(n))
    weight = np.exp(np.clip(_columns(unary, height, 0.0), -40, 40))
    first = _columns(starts.astype(float), height, 0.0) > 0
    width = weight.shape[1]

    def advance(clean, toxic, row):
        """The message into the next position from the message into this one."""
        toxic = toxic * weight[row]
        into_clean = clean * transition[0, 0] + toxic * transition[1, 0]
        into_toxic = clean * transition[0, 1] + toxic * transition[1, 1]
        return into_clean, into_toxic

    def enter(clean, toxic, row):
        """A text that starts here forgets what came before, but for its mass."""
        mass, new = clean + toxic, first[row]
        return np.where(new, mass * begin[0], clean), np.where(new, mass * begin[1], toxic)

    # What each column makes of the two unit messages.
    basis = [(np.ones(width), np.zeros(width)), (np.zeros(width), np.ones(width))]
    for row in range(height):
        basis = [advance(*enter(*message, row), row) for message in basis]
        scale = basis[0][0] + basis[0][1] + basis[1][0] + basis[1][1]
        basis = [(c / scale, t / scale) for c, t in basis]
    into = np.empty((2, width))
    clean, toxic = begin
    for column in range(width):
        into[:, column] = clean, toxic
        clean, toxic = (clean * basis[0][k][column] + toxic * basis[1][k][column] for k in (0, 1))
        total = clean + toxic
        clean, toxic = clean / total, toxic / total
    out = np.empty((height, width))
    clean, toxic = into
    for row in range(height):
        clean, toxic = enter(clean, toxic, row)
        out[row] = np.log(toxic) - np.log(clean)
        clean, toxic = advance(clean, toxic, row)
        total = clean + toxic
        clean, toxic = clean / total, toxic / total
    return out.T.reshape(-1)[:n]


def marginals(unary: np.ndarray, starts: np.ndarray, transition: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of toxic at every position, and the forward messages."""
    if not len(unary):
        return np.zeros(0), np.zeros(0)
    forward = _messages(unary, starts, transition, begin)
    # Backwards the same recursion runs over the reversed chain; the first position of a text is its last, and its message is
    # uniform.  A start's own ``begin`` is part of the forward message already.
    ends = np.append(starts[1:], True)[::-1]
    backward = _messages(unary[::-1], ends, transition.T, np.array([0.5, 0.5]))[::-1]
    return unary + forward + backward, forward


# ---------------------------------------------------------------------------------------------------------------- model


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of forms, transition potentials, and the two numbers of the logistic score; ``usable`` is False without labels."""

    weights: dict[str, float]
    bias: float
    transition: list[list[float]]
    begin: list[float]
    slope: list[float]
    offset: float
    usable: bool = True
    _known: dict[str, float] = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def word_score(self, word: str) -> float:
        score = self._known.get(word)
        if score is None:
            score = self.bias + sum(self.weights.get(f, 0.0) for f in forms(word))
            if len(self._known) >= MAX_KNOWN_WORDS:
                self._known.clear()
            self._known[word] = score
        return score

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The probability of toxic of every word of every text."""
        lengths = [len(t) for t in texts]
        known, slow = self._known.get, self.word_score
        unary = np.array([slow(w) if (s := known(w)) is None else s for t in texts for w in t], dtype=float)
        starts = np.zeros(len(unary), dtype=bool)
        begins = np.cumsum([0, *lengths])
        starts[begins[:-1][np.array(lengths, dtype=int) > 0]] = True
        odds, _ = marginals(unary, starts, np.array(self.transition), np.array(self.begin))
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        return [p[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]

    def score(self, tags: list[np.ndarray]) -> list[float]:
        if not self.usable:
            return [0.0] * len(tags)
        x = np.array([evidence(p) for p in tags]).reshape(-1, 2)
        return (1 / (1 + np.exp(-(x @ np.array(self.slope) + self.offset)))).tolist()


UNUSABLE = ToxicityModel({}, 0.0, [[1.0, 1.0], [1.0, 1.0]], [0.5, 0.5], [0.0, 0.0], 0.0, usable=False)


def evidence(p: np.ndarray) -> tuple[float, float]:
    """What a document's tags say: the strongest one, and how many likely ones there are on a log scale.

    Unlikely ones are left out, or the mere length of a text would count.
    """
    return (float(p.max()), math.log1p(float(p[p >= LIKELY].sum()))) if len(p) else (0.0, 0.0)


def toxic_forms(texts: list[list[str]], toxic: list[bool]) -> set[str]:
    """Forms that are met in toxic documents far more often than in clean ones, each neighbourhood counted once."""
    size, by_form = Counter(), {True: Counter(), False: Counter()}
    for kind in (True, False):  # toxic first: what they do not hold need not be counted in the clean ones
        marks, flat = array("q"), []
        for words, is_toxic in zip(texts, toxic, strict=True):
            if is_toxic == kind:
                marks.extend(map(hash, zip(["", *words[:-1]], words, [*words[1:], ""], strict=True)))
                flat.extend(words)
        _, firsts = np.unique(np.frombuffer(marks, dtype=np.int64), return_index=True)
        count = Counter(flat[i] for i in firsts.tolist())
        size[kind] = len(firsts) + 1.0
        for word, n in count.items():
            for f in forms(word):
                if kind or f in by_form[True]:
                    by_form[kind][f] += n
    return {
        f
        for f, n in by_form[True].items()
        if n >= MIN_CONTEXTS and (n / size[True]) >= MIN_LIFT * ((by_form[False][f] + 0.5) / size[False])
    }


def learn(texts: list[str], toxic: list[bool]) -> ToxicityModel:
    """A model from labelled documents; every step is deterministic."""
    if len(set(toxic)) < 2:
        return UNUSABLE
    one: dict[str, str] = {}  # one string per word, however often it occurs
    split = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]
    known = toxic_forms(split, toxic)
    # Only forms that tag a word, or that such a word shares with others, can have a weight.
    columns: dict[str, int] = {}
    for words, is_toxic in zip(split, toxic, strict=True):
        if is_toxic:
            for word in words:
                mine = forms(word)
                if not known.isdisjoint(mine):
                    for f in mine:
                        columns.setdefault(f, len(columns))
    by_word: dict[str, np.ndarray] = {}
    for word in {w for words in split for w in words}:
        found = [columns[f] for f in forms(word) if f in columns]
        if found:
            by_word[word] = np.array(found)
    lengths = [len(w) for w in split]
    begins = np.cumsum([0, *lengths])
    n = int(begins[-1])
    starts, tags = np.zeros(n, dtype=bool), np.zeros(n)
    starts[begins[:-1][np.array(lengths, dtype=int) > 0]] = True
    at, of = [], []
    for words, is_toxic, first in zip(split, toxic, begins, strict=False):
        for i, word in enumerate(words, first):
            found = by_word.get(word)
            if found is not None:
                at.append(np.full(len(found), i))
                of.append(found)
                if is_toxic and not known.isdisjoint(forms(word)):
                    tags[i] = 1.0
    at = np.concatenate(at) if at else np.zeros(0, dtype=int)
    of = np.concatenate(of) if of else np.zeros(0, dtype=int)
    model = _fit(at, of, len(columns), tags, starts)
    weights = {f: float(model[0][i]) for f, i in columns.items() if model[0][i]}
    fitted = ToxicityModel(weights, float(model[1]), model[2].tolist(), model[3].tolist(), [0.0, 0.0], 0.0)
    slope, offset = _logistic(np.array([evidence(p) for p in fitted.tag(split)]).reshape(-1, 2), np.array(toxic, dtype=float))
    return ToxicityModel(fitted.weights, fitted.bias, fitted.transition, fitted.begin, slope.tolist(), float(offset))


def _fit(at: np.ndarray, of: np.ndarray, size: int, tags: np.ndarray, starts: np.ndarray):
    """Gradient ascent with per-weight step sizes on the penalised likelihood of the tags."""
    n = len(tags)
    follows = ~starts
    before = np.roll(tags, 1)
    # Observed counts of the features.
    seen = np.bincount(of, weights=tags[at], minlength=size)
    pairs_seen = np.array([[(follows * (before == a) * (tags == b)).sum() for b in (0, 1)] for a in (0, 1)])
    first_seen = np.array([(starts * (tags == b)).sum() for b in (0, 1)])
    theta = np.concatenate([np.zeros(size), [-4.0], np.zeros(4), np.zeros(2)])
    square = np.full(len(theta), 1e-8)
    for _ in range(ROUNDS if n else 0):
        w, b, step, begin = theta[:size], theta[size], np.exp(theta[size + 1 : size + 5]).reshape(2, 2), np.exp(theta[size + 5 :])
        begin = begin / begin.sum()
        unary = np.bincount(at, weights=w[of], minlength=n) + b
        odds, forward = marginals(unary, starts, step, begin)
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        # Both of two neighbours toxic, from the forward odds and own score of the first, the transition, and the rest of the
        # second; the other three counts follow from the marginals.
        before_odds = np.clip(np.roll(forward + unary, 1)[follows], -40, 40)
        rest = np.clip((odds - forward)[follows], -40, 40)
        both = 1 / (
            1 + step[0, 0] / step[1, 1] * np.exp(-before_odds - rest)
            + step[0, 1] / step[1, 1] * np.exp(-before_odds) + step[1, 0] / step[1, 1] * np.exp(-rest)
        )
        n11, into, out_of = both.sum(), p[follows].sum(), np.roll(p, 1)[follows].sum()
        expected = np.array([[len(both) - into - out_of + n11, into - n11], [out_of - n11, n11]])
        first_expected = np.array([((1 - p) * starts).sum(), (p * starts).sum()])
        gradient = np.concatenate([
            seen - np.bincount(of, weights=p[at], minlength=size), [tags.sum() - p.sum()],
            (pairs_seen - expected).ravel(), first_seen - first_expected,
        ]) - PENALTY * n * np.concatenate([theta[:size] / max(size, 1), np.zeros(7)])
        square += gradient**2
        theta = theta + RATE * gradient / np.sqrt(square)
    begin = np.exp(theta[size + 5 :])
    return theta[:size], theta[size], np.exp(theta[size + 1 : size + 5]).reshape(2, 2), begin / begin.sum()


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(3)
    penalty = np.diag([0.1, 0.1, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(3), a.T @ (y - p) - penalty @ theta)
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return theta[:2], theta[2]


# ---------------------------------------------------------------------------------------------------------------- Spark


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(HELD_OUT_OF))


def common_length(lengths: list[int], copies: list[int], most: int) -> int:
    """The length to which texts are shortened so that all copies together are no longer than ``most``; the longest, if they fit."""
    rest, left = most, sum(copies)
    for n, k in sorted(zip(lengths, copies, strict=True)):
        if n * left > rest:
            return max(1, rest // left)
        rest, left = rest - n * k, left - k
    return max(lengths, default=0)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> DataFrame | None:
    """_id, UTF-8 data, _toxic and copies of a bounded sample of labelled rows outside the held-out fold; None if there are none.

    Ids are chosen by a hash.  Rows that repeat an id can be any number, so of ids, lengths and digests of the texts a bounded
    number is chosen first, and only the texts of those, shortened where they exceed ``max_bytes`` together, are read on.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter(
        "_id is not null and _toxic is not null"
    )
    usable = usable.filter(_remainder("_id") != 0).groupBy("_id", F.col("_toxic").cast("boolean").alias("_toxic")).agg(F.count("*").alias("_k"))
    total = usable.count()
    if total > max_rows:
        share = int(max_rows / total * (1 << 32))
        usable = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 32)) < share)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("data"))
    # The sample's ids are bounded by max_rows, so every task can hold them.
    sizes = narrow.join(F.broadcast(usable), "_id").select(
        "_id", "_toxic", "_k", F.xxhash64("data").alias("_digest"), F.coalesce(F.octet_length("data"), F.lit(0)).alias("_n")
    )
    sizes = sizes.groupBy("_id", "_toxic", "_digest", "_n").agg(F.sum("_k").alias("_k"))
    # Ids alone seldom give a quarter more than max_rows.  By a hash of the whole row, an id of many texts has its share only.
    most = max_rows + max_rows // 4
    chosen = sizes.orderBy(F.xxhash64("_id", "_digest", "_toxic"), "_id", "_digest", "_toxic").limit(most).collect()
    if not chosen:
        return None
    repeats = max(1.0, sum(r["_k"] for r in chosen) / most)
    copies = [max(1, int(r["_k"] / repeats)) for r in chosen]
    length = common_length([r["_n"] for r in chosen], copies, max_bytes)
    rows = [(r["_id"], r["_digest"], r["_toxic"], k) for r, k in zip(chosen, copies, strict=True)]
    spark = docs.sparkSession
    picked = spark.createDataFrame(rows, StructType.fromDDL("_id bigint, _digest bigint, _toxic boolean, copies bigint"))
    return (
        narrow.withColumn("_digest", F.xxhash64("data"))
        .join(F.broadcast(picked), ["_id", "_digest"])
        .select("_id", "_digest", "_toxic", "copies", F.substring("data", 1, length).alias("data"))
        .dropDuplicates(["_id", "_digest", "_toxic"])
        .select("_id", "data", "_toxic", "copies")
    )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
) -> ToxicityModel:
    """Learn from the bounded sample inside one task; the driver sees its ids and lengths, and the weights."""
    spark = bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, id_col, text_col, max_rows, max_bytes)
    if sample is None:
        return UNUSABLE

    def fit(batches):
        rows = []
        for batch in batches:
            for i, data, toxic, copies in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows += [(i, (data or b"").decode("utf-8", "replace"), toxic)] * copies
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
        model = learn([t for _, t, _ in rows], [x for _, _, x in rows]) if rows else UNUSABLE
        head = [model.bias, *model.transition[0], *model.transition[1], *model.begin, *model.slope, model.offset, float(model.usable)]
        names, values = [None] * len(head), head
        names, values = names + list(model.weights), values + list(model.weights.values())
        rows = None
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["form", "value"])

    found = sample.repartition(1).mapInArrow(fit, "form string, value double").collect()
    if not found:
        return UNUSABLE
    head, weights = [r["value"] for r in found if r["form"] is None], {r["form"]: r["value"] for r in found if r["form"] is not None}
    return ToxicityModel(weights, head[0], [head[1:3], head[3:5]], head[5:7], head[7:9], head[9], usable=bool(head[10]))


SCORE_SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"
SPAN_SCHEMA = "doc_id bigint, start int, end int, span string, probability double"
_MEMORY: dict[int, ToxicityModel] = {}


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``SLICE_CHARS`` characters."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _scores(texts: list[str], model: ToxicityModel) -> list[float]:
    return [s for some in _slices(texts) for s in model.score(model.tag([words_of(t) for t in some]))]


def _score(batch: pa.RecordBatch, model: ToxicityModel) -> list:
    texts = [data.decode("utf-8", "replace") for data in text_bytes(batch.column(1))]
    ids = batch.column(0).to_pylist()
    scores = _scores(texts, model)
    held = [None if i is None else zlib.crc32(str(i).encode()) % HELD_OUT_OF == 0 for i in ids]
    return [batch.column(0), held, scores, [int(s >= 0.5) for s in scores]]


def _spans(batch: pa.RecordBatch, model: ToxicityModel) -> list:
    out = defaultdict(list)
    ids = batch.column(0).to_pylist()
    texts = [data.decode("utf-8", "replace") for data in text_bytes(batch.column(1))]
    for i, text, tags in zip(ids, texts, model.tag([words_of(t) for t in texts]), strict=True):
        if not model.usable or not len(tags) or tags.max() < 0.5 or len(text.lower()) != len(text):
            continue  # offsets hold where lower-casing keeps the length; see below for the others
        _collect(out, i, text, text.lower(), tags)
    for i, text in zip(ids, texts, strict=True):
        if model.usable and len(text.lower()) != len(text):
            # Lower-casing made some letters longer: tag the words of the text as it is, lower-cased one by one.
            words = [m[0].lower() for m in _WORD.finditer(text)]
            tags = model.tag([words])[0]
            if len(tags) and tags.max() >= 0.5:
                _collect(out, i, text, text, tags)
    return [pa.array(out[k], t) for k, t in (("id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("span", pa.string()), ("p", pa.float64()))]


def _collect(out, i, text, searched, tags) -> None:
    """Offending spans: neighbouring words that are tagged toxic form one span."""
    last = -2
    for k, m in enumerate(_WORD.finditer(searched)):
        if tags[k] >= 0.5:
            if k == last + 1:
                out["end"][-1], out["p"][-1] = m.end(), max(out["p"][-1], float(tags[k]))
                out["span"][-1] = text[out["start"][-1] : m.end()]
            else:
                for name, value in (("id", i), ("start", m.start()), ("end", m.end()), ("span", text[m.start() : m.end()]), ("p", float(tags[k]))):
                    out[name].append(value)
            last = k


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score and prediction of every document; ``held_out`` is null where the id is null."""
    model = train(docs, labels, id_col, text_col)
    return arrow_map(_narrow(docs, id_col, text_col), _score, SCORE_SCHEMA, (model,))


def toxic_spans(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Character offsets of the offending words of every document."""
    return arrow_map(_narrow(docs, id_col, text_col), _spans, SPAN_SCHEMA, (model,))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""
    model = train(docs, labels, id_col, text_col)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        kept = pd.Series([s < 0.5 for s in _scores([t or "" for t in texts], model)], dtype=bool)
        give_back()
        return kept

    return docs.filter(clean(F.expr(f"cast(`{text_col}` as string)")))
