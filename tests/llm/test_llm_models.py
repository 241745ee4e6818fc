"""Line quality, whitening and periodic runs against brute force, other solvers and held-out labels."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from cases import TEXTS, as_set, documents

from changegate.llm import line_quality, periodic_runs, queries, whitening

SF_DIR = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------------------------------- line quality


def test_line_marginals_equal_the_sum_over_all_taggings():
    rng = np.random.default_rng(3)
    per_text = np.array([1, 4, 2, 5])
    unary, transition, begin = rng.normal(size=12), rng.uniform(0.2, 2, (2, 2)), np.array([0.3, 0.7])
    odds, _, starts = line_quality.marginals(unary, per_text, transition, begin)
    at = 0
    for n in per_text:
        mass = np.zeros((n, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            weight = begin[tags[0]] * np.exp(sum(u for u, t in zip(unary[at : at + n], tags, strict=True) if t))
            weight *= np.prod([transition[a, b] for a, b in zip(tags, tags[1:], strict=False)])
            for i, t in enumerate(tags):
                mass[i, t] += weight
        assert np.allclose(np.log(mass[:, 1] / mass[:, 0]), odds[at : at + n])
        assert starts[at]
        at += n


def test_gradient_equals_differences_of_the_likelihood():
    rng = np.random.default_rng(0)
    per_text = np.array([3, 1, 4])
    bins = rng.integers(0, 3, (8, len(line_quality.PROPERTIES))).astype(np.uint8)
    tags = np.array([1, 0, 0, 1, 0, 1, 1, 0.0])
    columns = line_quality.neighbours(bins, line_quality._starts(per_text))
    theta = rng.normal(size=3 * line_quality.SIZE + 7) / 3

    def likelihood(theta):
        model = line_quality._model(theta)
        unary = model.bias + model.weights[columns].sum(axis=1)
        total, at = 0.0, 0
        for n in per_text:
            weights = {}
            for t in itertools.product((0, 1), repeat=int(n)):
                w = model.begin[t[0]] * np.exp((unary[at : at + n] * t).sum())
                weights[t] = w * np.prod([model.transition[a, b] for a, b in zip(t, t[1:], strict=False)])
            total += np.log(weights[tuple(tags[at : at + n].astype(int))] / sum(weights.values()))
            at += n
        return total

    got = line_quality.gradient(columns, per_text, tags, theta)
    for k in [*np.unique(columns)[::7], *range(len(theta) - 7, len(theta))]:
        step = np.zeros(len(theta))
        step[k] = 1e-5
        assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-5 - got[k]) < 1e-6


def plain_description(text):
    """Some properties of a text's lines, counted one by one."""
    out, seen = [], set()
    all_words = [line.split() for line in text.split(b"\n")]
    windows = [w for words in [sum(all_words, [])] for w in zip(words, words[1:], words[2:], strict=False)]
    for number, (line, words) in enumerate(zip(text.split(b"\n"), all_words, strict=True)):
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
        earlier = (len(words) - len(set(words))) / max(1, len(words))
        again = bool(words) and tuple(words) in seen
        just = bool(words) and number > 0 and words == all_words[number - 1]
        seen.add(tuple(words))
        at = sum(map(len, all_words[:number]))
        met = sum(windows.count(w) > 1 for w in windows[at : at + len(words)]) / max(1, len(words))
        out.append((len(line.decode()), len(words), sum(map(len, words)) / max(1, len(words)), repeats, earlier, met, again, just))
    return out


def test_properties_equal_a_plain_count():
    random.seed(5)
    texts = [b"", b"\n", b"   ", "é b é b é b\né b é b é b\n# x".encode()]
    for _ in range(60):
        lines = [" ".join(random.choices(["a", "bb", "é", "word", "#", "12", "Z."], k=random.randint(0, 9))) for _ in range(random.randint(1, 8))]
        texts.append("\n".join(random.choices(lines, k=len(lines) + 2)).encode())
    bins, weight, per_text = line_quality.describe(texts)
    want = [row for t in texts for row in plain_description(t)]
    assert len(want) == len(bins) == per_text.sum()
    names = [n for n, _ in line_quality.PROPERTIES]
    tested = ("characters", "words", "word length", "repeats of the word before", "words met earlier in the line", "windows met elsewhere",
              "same line earlier", "same line just before")
    for k, name in enumerate(tested):
        column = names.index(name)
        edges = line_quality.PROPERTIES[column][1]
        assert [int(np.searchsorted(edges, float(r[k]), side="right")) for r in want] == bins[:, column].tolist(), name
    assert weight.tolist() == [len(line) + 1 for t in texts for line in t.split(b"\n")]
    # Slices of hashing, and texts described alone, make no difference.
    alone = [line_quality.describe([t])[0] for t in texts]
    assert np.array_equal(np.vstack(alone), bins)
    old, line_quality.HASH_BYTES = line_quality.HASH_BYTES, 7
    try:
        assert np.array_equal(line_quality.describe(texts)[0], bins)
    finally:
        line_quality.HASH_BYTES = old


def test_quality_on_held_out_labels(spark):
    base = SF_DIR.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["doc_id"]: r for r in line_quality.score_documents(docs, labels).collect()}
    assert len(scores) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in scores.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in scores.values())
    held = [(scores[r["doc_id"]], r["quality"]) for r in labels.collect() if scores[r["doc_id"]]["held_out"]]
    good, bad = ([s["score"] for s, q in held if q == k] for k in (1, 0))
    assert np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good]) > 0.95
    assert np.mean([s["predicted"] == q for s, q in held]) > 0.95


def test_quality_of_awkward_rows(spark):
    texts = [(i, ("a good line of words here.\n" * 3) if i % 2 else "### $$$ | | x x x x\n" * 4) for i in range(100, 140)]
    docs = documents(spark, TEXTS + texts)
    rows = [(i, i % 2, 0) for i, _ in texts] + [(0, 1, 0), (0, 1, 0), (0, 0, 1), (None, 1, 0), (4, None, 0), (4, 1, 0), (5, 1, None)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    out = line_quality.score_documents(docs, labels)
    got = as_set(out)
    assert len(got) == len(TEXTS) + len(texts)
    assert [r[1] for r in got if r[0] is None] == [None]
    by_id = {r[0]: r[2] for r in got}
    assert by_id[101] > 0.5 > by_id[100] and by_id[1] == by_id[2]
    assert len({r[2] for r in got if r[0] == 5}) == 1
    for none in (labels.filter("false"), labels.filter("quality = 1")):
        assert {r[2] for r in as_set(line_quality.score_documents(docs, none))} == {0.5}
    assert line_quality.score_documents(documents(spark, []), labels).count() == 0
    model = line_quality.train(docs, labels)
    tags = line_quality.line_tags(docs, model)
    assert tags.count() == sum((t or "").count("\n") + 1 for _, t in TEXTS + texts)


def test_learning_sample_is_bounded(spark):
    docs = documents(spark, [(7, f"text {i} " + "w " * i) for i in range(300)] + [(i, "same") for i in range(200, 260)])
    labels = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(200, 260)], "doc_id bigint, quality int")
    sample = line_quality.labelled_lines(docs, labels, "doc_id", "text", max_rows=40, max_bytes=400).collect()
    assert 0 < len(sample) <= 50
    assert line_quality._common([5, 1, 9], 12) == 6 and line_quality._common([5, 1, 9], 11) == 5 and line_quality._common([5, 1, 9], 15) == 9 and line_quality._common([], 3) == 0


# ---------------------------------------------------------------------------------------------------------- whitening


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24])
def test_eigenvectors_by_divide_and_conquer(n):
    rng = np.random.default_rng(n)
    b = rng.normal(size=(n, n))
    q = np.linalg.qr(b)[0]
    repeated = np.repeat(rng.normal(size=n), 3)[:n]
    low_rank = q[:, : n // 2] @ q[:, : n // 2].T
    for a in (b @ b.T, b + b.T, q @ np.diag(repeated) @ q.T, np.diag(repeated), np.eye(n), np.ones((n, n)), np.zeros((n, n)), low_rank,
              q @ np.diag(10.0 ** -np.arange(n)) @ q.T, q @ np.diag(1 + 1e-9 * rng.normal(size=n)) @ q.T):
        a = (a + a.T) / 2
        values, vectors = whitening.eigen(a)
        size = np.abs(a).max() + 1e-300
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() / size < 1e-13 * max(n, 10)
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
        assert np.abs(a @ vectors - vectors * values).max() / size < 1e-13 * max(n, 10)


def test_polar_factor():
    a = np.random.default_rng(2).normal(size=(12, 12))
    a = a + a.T
    u = whitening.polar(a)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(u - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-12


def test_whitening_of_the_table(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF_DIR}/embeddings.parquet'").fetchall()
    x = {i: np.floor(1024 * np.array(v, dtype=float)).astype(int) + 100_000 for i, v in rows}
    n, total = len(x), sum(x.values())
    centred = np.array([v - total / n for v in x.values()])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {i: row for i, row in zip(x, centred @ vectors[:, :8] / np.sqrt(values[:8]), strict=True)}
    got = queries.op12_whitening(spark, SF_DIR).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 9))
    sign = {}
    for r in got:
        k = r["component"] - 1
        w = want[r["vec_id"]][k]
        if abs(w) > 0.1:
            assert sign.setdefault(k, np.sign(w * r["whitened"])) == np.sign(w * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(w)) < 1e-9
        assert abs(r["explained"] / (values[k] / np.trace(covariance)) - 1) < 1e-12
        assert r["deviation"] == sum(int(n * int(a) - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], total, strict=True))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, n string")


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(7, [1.0, 2.0, 3.0, 4.0]), (None, [0.5] * 4), (61, [1.0]), (62, [])]
    bad = [(70, None), (71, [1.0, None, 0.0, 0.0]), (72, [nan, 0.0, 0.0, 0.0]), (73, [inf, 0.0, 0.0, 0.0])]
    out = as_set(whitening.whiten(vectors_table(spark, good + bad)))
    assert len(out) == 4 * len(good) and not {70, 71, 72, 73} & {r[0] for r in out}
    assert sum(r[0] is None for r in out) == 4 and sum(r[0] == 7 for r in out) == 8
    assert all(r[6] < 1e-10 and r[4] is not None for r in out)
    # One vector, and copies of one, have no variance.
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        assert {r[1:] for r in as_set(whitening.whiten(vectors_table(spark, rows)))} == {
            (k, len(rows), 0, None, None, None) for k in (1, 2)
        }
    # Two vectors vary in one direction only.
    two = as_set(whitening.whiten(vectors_table(spark, [(1, [1.0, 2.0]), (2, [3.0, 5.0])])))
    assert [round(abs(r[4]), 9) if r[4] is not None else None for r in two] == [1.0, None, 1.0, None]
    assert whitening.whiten(vectors_table(spark, [])).count() == 0
    assert whitening.whiten(vectors_table(spark, [(1, [])])).count() == 0
    # Values beyond a long stop at its end; their deviations do not fit one.
    huge = as_set(whitening.whiten(vectors_table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])])))
    assert len(huge) == 6 and {r[3] for r in huge if r[0] in (1, 2)} == {None}


def test_moments_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE", 2)
    rows = spark.range(0, 1000, 1, 9).selectExpr("array(double(id), double(id % 7)) as vector")
    x = np.array([[i, i % 7] for i in range(1000)], dtype=float)
    blank = whitening.Whitening(1, [0, 0], np.zeros((2, 0)), [])
    got = whitening.second_moments(rows, 2, lambda b: (blank.centre(b.column(0)) - whitening.OFFSET) / whitening.SCALE)
    assert np.allclose(got, x.T @ x)
    n, sums = whitening.count_and_sums(rows, 2)
    assert n == 1000 and sums == [int(v) for v in (x * 1024 + 100_000).sum(axis=0)]


# ------------------------------------------------------------------------------------------------------- periodic runs


def runs_by_hand(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                smaller = any(all(words[k] == words[k + r] for k in range(i, i + length - r)) for r in range(1, q))
                if not smaller:
                    out.append((i, length, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest_by_hand(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1] or [(None, None, None)]
    s, n, q = best[0]
    runs_text = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return doc_id, len(runs), s, n, q, None if s is None else 1000 * n // q, sha(runs_text), sha(kept)


@pytest.mark.parametrize("split", [True, False])
def test_runs_equal_a_brute_force_search(split, monkeypatch):
    if not split:
        monkeypatch.setattr(periodic_runs, "stretches", lambda ids: [(0, len(ids))])
    random.seed(11)
    for _ in range(3000):
        words = [bytes([97 + random.randrange(random.choice([1, 2, 3, 5]))]) for _ in range(random.randint(0, 50))]
        if random.random() < 0.6 and len(words) > 8:
            a, p = random.randrange(len(words)), random.randint(1, 8)
            words = words[:a] + (words[a : a + p] * 40)[: random.randint(1, 40)] + words[a:][:10]
        assert periodic_runs.find_runs(words) == runs_by_hand(words), words


def test_suffix_automaton_holds_all_substrings():
    random.seed(2)
    for _ in range(200):
        word_ids = [random.randrange(3) for _ in range(random.randint(1, 20))]
        link, length, states = periodic_runs.suffix_automaton(word_ids)
        # Every state stands for (its length minus its link's) substrings; together they are all different ones.
        distinct = {tuple(word_ids[i:j]) for i in range(len(word_ids)) for j in range(i + 1, len(word_ids) + 1)}
        assert sum(length[s] - length[link[s]] for s in range(2, len(link))) == len(distinct)
        assert [length[s] for s in states] == list(range(1, len(word_ids) + 1))


def test_runs_of_awkward_rows(spark):
    texts = TEXTS + [(i, " ".join(["a b c"] * 9 + ["z"] * 7 + ["a b"] * 5)) for i in (100, 101)] + [(i, "w x y z v " * 8) for i in range(200, 230)]
    docs = documents(spark, texts)
    want = sorted((digest_by_hand(i, t) for i, t in texts if t is not TEXTS[4][1]), key=repr)
    got = as_set(periodic_runs.run_digests(docs))
    assert [r for r in got if r[0] != 4] == want
    assert [(r[0], r[1]) for r in got if r[0] == 4] == [(4, 1)]
    assert (100, 0, 27, 3) in as_set(periodic_runs.periodic_runs(docs))
    collapsed = dict(as_set(periodic_runs.collapse_runs(docs)))
    assert collapsed[100] == "a b c z a b" and collapsed[1] == "" and collapsed[0] == TEXTS[0][1]
    assert periodic_runs.run_digests(documents(spark, [])).count() == 0


def test_runs_of_the_table(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF_DIR}/documents.parquet' where length(text) < 6000").fetchall()
    got = {r[0]: r for r in as_set(queries.op13_periodic_runs(spark, SF_DIR))}
    assert len(got) == duckdb.sql(f"select count(*) from '{SF_DIR}/documents.parquet'").fetchall()[0][0]
    for i, text in rows:
        assert tuple(got[i]) == digest_by_hand(i, text)
