"""Top-k search, sharding, near-duplicates, components and the pipeline against brute force."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from cases import TEXTS, as_set, documents

import __spark_entry__ as entry_point
import corpus_pipeline
from changegate.llm import components, cover_tree, near_copies, packing, quality, queries, sharding, simhash, toxicity

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(cursor.fetchall(), key=repr) == as_set(queries.QUERIES[name](spark, SF_DIR), *names)


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in entry_point.queries()


# ------------------------------------------------------------------------------------------------------------ top-k


def best_of(rows, k=5, every=50):
    """Brute force over rows (id, vector) that take part; a row is no candidate of itself."""
    out = []
    for n, (q, a) in enumerate(rows):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for m, (i, b) in enumerate(rows) if m != n)[:k]
            out += [(q, r + 1, i, -s if abs(s) < 1 << 63 else None) for r, (s, i) in enumerate(scores)]
    return sorted(out, key=repr)


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, score string")


def test_top_k_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) / 4 for j in range(4)]) for i in range(0, 120)]
    rows += [(500, None), (550, [1.0, None, 0.0, 0.0]), (600, [nan, 0.0, 0.0, 0.0]), (650, [inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (700, []),
             (701, [0.5]), (750, [0.25] * 6), (-50, [1.0, 1.0, 1.0, 1.0]), (7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0]),
             (50, [2.0, 0.0, 0.0, 0.0]), (50, [-2.0, 0.5, 0.0, 0.0])]
    large = [(800, [2e6, 0.0, 0.0, 0.0]), (801, [3e6, 1.0, 0.0, 0.0]), (850, [1e30, 1.0, 0.0, 0.0]), (851, [-1e30, 0.0, 1e20, 0.0]), (900, [3e38, -3e38, 0.0, 0.0])]
    for more in ([], large):
        table = vectors_table(spark, rows + more)
        # As stored: single precision.
        stored = [(r["vec_id"], r["embedding"]) for r in table.collect()]
        part = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in stored if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
        want = best_of(part)
        assert as_set(cover_tree.top_k(table, block=16)) == want
        assert as_set(cover_tree.top_k(table)) == want
    assert cover_tree.top_k(vectors_table(spark, [])).count() == 0
    assert as_set(cover_tree.top_k(vectors_table(spark, [(0, [1.0]), (1, [2.0])]))) == [(0, 1, 1, 131072)]
    # Rows that repeat an id are candidates of their own.
    repeated = vectors_table(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0])])
    assert as_set(cover_tree.top_k(repeated)) == [(0, 1, 1, 65536), (0, 2, 1, 58880), (0, 3, 1, 32768)]


def test_dual_search_prunes_and_stays_exact():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 8)) * 500
    points = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8)) * 10)
    points[:400] = points[0]  # many equal vectors: ties go to the smaller id
    ids = rng.permutation(3000).astype(np.int64)
    asked = np.flatnonzero(ids % 50 == 0)
    tree = cover_tree.build(points)
    search = cover_tree.DualSearch(ids[asked], points[asked], np.full(len(asked), -np.inf), 5)
    search.search(ids, points, tree)
    scores = (points[asked] @ points.T).astype(int)
    for row, i in enumerate(asked):
        assert search.best[row] == sorted((-scores[row, j], ids[j], ids[j]) for j in range(3000) if j != i)[:5]
    assert search.compared < len(asked) * 3000


def test_cover_tree_invariants():
    points = np.floor(np.random.default_rng(4).normal(size=(2000, 3)) * 100)
    seen, todo = [], [cover_tree.build(points)]
    while todo:
        node = todo.pop()
        for child in node.children:
            todo.append(child)
        below, stack = [], [node]
        while stack:
            n = stack.pop()
            stack += n.children
            below += n.points.tolist()
        assert (np.linalg.norm(points[below] - node.centre, axis=1) <= node.radius + 1e-6).all()
        seen += node.points.tolist()
    assert sorted(seen) == list(range(2000))


# ------------------------------------------------------------------------------------------------------------ sharding


def check_shards(rows, n):
    assert len(rows) == n
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_of_awkward_rows(spark):
    rows = sharding.shard_documents(documents(spark)).collect()
    check_shards(rows, len(TEXTS))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == sorted(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS if i is not None
    )
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1  # copies stay together
    assert sharding.shard_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("limits", [(4000, 20_000), (600, 1500)])
def test_shards_are_level_and_keep_copies_together(spark, limits):
    pick = random.Random(1)
    texts = [(i, "x" * pick.randint(1, 3000) + str(i)) for i in range(2500)] + [(3000 + i, f"copy {i % 20} " * 30) for i in range(200)]
    texts += [(5000 + i, "a third of all rows") for i in range(1350)]
    rows = sharding.shard_documents(documents(spark, texts), block_items=limits[0], top_items=limits[1]).collect()
    check_shards(rows, len(texts))
    size = defaultdict(int)
    for r in rows:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 40
    assert max(size.values()) - min(size.values()) < 0.02 * mean
    groups = defaultdict(set)
    for r in rows:
        if 3000 <= r["doc_id"] < 5000:
            groups[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())


@pytest.mark.parametrize("doc_id", [None, 7])
def test_shards_are_level_for_repeated_rows(spark, doc_id):
    """Copies of one text without ids, or with one id, are cut like others."""
    pick = random.Random(2)
    texts = [(doc_id, "a third of all rows and more")] * 3000 + [(i, "y" * pick.randint(1, 40) + str(i)) for i in range(100, 3100)]
    rows = sharding.shard_documents(documents(spark, texts)).collect()
    check_shards(rows, len(texts))
    size = defaultdict(int)
    for r in rows:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 40
    assert len(size) == 40 and max(size.values()) - min(size.values()) < 0.1 * mean


def test_differencing_beats_filling_the_emptiest():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1000, 100_000, 400)
    parts = np.zeros((400, 40), dtype=np.int64)
    parts[:, 0] = sizes
    goes, total = sharding.difference(parts)
    assert (np.bincount(goes[:, 0], weights=sizes, minlength=40) == total).all()
    greedy = np.zeros(40)
    for s in sorted(sizes, reverse=True):
        greedy[greedy.argmin()] += s
    assert np.ptp(total) < np.ptp(greedy)


# ------------------------------------------------------------------------------------------------------------ near-duplicates


def brute_prints(texts):
    out = []
    for _, t in texts:
        words = [w for w in (t or "").encode().lower().split()]
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        out.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)))
    return out


def brute_components(prints, ids, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)].append(d)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def test_near_duplicates_of_awkward_rows(spark):
    prints = brute_prints(TEXTS)
    roots = brute_components(prints, [i for i, _ in TEXTS])
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(TEXTS, prints, roots, strict=True)]
    assert as_set(simhash.near_duplicates(documents(spark))) == sorted(want, key=repr)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for c in roots if c is not None})
    assert kept.count() == len(set(roots)) and simhash.keep_one(documents(spark, [])).count() == 0


def test_one_row_stays_of_every_component_whatever_its_ids(spark):
    """Components of null ids only, one id on two texts, and rows that differ in where their nulls are."""
    long = [f"{w}{i}" for i in range(400) for w in "xy"]
    near = " ".join([*long[:-1], "other"])
    texts = [(None, f"nothing like number {i * i} was ever seen by {i} others") for i in range(6)]
    texts += [(5, "a text that has nothing in common with any other"), (5, " ".join(long)), (9, near), (9, near), (None, near)]
    roots = brute_components(brute_prints(texts), range(len(texts)))
    assert len(set(roots)) == 8 and len(set(roots[7:])) == 1
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(documents(spark, texts)).collect()]
    assert sorted(kept, key=repr) == sorted(texts[:8], key=repr)
    rows = spark.createDataFrame([(None, "x", None), (None, None, "x")], "doc_id bigint, text string, lang string")
    assert simhash.keep_one(rows).count() == 2


def test_near_duplicates_of_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    prints = brute_prints(docs)
    want = sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, brute_components(prints, [i for i, _ in docs]), strict=True))
    assert sorted(as_set(queries.QUERIES["op9_simhash"](spark, SF_DIR))) == want


def test_bit_sliced_distances_equal_counted_bits():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = np.concatenate([base[i % 3 : i % 3 + 1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), False))) for i in range(500)])
    planes = simhash.bit_planes(values)
    for radius in (0, 1, 3, 4, 7):
        for i in (0, 63, 64, 499):
            near = simhash.within(planes, int(values[i]), radius)
            want = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius)
            assert near[near < 500].tolist() == want.tolist()


def test_hot_bucket_in_chunks_loses_no_link(spark):
    """One large group of near copies, searched in many small chunks."""
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 1 << 63))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, 3, False)) for _ in range(900)} | {int(x) for x in rng.integers(0, 1 << 63, 50)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "bits bigint"), chunk=64)
    found = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    roots = brute_components(prints, list(range(len(prints))))
    groups, want = defaultdict(set), defaultdict(set)
    for (s,), r in zip(signed, roots, strict=True):
        groups[found.get(s, s)].add(s)
        want[r].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_bucket_keys_are_not_broadcast(spark):
    """Spark sizes the keys of all buckets, many for each fingerprint, like one; they must not be sent to the driver for that."""
    links = simhash.near_links(spark.range(1000).selectExpr("xxhash64(id) as bits"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [which" in plan and "Broadcast" not in plan


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (5000, 5000)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ------------------------------------------------------------------------------------------------------------ pipeline


def kept_of_groups(rows, similarity=near_copies.SIMILARITY):
    """Ids that stay, and ids in links, by comparing the shingle sets of all pairs that share a shingle."""
    sets = [frozenset(near_copies.shingles((t or "").encode().lower().split()).tolist()) for _, t in rows]
    parent, holders = list(range(len(rows))), defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, mine in enumerate(sets):
        shared = defaultdict(int)
        for shingle in mine or {"none"}:
            for j in holders[shingle]:
                shared[j] += 1
            holders[shingle].append(i)
        for j, n in shared.items():
            if n / max(1, len(mine) + len(sets[j]) - n) >= similarity or not mine:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return set(least.values())


def exchanged(words, share, rng):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def test_near_copies_by_similarity(spark):
    """Copies of texts with words exchanged at random: nine in ten go in every band of similarity, unlike texts never."""
    rng = random.Random(8)
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").collect()
    texts = [t for t in ((r["text"] or "").lower().split() for r in docs) if 100 <= len(t) <= 600][:250]
    rows, similarity = [], {}
    for k, words in enumerate(texts):
        rows.append((k, " ".join(words)))
        for c in range(4):
            copy = exchanged(words, rng.random() * 0.03, rng)
            a, b = (near_copies.shingles([w.encode() for w in w_]) for w_ in (words, copy))
            rows.append((1000 + 10 * k + c, " ".join(copy)))
            similarity[1000 + 10 * k + c] = near_copies.jaccard(a, b)
    kept = {r["doc_id"] for r in near_copies.keep_distinct(documents(spark, rows)).collect()}
    want = kept_of_groups(rows)
    assert want <= kept  # nothing goes without a link that leads to a smaller id
    for low in (0.8, 0.85, 0.9, 0.95):
        band = [i for i, s in similarity.items() if low <= s < low + 0.05]
        assert len(band) > 50 and sum(i not in kept for i in band) >= 0.9 * len(band), low


def test_near_copies_of_awkward_rows(spark):
    long = [f"{w}{i}" for i in range(400) for w in "xy"]
    near, far = [*long[:-1], "other"], [w if i % 9 else "gone" for i, w in enumerate(long)]
    same_words = " ".join(reversed(long))
    texts = [(None, f"nothing like number {i * i} was ever seen by {i} others") for i in range(6)]
    texts += [(5, "a text that has nothing in common with any other"), (5, " ".join(long)), (9, " ".join(near)), (9, " ".join(near)), (None, " ".join(near))]
    texts += [(11, " ".join(far)), (12, same_words), (13, None), (14, " "), (15, "A\tb"), (16, "a B"), (17, "a c")]
    for chunk in (near_copies.CHUNK, 2):
        kept = [(r["doc_id"], r["text"]) for r in near_copies.keep_distinct(documents(spark, texts), chunk=chunk).collect()]
        assert sorted(kept, key=repr) == sorted([*texts[:8], texts[11], texts[12], texts[13], texts[15], texts[17]], key=repr)
    columns = documents(spark, texts).columns
    mapped = documents(spark, texts).selectExpr("*", "map('k', text) as facts", "array(map('a', 1)) as more")
    for keep in (near_copies.keep_distinct, simhash.keep_one):
        out = keep(mapped)
        assert out.columns == [*columns, "facts", "more"] and out.count() > 0
    assert near_copies.keep_distinct(documents(spark, [])).count() == 0


def test_near_copies_of_large_groups_lose_no_link(spark, monkeypatch):
    """Many texts within the radius of each other, of which each is similar enough to few: every such pair links, at any chunk."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    texts = [words]
    while len(texts) < 400:
        copy = list(rng.choice(texts))
        for _ in range(2):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        texts.append(copy)
    rng.shuffle(texts)
    bits = np.array([near_copies.fingerprint([w.encode() for w in t]) for t in texts], dtype=np.uint64)
    sets = [near_copies.shingles([w.encode() for w in t]) for t in texts]
    group, n_near = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= near_copies.RADIUS).tolist():
            n_near += 1
            if near_copies.jaccard(sets[i], sets[j]) >= near_copies.SIMILARITY and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert n_near > 4000 and len(set(group)) > 20
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for chunk, piece in ((near_copies.CHUNK, near_copies.PIECE_ROWS), (50, 20)):
        monkeypatch.setattr(near_copies, "PIECE_ROWS", piece)
        kept = {r["doc_id"] for r in near_copies.keep_distinct(documents(spark, rows), chunk=chunk).collect()}
        assert kept == set(group)


def test_named_pairs_and_dense_rows_hold_every_pair(spark):
    """Pairs are named once, at most ``NEIGHBOURS`` times the rows of all buckets, and dense rows have the rest."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    values = np.unique([base[i % 2] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), False))) for i in range(700)])
    items = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values.view(np.int64))], "node bigint, bits bigint")
    want = {(i, j) for j, v in enumerate(values) for i in np.flatnonzero(np.bitwise_count(values[:j] ^ v) <= 6).tolist()}
    for chunk in (near_copies.CHUNK, 30):
        found = near_copies.near_pairs(items, chunk=chunk).collect()
        named = [(r["a"], r["b"]) for r in found if r["b"] is not None]
        assert len(named) == len(set(named)) and set(named) <= want
        rest, slots = want - set(named), defaultdict(list)
        assert rest  # the group is large enough that some of it is dense
        for r in found:
            if r["b"] is None:
                slots[r["slot"]].append((r["a"], r["side"]))
        together = {(a, b) for members in slots.values() for a, s in members for b, t in members if a < b and (s != t or s == 2)}
        assert rest <= together
        nothing = spark.createDataFrame([(i, b"12345678") for i in range(len(values))], "node bigint, shingles binary")
        dense = spark.createDataFrame([(r["a"], r["bits"], r["slot"], r["side"]) for r in found if r["b"] is None], "node bigint, bits bigint, slot bigint, side int")
        links = near_copies.dense_links(dense, nothing, 6, 0.8).collect()
        assert {(r["a"], r["b"]) for r in links} <= rest


def test_named_pairs_are_no_more_than_rows_of_buckets(spark):
    """A group of near copies leaves the search as at most one row for each of its rows in a bucket, whatever its pairs."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    values = np.unique([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 4, False))) for _ in range(300)])
    items = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values.view(np.int64))], "node bigint, bits bigint")
    table, masks, held = near_copies._first_choices(6), [np.uint64(m) for m in near_copies.bands(6)], set()
    for j, v in enumerate(values):
        for i in np.flatnonzero(np.bitwise_count(values[:j] ^ v) <= 6).tolist():
            first = table[sum(1 << k for k, m in enumerate(masks) if not (values[i] ^ v) & m)]
            held |= {(i, first), (j, first)}
    assert near_copies.near_pairs(items).count() <= len(held)


def test_components_leave_what_is_one_node(spark, monkeypatch):
    """Links within a group that is one node already do not come again in later rounds."""
    links, written, keep = [(i, j) for i in range(30) for j in range(i)] + [(i, i + 1) for i in range(100, 140)], [], components.cut_lineage

    def noted(df):
        written.append(keep(df))
        return written[-1]

    monkeypatch.setattr(components, "cut_lineage", noted)
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == dict.fromkeys(range(30), 0) | dict.fromkeys(range(100, 141), 100)
    left = [df.count() for df in written if df.columns == ["a", "b"]]
    assert left[0] == len(links) and left[-1] == 0


def test_nearest_neighbours_equal_plain_distances():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    values = np.array([base[i % 4] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), False))) for i in range(300)])
    slots = np.sort(rng.choice([1, 2, 2, 2, 2, 2, 3, 3, *range(4, 20)], len(values)))
    got = {tuple(p) for p in near_copies.nearest(slots, values, 6, neighbours=2).tolist()}
    allowed = set()
    for i, v in enumerate(values):
        mine = slots == slots[i]
        for part in (np.flatnonzero(mine[:i]), i + 1 + np.flatnonzero(mine[i + 1 :])):
            distance = np.bitwise_count(values[part] ^ v)
            pairs = [tuple(sorted((i, int(k)))) for k in part[distance <= 6]]
            allowed |= set(pairs)
            if mine.sum() <= near_copies.DENSE:
                assert set(pairs) <= got
            else:
                kept = np.sort([np.bitwise_count(values[a] ^ values[b]) for a, b in pairs if (a, b) in got])[:2]
                assert kept.tolist() == np.sort(distance[distance <= 6])[:2].tolist()
    assert got <= allowed
    planes = simhash.bit_planes(values)
    for radius in (0, 3, 6, 7):
        row, other = near_copies.within_block(planes, values[:50], radius)
        pairs = {(i, j) for i, j in zip(row.tolist(), other.tolist(), strict=True) if j < len(values)}
        assert pairs == set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(values[:50, None] ^ values[None, :]) <= radius)), strict=True))


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    left, stages = docs, dict(corpus_pipeline.STAGES)
    model = toxicity.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = toxicity._scores([t or "" for _, t in rows], model)
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    left = stages["toxicity"](spark, left, SF_DIR)
    assert left.columns == docs.columns and as_set(left, "doc_id") == sorted(((i,) for i, _ in rows), key=repr)
    profiles = [quality.profile((t or "").encode()) for _, t in rows]
    votes = np.array([quality.vote(p) for p in profiles])
    good = quality.estimate(votes, np.ones(len(votes))).posterior(votes) >= 0.5
    rows = [r for r, p, g in zip(rows, profiles, good, strict=True) if g and not p.base_failed]
    left = stages["quality rules"](spark, left, SF_DIR)
    assert left.columns == docs.columns and as_set(left, "doc_id") == sorted(((i,) for i, _ in rows), key=repr)
    keep = kept_of_groups(rows)
    left = stages["SimHash near-dedup"](spark, left, SF_DIR)
    got = {r["doc_id"] for r in left.collect()}
    # Whatever goes has a near copy of a smaller id; of what should go, nine in ten do.
    assert left.columns == docs.columns and keep <= got and len(got - keep) <= 0.1 * (len(rows) - len(keep))
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in packed} == got
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_pipeline_of_no_documents(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0
        assert name == "packing" or docs.columns == documents(spark).columns


def test_pipeline_keeps_all_columns_of_awkward_rows(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == documents(spark).columns
    assert set(packing.pack_documents(docs).columns) >= {"doc_id", "sequence_id"}
