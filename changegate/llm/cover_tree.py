"""Exact top-k by inner product with two cover trees.

Candidates are dealt into blocks of bounded size, and each block is indexed by a cover tree: a node has a centre and a covering
radius, its children's centres are further apart than half of that radius, and every point of a child lies within half of it.
Queries come in groups with trees of their own.  A pair of nodes, one of each tree, is pruned when no query of the one can
have a better score with a point of the other than its k-th best so far: with centres q, r and radii a, b no score exceeds
``q.r + |q| b + |r| a + a b``.  What is not pruned is split, the larger node first and the most promising children first; two
leaves are compared by one matrix product.

Every query starts from the k-th best score within a *bounded* sample of the candidates (about ``SAMPLE`` rows), a true lower
bound, so that blocks prune and stay silent from the start.  Each block names at most k candidates for a query, and the best of
those are the result: exact, by integers, ties to the smaller id.

*At scale* a task meets one block and, one after the other, the groups of queries; its memory is a block and a group.

Defined results: components become ``floor(256 x)``.  Vectors that are null, or hold nulls, infinities or NaN (or become
infinite when multiplied), take no part, nor do rows without an id.  Shorter vectors count as filled with zeros; the empty
vector scores 0.  Rows are told apart by a number of their own: rows that repeat an id are each a candidate, and each a query
with rows of its own, and a row is no candidate of itself only.  Scores are exact at any size; one that does not fit a long is
null, and is ranked where it belongs.  Extra columns are not read.  With fewer than k candidates a query has fewer rows; with
none, no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changegate.llm.common import bounded_batches, cut_lineage

K, EVERY = 5, 50
BLOCK, GROUP, SAMPLE, LEAF, QUERY_LEAF = 4096, 256, 1024, 64, 16
_EXACT = 1 << 53  # below this, doubles hold integers and their sums exactly
_LONG = 1 << 63
_PICKS = 64  # possible centres whose distances are found together

# ``range`` is 0 for a score that fits a long, else its sign; ``beyond`` then orders such scores as text.
FOUND_SCHEMA = "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint, range int, beyond string"


@dataclass
class Node:
    """A ball of points; a leaf has ``points``, an inner node children, whose centres are kept as one matrix."""

    centre: np.ndarray
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    norms: np.ndarray | None = None
    radii: np.ndarray | None = None


def _distances(points: np.ndarray, squares: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of every centre (row) to every point; where squares are below 2**53 they are exact."""
    if max(squares.max(initial=0), (centres * centres).sum(axis=1).max(initial=0)) >= _EXACT // 4:
        # Differences first, which lose nothing to cancellation; a little is added for what the sum rounds off.
        return np.stack([np.sqrt(((points - c) ** 2).sum(axis=1)) * (1 + 1e-9) for c in centres])
    squared = (centres * centres).sum(axis=1)[:, None] + squares[None, :] - 2.0 * (centres @ points.T)
    return np.sqrt(np.maximum(squared, 0.0))


def build(points: np.ndarray, leaf: int = LEAF) -> Node | None:
    """A cover tree of the rows of ``points``; without rows, None."""
    if not len(points):
        return None
    squares = (points * points).sum(axis=1)
    everything = np.arange(len(points))

    def node(centre: int, members: np.ndarray, distance: np.ndarray) -> Node:
        return Node(points[centre], float(distance.max()) * (1 + 1e-12), members)

    root = node(0, everything, _distances(points, squares, points[:1])[0])
    todo = [(root, 0)]
    while todo:
        parent, centre = todo.pop()
        if len(parent.points) <= leaf or parent.radius == 0:
            continue
        reach = parent.radius / 2
        # The parent's centre is its first child's, as cover trees nest; every further centre lies outside the earlier ones.
        members = np.concatenate([[centre], parent.points[parent.points != centre]])
        picked = []
        while len(members):
            picks = members[:_PICKS]
            near = _distances(points[members], squares[members], points[picks])
            covers = near <= reach
            covers[np.arange(len(picks)), np.arange(len(picks))] = True
            free = np.ones(len(members), dtype=bool)
            apart = covers.sum(axis=0).max() == 1  # no point is claimed twice
            for i in range(len(picks)):
                if apart or free[i]:
                    mine = np.flatnonzero(covers[i] if apart else covers[i] & free)
                    picked.append((picks[i], members[mine], near[i][mine]))
                    free[mine] = False
            members = members[free]
        # Lone points are put side by side into leaves: one product compares them all.
        lone = [m for _, m, _ in picked if len(m) == 1]
        for c, m, d in picked:
            if len(m) > 1:
                child = node(c, m, d)
                parent.children.append(child)
                todo.append((child, c))
        together = np.concatenate(lone) if lone else members
        for i in range(0, len(together), leaf):
            few = together[i : i + leaf]
            parent.children.append(node(few[0], few, _distances(points[few], squares[few], points[few[:1]])[0]))
        parent.points = parent.points[:0]
    _finish(root)
    return root


def _finish(root: Node) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.children:
            node.centres = np.stack([c.centre for c in node.children])
            node.norms = np.linalg.norm(node.centres, axis=1)
            node.radii = np.array([c.radius for c in node.children])
            todo.extend(node.children)


class DualSearch:
    """The k best candidates of every query of a group, over any number of blocks' trees."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k  # ``ids`` tell rows apart
        self.worst = floors.astype(float)  # the score that a candidate must reach
        self.best: list[list[tuple]] = [[] for _ in ids]  # (-score, vec_id, row), in order
        self.tree = build(queries, QUERY_LEAF)
        self.members: dict[int, np.ndarray] = {}
        if self.tree is not None:
            self._gather(self.tree)
        self.pruned = self.compared = 0

    def _gather(self, node: Node) -> np.ndarray:
        inside = np.concatenate([self._gather(c) for c in node.children]) if node.children else node.points
        self.members[id(node)] = inside
        return inside

    def search(self, ids: np.ndarray, points: np.ndarray, tree: Node | None, names: np.ndarray | None = None) -> None:
        """Search a block of rows ``ids``; ``names`` are their vec_ids, where those are not the ids."""
        if tree is None or self.tree is None:
            return
        self.names = ids if names is None else names
        todo = [(self.tree, tree, np.inf)]
        while todo:
            q, r, bound = todo.pop()
            worst = self.worst[self.members[id(q)]].min()
            if bound < worst:
                self.pruned += 1
                continue
            if not r.children and not q.children:
                self._compare(q.points, ids, points, r.points)
                continue
            length = float(np.linalg.norm(q.centre))
            if r.children and (not q.children or r.radius >= q.radius):
                bounds = r.centres @ q.centre + length * r.radii + (r.norms + r.radii) * q.radius
                bounds = bounds + 1e-9 * ((length + q.radius) * (r.norms + r.radii) + 1)  # beyond any rounding
                # The most promising child is searched first: it lies on top of the stack.
                for i in np.argsort(bounds):
                    if bounds[i] < worst:
                        self.pruned += 1
                    else:
                        todo.append((q, r.children[i], bounds[i]))
            else:
                size = float(np.linalg.norm(r.centre))
                for child, norm in zip(q.children, q.norms, strict=True):
                    most = float(child.centre @ r.centre) + norm * r.radius + (size + r.radius) * child.radius
                    todo.append((child, r, most + 1e-9 * ((norm + child.radius) * (size + r.radius) + 1)))

    def _compare(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray, columns: np.ndarray) -> None:
        self.compared += len(rows) * len(columns)
        scores = _products(self.queries[rows], points[columns])
        good = scores >= self.worst[rows][:, None]
        for i in np.flatnonzero(good.any(axis=1)):
            row = rows[i]
            found = columns[good[i]]
            mine, own, name = scores[i][good[i]], ids[found], self.names[found]
            keep = own != self.ids[row]
            mine, own, name = mine[keep], own[keep], name[keep]
            if len(mine) > self.k:
                order = np.lexsort((own, name, -mine))[: self.k]
                mine, own, name = mine[order], own[order], name[order]
            best = sorted([*self.best[row], *zip((-mine).tolist(), name.tolist(), own.tolist(), strict=True)])[: self.k]
            self.best[row] = best
            if len(best) == self.k:
                self.worst[row] = max(self.worst[row], _at_most(-best[-1][0]))


def _at_most(score: int) -> float:
    """A double that is no larger than an integer, and is it where doubles hold it."""
    value = float(score)
    return value if abs(score) < _EXACT else float(np.nextafter(value, -np.inf))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles or longs where every partial sum fits, else in Python's integers."""
    limit = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if limit < _EXACT:
        return (a @ b.T).astype(np.int64)
    if limit < _LONG // 2:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), dtype=np.int64)


def _placed(score: int) -> tuple[int | None, int, str | None]:
    """(score, range, beyond) of a score: what does not fit a long is written so that larger ones are larger texts."""
    if -_LONG <= score < _LONG:
        return score, 0, None
    digits = str(abs(score))
    if score > 0:
        return None, 1, f"{len(digits):05d}{digits}"
    return None, -1, f"{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _matrix(vectors: pd.Series, width: int = 0) -> np.ndarray:
    """Rows of equal length, filled up with zeros."""
    longest = max([width, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), longest))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _widen(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _floors(sample: list[tuple[int, list[int]]], k: int):
    """Adds to queries the k-th best score within the sample, or none if the sample is smaller."""

    def run(frames):
        sample_ids = np.array([i for i, _ in sample], dtype=np.int64)
        points = _matrix(pd.Series([v for _, v in sample])) if sample else np.zeros((0, 0))
        for frame in frames:
            floors = np.full(len(frame), np.nan)
            if len(sample_ids) > k:
                queries = _matrix(frame["v"], points.shape[1])
                scores = _products(queries, _widen(points, queries.shape[1])).astype(float)
                scores = np.where(np.abs(scores) < _EXACT, scores, np.nextafter(scores, -np.inf))
                scores[frame["row"].to_numpy()[:, None] == sample_ids[None, :]] = -np.inf
                floors = np.partition(scores, -k, axis=1)[:, -k]
            yield frame.assign(floor=floors)

    return run


def _search_blocks(k: int):
    """Searches the blocks of a partition: sorted by block, candidates before queries, queries by group."""

    def answer(group: pd.DataFrame, ids, names, points, tree):
        floors = group["floor"].fillna(-np.inf).to_numpy(dtype=float)
        queries = _matrix(group["v"], points.shape[1])
        if queries.shape[1] > points.shape[1]:
            points = _widen(points, queries.shape[1])
            tree = build(points)
        search = DualSearch(group["row"].to_numpy(), queries, floors, k)
        search.search(ids, points, tree, names)
        asked = zip(group["row"].tolist(), group["vec_id"].tolist(), search.best, strict=True)
        rows = [(q, name, i, row, *_placed(-s)) for q, name, best in asked for s, i, row in best]
        found = pd.DataFrame(rows, columns=["query_row", "query_id", "vec_id", "row", "score", "range", "beyond"])
        return found.astype({"score": "Int64"})

    def run(frames):
        parts: list[pd.DataFrame] = []  # the rows of the current block's candidates, or of the current group
        current, block, held = None, None, None

        def finish():
            nonlocal held, block
            if not parts:
                return None
            rows = pd.concat(parts, ignore_index=True)
            parts.clear()
            if current[1] == 0:
                points = _matrix(rows["v"])
                held, block = (rows["row"].to_numpy(), rows["vec_id"].to_numpy(), points, build(points)), current[0]
                return None
            return answer(rows, *held) if held is not None and block == current[0] else None

        for frame in frames:
            keys = list(zip(frame["block"], frame["kind"], frame["part"], strict=True))
            first = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[first]:
                    continue
                if keys[first] != current:
                    found = finish()
                    if found is not None and len(found):
                        yield found
                    current = keys[first]
                parts.append(frame.iloc[first:i])
                first = i
        found = finish()
        if found is not None and len(found):
            yield found

    return run


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, row) of the rows that take part; ``v`` are whole numbers in doubles, which hold them exactly."""
    whole = F.transform(F.col(vector_col), _whole)
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), whole.alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150)))
    return rows.filter(usable).withColumn("row", F.monotonically_increasing_id())


def _whole(x):
    """floor(256 x) as a double, also where it does not fit a long."""
    scaled = x.cast("double") * 256
    small = F.abs(scaled) < F.lit(float(_EXACT))
    return F.when(small, F.floor(F.when(small, scaled)).cast("double")).otherwise(scaled)  # larger doubles are whole


def top_k(
    vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row whose id is divisible by ``every``."""
    spark = bounded_batches(vectors.sparkSession)
    # Numbered once and written, so that every reader sees the same numbers.
    rows = cut_lineage(integer_vectors(vectors, id_col, vector_col))
    is_query = F.col("vec_id") % every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    mixed = F.xxhash64("row")
    # About SAMPLE rows, whatever the number of rows.
    sample = rows.filter(F.pmod(mixed, F.lit(max(1, n))) < SAMPLE).limit(2 * SAMPLE)
    sample = [(r["row"], r["v"]) for r in sample.collect()]
    schema = "row bigint, vec_id bigint, v array<double>, floor double"
    queries = rows.filter(is_query).select("row", "vec_id", "v").mapInPandas(_floors(sample, k), schema)
    n_blocks, n_groups = max(1, -(-n // block)), max(1, -(-n_queries // GROUP))
    group = F.pmod(F.xxhash64("row", F.lit("group")), F.lit(n_groups)).cast("int")
    candidates = rows.select(
        F.pmod(mixed, F.lit(n_blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("part"),
        "row", "vec_id", "v", F.lit(None).cast("double").alias("floor"),
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("kind"), group.alias("part"),
        "row", "vec_id", "v", "floor",
    )
    met = candidates.union(asked).repartition("block").sortWithinPartitions("block", "kind", "part")
    found = met.mapInPandas(_search_blocks(k), FOUND_SCHEMA)
    best_first = [F.col("range").desc(), F.col("score").desc(), F.col("beyond").desc(), F.col("vec_id"), F.col("row")]
    order = Window.partitionBy("query_row").orderBy(*best_first)
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = K, every: int = EVERY) -> str:
    """DuckDB SQL for the same rows, by comparing every query with every row."""
    return f"""
with rows as materialized (
  select row_number() over () as row, vec_id, [cast(floor(256 * cast(x as double)) as hugeint) for x in embedding] as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.row as query_row, q.vec_id as query_id, c.vec_id, c.row,
         cast(coalesce(list_sum([q.v[i] * c.v[i] for i in range(1, least(len(q.v), len(c.v)) + 1)]), 0) as bigint) as score
  from rows q join rows c on q.row <> c.row
  where q.vec_id % {every} = 0),
ranked as (select *, cast(row_number() over (partition by query_row order by score desc, vec_id, row) as int) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= {k}
"""
