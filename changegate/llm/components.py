"""Connected components of a graph given as a table of links, for graphs of any size and any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegate.llm.common import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); ``root`` is the smallest node of the component.

    Every round points each node to the smallest among itself and its neighbours, follows those pointers to their ends, and
    contracts the links: their ends become the nodes pointed to, and links within one such node or met twice go.  So a round has
    at most half the nodes of the one before and no more links, and a group is left as soon as it is one node.  The minima
    combine in the map tasks, so a hub costs no large task; the joins are plain shuffles that Spark splits where a key is
    hot.  Every round is written to the shared folder: a lost executor costs one round.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    edges, roots = cut_lineage(ends.distinct()), None
    while roots is None or not edges.isEmpty():
        near = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        first = near.groupBy(F.col("e.a").alias("node")).agg(F.min("e.b").alias("least"))
        tops = _ends_of_pointers(cut_lineage(first.select("node", F.least("least", "node").alias("root"))))
        if roots is None:
            roots = tops
        else:
            moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            roots = cut_lineage(moved.select("node", F.coalesce("next", "root").alias("root")))
        for end in ("a", "b"):
            edges = edges.join(tops.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        low, high = F.least("a_root", "b_root"), F.greatest("a_root", "b_root")
        edges = cut_lineage(edges.select(low.alias("a"), high.alias("b")).filter("a <> b").distinct())
    return roots


def _ends_of_pointers(pointers: DataFrame) -> DataFrame:
    """(node, root) with every pointer followed to its end; pointers lead to smaller nodes, and the ends point to themselves."""
    while True:
        ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        further = cut_lineage(pointers.join(ahead, "root").select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
        pointers = further.select("node", "root")
        if further.filter("moved").isEmpty():
            return pointers
