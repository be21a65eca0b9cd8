"""Connected components of an edge table, by alternating large and small stars; of few edges, in
one task.  Both give the same."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop, held, kept


#: Edges that one task holds at most (16 bytes each); the count is checked.
FEW_EDGES = 50_000


def _union(frames: Iterator) -> Iterator:
    """node and the smallest node of its component, of all edges of the task."""
    import pandas as pd

    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for pdf in frames:
        for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            low, high = sorted((find(x), find(y)))
            root[high] = low
    yield pd.DataFrame({"node": list(root), "root": [find(x) for x in root]}).astype("int64")


def _digest(edges: DataFrame) -> tuple:
    """The number of edges and two sums over their hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for all ends of the edges (a, b).

    Loops are no edges; without edges there are no rows; null ends are not allowed.

    A star only needs the smallest neighbour of each node, an aggregate, and a join back to
    its edges: no neighbourhood is ever gathered in one place.
    """
    edges = held(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= FEW_EDGES:
        out = kept(edges.coalesce(1).mapInPandas(_union, "node long, root long"))
        drop(edges)
        return out
    before = _digest(edges)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        small = kept(small)
        now = _digest(small)
        drop(edges)
        edges = small
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
