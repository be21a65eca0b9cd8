"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialised


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for all ends of the edges (a, b).

    A step needs the smallest neighbour of each node, an aggregate, and a join back to the
    edges; no neighbourhood is gathered in one place.  Steps are written to the shared folder.
    """
    edges = materialised(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        to_low = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = materialised(large.join(low, "a").select(F.explode(to_low).alias("e")).select("e.*").filter("a <> b").distinct())
        same = small.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(small, ["a", "b"], "left_anti").isEmpty()
        discard(edges)
        edges = small
        if same:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
