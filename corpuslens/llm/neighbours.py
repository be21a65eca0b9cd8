"""Approximate nearest neighbours by largest inner product: stable projections and kd-trees.

Vectors get one more component, so that the largest inner product is the smallest Euclidean
distance.  Gaussian (2-stable) projections to few dimensions are indexed by a kd-tree whose
upper part is fitted on a bounded sample and deals all vectors to its leaves.  A query first
searches its own leaf; the answer bounds how far a nearer vector's projection can lie by the
chi-square test, and only leaves whose boxes reach into that radius are searched for it.
Inside a leaf, a finer kd-tree walks its parts in the order of their projected distance and
verifies what it meets on the original vectors; it stops once the test says that a nearer
vector would most likely have been met already.

Every vector is indexed; equal vectors are one entry that keeps as many of the smallest ids
as an answer can hold.  How many leaves a query needs depends on the vectors: if those wanted
are hardly nearer than all others, the test cannot rule out much.

Defined results: null, empty and zero vectors and those with null or non-finite components,
and null ids take no part; vectors of different lengths have no inner product, so each length
is searched among its own; ties go to the smaller id; with fewer candidates than asked for
all are returned; repeated ids are entries of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import got, kept, only, sent

NEIGHBOURS, QUERY_STEP = 20, 20
DIMENSIONS = 8
#: Chance, by the chi-square test, that a vector as near as the last kept one has been met.
CONFIDENCE = 0.95
#: Entries in a leaf of the upper tree, and in one part of a leaf that came out larger, about.
LEAF_ENTRIES, BLOCK_ROWS = 8_192, 32_768
#: Leaves of the upper tree of one vector length at most, and vectors sampled for each leaf.
MAX_LEAVES, SAMPLE_PER_LEAF = 65_536, 16
LEAF_ROWS, QUERY_ROWS = 64, 2048
FOUND = "query_id long, vec_id long, score double"


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def chi_square(x: np.ndarray | float, m: int):
    """Its distribution function for an even number of degrees of freedom."""
    half, term, total = np.asarray(x) / 2, 1.0, 0.0
    for j in range(m // 2):
        term = term * half / j if j else np.ones_like(half)
        total = total + term
    return 1 - np.exp(-half) * total


class Block:
    """A kd-tree over projected vectors: leaves are slices of one order, with their boxes."""

    def __init__(self, vectors: np.ndarray, longest: float) -> None:
        self.projected = projected(vectors, longest)
        order, todo, leaves = np.arange(len(vectors)), [(0, len(vectors))], []
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF_ROWS:
                leaves.append((a, b))
                continue
            p = self.projected[order[a:b]]
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(p[:, axis], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.order, self.leaves = order, leaves
        boxes = [self.projected[order[a:b]] for a, b in leaves]
        self.low, self.high = np.array([x.min(axis=0) for x in boxes]), np.array([x.max(axis=0) for x in boxes])
        self.vectors = vectors

    def search(self, query: np.ndarray, projected: np.ndarray, longest: float, want: int, bound: float) -> np.ndarray:
        """Rows of this block worth verifying, the walk stopped by the chi-square test; ``bound``
        is a score that as many vectors elsewhere have as are wanted, or minus infinity."""
        gap = np.maximum(np.maximum(self.low - projected, projected - self.high), 0.0)
        away = (gap**2).sum(axis=1)
        walk = np.argsort(away, kind="stable")
        base, met, scores = float(query @ query) + longest**2, [], np.zeros(0)
        at, step = 0, max(1, -(-4 * want // LEAF_ROWS))
        while at < len(walk):
            own = np.partition(scores, len(scores) - want)[len(scores) - want] if len(scores) >= want else -math.inf
            if max(own, bound) > -math.inf:
                kth = base - 2 * max(own, bound)
                if kth <= 0 or chi_square(away[walk[at]] / kth, projected.shape[0]) >= CONFIDENCE:
                    break
            rows = np.concatenate([self.order[a:b] for a, b in (self.leaves[i] for i in walk[at : at + step])])
            met.append(rows)
            scores = np.concatenate([scores, self.vectors[rows] @ query])
            at, step = at + step, min(2 * step, 64)
        met = np.concatenate(met) if met else np.zeros(0, np.int64)
        if len(met) > want:
            edge = np.partition(scores, len(scores) - want)[len(scores) - want]
            met = met[scores >= edge - 1e-9 * abs(edge)]
        return met


class Tree:
    """The upper kd-tree of one vector length: cuts by axis; leaves are numbered from ``base``."""

    def __init__(self, points: np.ndarray, leaves: int, longest: float, base: int) -> None:
        self.longest, self.axis, self.cut, self.below = longest, [], [], []
        todo, self.leaves = [(points, leaves, None)], 0
        while todo:
            p, n, parent = todo.pop()
            if parent is not None:
                self.below[parent[0]][parent[1]] = len(self.axis)
            wide = p.max(axis=0) - p.min(axis=0) if len(p) else np.zeros(1)
            if n < 2 or len(p) < 2 or not wide.max() > 0:
                self.axis.append(-1)
                self.cut.append(0.0)
                self.below.append([base + self.leaves, base + self.leaves])
                self.leaves += 1
                continue
            axis = int(np.argmax(wide))
            cut = float(np.median(p[:, axis]))
            high = p[:, axis] >= cut
            if high.all():
                high = p[:, axis] > cut
                cut = float(p[high, axis].min())
            self.axis.append(axis)
            self.cut.append(cut)
            self.below.append([0, 0])
            todo += [(p[~high], n // 2, (len(self.axis) - 1, 0)), (p[high], n - n // 2, (len(self.axis) - 1, 1))]
        self.axis, self.cut, self.below = np.array(self.axis), np.array(self.cut), np.array(self.below)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                return self.below[node, 0]
            at = node[inner]
            node[inner] = self.below[at, (points[inner, self.axis[at]] >= self.cut[at]).astype(np.int64)]


def projected(vectors: np.ndarray, longest: float | None) -> np.ndarray:
    """Projections of vectors with their last component, none for queries (``longest`` null)."""
    size = vectors.shape[1]
    directions = np.random.Generator(np.random.PCG64([11, size])).standard_normal((size + 1, DIMENSIONS))
    rest = np.zeros(len(vectors)) if longest is None else np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
    return np.concatenate([vectors, rest[:, None]], axis=1) @ directions


def _by_length(batch: pa.RecordBatch):
    """Rows and vectors of each length in a batch."""
    size = batch.column("size").to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield n, at, np.asarray(batch.column("vector").take(pa.array(at)).flatten(), dtype=np.float64).reshape(-1, n)


def sample_points(batches: Iterator[pa.RecordBatch], facts) -> Iterator[pa.RecordBatch]:
    """Projections of a sample of every length's vectors."""
    for batch in batches:
        for n, at, vectors in _by_length(batch):
            longest, share = facts[n]
            draw = batch.column("draw").to_numpy(zero_copy_only=False)[at] < share
            points = projected(vectors[draw], longest)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), n)), pa.array(list(points), type=pa.list_(pa.float64()))], names=["size", "point"])


def route(batches: Iterator[pa.RecordBatch], trees, query: bool) -> Iterator[pa.RecordBatch]:
    """Rows with the leaf and the projection of their vectors."""
    known = got(trees)
    for batch in batches:
        leaf, points = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, DIMENSIONS))
        for n, at, vectors in _by_length(batch):
            points[at] = projected(vectors, None if query else known[n].longest)
            leaf[at] = known[n].leaf_of(points[at])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(list(points), type=pa.list_(pa.float64()))], names=[*batch.schema.names, "leaf", "point"])


def admit(batches: Iterator[pa.RecordBatch], boxes) -> Iterator[pa.RecordBatch]:
    """Each query once for every other leaf of its length that its bound lets in."""
    known = got(boxes)
    for batch in batches:
        size, own = batch.column("size").to_pylist(), batch.column("leaf").to_numpy()
        bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
        norm = batch.column("norm").to_numpy(zero_copy_only=False)
        rows, leaves, held = [], [], 0
        for i, point in enumerate(batch.column("point").to_pylist()):
            number, low, high, longest = known[size[i]]
            away = (np.maximum(np.maximum(low - point, point - high), 0.0) ** 2).sum(axis=1)
            kth = norm[i] + longest**2 - 2 * bound[i] if bound[i] == bound[i] else math.inf
            inside = np.full(len(number), True) if kth == math.inf else away <= 0 if kth <= 0 else chi_square(away / kth, DIMENSIONS) < CONFIDENCE
            to = number[inside & (number != own[i])]
            rows.append(np.full(len(to), i))
            leaves.append(to)
            held += len(to)
            if held > 4096 or i + 1 == batch.num_rows:
                out = batch.select(["query_id", "vector", "size", "bound"]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(leaves))], names=["query_id", "vector", "size", "bound", "leaf"])
                rows, leaves, held = [], [], 0


def search_block(queries, rows, longest: dict[int, float], want: int):
    """The best candidates of one part of a leaf for one batch of queries."""
    import pandas as pd

    if not len(rows) or not len(queries):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    vectors, ids = np.array(rows["vector"].tolist(), dtype=np.float64), rows["ids"].tolist()
    most = longest[vectors.shape[1]]
    block = Block(vectors, most)
    out_q, out_v, out_s = [], [], []
    asked = np.array(queries["vector"].tolist(), dtype=np.float64)
    bounds = queries["bound"].astype(float).fillna(-math.inf).tolist()
    for q, vector, point, bound in zip(queries["query_id"].tolist(), asked, projected(asked, None), bounds):
        best = []
        for r in block.search(vector, point, most, want + 1, bound).tolist():
            score = float(np.dot(vectors[r], vector))
            best += [(-score, int(i)) for i in ids[r] if i != q]
        for s, i in sorted(best)[:want]:
            out_q.append(q)
            out_v.append(i)
            out_s.append(-s)
    return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_s}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _search(asked: DataFrame, held: DataFrame, entries: dict[int, int], longest: dict[int, float], want: int) -> DataFrame:
    """What the leaves give for the queries that are sent to them; a leaf with many entries is
    searched in parts, and one with many queries in batches."""
    spark = asked.sparkSession
    sizes = {r["leaf"]: r["n"] for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf
    plan = F.broadcast(spark.createDataFrame([(k, max(1, math.ceil(entries[k] / BLOCK_ROWS)), math.ceil(n / QUERY_ROWS)) for k, n in sizes.items() if k in entries], "leaf long, parts int, batches int"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(plan, "leaf").withColumn("batch", F.pmod(F.xxhash64("query_id"), "batches").cast("int")).withColumn("part", numbers("parts"))
    held = held.join(plan, "leaf").withColumn("part", F.pmod(F.xxhash64("vector"), "parts").cast("int")).withColumn("batch", numbers("batches"))
    by = ["leaf", "part", "batch"]
    asked, held = asked.select(*by, "query_id", "vector", "bound"), held.select(*by, "ids", "vector")
    return kept(asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(lambda q, r: search_block(q, r, longest, want), FOUND))


def nearest(table: DataFrame, query_step: int = QUERY_STEP, want: int = NEIGHBOURS, leaf_entries: int = LEAF_ENTRIES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest found."""
    spark, vector = table.sparkSession, F.col("embedding").cast("array<double>")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    rows = kept(only(table, "vec_id", "embedding").select(F.col("vec_id").cast("long"), vector.alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector")))
    facts = {r["size"]: r for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.max(F.sqrt(norm)).alias("longest")).collect()}  # one row a length
    if not facts:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    longest = {k: r["longest"] for k, r in facts.items()}
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= want + 1)
    entries = few.groupBy("vector", "size").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    leaves = {k: min(MAX_LEAVES, max(1, math.ceil(r["n"] / leaf_entries))) for k, r in facts.items()}
    shares = {k: (longest[k], min(1.0, SAMPLE_PER_LEAF * 4 * leaves[k] / r["n"])) for k, r in facts.items()}
    draw = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn: dict[int, list] = {k: [] for k in facts}
    for r in rows.select("vector", "size", draw.alias("draw")).mapInArrow(lambda batches: sample_points(batches, shares), "size long, point array<double>").toLocalIterator():
        drawn[r["size"]].append(r["point"])
    trees, base = {}, 0
    for k in sorted(facts):
        trees[k] = Tree(np.array(drawn[k]).reshape(-1, DIMENSIONS), leaves[k], longest[k], base)
        base += trees[k].leaves
    trees = sent(spark, trees)
    held = kept(entries.mapInArrow(lambda batches: route(batches, trees, False), "vector array<double>, size int, ids array<long>, leaf long, point array<double>"))
    sides = [f(F.get("point", F.lit(i))).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(DIMENSIONS)]
    boxes: dict[int, list] = {}
    counts = {}
    for r in held.groupBy("size", "leaf").agg(F.count("*").alias("n"), *sides).collect():  # one row a leaf
        counts[r["leaf"]] = r["n"]
        boxes.setdefault(r["size"], []).append((r["leaf"], *[[r[f"{name}{i}"] for i in range(DIMENSIONS)] for name in ("low", "high")]))
    boxes = sent(spark, {k: (*[np.array(x) for x in zip(*v)], longest[k]) for k, v in boxes.items()})

    asked = rows.filter(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), "vector", "size")
    asked = kept(asked.mapInArrow(lambda batches: route(batches, trees, True), "query_id long, vector array<double>, size int, leaf long, point array<double>"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = _search(asked.withColumn("bound", F.lit(None).cast("double")), held, counts, longest, want)
    bounds = first.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == want).select("query_id", F.col("score").alias("bound"))
    wide = asked.join(bounds, "query_id", "left").select("query_id", "vector", "size", "leaf", "point", "bound", norm.alias("norm"))
    wide = kept(wide.mapInArrow(lambda batches: admit(batches, boxes), "query_id long, vector array<double>, size int, bound double, leaf long"))
    found = first.unionByName(_search(wide, held, counts, longest, want))
    ranked = found.distinct().withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= want)
    return ranked.select("query_id", "rank", "vec_id", "score")
