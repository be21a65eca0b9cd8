"""Clusters by density: vectors of one level, grouped where they lie closer than what surrounds them.

The hierarchy is that of mutual reachability: two vectors meet at the largest of their distance and
their two core distances (to the ``min_samples``-th neighbour, the vector itself counted).  Its
minimum spanning tree is cut by falling distance; a part of at least ``min_cluster_size`` vectors is
a cluster, and the clusters that last (by stability) are chosen.  Others are noise.

Equal vectors are one node with a weight.  Nodes lie in blocks, the leaves of a kd-tree over a
bounded sample; a block looks only into blocks whose distance, by centre and radius, is within what
it has found.  The spanning tree grows by Boruvka's rounds over blocks, and is exact.  Parts under
the least size are then contracted round by round, so that only the clusters' own tree, at most one
node in ``min_cluster_size``, is ever looked at as a whole.  Levels of one block go through the same
steps in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialised
from .components import components

#: Nodes of a block, about; sampled vectors of each; spanning trees that one task condenses.
BLOCK, SAMPLED, FEW = 1024, 64, 200_000
#: Bytes of the blocks' centres that are looked at together, and clusters whose tree is broadcast.
CENTRE_BYTES, CLUSTERS = 32 << 20, 2_000_000
#: Distances that are worked out at once.
CELLS = 1 << 22
NODE = "level string, leaf int, node long, weight long, vector array<double>"
PACKED = "level string, leaf int, nodes binary, weights binary, vectors binary, cores binary, parts binary"
EDGE = "level string, a long, b long, w double"
LEAST = 1e-12  # distances under it count as this, so that equal vectors have a finite density


# ---- blocks


def _split(sample: np.ndarray, leaves: int) -> list[tuple]:
    """A kd-tree as a list of (dimension, border, low child, high child); leaves are negative."""
    tree, n_leaves = [], 0

    def grow(rows: np.ndarray, leaves: int) -> int:
        nonlocal n_leaves
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if leaves < 2 or len(rows) < 2 or spread.max() == 0:
            n_leaves += 1
            return -n_leaves
        d = int(spread.argmax())
        border = float(np.median(rows[:, d]))
        low = rows[:, d] < border
        if not low.any():
            border = float(rows[rows[:, d] > border, d].min())
            low = rows[:, d] < border
        at = len(tree)
        tree.append(None)
        tree[at] = (d, border, grow(rows[low], leaves // 2), grow(rows[~low], leaves - leaves // 2))
        return at

    grow(sample, leaves)
    return tree


def _leaves(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64) if tree else np.full(len(x), -1)
    while (open_ := at >= 0).any():
        for k in np.unique(at[open_]):
            d, border, low, high = tree[k]
            own = at == k
            at[own] = np.where(x[own, d] < border, low, high)
    return -1 - at


def _blocks(nodes: DataFrame, block: int) -> DataFrame:
    """A row for each block: its nodes, weights and vectors, packed."""
    spark = nodes.sparkSession
    sizes = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count("*").alias("n")).filter(F.col("n") > block).collect()}
    share = min(1.0, SAMPLED / block)
    drawn: dict[str, list] = {}
    if sizes:  # a row in block / SAMPLED of the large levels
        picked = nodes.filter(F.col("level").isin(*sizes)).filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000))
        for r in picked.select("level", "vector").toLocalIterator():
            drawn.setdefault(r["level"], []).append(r["vector"])
    trees = spark.sparkContext.broadcast({k: _split(np.array(drawn.get(k, []), dtype=float).reshape(len(drawn.get(k, [])), -1), -(-n // block)) for k, n in sizes.items()})

    def deal(batches):
        for batch in batches:
            leaf = np.zeros(len(batch), np.int64)
            for level, own in batch.groupby("level").indices.items():
                if tree := trees.value.get(level):
                    leaf[own] = _leaves(tree, np.array(batch["vector"].iloc[own].tolist()))
            yield batch.assign(leaf=leaf)[["level", "leaf", "node", "weight", "vector"]]

    def pack(pdf):
        x = np.array(pdf["vector"].tolist(), dtype=float)
        none = np.full(len(x), np.nan)
        return _packed(pdf["level"].iloc[0], pdf["leaf"].iloc[0], pdf["node"].to_numpy(), pdf["weight"].to_numpy(), x, none, pdf["node"].to_numpy())

    return materialised(nodes.mapInPandas(deal, NODE).groupBy("level", "leaf").applyInPandas(pack, PACKED))


def _packed(level, leaf, nodes, weights, x, cores, parts) -> pd.DataFrame:
    return pd.DataFrame({"level": [level], "leaf": [leaf], "nodes": [nodes.astype(np.int64).tobytes()], "weights": [weights.astype(np.int64).tobytes()], "vectors": [x.tobytes()], "cores": [cores.tobytes()], "parts": [parts.astype(np.int64).tobytes()]})


class _Block:
    def __init__(self, nodes, weights, vectors, cores, parts) -> None:
        self.nodes, self.weights, self.cores, self.parts = np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64), np.frombuffer(cores, float), np.frombuffer(parts, np.int64)
        self.x = np.frombuffer(vectors, float).reshape(len(self.nodes), -1)

    def rows(self, others: int):
        """Stretches of rows whose distances to so many others are worked out at once."""
        step = max(1, CELLS // max(1, others * self.x.shape[1]))
        return ((lo, min(lo + step, len(self.x))) for lo in range(0, len(self.x), step))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - y[None]) ** 2).sum(2))


def _about(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one product of matrices, and how far off by rounding they are at most."""
    centre = y.mean(0)
    x, y = x - centre, y - centre
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    return xx[:, None] + yy[None] - 2 * (x @ y.T), 16 * (x.shape[1] + 8) * np.finfo(float).eps * float(xx.max() + yy.max())


def _each(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of some pairs, equal to those in ``_distances``."""
    return np.sqrt(((x[i] - y[j]) ** 2).sum(1))


def _block_of(row) -> _Block:
    return _Block(row.nodes, row.weights, row.vectors, row.cores, row.parts)


def _facts(blocks: DataFrame, bound) -> list:
    """level, leaf, centre, radius, least and largest core, the part if it is but one, and a bound of
    every block (``bound`` of a block), a row each."""

    def look(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples():
                b = _block_of(row)
                centre = b.x.mean(0)
                one = int(b.parts[0]) if (b.parts == b.parts[0]).all() else None
                out.append((row.level, row.leaf, centre.tolist(), float(np.sqrt(((b.x - centre) ** 2).sum(1).max())) * (1 + 1e-12) + 1e-12, float(b.cores.min()), float(b.cores.max()), one, float(bound(b))))
            yield pd.DataFrame(out, columns=["level", "leaf", "centre", "radius", "low", "high", "one", "bound"]).astype({"one": "Int64"})

    return blocks.mapInPandas(look, "level string, leaf int, centre array<double>, radius double, low double, high double, one long, bound double").collect()


def _pairs(spark: SparkSession, facts: list, reach) -> DataFrame:
    """Blocks i and j of a level such that i looks into j: ``reach`` tells it of all j for some i."""
    out, by_level = [], {}
    for r in facts:
        by_level.setdefault(r["level"], []).append(r)
    for level, own in by_level.items():
        centre = np.array([r["centre"] for r in own])
        radius, leaf = np.array([r["radius"] for r in own]), np.array([r["leaf"] for r in own])
        step = max(1, CENTRE_BYTES // (8 * centre.size))
        for lo in range(0, len(own), step):
            i = np.arange(lo, min(lo + step, len(own)))
            between = _distances(centre[i], centre)
            look = reach(own, i, between - radius[i][:, None] - radius[None], between + radius[i][:, None] + radius[None])
            out += [(level, int(leaf[i[a]]), int(leaf[b])) for a, b in zip(*np.nonzero(look))]
    return spark.createDataFrame(out, "level string, leaf int, other int")


def _met(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Both blocks of every pair in one row."""
    columns = ["nodes", "weights", "vectors", "cores", "parts"]
    mine = blocks.select("level", "leaf", *columns)
    theirs = blocks.select("level", F.col("leaf").alias("other"), *[F.col(c).alias(f"o_{c}") for c in columns])
    return pairs.join(mine, ["level", "leaf"]).join(theirs, ["level", "other"])


def _both(row) -> tuple[_Block, _Block]:
    return _block_of(row), _Block(row.o_nodes, row.o_weights, row.o_vectors, row.o_cores, row.o_parts)


# ---- core distances


def _nearest(b: _Block, o: _Block, least: int, own: bool):
    """For each node of b the nearest of o until they weigh enough: places, distances, weights."""
    for lo, hi in b.rows(len(o.x)):
        k = min(least, len(o.x))
        about, off = _about(b.x[lo:hi], o.x)
        limit = np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * off
        if np.isfinite(limit).all():
            i, j = np.nonzero(about <= limit[:, None])
            d = _each(b.x[lo:hi], o.x, i, j)
            order = np.lexsort((d, i))
            some = order[np.searchsorted(i, np.arange(hi - lo))[:, None] + np.arange(k)]
            yield lo, hi, d[some], o.weights[j[some]]
        else:
            d = _distances(b.x[lo:hi], o.x)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            yield lo, hi, np.take_along_axis(d, near, 1), o.weights[near]


def _kth(distances: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
    """Of each row, the distance at which the nearest weigh enough; infinite if they never do."""
    order = np.argsort(distances, axis=1, kind="stable")
    d, w = np.take_along_axis(distances, order, 1), np.cumsum(np.take_along_axis(weights, order, 1), axis=1)
    enough = w >= least
    return np.where(enough.any(1), d[np.arange(len(d)), enough.argmax(1)], np.inf)


def _with_cores(blocks: DataFrame, least: int) -> DataFrame:
    """The blocks with the core distance of every node."""
    spark = blocks.sparkSession

    def own(b: _Block) -> np.ndarray:
        return np.concatenate([_kth(d, w, least) for _, _, d, w in _nearest(b, b, least, True)])

    facts = _facts(blocks, lambda b: own(b).max())
    pairs = _pairs(spark, facts, lambda rows, i, low, _: low <= np.array([rows[k]["bound"] for k in i])[:, None])

    def look(batches):
        for batch in batches:
            for row in batch.itertuples():
                b, o = _both(row)
                limit = own(b)
                for lo, hi, d, w in _nearest(b, o, least, False):
                    at, k = np.nonzero(d <= limit[lo:hi, None])
                    yield pd.DataFrame({"level": row.level, "leaf": row.leaf, "node": b.nodes[lo:hi][at], "d": d[at, k], "w": w[at, k]})

    near = _met(pairs, blocks).mapInPandas(look, "level string, leaf int, node long, d double, w long")
    # A block gives a node at most ``least`` neighbours; what they weigh in order of distance tells the core.
    listed = near.groupBy("level", "leaf", "node").agg(F.array_sort(F.collect_list(F.struct("d", "w"))).alias("near"))
    step = lambda s, x: F.when(s["w"] >= least, s).otherwise(F.struct((s["w"] + x["w"]).alias("w"), x["d"].alias("d")))
    core = F.aggregate("near", F.struct(F.lit(0).cast("long").alias("w"), F.lit(0.0).alias("d")), step, lambda s: F.when(s["w"] >= least, s["d"]).otherwise(float("inf")))
    cores = listed.select("level", "leaf", "node", core.alias("core"))

    def fill(key, pdf, found):
        b = _block_of(next(pdf.itertuples()))
        core = found.set_index("node")["core"].reindex(b.nodes).to_numpy(dtype=float)
        return _packed(key[0], key[1], b.nodes, b.weights, b.x, core, b.parts)

    out = materialised(blocks.groupBy("level", "leaf").cogroup(cores.groupBy("level", "leaf")).applyInPandas(fill, PACKED))
    discard(blocks)
    return out


# ---- the spanning tree


def _cheapest(b: _Block, o: _Block) -> pd.DataFrame:
    """For each part of b the least edge to another part in o; ties by the nodes' numbers."""
    found = []
    for lo, hi in b.rows(len(o.x)):
        apart = b.parts[lo:hi, None] != o.parts[None]
        core = np.maximum(b.cores[lo:hi, None], o.cores[None])
        about, off = _about(b.x[lo:hi], o.x)
        if np.isfinite(off):  # only what rounding leaves in doubt is worked out exactly
            limit = np.where(apart, np.maximum(about + off, core**2), np.inf).min(1) * (1 + 1e-14)
            apart &= np.maximum(about - off, core**2) <= limit[:, None]
        i, j = np.nonzero(apart)
        w = np.maximum(_each(b.x[lo:hi], o.x, i, j), core[i, j])
        order = np.lexsort((o.nodes[j], w, i))
        first = order[np.append(True, i[1:] != i[:-1])] if len(i) else order  # i is in order already
        i, j, best = i[first], j[first], w[first]
        mine, theirs = b.nodes[lo:hi][i], o.nodes[j]
        found.append(pd.DataFrame({"part": b.parts[lo:hi][i], "w": best, "a": np.minimum(mine, theirs), "b": np.maximum(mine, theirs), "other": o.parts[j]}))
    found = pd.concat(found)
    return found[np.isfinite(found["w"])].sort_values(["w", "a", "b"]).groupby("part", as_index=False).first()


def _alone(batches):
    """The spanning tree of a block that is a whole level, node by node."""
    for batch in batches:
        for row in batch.itertuples():
            b, out = _block_of(row), []
            left, best, via = np.ones(len(b.nodes), bool), np.full(len(b.nodes), np.inf), np.zeros(len(b.nodes), np.int64)
            at = 0
            for _ in range(len(b.nodes) - 1):
                left[at] = False
                w = np.maximum(_distances(b.x[at : at + 1], b.x)[0], np.maximum(b.cores[at], b.cores))
                nearer = left & (w < best)
                best[nearer], via[nearer] = w[nearer], at
                at = int(np.where(left, best, np.inf).argmin())
                out.append((row.level, *sorted((int(b.nodes[at]), int(b.nodes[via[at]]))), float(best[at])))
            yield pd.DataFrame(out, columns=["level", "a", "b", "w"]).astype({"a": "int64", "b": "int64", "w": "float64"})


def _renamed(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """The blocks with their parts' new names."""

    def name(key, pdf, known):
        b = _block_of(next(pdf.itertuples()))
        to = known.set_index("node")["root"].to_dict()
        return _packed(key[0], key[1], b.nodes, b.weights, b.x, b.cores, np.array([to.get(p, p) for p in b.parts.tolist()], dtype=np.int64))

    def where(batches):
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame({"level": row.level, "leaf": row.leaf, "node": np.unique(np.frombuffer(row.parts, np.int64))})

    own = blocks.mapInPandas(where, "level string, leaf int, node long").join(parts, "node")
    out = materialised(blocks.groupBy("level", "leaf").cogroup(own.groupBy("level", "leaf")).applyInPandas(name, PACKED))
    discard(blocks)
    return out


def _reach(rows: list, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which blocks the blocks i must look into for the least edges of their parts.

    Some edge between two blocks is at most as long as their farthest nodes are apart (or their
    largest core distances); a block with one part may count on any block that is not wholly of that
    part, one of several parts on blocks of several parts, itself among them.
    """
    one = [r["one"] for r in rows]
    number = {p: k for k, p in enumerate(dict.fromkeys(p for p in one if p is not None))}
    part = np.array([-1 if p is None else number[p] for p in one])
    least, most = np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])
    same = (part[i][:, None] == part[None]) & (part[None] >= 0)
    counts = np.where(part[i][:, None] >= 0, ~same, part[None] < 0)
    able = np.where(counts, np.maximum(high, np.maximum(most[i][:, None], most[None])), np.inf).min(1)
    return ~same & (np.maximum(low, np.maximum(least[i][:, None], least[None])) <= able[:, None])


def _tree(blocks: DataFrame) -> DataFrame:
    """The edges of the spanning tree of every level, one part's least edges after the other's."""
    spark = blocks.sparkSession
    count = blocks.groupBy("level").agg(F.count("*").alias("n"))
    edges = blocks.join(count.filter("n = 1").select("level"), "level", "left_semi").mapInPandas(_alone, EDGE)
    left = materialised(blocks.join(count.filter("n > 1").select("level"), "level", "left_semi"))

    def look(batches):
        for batch in batches:
            for row in batch.itertuples():
                yield _cheapest(*_both(row)).assign(level=row.level)[["level", "part", "w", "a", "b", "other"]]

    while True:
        facts, parts = _facts(left, lambda b: 0.0), {}
        for r in facts:
            parts.setdefault(r["level"], set()).add(r["one"])
        facts = [r for r in facts if None in parts[r["level"]] or len(parts[r["level"]]) > 1]
        if not facts:
            break
        found = _met(_pairs(spark, facts, _reach), left).mapInPandas(look, "level string, part long, w double, a long, b long, other long")
        best = materialised(found.groupBy("level", "part").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("level", "part", "e.*"))
        edges = edges.unionByName(best.select("level", "a", "b", "w").distinct())
        left = _renamed(left, components(best.select(F.col("part").alias("a"), F.col("other").alias("b"))))
    discard(left)
    return materialised(edges)


# ---- the hierarchy


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = x = root[root[x]]
    return x


def _contracted(weights: np.ndarray, cores: np.ndarray, edges: list[tuple], least: int):
    """Parts under the least size, put together edge by edge: each node's seed (the first part large
    enough that it is in) and when it leaves, the seeds' births, and the edges between seeds."""
    n = len(weights)
    root, size, held = list(range(n)), weights.astype(np.int64).tolist(), [[k] for k in range(n)]
    seed, leaves, part = np.full(n, -1), np.full(n, np.inf), [-1] * n
    births, between = [], []
    for k in np.flatnonzero(weights >= least).tolist():
        part[k], seed[k], leaves[k] = len(births), len(births), cores[k]
        births.append(float(cores[k]))
    for w, a, b in edges:
        a, b = _find(root, a), _find(root, b)
        if len(held[a]) < len(held[b]):
            a, b = b, a
        both = size[a] + size[b]
        if part[a] >= 0 and part[b] >= 0:
            between.append((w, part[a], part[b]))
        elif part[a] < 0 and part[b] < 0:
            held[a] += held[b]
            if both >= least:
                part[a] = len(births)
                births.append(w)
                seed[held[a]], leaves[held[a]] = part[a], w
        else:
            large, small = (a, b) if part[a] >= 0 else (b, a)
            seed[held[small]], leaves[held[small]] = part[large], w
            part[a] = part[large]
        root[b], size[a] = a, both
    return seed, leaves, np.array(births), between


class Hierarchy:
    """Clusters of one level: seeds, and a cluster for every two that meet."""

    def __init__(self, births: np.ndarray, edges: list[tuple]) -> None:
        n = len(births)
        root, top = list(range(n)), list(range(n))
        self.parent, self.low = [-1] * n, births.tolist()
        for w, a, b in sorted(edges):
            a, b = _find(root, a), _find(root, b)
            new = len(self.parent)
            self.parent += [-1]
            self.low += [w]
            self.parent[top[a]] = self.parent[top[b]] = new
            root[b], top[a] = a, new
        self.parent, self.low = np.array(self.parent, dtype=np.int64), np.maximum(np.array(self.low, dtype=float), LEAST)
        self.high = np.where(self.parent >= 0, self.low[self.parent] if n else 0.0, np.inf)
        self.jumps = [np.where(self.parent >= 0, self.parent, np.arange(len(self.parent)))]
        while (self.jumps[-1][self.jumps[-1]] != self.jumps[-1]).any():
            self.jumps.append(self.jumps[-1][self.jumps[-1]])

    def cluster_of(self, seed: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The cluster that a node leaves: the last around its seed that had formed by then."""
        at = seed.copy()
        for jump in reversed(self.jumps):
            ahead = jump[at]
            at = np.where(self.low[ahead] <= leaves, ahead, at)
        return at

    def chosen(self, weight: np.ndarray, density: np.ndarray) -> np.ndarray:
        """The chosen cluster that every cluster is in, or -1; of each cluster the weight of the nodes
        that leave it, and the sum of their densities (1 / distance)."""
        n = len(self.parent)
        size, sums = weight.astype(float), np.zeros(n)
        stable, best = np.zeros(n), np.zeros(n, bool)
        for k in range(n):  # children come before their parents
            born = 0.0 if np.isinf(self.high[k]) else 1 / self.high[k]
            stable[k] = density[k] + (size[k] - weight[k]) / self.low[k] - size[k] * born
            best[k] = self.parent[k] >= 0 and stable[k] >= sums[k]
            if self.parent[k] >= 0:
                size[self.parent[k]] += size[k]
                sums[self.parent[k]] += max(stable[k], sums[k])
        out = np.full(n, -1)
        for k in range(n - 1, -1, -1):
            above = out[self.parent[k]] if self.parent[k] >= 0 else -1
            out[k] = above if above >= 0 else k if best[k] else -1
        return out


def _labelled(nodes: np.ndarray, weights: np.ndarray, seed: np.ndarray, leaves: np.ndarray, tree: Hierarchy) -> np.ndarray:
    """The chosen cluster of every node, or -1."""
    some = np.flatnonzero(seed >= 0)
    out = np.full(len(nodes), -1)
    if len(some):
        own, n = tree.cluster_of(seed[some], leaves[some]), len(tree.parent)
        density = np.bincount(own, weights[some] / np.maximum(leaves[some], LEAST), n)
        out[some] = tree.chosen(np.bincount(own, weights[some], n), density)[own]
    return out


def _condensed(least: int):
    def condense(key, nodes, edges):
        number = {x: k for k, x in enumerate(nodes["node"].tolist())}
        ends = sorted((w, a, b) for a, b, w in zip(edges["a"].tolist(), edges["b"].tolist(), edges["w"].tolist()))
        ends = [(w, number[a], number[b]) for w, a, b in ends]
        weights = nodes["weight"].to_numpy()
        seed, leaves, births, between = _contracted(weights, nodes["core"].to_numpy(), ends, least)
        label = _labelled(nodes["node"].to_numpy(), weights, seed, leaves, Hierarchy(births, between))
        return pd.DataFrame({"level": key[0], "node": nodes["node"], "label": label})

    return condense


def _by_rounds(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """As ``_contracted`` and ``_labelled`` for levels that no task holds: in every round, parts under
    the least size go along their least edge into a large one, or meet one whose least edge it is too."""
    spark = nodes.sparkSession
    place = nodes.select("level", "node", "weight", F.col("node").alias("part"), F.when(F.col("weight") >= least, F.col("core")).alias("leaves"))
    parts = materialised(nodes.select("level", F.col("node").alias("part"), F.col("weight").alias("size"), F.when(F.col("weight") >= least, F.col("core")).alias("birth")))
    edges = materialised(edges.select("level", "a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")))
    while True:
        ends = edges.select("level", F.col("a").alias("part"), F.col("b").alias("other"), "w", "x", "y").unionByName(edges.select("level", F.col("b").alias("part"), F.col("a").alias("other"), "w", "x", "y"))
        best = ends.groupBy("part").agg(F.min(F.struct("w", "x", "y", "other")).alias("e")).select("part", "e.w", "e.other")
        small = materialised(parts.filter("birth is null").join(best, "part").join(parts.select(F.col("part").alias("other"), F.col("size").alias("o_size"), F.col("birth").alias("o_birth")), "other"))
        if small.isEmpty():
            break
        back = small.select(F.col("part").alias("other"), F.col("other").alias("part"))
        pairs = small.filter("o_birth is null").join(back, ["part", "other"])
        moved = small.filter("o_birth is not null").select("part", F.col("other").alias("to"), "w", F.lit(True).alias("out"))
        met = pairs.select("part", F.least("part", "other").alias("to"), "w", (F.col("size") + F.col("o_size") >= least).alias("out"))
        moved = materialised(moved.unionByName(met))
        new = met.filter("part = to").select("part", "w", "out")
        sizes = parts.join(moved.select("part", "to"), "part", "left").groupBy("level", F.coalesce("to", "part").alias("part")).agg(F.sum("size").alias("size"), F.max("birth").alias("birth"))
        parts = materialised(sizes.join(new, "part", "left").select("level", "part", "size", F.when(F.col("out"), F.col("w")).otherwise(F.col("birth")).alias("birth")))
        place = materialised(place.join(moved, "part", "left").select("level", "node", "weight", F.coalesce("to", "part").alias("part"), F.coalesce("leaves", F.when(F.col("out"), F.col("w"))).alias("leaves")))
        to = lambda c: moved.select(F.col("part").alias(c), F.col("to").alias(f"to_{c}"))
        edges = materialised(edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select("level", F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "w", "x", "y").filter("a <> b"))
    place = materialised(place)
    seeds = parts.filter("birth is not null")
    many = seeds.limit(CLUSTERS + 1).count()
    if many > CLUSTERS:
        raise ValueError(f"more than {CLUSTERS} parts of {least} vectors: a larger least size is needed")
    trees, names = {}, {}
    for r in seeds.orderBy("level", "part").collect():  # CLUSTERS at most
        names.setdefault(r["level"], []).append((r["part"], r["birth"]))
    between: dict[str, list] = {}
    for r in edges.collect():  # fewer than the clusters
        between.setdefault(r["level"], []).append((r["w"], r["x"], r["y"], r["a"], r["b"]))
    for level, own in names.items():
        number = {p: k for k, (p, _) in enumerate(own)}
        trees[level] = ([p for p, _ in own], Hierarchy(np.array([b for _, b in own]), [(w, number[a], number[b]) for w, _, _, a, b in sorted(between.get(level, [])) if a in number and b in number]))
    shared = spark.sparkContext.broadcast({k: (np.array(p), t.parent, t.low) for k, (p, t) in trees.items()})

    def leave(batches):
        known = {}
        for batch in batches:
            for level, own in batch.groupby("level"):
                if level not in known:
                    names, parent, low = shared.value[level]
                    known[level] = names, _restored(parent, low)
                names, tree = known[level]
                yield own.assign(cluster=tree.cluster_of(np.searchsorted(names, own["part"].to_numpy()), own["leaves"].to_numpy()))[["level", "node", "weight", "leaves", "cluster"]]

    out = materialised(place.filter("leaves is not null").mapInPandas(leave, "level string, node long, weight long, leaves double, cluster long"))
    sums = out.groupBy("level", "cluster").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") / F.greatest(F.col("leaves"), F.lit(LEAST))).alias("density"))
    found: dict[str, list] = {}
    for r in sums.collect():  # a row a cluster
        found.setdefault(r["level"], []).append((r["cluster"], r["n"], r["density"]))
    labels = []
    for level, (_, tree) in trees.items():
        weight, density = np.zeros(len(tree.parent)), np.zeros(len(tree.parent))
        for k, n, d in found.get(level, []):
            weight[k], density[k] = n, d
        labels += [(level, k, int(x)) for k, x in enumerate(tree.chosen(weight, density)) if x >= 0]
    labels = spark.createDataFrame(labels, "level string, cluster long, label long")
    return place.select("level", "node").join(out.join(labels, ["level", "cluster"]).select("level", "node", "label"), ["level", "node"], "left").select("level", "node", F.coalesce("label", F.lit(-1)).alias("label"))


def _restored(parent: np.ndarray, low: np.ndarray) -> Hierarchy:
    """A hierarchy from its arrays: workers need no more."""
    tree = Hierarchy(np.zeros(0), [])
    tree.parent, tree.low = parent, low
    tree.jumps = [np.where(parent >= 0, parent, np.arange(len(parent)))]
    while (tree.jumps[-1][tree.jumps[-1]] != tree.jumps[-1]).any():
        tree.jumps.append(tree.jumps[-1][tree.jumps[-1]])
    return tree


def clusters(vectors: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """level, id, cluster and noise of vectors (level, id, vector): clusters are numbered by a member,
    and what is noise is a cluster of its own.  Vectors of one level only are compared; null ones are
    noise, shorter ones are followed by zeros."""
    least = max(2, min_cluster_size)
    key = F.coalesce(F.concat(F.lit("="), F.col("level").cast("string")), F.lit(""))
    rows = vectors.select("level", "id", key.alias("key"), F.expr("cast(vector as array<double>)").alias("vector"), F.xxhash64(key, F.col("id").cast("string")).alias("row"))
    wide = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = materialised(rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(max(1, wide)) - F.size("vector")))))
    nodes = materialised(rows.filter("vector is not null").groupBy("key", "vector").agg(F.min("row").alias("node"), F.count("*").alias("weight")))
    blocks = _with_cores(_blocks(nodes.select(F.col("key").alias("level"), "node", "weight", "vector"), block), min_samples or least)

    def cores(batches):
        for batch in batches:
            for row in batch.itertuples():
                b = _block_of(row)
                yield pd.DataFrame({"level": row.level, "node": b.nodes, "weight": b.weights, "core": b.cores})

    known = materialised(blocks.mapInPandas(cores, "level string, node long, weight long, core double"))
    edges = _tree(blocks)
    sizes = known.groupBy("level").agg(F.count("*").alias("n"))
    small, large = (sizes.filter(x).select("level") for x in (F.col("n") <= few, F.col("n") > few))
    of = lambda df, levels: df.join(levels, "level", "left_semi")
    found = of(known, small).groupBy("level").cogroup(of(edges, small).groupBy("level")).applyInPandas(_condensed(least), "level string, node long, label long")
    if not large.isEmpty():
        found = found.unionByName(_by_rounds(of(known, large), of(edges, large), least))
    found = found.filter("label >= 0")
    names = found.groupBy("level", "label").agg(F.min("node").alias("cluster"))
    named = nodes.select(F.col("key").alias("level"), "vector", "node").join(found, ["level", "node"]).join(names, ["level", "label"]).select(F.col("level").alias("key"), "vector", "cluster")
    out = rows.join(named, ["key", "vector"], "left")
    return out.select("level", "id", F.coalesce("cluster", "row").alias("cluster"), F.col("cluster").isNull().alias("noise"))
