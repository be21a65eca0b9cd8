"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Pieces are dealt at random into blocks; several islands evolve packings of each block from
best-fit starts in decreasing and in random order.  A crossover injects whole well-filled
sequences of one parent into another, dissolves the sequences that then hold a piece twice,
and best-fits the displaced pieces.  Elites migrate around the ring of a block's islands
between epochs.  Sequences filled well are kept; the pieces of all others are dealt anew
for the next round.  A block whose best packing has no more sequences than its tokens need
has nothing to evolve.

Defined results: null and empty texts are one piece, the end-of-text id alone; repeated
and null doc_ids each give pieces of their own; equal lengths are dealt by piece number; an
empty table gives no rows; other columns are ignored.  Whole texts are tokenised, whatever
their length.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import kept, only
from ._tokens import worker_ids

CAPACITY, END_ID = 2048, 0
BLOCK_ITEMS, ISLANDS, EPOCHS = 4096, 2, 3
#: Packings on an island, children bred in an epoch, and children without progress that end it.
POPULATION, CHILDREN, PATIENCE = 8, 80, 24
#: A sequence with at most so many free places is kept; the others are dealt anew.
WELL_FILLED, ROUNDS = 4, 3
PIECES = "pid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "block long, island int, n_bins int, pids array<long>, lengths array<int>, bins array<int>"


def cut_pieces(batches: Iterator[pa.RecordBatch], tokenizer_path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces of every text; pid is the number of the task's first row plus the pieces before."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ids, pid, end = None, None, end_id.to_bytes(4, "little")
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        if batch.num_rows:
            ids = ids or worker_ids(tokenizer_path)
            # Row numbers hold the task's number above 33 bits, so pieces of tasks never meet.
            pid = batch.column("row")[0].as_py() >> 33 << 33 if pid is None else pid
        for doc, own in zip(batch.column("doc_id").to_pylist(), ids.batch(batch.column("text")) if ids else ()):
            own = own.tobytes() + end
            n = len(own) // 4
            first = n if n <= capacity else n % capacity or capacity
            a = 0
            for k, b in enumerate(range(first, n + 1, capacity)):
                for col, x in zip(out, (pid, doc, k, a, b - a, zlib.crc32(own[4 * a : 4 * b]))):
                    col.append(x)
                pid, a = pid + 1, b
        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, types)], names=["pid", "doc_id", "piece", "start", "length", "ids_crc32"])


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and id checksum of every piece; only the first may be short."""
    rows = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda batches: cut_pieces(batches, tokenizer_path, capacity, end_id), PIECES)


class Packing:
    """Sequences under way: pieces of each, and which have how many free places."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins, self.free, self.by_free, self.mask = capacity, [], [], {}, 0

    def open(self, items: list[int], free: int) -> None:
        self.bins.append(items)
        self.free.append(free)
        self._note(len(self.bins) - 1, free)

    def _note(self, b: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(b)
            self.mask |= 1 << free

    def best_fit(self, item: int, length: int) -> None:
        """Into the sequence that it fills best, or into a new one."""
        rest = self.mask >> length
        if not rest:
            self.open([item], self.capacity - length)
            return
        free = length + (rest & -rest).bit_length() - 1
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.bins[b].append(item)
        self.free[b] = free - length
        self._note(b, free - length)


def best_fit(order, lengths: list[int], capacity: int, bins=()) -> Packing:
    """The pieces one by one, each where it fits best, beside the sequences given."""
    out = Packing(capacity)
    for items, free in bins:
        out.open(list(items), free)
    for i in order:
        out.best_fit(i, lengths[i])
    return out


def fitness(p: Packing) -> tuple[int, float]:
    """Fewer sequences are better; then fuller ones beside emptier ones."""
    return len(p.bins), -sum(((p.capacity - f) / p.capacity) ** 4 for f in p.free)


def crossover(rng: random.Random, giver: Packing, taker: Packing, lengths: list[int]) -> Packing:
    """Whole well-filled sequences of the giver, what they leave whole of the taker's fuller
    sequences, and the displaced pieces best-fitted beside them."""
    full = sorted(range(len(giver.bins)), key=lambda b: giver.free[b])[: max(1, len(giver.bins) // 2)]
    edge = rng.randrange(len(full))
    injected = [b for k, b in enumerate(full) if giver.free[b] <= WELL_FILLED and rng.random() < 0.7 or k <= edge and rng.random() < 0.5]
    there = {i for b in injected for i in giver.bins[b]}
    bins, displaced = [(giver.bins[b], giver.free[b]) for b in injected], []
    loose = sorted(taker.free)[len(taker.free) * 3 // 4]
    for items, free in zip(taker.bins, taker.free):
        if there.isdisjoint(items) and (free <= WELL_FILLED or free < loose or rng.random() < 0.5):
            bins.append((items, free))
        else:
            displaced += [i for i in items if i not in there]
    spread = rng.choice((0.0, 0.1, 0.5, 1.0))
    displaced.sort(key=lambda i: -lengths[i] * (1 - spread * rng.random()))
    return best_fit(displaced, lengths, giver.capacity, bins)


def _packing(bins: list[int], lengths: list[int], capacity: int) -> Packing:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        groups.setdefault(b, []).append(i)
    return best_fit((), lengths, capacity, [(g, capacity - sum(lengths[i] for i in g)) for g in groups.values()])


def evolve(seed: int, lengths: list[int], capacity: int, elites: list[list[int]], children: int = CHILDREN) -> list[int]:
    """The sequence number of each piece, in the best packing that an island finds."""
    rng = random.Random(seed)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    population = [_packing(bins, lengths, capacity) for bins in elites] or [best_fit(order, lengths, capacity)]
    least = -(-sum(lengths) // capacity)
    if min(len(p.bins) for p in population) > least:
        while len(population) < POPULATION:
            spread = rng.choice((0.1, 0.3, 1.0))
            population.append(best_fit(sorted(order, key=lambda i: -lengths[i] * (1 - spread * rng.random())), lengths, capacity))
    population.sort(key=fitness)
    idle = 0
    for _ in range(children):
        if len(population[0].bins) <= least or idle >= PATIENCE or len(population) < 2:
            break
        a, b = sorted(rng.sample(range(len(population)), 2))
        child = crossover(rng, *((population[a], population[b]) if rng.random() < 0.5 else (population[b], population[a])), lengths)
        idle = 0 if fitness(child) < fitness(population[0]) else idle + 1
        if all(fitness(child) != fitness(p) for p in population) and fitness(child) < fitness(population[-1]):
            population[-1] = child
            population.sort(key=fitness)
    out = [0] * len(lengths)
    for b, items in enumerate(population[0].bins):
        for i in items:
            out[i] = b
    return out


def island_epoch(capacity: int, epoch: int):
    """One epoch of one island: its block's pieces, and the elites that came to it."""

    def step(pdf):
        import pandas as pd

        row = pdf.iloc[0]
        lengths = [int(x) for x in row["lengths"]]
        seed = (int(row["block"]) * 64 + int(row["island"])) * 64 + epoch
        bins = evolve(seed, lengths, capacity, [[int(b) for b in x] for x in pdf["bins"] if x is not None and len(x)])
        return pd.DataFrame({"block": [row["block"]], "island": [row["island"]], "n_bins": [max(bins) + 1], "pids": [row["pids"]], "lengths": [lengths], "bins": [bins]})

    return step


def placed(batches: Iterator[pa.RecordBatch], capacity: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Sequence and offset of every piece; of those in sequences to deal anew, sequence -1."""
    for batch in batches:
        for block, pids, lengths, bins in zip(*[batch.column(c) for c in ("block", "pids", "lengths", "bins")]):
            pid, n, b = (np.asarray(x.values, dtype=np.int64) for x in (pids, lengths, bins))
            order = np.argsort(b, kind="stable")
            pid, n, b = pid[order], n[order], b[order]
            fill = np.bincount(b, weights=n).astype(np.int64)
            at = np.cumsum(n) - n
            at -= (np.cumsum(fill) - fill)[b]
            stays = np.full(len(b), True) if last else (capacity - fill <= WELL_FILLED)[b]
            yield pa.RecordBatch.from_arrays([pa.array(pid), pa.array(n), pa.array(np.where(stays, (block.as_py() << 20) + b, -1)), pa.array(at)], names=["pid", "length", "bin", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """pid, sequence_id and offset of every piece (pid, length), lengths up to ``capacity``."""
    full = pieces.filter(F.col("length") == capacity).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, outs = pieces.filter(F.col("length") < capacity).select("pid", F.col("length").cast("long")), [full]
    for k in range(rounds):
        n = left.count()
        if not n:
            break
        last, blocks = k + 1 == rounds or n <= block_items // 8, max(1, round(n / block_items))
        grouped = left.groupBy(F.pmod(F.xxhash64("pid", F.lit(k)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pid", "length"))).alias("x"))
        state = grouped.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).alias("n_bins"), F.col("x.pid").alias("pids"), F.col("x.length").cast("array<int>").alias("lengths"), F.array().cast("array<int>").alias("bins"))
        for epoch in range(EPOCHS):
            if epoch:  # every island's elite also goes to the next island of its ring
                state = state.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
            state = state.groupBy("block", "island").applyInPandas(island_epoch(capacity, epoch), PLAN)
        best = state.groupBy("block").agg(F.min_by(F.struct("pids", "lengths", "bins"), F.struct("n_bins", "island")).alias("b")).select("block", "b.*")
        done = kept(best.mapInArrow(lambda batches, last=last: placed(batches, capacity, last), "pid long, length long, bin long, offset long"))
        outs.append(done.filter("bin >= 0").select("pid", (F.col("bin") + F.lit(k << 58)).alias("sequence_id"), "offset"))
        left = done.filter("bin < 0").select("pid", "length")
        if last:
            break
    out = outs[0]
    for x in outs[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    pieces = kept(tokenise(docs, tokenizer_path, capacity, end_id))
    return pieces.join(pack(pieces, capacity), "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
