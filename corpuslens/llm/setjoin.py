"""Exact Jaccard join of documents' shingle sets, by the relations between sets.

Equal sets are one node.  All sets follow one order of shingles, from the rarer to the more
frequent; two similar sets share a shingle in the first fifth of both (their prefixes), so the
prefixes are the index, a list of nodes for each shingle.

Answers are derived from those of a similar set: every list's members are compared with its
leader, and the exact overlaps with the leader (a) settle links, (b) bound the overlap of any two
members without reading them: min(x, z) + min(|X| - x, |Z| - z), for overlaps x and z with the
leader, (c) make members of one component need no answer of their own.  Lists that then still
hold several components get other leaders, each of whose answers in the list is then complete,
so it leaves the list; what is left is cut into blocks of members of like size and position, and
pairs of blocks are skipped when no size, position or component in them can give a new link.

The frequencies that give the order are counted over all documents, in a table of fixed size
(2^20 counts, broadcast) by the shingle's hash; any order gives the same links.

Defined results: null, empty and wordless texts have no shingles and link with nothing, not even
with each other; texts of fewer words than a shingle are one shingle; repeated rows are rows of
their own, in one component; null doc_ids count only where a component has no other; shingles are
64-bit hashes; an empty table gives no rows; other columns are ignored; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import Roller, mix, pack_plain, pack_sorted, text_blocks, unpack_plain, unpack_sorted
from ._spark import drop, held, kept, only
from .decontaminate import LOWER
from .graph import components
from .near_dedup import BROADCAST_NODES, _text_key, distinct_shingles, shingles

#: Sets link when SHARE[0] * overlap >= SHARE[1] * union.
SHARE = (100, 80)
BITS, RANGES = 20, 64
#: Cells of one range that are added up together, first; the sums of these make the second step.
SALTS = 1024
#: Prefix shingles of a chunk of nodes and of a shard of shingles, about; low bits that shingles go
#: without on the way to their shard, where they only tell which lists may have a second member.
CHUNK_SHINGLES, SHARD_SHINGLES, CUT_BITS = 500_000, 400_000, np.uint64(16)
#: Rounds with other leaders; the members of a block.
LEADERS, BLOCK = 3, 64
#: Members of one leader that a task compares, about.
MEMBERS = 64

_word = np.ones(256, dtype=bool)
_word[[0x20, *range(0x09, 0x0E)]] = False
NODE = ["node", "first_id", "h1", "h2", "size", "d1", "d2", "n", "least_id"]
CHUNK = "chunk long, rows array<struct<node:long,first_id:long,h1:long,h2:int,size:long,d1:long,d2:long,n:int,least_id:long>>, reach binary, prefixes binary"
SIGNED = "row long, doc_id long, h1 long, h2 int, size long, d1 long, d2 long, n int, prefix array<long>"


def sets_of(column: pa.Array, roller: Roller) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, distinct shingles, their rows) of consecutive texts."""
    for lo, hi, raw, offsets in text_blocks(column, 1 << 19):
        h, rows, _ = distinct_shingles(*shingles(LOWER[raw], offsets, roller, _word))
        yield lo, hi, h, rows


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the shingles of each place of the table occur in this task."""
    roller, counts = Roller(), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for _, _, h, _ in sets_of(batch.column("text"), roller):
            counts += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    cells = [(i, pack_plain(part.astype(np.uint64))) for i, part in enumerate(np.split(counts, RANGES)) if part.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cells], type=pa.int32()), pa.array([c for _, c in cells], type=pa.binary())], names=["part", "counts"])


def frequencies(docs: DataFrame) -> np.ndarray:
    """Occurrences of shingles by the first bits of their hash, over all documents."""

    def add(pdf):
        import pandas as pd

        total = np.zeros((1 << BITS) // RANGES, np.uint64)
        for cell in pdf["counts"]:
            total += unpack_plain(cell)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [pack_plain(total)]})

    cells = docs.select("text").mapInArrow(count_batches, "part int, counts binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    once = cells.groupBy("part", "salt").applyInPandas(add, "part int, counts binary")
    out = np.zeros(1 << BITS, np.uint64)
    for r in once.groupBy("part").applyInPandas(add, "part int, counts binary").collect():  # 2^20 counts at most
        size = (1 << BITS) // RANGES
        out[r["part"] * size : (r["part"] + 1) * size] = unpack_plain(r["counts"])
    return out


def sign_batches(batches: Iterator[pa.RecordBatch], shared, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Each text's set: its digest, size and prefix."""
    roller, counts = Roller(), shared.value
    names = ["row", "doc_id", "h1", "h2", "size"]
    for batch in batches:
        for lo, hi, h, rows in sets_of(batch.column("text"), roller):
            n = np.bincount(rows, minlength=hi - lo)
            first = np.concatenate([[0], np.cumsum(n)])
            digests = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)), dtype=np.uint64)])
                digests.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            order = np.lexsort((h, counts[(h >> np.uint64(64 - BITS)).astype(np.int64)], rows))
            reach = np.where(n > 0, n - -(-n * share[1] // share[0]) + 1, 0)
            inside = order[np.arange(len(h)) - first[rows] < reach[rows]]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(reach)]).astype(np.int32)), pa.array(h[inside].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in names], *map(pa.array, digests), pa.array(n.astype(np.int32)), prefix], names=[*names, "d1", "d2", "n", "prefix"])


def chunk_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Nodes in chunks, a row each, named by their first node: their columns, and all prefixes."""
    for batch in batches:
        prefix = batch.column("prefix")
        at = np.concatenate([[0], np.cumsum(np.asarray(prefix.value_lengths()))])
        rows = pa.StructArray.from_arrays([batch.column(c) for c in NODE], names=NODE)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            own = np.asarray(prefix.slice(lo, hi - lo).flatten())
            part = rows.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, 1), pa.ListArray.from_arrays(pa.array([0, hi - lo], type=pa.int32()), pa.concat_arrays([part])), pa.array([np.diff(at[lo : hi + 1]).astype(np.int32).tobytes()], type=pa.binary()), pa.array([own.tobytes()], type=pa.binary())], names=["chunk", "rows", "reach", "prefixes"])
            lo = hi


def ask_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The distinct prefix shingles of every chunk, by shard of the hash."""
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("prefixes")):
            keys = np.unique(np.frombuffer(blob.as_buffer(), np.uint64) >> CUT_BITS)
            edges = np.searchsorted(keys >> (np.uint64(64 - bits) - CUT_BITS), np.arange((1 << bits) + 1, dtype=np.uint64))
            cells = [(k, pack_sorted(keys[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cells], type=pa.int32()), pa.array([chunk] * len(cells), type=pa.int64()), pa.array([x for _, x in cells], type=pa.binary())], names=["shard", "chunk", "keys"])


def _several(pdf):
    """To every chunk those of its shingles in this shard that other chunks have too."""
    import pandas as pd

    own = [unpack_sorted(x) for x in pdf["keys"]]
    keys, counts = np.unique(np.concatenate(own), return_counts=True)
    keys = keys[counts > 1]
    hits = [x[keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x] if len(keys) else x[:0] for x in own]
    return pd.DataFrame([(c, pack_sorted(x)) for c, x in zip(pdf["chunk"], hits) if len(x)], columns=["chunk", "hits"])


def list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, node, n and pos of the prefix shingles that may be another node's too."""
    for batch in batches:
        for rows, reach, blob, told in zip(batch.column("rows"), batch.column("reach"), batch.column("prefixes"), batch.column("told").to_pylist()):
            token, reach = np.frombuffer(blob.as_buffer(), np.uint64), np.frombuffer(reach.as_buffer(), np.int32)
            keys, where, counts = np.unique(token >> CUT_BITS, return_inverse=True, return_counts=True)
            shared = counts > 1
            for hits in map(unpack_sorted, told or []):
                shared[np.searchsorted(keys, hits)] = True
            own = np.repeat(np.arange(len(reach)), reach)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(reach) - reach, reach)
            keep = shared[where]
            fields = rows.values
            node, n = (np.asarray(fields.field(c)) for c in ("node", "n"))
            own = own[keep]
            yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(node[own]), pa.array(n[own]), pa.array(pos[keep].astype(np.int32))], names=["token", "node", "n", "pos"])


def send_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each asked node's whole set, to every leader that it is compared with, itself among them."""
    roller, seen = Roller(), set()
    for batch in batches:
        nodes, to = batch.column("node").to_pylist(), batch.column("to").to_pylist()
        for lo, hi, h, rows in sets_of(batch.column("text"), roller):
            edges, out = np.searchsorted(rows, np.arange(hi - lo + 1)), []
            for k in range(lo, hi):
                if nodes[k] not in seen:  # a repeated row asks nothing new
                    seen.add(nodes[k])
                    items = h[edges[k - lo] : edges[k - lo + 1]].tobytes()
                    out += [(x["a"], salt, nodes[k], items) for x in to[k] for salt in (range(x["salts"]) if x["a"] == nodes[k] else [nodes[k] % x["salts"]])]
            columns = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["a", "salt", "b", "items"])


def overlap_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and overlaps of members with their leaders, which come before them."""
    leader, items, before = None, np.zeros(0, np.uint64), None
    for batch in batches:
        out = []
        for a, b, blob in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("items")):
            own = np.frombuffer(blob.as_buffer(), np.uint64)
            if a == b:
                leader, items = a, own
            elif a == leader and (a, b) != before:
                out.append((a, b, len(items), len(own), len(np.intersect1d(items, own, assume_unique=True))))
            before = a, b
        columns = zip(*out) if out else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["a", "b", "an", "bn", "both"])


def _enough(both: Column, n: Column, m: Column, share: tuple[int, int]) -> Column:
    """Whether an overlap makes sets of these sizes link (or, for a bound, can)."""
    return both.cast("long") * sum(share) >= share[1] * (n.cast("long") + m)


def _can_link(n: Column, pos: Column, m: Column, at: Column, share: tuple[int, int]) -> Column:
    """By sizes and places in the lists: the first common shingle of two sets passes this."""
    return (share[0] * F.least(n, m) >= share[1] * F.greatest(n, m)) & _enough(F.least(n - pos, m - at), n, m, share)


def shingle_join(docs: DataFrame, share: tuple[int, int] = SHARE, leaders: int = LEADERS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text)
    counts = docs.sparkSession.sparkContext.broadcast(frequencies(docs))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *_text_key(F.col("text")), "text")
    signed = kept(rows.mapInArrow(lambda batches: sign_batches(batches, counts, share), SIGNED))
    key = ["d1", "d2", "n"]
    nodes = signed.filter("n > 0").groupBy(*key).agg(F.min(F.struct("row", "doc_id", "h1", "h2", "size")).alias("f"), F.min("doc_id").alias("least_id"), F.first("prefix").alias("prefix"))
    nodes = nodes.select(F.col("f.row").alias("node"), F.col("f.doc_id").alias("first_id"), "f.h1", "f.h2", "f.size", *key, "least_id", "prefix")
    chunks = held(nodes.mapInArrow(lambda batches: chunk_batches(batches, CHUNK_SHINGLES), CHUNK))
    nodes = kept(chunks.select(F.explode("rows").alias("r")).select("r.*"))
    lists = _lists(chunks)
    shared = lists.groupBy("token").agg(F.min(F.struct("node", "n", "pos")).alias("l"), F.count("*").alias("members")).filter("members > 1").select("token", "l")
    every, lists = lists, kept(lists.join(shared, "token"))
    drop(every, chunks)
    texts = nodes.select("node", "first_id", "h1", "h2", "size")

    # Answers of the leaders.
    first = lists.filter(F.col("node") != F.col("l.node")).filter(_can_link(F.col("n"), F.col("pos"), F.col("l.n"), F.col("l.pos"), share))
    answers = _answers(first.select(F.col("l.node").alias("a"), F.col("node").alias("b")), texts, docs)
    is_link = _enough(F.col("both"), F.col("an"), F.col("bn"), share)
    links = answers.filter(is_link).select("a", "b")
    classes = components(links)

    # Lists of several components: what members have in common with the leader bounds the rest.
    known = answers.select(F.col("a").alias("lead"), F.col("b").alias("node"), "both")
    left = lists.select("token", "node", "n", "pos", F.col("l.node").alias("lead"))
    left = kept(_of_several(left, classes).join(_light(known), ["lead", "node"], "left").filter("node <> lead").drop("lead"))
    drop(lists)
    for turn in range(leaders):
        left = _narrowed(left, classes)
        if left.isEmpty():
            break
        lead = left.groupBy("token").agg(F.min_by(F.struct("node", "n", "pos", "root", "both"), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("l"))
        stars = left.join(lead, "token").filter(F.col("node") != F.col("l.node"))
        asked = stars.filter(_open("l.", share)).select(F.col("l.node").alias("a"), F.col("node").alias("b"))
        more = _answers(asked, texts, docs).filter(is_link).select("a", "b")
        before, left = left, kept(stars.drop("l"))
        drop(before)
        if not more.isEmpty():
            links = kept(links.unionByName(more))
            classes = components(links)
    left = _narrowed(left, classes)
    if not left.isEmpty():
        more = _answers(_block_pairs(left, share, block), texts, docs).filter(is_link).select("a", "b")
        if not more.isEmpty():
            links = kept(links.unionByName(more))
            classes = components(links)

    roots = nodes.join(classes, "node", "left").select(*key, "least_id", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    roots = roots.join(least, "root").select(*key, "component_id")
    out = signed.select("doc_id", *key).join(roots, key, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _lists(chunks: DataFrame) -> DataFrame:
    """The prefix index without most of the lists of one member: shards see each chunk's distinct
    shingles, packed, and tell it which of them other chunks have."""
    total = chunks.agg(F.sum(F.octet_length("prefixes") / 8)).first()[0] or 0
    bits = max(2, int(np.ceil(np.log2(max(1, total / SHARD_SHINGLES)))))
    asked = chunks.select("chunk", "prefixes").mapInArrow(lambda batches: ask_batches(batches, bits), "shard int, chunk long, keys binary")
    told = asked.groupBy("shard").applyInPandas(_several, "chunk long, hits binary").groupBy("chunk").agg(F.collect_list("hits").alias("told"))
    return held(chunks.join(told, "chunk", "left").mapInArrow(list_batches, "token long, node long, n int, pos int"))


def _open(other: str, share: tuple[int, int]) -> Column:
    """Whether a member and another (columns with a prefix) may link and are not yet connected."""
    n, m, x, z = F.col("n"), F.col(f"{other}n"), F.col("both"), F.col(f"{other}both")
    bound = F.coalesce(F.least(x, z) + F.least(n - x, m - z), F.least(n, m))
    return (F.col("root") != F.col(f"{other}root")) & _can_link(n, F.col("pos"), m, F.col(f"{other}pos"), share) & _enough(bound, n, m, share)


def _light(rows: DataFrame) -> DataFrame:
    """A table of a few numbers a row, for a broadcast if its number of rows, checked, allows that."""
    return F.broadcast(rows) if rows.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else rows


def _of_several(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of lists that hold more than one component, with their roots."""
    rooted = lists.join(_light(classes), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    return rooted.join(several, "token")


def _narrowed(left: DataFrame, classes: DataFrame) -> DataFrame:
    """The lists that still hold several components, in a table of their own."""
    out = kept(_of_several(left.drop("root"), classes))
    drop(left)
    return out


def _block_pairs(left: DataFrame, share: tuple[int, int], block: int) -> DataFrame:
    """Pairs of members of a list, by blocks of members of like size and position."""
    # A size class spans a factor of 1 / similarity, a position class a quarter of a prefix.
    size = F.floor(F.log("n") / F.log(F.lit(share[0] / share[1])))
    place = F.floor(4 * F.col("pos") / (F.col("n") - F.ceil(F.col("n") * share[1] / share[0]) + 1))
    classed = left.select("*", size.cast("int").alias("kind"), place.cast("int").alias("place"))
    many = classed.groupBy("token", "kind", "place").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    member = kept(classed.join(many, ["token", "kind", "place"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks"))
    by = ["token", "kind", "place", "part"]
    blocks = kept(member.groupBy(*by).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("root").alias("r0"), F.max("root").alias("r1")))
    name = F.struct("kind", "place", "part")
    one, two = (blocks.select("token", name.alias(f"block{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("low", "high", "rest", "r0", "r1")]) for i in "12")
    low, rest = F.col("low1") + F.col("low2"), F.least("rest1", "rest2")
    near = (F.col("high1") * share[0] >= F.col("low2") * share[1]) & (F.col("high2") * share[0] >= F.col("low1") * share[1])
    several = (F.least("r01", "r02") < F.greatest("r11", "r12"))
    asked = one.join(two, "token").filter((F.col("block1") <= F.col("block2")) & near & several & (rest * sum(share) >= low * share[1])).select("token", "block1", "block2")
    mine = member.select("token", name.alias("block1"), "node", "n", "pos", "root", "both")
    yours = member.select("token", name.alias("block2"), F.struct("node", "n", "pos", "root", "both").alias("o"))
    pairs = asked.join(mine, ["token", "block1"]).join(yours, ["token", "block2"])
    pairs = pairs.filter(((F.col("block1") < F.col("block2")) | (F.col("node") < F.col("o.node"))) & _open("o.", share))
    return pairs.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"))


def _answers(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The overlaps of the pairs' whole sets, each pair once: members go to their leader ``a``, at
    most about ``MEMBERS`` of one leader to a task."""
    pairs = kept(pairs.select("a", "b").distinct())
    leaders = kept(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")))
    asks = pairs.join(leaders, "a").select(F.col("b").alias("node"), F.struct("a", "salts").alias("to")).unionByName(leaders.select(F.col("a").alias("node"), F.struct("a", "salts").alias("to")))
    asks = asks.groupBy("node").agg(F.collect_list("to").alias("to"))  # at most a leader for each shingle of its prefix
    wanted = kept(texts.join(asks, "node").select("node", F.coalesce("first_id", F.lit(-1 << 63)).alias("id"), "h1", "h2", "size", "to"))
    # Few enough to broadcast, by a check of their number; else the texts are shuffled.
    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    keyed = docs.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), *_text_key(F.col("text")), "text")
    sent = keyed.join(keys, ["id", "h1", "h2", "size"]).select("node", "to", "text").mapInArrow(send_batches, "a long, salt int, b long, items binary")
    met = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b"), "b")
    out = kept(met.mapInArrow(overlap_batches, "a long, b long, an int, bn int, both int"))
    drop(pairs, leaders, wanted)
    return out
