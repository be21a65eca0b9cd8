"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

Equal texts are one class from the start.  Weighted samples of each text's shingles form
bands; texts that share a band are candidates; candidates are verified by the weighted
Jaccard similarity of their whole texts; components of the verified links are the classes.
A band's members are compared with its smallest first.  Where a band then still holds
different classes, all its members are compared if they are few; if they are many, they
are joined exactly by their rarest shingles, of which similar texts must share one: first
each with a neighbour in changing orders, as long as that unites classes, then all that are
still of different classes.  Both ways give the same links; a link is missed only if two
texts share no band at all, which at a similarity of 0.8 happens to two pairs in ten thousand.

The weight of a shingle is its count times log(1 + N / (N + df)): smoothed so that copies
of a widespread text still resemble each other.  Document frequencies are counted over all
documents; those under ``COMMON`` of the documents change a weight by less than that share
and are taken as none, so the table of common shingles is bounded by 1 / COMMON texts.

Defined results: null, empty and wordless texts are each a class of their own, but equal
wordless texts that are not empty are one class; texts of up to five words are one shingle;
repeated doc_ids are rows of their own; of equal doc_ids and texts any one row stays, and ties
between texts of one doc_id go to the row that comes first; an empty table gives no rows; other
columns are ignored; whole texts are compared, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import BYTE_CODES, Roller, find_words, mix, pack_plain, pack_sorted, text_blocks, unpack_plain, unpack_sorted, window_hashes
from ._spark import drop, held, kept, only
from .decontaminate import IS_WORD
from .graph import components
from .toxicity import _lowered

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
COMMON = 0.01
#: Documents to each shard of the frequency count, about.
SHARD_DOCS = 2_000
#: Members of a mixed band up to which all its pairs are compared.
SMALL_BAND = 8
#: Texts to fetch whose keys are broadcast, 40 bytes each; more are fetched by a shuffle.
BROADCAST_NODES = 500_000
TABLE_BITS = 16

#: Neighbours in an order that a member is compared with, round after round as long as so large
#: a part of the pairs are links; then all that are left are compared.
BESIDE, FRUITFUL = 32, 0.02

SIGNED = "row long, doc_id long, h1 long, h2 int, size long, bands array<long>"


def shingles(raw: np.ndarray, offsets: np.ndarray, roller: Roller, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all shingles, by row."""
    start, end, row = find_words(raw, offsets, is_word)
    words = roller.stretch(roller.prefix(BYTE_CODES[raw]), start, end)
    h = window_hashes(words, WORDS)
    inside = row[: len(h)] == row[WORDS - 1 :] if len(h) else np.zeros(0, dtype=bool)
    out, rows = [h[inside]], [row[: len(h)][inside]]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    for n in range(1, WORDS):
        short = np.flatnonzero(counts == n)
        if len(short):
            out.append(window_hashes(words, n)[firsts[short]])
            rows.append(short)
    h, rows = np.concatenate(out), np.concatenate(rows)
    order = np.lexsort((h, rows))
    return h[order], rows[order]


def distinct_shingles(h: np.ndarray, rows: np.ndarray):
    """Without repeats in a row, and how often each was there."""
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return h[at], rows[at], np.diff(np.append(at, len(h)))


def count_documents(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Packed shingles and their document counts, by shard of the hash."""
    roller, held, size = Roller(), [], 0

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.searchsorted(shard, np.arange((1 << bits) + 1))
        cells = [(s, pack_sorted(keys[a:b] >> np.uint64(20)), pack_plain(counts[a:b].astype(np.uint64))) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], type=pa.int32()), pa.array([c[1] for c in cells], type=pa.binary()), pa.array([c[2] for c in cells], type=pa.binary())], names=["shard", "keys", "counts"])

    for part in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
        for _, _, raw, offsets in text_blocks(_lowered(part.column("text")), 1 << 19):
            h, _, _ = distinct_shingles(*shingles(raw, offsets, roller))
            held.append(h)
            size += len(h)
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def common_shingles(docs: DataFrame, n: int) -> dict[str, np.ndarray]:
    """Shingles of at least ``COMMON`` of the documents: hash without its low bits, count."""
    bits = max(3, math.ceil(math.log2(max(1, n / SHARD_DOCS))))
    least = max(2, COMMON * n)

    def merge(pdf):
        import pandas as pd

        keys = np.concatenate([unpack_sorted(x) for x in pdf["keys"]])
        counts = np.concatenate([unpack_plain(x) for x in pdf["counts"]])
        keys, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, weights=counts).astype(np.int64)
        many = total >= least
        return pd.DataFrame({"key": keys[many].astype(np.int64), "df": total[many]})

    cells = docs.select("text").mapInArrow(lambda batches: count_documents(batches, bits), "shard int, keys binary, counts binary")
    found = cells.groupBy("shard").applyInPandas(merge, "key long, df long").collect()  # at most texts' shingles / COMMON
    found = sorted((r["key"], r["df"]) for r in found)
    return {"keys": np.array([k for k, _ in found], dtype=np.uint64), "idf": np.array([math.log(1 + n / (n + d)) for _, d in found])}


def weights(h: np.ndarray, counts: np.ndarray, common: dict[str, np.ndarray]) -> np.ndarray:
    idf = np.full(len(h), math.log(2.0))
    if len(common["keys"]) and len(h):
        short = h >> np.uint64(20)
        at = np.minimum(np.searchsorted(common["keys"], short), len(common["keys"]) - 1)
        hit = common["keys"][at] == short
        idf[hit] = common["idf"][at[hit]]
    return counts * idf


class Sampler:
    """Consistent weighted samples; the variates of (shingle, sample) come from a fixed table."""

    def __init__(self) -> None:
        g = np.random.Generator(np.random.PCG64(7))
        n = 1 << TABLE_BITS
        self.r, self.log_c, self.beta = g.gamma(2.0, 1.0, n), np.log(g.gamma(2.0, 1.0, n)), g.random(n)
        self.odd = g.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.usual = math.log(math.log(2.0))
        self.usual_t, self.usual_a = self._draw(np.full(n, self.usual), np.arange(n))

    def _draw(self, log_w: np.ndarray, at: np.ndarray):
        r, beta = self.r[at], self.beta[at]
        t = np.floor(log_w / r + beta)
        return t.astype(np.int64), (self.log_c[at] - r * (t - beta) - r).astype(np.float32)

    def samples(self, h: np.ndarray, rows: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of n rows and each sample a number for (shingle, t); rows without shingles are masked."""
        counts = np.bincount(rows, minlength=n)
        some = np.flatnonzero(counts)
        out = np.zeros((n, len(self.odd)), dtype=np.int32)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(counts[some])])[:-1]
            log_w = np.log(w)
            odd_ones = np.flatnonzero(np.abs(log_w - self.usual) > 1e-12)
            shift = np.uint64(64 - TABLE_BITS)
            for k, q in enumerate(self.odd):
                at = ((h * q) >> shift).astype(np.int64)
                a = self.usual_a[at]
                if len(odd_ones):
                    t_odd, a[odd_ones] = self._draw(log_w[odd_ones], at[odd_ones])
                low = np.minimum.reduceat(a, starts)
                hit = np.flatnonzero(a == np.repeat(low, counts[some]))
                hit = hit[np.searchsorted(hit, starts)]
                t = self.usual_t[at[hit]]
                if len(odd_ones):
                    place = np.minimum(np.searchsorted(odd_ones, hit), len(odd_ones) - 1)
                    own = odd_ones[place] == hit
                    t[own] = t_odd[place[own]]
                out[some, k] = (mix(h[hit] + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return out, counts > 0


def sign_batches(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    roller, sampler, known = Roller(), Sampler(), common.value
    for batch in batches:
        bands = []
        for lo, hi, raw, offsets in text_blocks(_lowered(batch.column("text")), 1 << 19):
            h, rows, counts = distinct_shingles(*shingles(raw, offsets, roller))
            out, some = sampler.samples(h, rows, weights(h, counts, known), hi - lo)
            key = np.zeros((hi - lo, BANDS), dtype=np.uint64)
            for j in range(ROWS):
                key = mix(key + out[:, j::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            bands += [x if ok else None for x, ok in zip(key.view(np.int64), some)]
        names = ["row", "doc_id", "h1", "h2", "size"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(bands, type=pa.list_(pa.int64()))], names=[*names, "bands"])


def similarities(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of the two whole texts of each pair."""
    roller, known, memory = Roller(), common.value, {}

    def vector(key: int, text: str):
        if key not in memory:
            if len(memory) > 256:
                memory.clear()
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            h, _, counts = distinct_shingles(*shingles(raw, np.array([0, len(raw)]), roller))
            memory[key] = h, weights(h, counts, known)
        return memory[key]

    for batch in batches:
        low = [_lowered(batch.column(c)) for c in ("text_a", "text_b")]
        out = []
        for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), *low):
            (h, w), (g, v) = vector(a, x.as_py()), vector(b, y.as_py())
            _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
            both = np.minimum(w[i], v[j]).sum()
            out.append(float(both / (w.sum() + v.sum() - both)) if len(h) and len(g) else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "similarity"])


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.octet_length(text).cast("long").alias("size")]


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), copies in the class, and whether
    the row is the one of its class that stays."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text)
    n = docs.count()
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, n))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *_text_key(F.col("text")), "text")
    signed = kept(rows.mapInArrow(lambda batches: sign_batches(batches, common), SIGNED))
    key = ["h1", "h2", "size"]
    texts = signed.filter("size > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("bands").alias("bands"))
    texts = kept(texts.select(F.col("first.row").alias("node"), F.col("first.doc_id").alias("first_id"), *key, "bands"))
    in_bands = held(texts.filter("bands is not null").select(F.explode("bands").alias("band"), "node"))
    texts = texts.drop("bands")
    shared = in_bands.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # What later steps build on is written, not held: a plan over held tables repeats theirs, and the
    # driver keeps the plans of all that was run.
    in_bands, each = kept(in_bands.join(shared, "band")), in_bands
    drop(each)
    pairs = in_bands.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    verify = lambda pairs: _verified(pairs, texts, docs, common, similarity)
    links = verify(pairs)
    classes = components(links)
    # Bands that still join different classes: small ones pair by pair; the members of large
    # ones exactly, by the rare shingles that similar texts must share.
    mixed = kept(_mixed(in_bands, classes))
    drop(in_bands)
    pairs = _pairs_across(mixed.filter(F.col("n") <= SMALL_BAND))
    crowd = kept(mixed.filter(F.col("n") > SMALL_BAND).select("node").distinct())
    more = verify(pairs.distinct())
    drop(mixed)
    if not crowd.isEmpty():
        keys = _keys_of(crowd, texts)
        crowd_texts = _texts_of(keys, docs)
        drop(keys)
        rare = kept(_prefixes(crowd_texts, common, similarity))
        star = rare.groupBy("band").agg(F.min_by(F.struct("node", "total", "rest"), "node").alias("l"))
        near = lambda total, rest: F.least("rest", rest) >= (similarity / (1 + similarity) - 1e-9) * (F.col("total") + total)
        stars = rare.join(star, "band").filter((F.col("node") != F.col("l.node")) & near(F.col("l.total"), F.col("l.rest"))).select(F.col("l.node").alias("a"), F.col("node").alias("b"))
        more = more.unionByName(kept(_compared(stars.distinct(), crowd_texts, common, similarity)))
        roots, turn = kept(crowd.join(classes, "node", "left").select("node", F.coalesce("root", "node").alias("root"))), 0
        drop(crowd)
        found = more
        while True:
            roots = _united(roots, found)
            left = held(_mixed(rare, roots))
            beside = held(_beside(left, turn, near).distinct())
            found, turn = kept(_compared(beside, crowd_texts, common, similarity)), turn + 1
            more = more.unionByName(found)
            fruitless = found.count() <= FRUITFUL * beside.count()
            drop(left, beside)
            if fruitless:
                break
        roots = _united(roots, found)
        left = held(_mixed(rare, roots))
        other = left.select("band", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("total").alias("total_b"), F.col("rest").alias("rest_b"))
        across = left.join(other, "band").filter((F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")) & near(F.col("total_b"), F.col("rest_b"))).select(F.col("node").alias("a"), "b")
        more = kept(more.unionByName(_compared(across.distinct(), crowd_texts, common, similarity)))
        drop(left, rare, crowd_texts, roots)
    if not more.isEmpty():
        links = kept(links.unionByName(more))
        classes = components(links)
    roots = texts.join(classes, "node", "left").select(*key, F.coalesce("root", "node").alias("root"), "first_id", "node")
    lowest = roots.groupBy("root").agg(F.min(F.struct(F.col("first_id").alias("class_id"), F.col("node").alias("stays"))).alias("s")).select("root", "s.*")
    roots = roots.join(lowest, "root").select(*key, "class_id", "stays")
    out = signed.select("row", "doc_id", *key).join(roots, key, "left")
    return out.select("doc_id", F.coalesce("class_id", F.when(F.col("stays").isNull(), F.col("doc_id"))).alias("class_id"), F.coalesce(F.col("row") == F.col("stays"), F.lit(True)).alias("stays"), *key)


def one_of_each(docs: DataFrame, columns: tuple[str, ...], similarity: float = SIMILARITY) -> DataFrame:
    """The named columns of one row of every class; rows without text all stay.  Of rows with the
    same id and text the smallest in the other columns stays."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stays = near_duplicates(docs, similarity).filter("stays and size > 0").select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), "h1", "h2", "size")
    key = ["id", "h1", "h2", "size"]
    keyed = only(docs, *columns).select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("id"), *_text_key(text))
    some = keyed.filter("size > 0").join(stays, key)
    one = some.groupBy(*key).agg(F.min(F.struct(*[c for c in columns if c != "text"], "text")).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in columns])
    return one.unionByName(keyed.filter("size = 0").drop(*key))


def _mixed(in_bands: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of bands that hold more than one class, with root and the number n in the band;
    nodes without a class are classes of their own."""
    known = in_bands.drop("leader", "n").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = known.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high").select("band", "n")
    return known.join(several, "band")


def _united(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node and root, after classes with links between them are one; ``roots`` is read no more."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    ends = links.select("a", "b").join(a, "a").join(b, "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    moved = components(ends).select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = kept(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    drop(roots)
    return out


def _pairs_across(small: DataFrame) -> DataFrame:
    """Pairs of different classes in bands of at most ``SMALL_BAND`` members."""
    other = small.select("band", F.col("node").alias("b"), F.col("root").alias("root_b"))
    return small.join(other, "band").filter("node < b and root <> root_b").select(F.col("node").alias("a"), "b")


def _beside(left: DataFrame, turn: int, near) -> DataFrame:
    """Pairs of each member of a band with those of other classes among the ``BESIDE`` before it, in an
    order that changes with the turn.  What ``near`` rules out never becomes a row."""
    order = Window.partitionBy("band").orderBy(F.xxhash64("node", F.lit(turn)), "node").rowsBetween(-BESIDE, -1)
    others = F.filter("o", lambda o: (F.col("root") != o["root"]) & near(o["total"], o["rest"]))
    each = left.withColumn("o", F.collect_list(F.struct("node", "root", "total", "rest")).over(order)).select("node", F.explode(others).alias("o"))
    return each.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"))


def _texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text; ``wanted`` has node and the keys of its text."""
    # Few enough to broadcast, by a check of their number; else the texts are shuffled.
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    keyed = docs.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), *_text_key(F.col("text")), "text")
    return kept(keyed.join(wanted, ["id", "h1", "h2", "size"]).select("node", "text").dropDuplicates(["node"]))


def _keys_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    return held(texts.join(nodes, "node", "left_semi").select("node", F.coalesce("first_id", F.lit(-1 << 63)).alias("id"), "h1", "h2", "size"))


def weigh_batches(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    """node, shingle and weight of all shingles of each text."""
    roller, known = Roller(), common.value
    for batch in batches:
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        for lo, hi, raw, offsets in text_blocks(_lowered(batch.column("text")), 1 << 19):
            h, rows, counts = distinct_shingles(*shingles(raw, offsets, roller))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[lo:hi][rows]), pa.array(h.view(np.int64)), pa.array(weights(h, counts, known))], names=["node", "band", "w"])


def _prefixes(crowd_texts: DataFrame, common, similarity: float) -> DataFrame:
    """band (a shingle), node, its total weight and the weight from this shingle on.

    A text's shingles are taken from the rarest on, until those left weigh less than the
    similarity times its total.  Similar texts share at least one shingle taken from both,
    and at their first the rest of each is at least the weight they must have in common.
    """
    each = kept(crowd_texts.mapInArrow(lambda batches: weigh_batches(batches, common), "node long, band long, w double"))
    of_node = Window.partitionBy("node")
    ranked = each.join(each.groupBy("band").agg(F.count("*").alias("df")), "band").withColumn("total", F.sum("w").over(of_node))
    ranked = ranked.withColumn("rest", F.col("total") - F.sum("w").over(of_node.orderBy("df", "band")) + F.col("w"))
    return ranked.filter((F.col("df") > 1) & (F.col("rest") >= (similarity - 1e-9) * F.col("total"))).select("band", "node", "total", "rest")


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, common, similarity: float) -> DataFrame:
    """The pairs (a < b) of texts whose weighted Jaccard similarity is high enough."""
    pairs = held(pairs.select("a", "b"))
    keys = _keys_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts)
    whole = _texts_of(keys, docs)
    out = kept(_compared(pairs, whole, common, similarity))
    drop(whole, keys, pairs)
    return out


def _compared(pairs: DataFrame, whole: DataFrame, common, similarity: float) -> DataFrame:
    """The pairs whose texts (node, text) are similar enough."""
    a, b = (whole.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    scored = pairs.join(a, "a").join(b, "b").mapInArrow(lambda batches: similarities(batches, common), "a long, b long, similarity double")
    return scored.filter(F.col("similarity") >= similarity)
