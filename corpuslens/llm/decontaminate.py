"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Words are runs of digits, lower-cased ASCII letters and bytes from 0x80 on.  A window is
``width`` consecutive words of an item; an item with fewer words is one window.  Document
windows are hashed in bulk, looked up in the set and verified word by word.

A set is a few arrays: the items' words in one text, their places, and the windows' hashes in
order with the items and places where they occur.  Its size is known before it is built, from the
benchmark's words (``WORD_BYTES`` each) and letters; up to ``SET_BYTES`` of it are broadcast at once.
A larger benchmark is dealt into several such sets, and each gives only what it found, by text.

Defined results: null or wordless texts have no words and no hits; null or wordless items
have no windows; null item ids are ignored; repeated items count once; repeated documents
are each answered; an empty table gives no rows, an empty benchmark no hits; other columns are
ignored; whole texts are read, however long, and long items in pieces that share no window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import BYTE_CODES, Roller, find_words, mix, text_blocks, window_hashes
from ._spark import got, kept, only, sent

WIDTH = 10
#: Bytes of one broadcast set, by what its arrays take: places, hashes and items of each word, and letters.
SET_BYTES, WORD_BYTES = 24 << 20, 36
#: Windows of an item that go into one set together; longer items are cut, with overlaps.
PIECE_WINDOWS = 50_000

_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_word = np.zeros(256, dtype=bool)
_word[0x30:0x3A] = _word[0x41:0x5B] = _word[0x61:0x7B] = _word[0x80:] = True
LOWER, IS_WORD = _lower, _word
SCAN = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    raw = LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    start, end, _ = find_words(raw, np.array([0, len(raw)]), IS_WORD)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]


def pieces_of(text: str | None, width: int, windows: int = PIECE_WINDOWS) -> list[tuple[str, int]]:
    """The words of a text in pieces that together hold each of its windows once, and their number."""
    words = words_of(text)
    cut = [words[i : i + windows + width - 1] for i in range(0, max(1, len(words) - width + 1), windows)] if words else []
    return [(b" ".join(x).decode("utf-8", "replace"), len(x)) for x in cut]


class WindowSet:
    """Windows by length and hash, each with its words and the items that hold it."""

    def __init__(self, rows: list[tuple[str, str]], width: int) -> None:
        self.ids = sorted({i for i, _ in rows})
        number = {i: k for k, i in enumerate(self.ids)}
        starts, ends, items, sizes, pieces, at = [], [], [], [], [], 0
        for item, text in rows:
            raw = LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
            start, end, _ = find_words(raw, np.array([0, len(raw)]), IS_WORD)
            # Words one blank apart, so that a window is one stretch of the whole text.
            lengths = end - start
            if not len(start):
                continue
            own = np.full(int(lengths.sum()) + len(start), 0x20, dtype=np.uint8)
            first = at + np.cumsum(lengths + 1) - lengths - 1
            letters = np.ones(len(own), dtype=bool)
            letters[first + lengths - at] = False
            own[letters] = raw[IS_WORD[raw]]
            starts.append(first)
            ends.append(first + lengths)
            items.append(np.full(len(start), number[item], np.int32))
            sizes.append(len(start))
            pieces.append(own)
            at += len(own)
        none = np.zeros(0, np.int64)
        blob = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        self.blob = blob.tobytes()
        self.starts, self.ends = (np.concatenate(x).astype(np.int64) if x else none for x in (starts, ends))
        words = Roller(max(1, len(blob))).stretch(Roller(max(1, len(blob))).prefix(BYTE_CODES[blob]), self.starts, self.ends) if len(blob) else np.zeros(0, np.uint64)
        item, n_words = np.concatenate(items) if items else np.zeros(0, np.int32), np.array(sizes, dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        piece = np.repeat(np.arange(len(n_words)), n_words)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.sieve = {}
        for size in sorted({min(width, int(n)) for n in n_words}):
            place = np.arange(max(0, len(words) - size + 1))
            own = (piece[place] == piece[place + size - 1]) & (n_words[piece[place]] >= size) if len(place) else np.zeros(0, bool)
            if size < width:  # only items of just so many words
                own &= n_words[piece[place]] == size
            place = place[own]
            h, other = window_hashes(words, size)[place], window_hashes(mix(words), size)[place]
            # One entry for each item and window: repeats have the same two hashes.
            order = np.lexsort((place, other, item[place], h))
            h, other, place = h[order], other[order], place[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (other[1:] != other[:-1]) | (item[place[1:]] != item[place[:-1]])
            h, place = h[new], place[new]
            keys, first = np.unique(h, return_index=True)
            self.by_size[size] = keys, np.append(first, len(h)).astype(np.int32), item[place], place.astype(np.int32)
            self.sieve[size] = np.zeros(1 << 20, dtype=bool)
            self.sieve[size][(keys >> np.uint64(44)).astype(np.int64)] = True

    def items_of(self, size: int, k: int, joined: bytes) -> list[str]:
        """The items that hold exactly these words, among the windows with the k-th hash."""
        _, first, items, places = self.by_size[size]
        own = range(first[k], first[k + 1])
        return [self.ids[items[e]] for e in own if self.blob[self.starts[places[e]] : self.ends[places[e] + size - 1]] == joined]

    def find(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Of every text the number of words, the merged spans of hit words, and the items found."""
        n_words, spans, items = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))], [set() for _ in range(len(texts))]
        if not hasattr(self, "roller"):
            self.roller = Roller()
        for lo, hi, raw, offsets in text_blocks(texts):
            raw = LOWER[raw]
            start, end, row = find_words(raw, offsets, IS_WORD)
            if not len(start):
                continue
            n_words[lo:hi] = np.bincount(row, minlength=hi - lo)
            hashes = self.roller.stretch(self.roller.prefix(BYTE_CODES[raw]), start, end)
            firsts = np.searchsorted(row, np.arange(hi - lo))
            for size, (keys, *_) in self.by_size.items():
                h = window_hashes(hashes, size)
                maybe = np.flatnonzero(self.sieve[size][(h >> np.uint64(44)).astype(np.int64)])
                maybe = maybe[row[maybe] == row[maybe + size - 1]]
                where = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                hit = keys[where] == h[maybe]
                for i, k in zip(maybe[hit].tolist(), where[hit].tolist()):
                    joined = b" ".join(raw[start[j] : end[j]].tobytes() for j in range(i, i + size))
                    if found := self.items_of(size, k, joined):
                        r = int(row[i])
                        spans[lo + r].append((int(i - firsts[r]), int(i - firsts[r]) + size - 1))
                        items[lo + r].update(found)
        return n_words, [merged(x) for x in spans], items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words, first and last, in order; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _found(batch: pa.RecordBatch, names: list[str], n_words, spans, items) -> pa.RecordBatch:
    held = pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], type=SPANS)
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n_words), held, pa.array([sorted(x) for x in items], type=pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])


def scan_batches(batches: Iterator[pa.RecordBatch], window_set, keep_text: bool) -> Iterator[pa.RecordBatch]:
    known: WindowSet = got(window_set)
    for batch in batches:
        names = [c for c in batch.schema.names if keep_text or c != "text"]
        yield _found(batch, names, *known.find(batch.column("text")))


def hit_batches(batches: Iterator[pa.RecordBatch], window_set) -> Iterator[pa.RecordBatch]:
    """The keys, spans and items of the texts that a set hits."""
    for batch in scan_batches(batches, window_set, False):
        yield batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column("spans")), 0)).drop_columns(["n_words"])


def together(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """What all sets found in a text, as one set would have found it; and its words counted."""
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("spans", "items") and (keep_text or c != "text")]
        n_words = np.zeros(batch.num_rows, np.int64)
        for lo, hi, raw, offsets in text_blocks(batch.column("text")):
            _, _, row = find_words(LOWER[raw], offsets, IS_WORD)
            n_words[lo:hi] = np.bincount(row, minlength=hi - lo)
        spans = [merged([(s["first"], s["last"]) for s in x or ()]) for x in batch.column("spans").to_pylist()]
        yield _found(batch, names, n_words, spans, [set(x or ()) for x in batch.column("items").to_pylist()])


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, set_bytes: int = SET_BYTES, columns: tuple[str, ...] = ("doc_id",), keep_text: bool = True, drop_share: float | None = None, piece_windows: int = PIECE_WINDOWS) -> DataFrame:
    """The named columns, text (if kept), n_words, hit word spans (first and last word), item ids of each document.

    The size of the benchmark's windows is checked: up to ``set_bytes`` they are one broadcast set.
    Beyond, items, the long ones in pieces, are dealt into sets of about that size; every set is
    looked for in all texts, only hits are written, and they come back to the documents by text.
    With ``drop_share`` the hit spans are also cut out, and ``gone`` stands for what was found.
    """
    spark = docs.sparkSession
    bench = only(benchmark, "item_id", "text").filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()

    def cut(batches):
        for b in batches:
            rows = [(i, *p) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()) for p in pieces_of(t, width, piece_windows)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["item_id", "text", "words"])

    bench = kept(bench.mapInArrow(cut, "item_id string, text string, words long"))
    total = bench.agg(F.sum(F.octet_length("text") + WORD_BYTES * F.col("words"))).first()[0] or 0
    sets = -(-2 * total // set_bytes) if total > set_bytes else 1
    own = only(docs, *dict.fromkeys([*columns, "text"])).withColumn("text", F.col("text").cast("string"))
    found = T.StructType.fromDDL(SCAN)
    keep = keep_text or drop_share is not None
    schema = [f for f in own.schema.fields if keep or f.name != "text"]
    built = lambda part: sent(spark, WindowSet([(r["item_id"], r["text"]) for r in part.select("item_id", "text").toLocalIterator()], width))

    if sets == 1:
        shared = built(bench)
        scan = lambda batches: scan_batches(batches, shared, keep)
        out = own
    else:
        key = [F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), F.octet_length("text").alias("k3")]
        keyed, hits = own.select("text", *key), None
        for k in range(sets):
            shared = built(bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == k))
            hit = keyed.mapInArrow(lambda batches, s=shared: hit_batches(batches, s), "k1 long, k2 int, k3 int, spans array<struct<first:long,last:long>>, items array<string>")
            hit = kept(hit.dropDuplicates(["k1", "k2", "k3"]))
            hits = hit if hits is None else hits.unionByName(hit)
        hits = kept(hits.groupBy("k1", "k2", "k3").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")))  # of one text each
        out = own.select("*", *key).join(hits, ["k1", "k2", "k3"], "left").drop("k1", "k2", "k3")
        scan = lambda batches: together(batches, keep)
    if drop_share is None:
        return out.mapInArrow(scan, T.StructType(schema + found.fields))
    return out.mapInArrow(lambda batches: cut_spans(scan(batches), drop_share), T.StructType([*schema, T.StructField("gone", T.BooleanType())]))


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: words, hit words, occurring items and their digest."""
    found = find_contamination(docs, benchmark, width, keep_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(F.col("doc_id").cast("long"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _between(whole: bytes, spans: list[dict]) -> bytes:
    start, end, _ = find_words(np.frombuffer(whole, dtype=np.uint8), np.array([0, len(whole)]), IS_WORD)
    at, out = 0, []
    for s in spans:
        out.append(whole[at : start[s["first"]]])
        at = end[s["last"]]
    return b"".join([*out, whole[at:]])


def cut_spans(batches: Iterator[pa.RecordBatch], drop_share: float) -> Iterator[pa.RecordBatch]:
    """Texts without their hit spans, and whether the document goes altogether."""
    for batch in batches:
        texts, gone = [], []
        for text, n, spans in zip(batch.column("text").to_pylist(), batch.column("n_words").to_pylist(), batch.column("spans").to_pylist()):
            hit = sum(s["last"] - s["first"] + 1 for s in spans)
            gone.append(bool(hit) and hit >= drop_share * n)
            if hit and not gone[-1]:
                text = _between(text.encode(), spans).decode("utf-8", "ignore")
            texts.append(text)
        names = [c for c in batch.schema.names if c not in ("n_words", "spans", "items")]
        yield pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string()) if c == "text" else batch.column(c) for c in names] + [pa.array(gone)], names=[*names, "gone"])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, drop_share: float = 0.5, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The named columns with cleaned text: hit spans are removed; documents mostly made of hits go."""
    return find_contamination(docs, benchmark, width, columns=columns, drop_share=drop_share).filter(~F.col("gone")).drop("gone")
