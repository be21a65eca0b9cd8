"""Removal of repeated passages by distributed prefix doubling over byte positions.

A 50-byte string repeats only if both its 25-byte halves do, so positions are named at
width 25 first and at width 50 from the pairs of names at offset 25.  Shards sort the names;
whatever is unique drops out.  At width 25 only the smallest-named of the 26 positions of
each 50-byte window is looked at: equal windows choose equal positions, so no repeat is
missed.  Neighbouring windows with the same choice are one stretch, named as a whole: where
a name at width 25 always stands in the same stretch, the whole stretch is settled at once,
and only the windows of the others go on to width 50.

Documents are grouped in chunks by a hash of their id; chunks send sorted, packed names to
shards and get back what repeats, with the smallest document that holds it.  A chunk sends
each name once, so a passage in a third of all documents weighs no more than one per chunk.

Ids travel as unsigned distances from the smallest, so their order holds for any sign.

Defined results: null texts are empty; a null doc_id comes after all others, as does the
largest 64-bit number; rows with the same doc_id do not remove from each other; other columns
are ignored; matches never cross documents; an empty table gives no rows.  Names have 64 bits;
at width 50 shards and chunks see 56 of them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BYTE_CODES, Roller, mix, pack_plain, pack_sorted, unpack_plain, unpack_sorted
from ._spark import only

PASSAGE = 50
CHUNK_BYTES, SHARD_NAMES = 3 << 20, 400_000
#: Partitions that the chunks are dealt to, at most; a partition may hold several chunks.
PARTITIONS = 20_000
BLOCK = 1 << 18
LAST_ID = (1 << 63) - 1
CELL = "shard int, chunk int, names binary, values binary"
REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Low bits that names at width 25 and 50 go without on the way.  At width 25 a clash only
#: makes windows tell; stretches are compared by 32 bits more.
FIRST_BITS, KEPT_BITS, STRETCH_BITS = np.uint64(24), np.uint64(8), np.uint64(32)


class Chunk:
    """The texts of one chunk, and stretches of windows over them, block by block."""

    def __init__(self, texts: list[str | None], docs: np.ndarray, passage: int) -> None:
        self.bytes, self.docs, self.passage, self.half = [(t or "").encode() for t in texts], docs, passage, -(-passage // 2)
        self.roller = Roller(2 * BLOCK)

    def _blocks(self):
        """Pieces (document, start, bytes) of at most a block together; long texts overlap by a window."""
        held, size = [], 0
        for d, raw in enumerate(self.bytes):
            for s in range(0, max(1, len(raw) - self.passage + 1), BLOCK):
                piece = raw[s : s + BLOCK + self.passage - 1]
                if len(piece) < self.passage:
                    continue
                if held and size + len(piece) > BLOCK:
                    yield held
                    held, size = [], 0
                held.append((d, s, piece))
                size += len(piece)
        if held:
            yield held

    def stretches(self):
        """For each block: document, start, windows, chosen name and stretch name of every stretch,
        and a function that names single windows."""
        for pieces in self._blocks():
            raw = np.frombuffer(b"".join(p for _, _, p in pieces), dtype=np.uint8)
            n, half, w = len(raw), self.half, self.passage
            prefix = self.roller.prefix(BYTE_CODES[raw])
            name = mix((prefix[half:] - prefix[:-half]) * self.roller.down[: n - half + 1])
            low, width = name, 1
            wanted = w - half + 1
            while 2 * width <= wanted:
                low, width = np.minimum(low[:-width], low[width:]), 2 * width
            if width < wanted:
                low = np.minimum(low[: n - w + 1], low[wanted - width : wanted - width + n - w + 1])
            sizes = np.array([len(p) for _, _, p in pieces])
            begin = np.concatenate([[0], np.cumsum(sizes)])
            whole = np.zeros(n - w + 1, dtype=bool)  # windows inside one piece
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                whole[a : b - w + 1] = True
            change = np.ones(len(low), dtype=bool)
            change[1:] = (low[1:] != low[:-1]) | ~whole[:-1]
            at = np.flatnonzero(change & whole)
            ends = np.flatnonzero(whole & np.append(change[1:] | ~whole[1:], True)) + 1
            stretch = self.roller.stretch(prefix, at, ends + w - 1)
            piece = np.searchsorted(begin, at, "right") - 1
            doc = np.array([d for d, _, _ in pieces])[piece]
            start = at - begin[piece] + np.array([s for _, s, _ in pieces])[piece]

            def windows(i: np.ndarray, name=name, half=half, w=w) -> np.ndarray:
                return mix(name[i] * np.uint64(0xA0761D6478BD642F) + name[i + w - half])

            yield doc, start, ends - at, low[at], stretch, at, windows


def _cells(chunk: int, names: np.ndarray, values: list[np.ndarray], bits: int, without: np.uint64) -> dict[str, list]:
    """Packed cells of sorted names by shard; values go with them."""
    shards, edges = np.unique((names >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
    out: dict[str, list] = {"shard": [], "chunk": [], "names": [], "values": []}
    for s, a, b in zip(shards.tolist(), edges.tolist(), [*edges[1:].tolist(), len(names)]):
        out["shard"].append(s)
        out["chunk"].append(chunk)
        out["names"].append(pack_sorted(names[a:b] >> without))
        out["values"].append(_join([pack_plain(v[a:b]) for v in values]))
    return out


def _join(blobs: list[bytes]) -> bytes:
    return b"".join(len(b).to_bytes(4, "little") + b for b in blobs)


def _split(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(unpack_plain(blob[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def _least(keys: list[np.ndarray], docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, the smallest document of each, and whether it has others."""
    order = np.lexsort((docs, *reversed(keys)))
    keys, docs = [k[order] for k in keys], docs[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(docs)) - 1
    return [k[at] for k in keys], docs[at], docs[last] != docs[at] if len(at) else np.zeros(0, dtype=bool)


def _frame(cells: dict[str, list]):
    import pandas as pd

    return pd.DataFrame(cells).astype({"shard": "int32", "chunk": "int32"})


def _distances(pdf, least: int) -> np.ndarray:
    """Ids as unsigned distances from the smallest id."""
    return pdf["id"].to_numpy(np.int64).view(np.uint64) - np.int64(least).view(np.uint64)


def name_stretches(key, pdf, passage: int, bits: int, least: int):
    """Width 25: chosen names of a chunk with their stretches and smallest documents."""
    chunk = Chunk(pdf["text"].tolist(), _distances(pdf, least), passage)
    names, stretch, docs = [], [], []
    for doc, _, _, low, whole, _, _ in chunk.stretches():
        names.append(low)
        stretch.append(whole >> STRETCH_BITS)
        docs.append(chunk.docs[doc])
    if not names:
        return _frame({"shard": [], "chunk": [], "names": [], "values": []})
    (names, stretch), docs, more = _least([np.concatenate(names), np.concatenate(stretch)], np.concatenate(docs))
    return _frame(_cells(int(key[0]), names, [stretch, docs, more.astype(np.uint64)], bits, FIRST_BITS))


def _gathered(pdf) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All cells of a shard in the order of their names: names, chunks and values; the unsorted
    parts are let go one by one."""
    names = np.concatenate([unpack_sorted(n) for n in pdf["names"]])
    order = np.argsort(names, kind="stable").astype(np.int32)
    names = names[order]
    parts = [_split(v) for v in pdf["values"]]
    chunks = np.repeat(pdf["chunk"].to_numpy(np.int32), [len(p[0]) for p in parts])[order]
    values = []
    for i in range(len(parts[0])):
        values.append(np.concatenate([p[i] for p in parts])[order])
        for p in parts:
            p[i] = None
    return names, chunks, values


def rank_stretches(key, pdf, bits: int):
    """A shard's sort at width 25: for names in several documents, the smallest one if the
    stretch is always the same (plus one), else 0: windows must tell."""
    names, chunks, (stretch, docs, more) = _gathered(pdf)
    at = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    low, high = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
    several = (low != high) | (np.maximum.reduceat(more, at) > 0)
    same = np.minimum.reduceat(stretch, at) == np.maximum.reduceat(stretch, at)
    size = np.diff(np.append(at, len(names)))
    # A chunk whose only document with the name is the smallest has nothing to remove.
    keep = np.repeat(several, size) & ~(np.repeat(same, size) & (docs == np.repeat(low, size)) & (more == 0))
    answer = np.repeat(np.where(same, low + np.uint64(1), np.uint64(0)), size)
    return _answers(int(key[0]), names[keep], chunks[keep], answer[keep])


def _answers(shard: int, names: np.ndarray, chunks: np.ndarray, values: np.ndarray):
    """What each chunk is told: names in order, once each, with their values."""
    order = np.lexsort((names, chunks))
    names, chunks, values = names[order], chunks[order], values[order]
    new = np.append(True, (names[1:] != names[:-1]) | (chunks[1:] != chunks[:-1])) if len(names) else np.zeros(0, dtype=bool)
    names, chunks, values = names[new], chunks[new], values[new]
    edges = np.append(np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])), len(chunks)) if len(chunks) else np.zeros(1, dtype=np.int64)
    out: dict[str, list] = {"shard": [], "chunk": [], "names": [], "values": []}
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        out["shard"].append(shard)
        out["chunk"].append(int(chunks[a]))
        out["names"].append(pack_sorted(names[a:b]))
        out["values"].append(_join([pack_plain(values[a:b])]))
    return _frame(out)


def _told(pdf) -> tuple[np.ndarray, np.ndarray]:
    """All answers to a chunk, by name."""
    if not len(pdf):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    names, values = np.concatenate([unpack_sorted(n) for n in pdf["names"]]), np.concatenate([_split(v)[0] for v in pdf["values"]])
    order = np.argsort(names, kind="stable")
    return names[order], values[order]


def _look_up(names: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, names), max(len(known) - 1, 0))
    return at, known[at] == names if len(known) else np.zeros(len(names), dtype=bool)


def _each(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers at, at + 1, ... of each stretch in a row, and which stretch they are of."""
    which = np.repeat(np.arange(len(at)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + at[which], which


def name_windows(key, pdf, told, passage: int, bits: int, least: int):
    """Width 50: windows of the stretches that are not settled, with their smallest documents."""
    known, answers = _told(told)
    known = known[answers == 0]
    chunk = Chunk(pdf["text"].tolist() if len(known) else [], _distances(pdf, least), passage)
    names, docs = [], []
    for doc, _, size, low, _, at, windows in chunk.stretches():
        _, hit = _look_up(low >> FIRST_BITS, known)
        i, which = _each(at[hit], size[hit])
        names.append(windows(i))
        docs.append(chunk.docs[doc[hit][which]])
    if not names:
        return _frame({"shard": [], "chunk": [], "names": [], "values": []})
    (names,), docs, more = _least([np.concatenate(names)], np.concatenate(docs))
    return _frame(_cells(int(key[0]), names, [docs, more.astype(np.uint64)], bits, KEPT_BITS))


def rank_windows(key, pdf, bits: int):
    """A shard's sort at width 50: the smallest document of every name in several."""
    names, chunks, (docs, more) = _gathered(pdf)
    at = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    low = np.minimum.reduceat(docs, at)
    several = (low != np.maximum.reduceat(docs, at)) | (np.maximum.reduceat(more, at) > 0)
    size = np.diff(np.append(at, len(names)))
    low = np.repeat(low, size)
    keep = np.repeat(several, size) & ~((docs == low) & (more == 0))
    return _answers(int(key[0]), names[keep], chunks[keep], low[keep])


def covered(pdf, told, told_windows, passage: int, smallest: int):
    """For each text of a chunk the bytes that repeat one of a smaller document."""
    known, answers = _told(told)
    known_windows, least = _told(told_windows)
    chunk = Chunk(pdf["text"].tolist(), _distances(pdf, smallest), passage)
    cover: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in chunk.bytes]
    for doc, start, size, low, _, at, windows in chunk.stretches() if len(known) else ():
        own = chunk.docs[doc]
        where, hit = _look_up(low >> FIRST_BITS, known)
        value = np.where(hit, answers[where], np.uint64(0))
        settled = hit & (value > 0) & (value - np.uint64(1) < own)
        found = [(doc[settled], start[settled], start[settled] + size[settled] + passage - 1)]
        i, which = _each(at[hit & (value == 0)], size[hit & (value == 0)])
        if len(i):
            spot, there = _look_up(windows(i) >> KEPT_BITS, known_windows)
            open_doc, open_start, open_at = doc[hit & (value == 0)][which], start[hit & (value == 0)][which], at[hit & (value == 0)][which]
            there &= least[spot] < chunk.docs[open_doc] if len(least) else False
            begin = open_start[there] + i[there] - open_at[there]
            found.append((open_doc[there], begin, begin + passage))
        for d, a, b in found:
            order = np.argsort(d, kind="stable")
            d, a, b = d[order], a[order], b[order]
            edges = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d)) if len(d) else np.zeros(1, np.int64)
            for x, y in zip(edges.tolist(), edges[1:].tolist()):
                cover[d[x]].append((a[x:y], b[x:y]))
    return chunk, cover


def runs_of(cover: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open intervals."""
    if not cover:
        return []
    a, b = np.concatenate([x for x, _ in cover]), np.concatenate([x for _, x in cover])
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.append(True, a[1:] > b[:-1])
    last = np.append(np.flatnonzero(first)[1:], len(a)) - 1
    return list(zip(a[first].tolist(), b[last].tolist()))


def report_chunk(pdf, told, told_windows, passage: int, least: int):
    import pandas as pd

    chunk, cover = covered(pdf, told, told_windows, passage, least)
    out = []
    for raw, parts, doc, no_id in zip(chunk.bytes, cover, pdf["id"].tolist(), pdf["no_id"].tolist()):
        runs, kept, at = runs_of(parts), [], 0
        for a, b in runs:
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        out.append((None if no_id else doc, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest()))
    ids, n_bytes, removed, spans, digests = zip(*out)
    return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_bytes": n_bytes, "n_removed": removed, "n_spans": spans, "kept_sha256": digests})


def remove_passages(docs: DataFrame, passage: int = PASSAGE, chunk_bytes: int = CHUNK_BYTES, shard_names: int = SHARD_NAMES) -> DataFrame:
    """Bytes, removed bytes, removed runs and digest of what is kept, for every document."""
    rows = only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("text").cast("string"))
    facts = rows.agg(F.sum(F.octet_length("text")).alias("total"), F.min("id").alias("least")).first()
    total, least = facts["total"] or 0, facts["least"] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    bits = max(2, math.ceil(math.log2(max(1, total / 13 / shard_names))))
    texts = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).repartition(min(max(chunks, 8), PARTITIONS), "chunk")
    by_chunk = lambda df: df.groupBy("chunk")
    named = by_chunk(texts).applyInPandas(lambda key, pdf: name_stretches(key, pdf, passage, bits, least), CELL)
    told = named.groupBy("shard").applyInPandas(lambda key, pdf: rank_stretches(key, pdf, bits), CELL)
    windows = by_chunk(texts).cogroup(by_chunk(told)).applyInPandas(lambda key, pdf, t: name_windows(key, pdf, t, passage, bits, least), CELL)
    told_windows = windows.groupBy("shard").applyInPandas(lambda key, pdf: rank_windows(key, pdf, bits), CELL)
    both = told.withColumn("level", F.lit(1)).unionByName(told_windows.withColumn("level", F.lit(2)))
    return by_chunk(texts).cogroup(by_chunk(both)).applyInPandas(lambda key, pdf, t: report_chunk(pdf, t[t["level"] == 1], t[t["level"] == 2], passage, least), REPORT)
