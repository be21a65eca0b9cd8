"""Shingles and MinHash bands of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .. import fixed

_random = np.random.Generator(np.random.PCG64(fixed.MINHASH_SEED))
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
FACTORS = _random.integers(1, 1 << 63, fixed.SIGNATURE_SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words between blanks; rows are cut at ``edges``."""
    n = len(raw)
    letter = raw != 0x20
    cut = np.zeros(n + 1, dtype=bool)
    cut[edges] = True
    start = np.flatnonzero(letter & (np.append(True, ~letter[:-1]) | cut[:n]))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # A word's hash is its bytes as digits of a number: each is the one before times ODD, plus a value.
    stop = np.flatnonzero(letter & (np.append(~letter[1:], True) | cut[1:])) + 1
    size, h = stop - start, np.zeros(len(start), dtype=np.uint64)
    for k in range(int(size.max())):
        more = np.flatnonzero(size > k)
        h[more] = h[more] * ODD + BYTE_VALUES[raw[start[more] + k]]
    return scrambled(h + size.astype(np.uint64)), np.searchsorted(edges, start, "right") - 1


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of every row's runs of ``width`` words, by row; a shorter row is one run."""
    count = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(count) - count
    runs = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
    row = np.repeat(np.arange(n_rows), runs)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    long = np.minimum(count[row], width)
    h = long.astype(np.uint64)
    for k in range(width):
        own = np.flatnonzero(long > k)
        h[own] = h[own] * ODD + words[at[own] + k]
    h = scrambled(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    return h[new], row[new]


def band_keys(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys of all bands of each row that has shingles, a row of the result for each."""
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    rows = fixed.SIGNATURE_SIZE // fixed.BAND_COUNT
    keys = np.zeros((len(begin), fixed.BAND_COUNT), dtype=np.uint64)
    for k, factor in enumerate(FACTORS):
        low = np.minimum.reduceat((h ^ (h >> np.uint64(29))) * factor, begin)
        b = k // rows
        keys[:, b] = scrambled(keys[:, b] * ODD + low + np.uint64(b))
    return keys


def shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, sorted distinct shingles and band keys of normalised texts (id, normal) with words."""
    for whole in batches:
        for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
            text = batch.column("normal").cast(pa.large_string()).fill_null("")
            _, offsets, data = text.buffers()
            edges = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
            words, rows = word_hashes(raw, edges - edges[0])
            h, row = shingle_hashes(words, rows, len(text), fixed.SHINGLE_WORDS)
            if not len(h):
                continue
            some = np.unique(row)
            keys = band_keys(h, row)
            ends = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(h)).astype(np.int32)
            bands = np.arange(len(some) + 1, dtype=np.int32) * fixed.BAND_COUNT
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(some)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(bands), pa.array(keys.ravel().view(np.int64)))], names=["id", "shingles", "keys"])
