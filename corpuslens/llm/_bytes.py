"""Vectorised hashing of words and windows over whole Arrow batches of UTF-8 text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20
#: One random number for each byte value, the same on every machine.
BYTE_CODES = np.random.Generator(np.random.PCG64(20240901)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Roller:
    """Hashes of any stretch of a byte block from one pass of prefix sums."""

    def __init__(self, size: int = BLOCK_BYTES) -> None:
        self.up, self.down = powers(BASE, size + 1), powers(BASE_INVERSE, size + 1)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if n >= len(self.up):
            self.up, self.down = powers(BASE, n + 1), powers(BASE_INVERSE, n + 1)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * self.up[:n], out=out[1:])
        return out

    def stretch(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, last row + 1, bytes, offsets from 0) of consecutive rows; null is empty.

    A block holds at most ``limit`` bytes, or one row when that is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def find_words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts, ends and row numbers of the runs of word bytes; runs never cross rows."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    w = is_word[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = w[:-1]
    start = np.flatnonzero(w & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = w[1:]
    end = np.flatnonzero(w & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes (rows are not looked at)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    q = 1
    for j in range(width):
        out += words[j : j + n] * U64(q)
        q = q * 0xA0761D6478BD642F % (1 << 64) | 1
    return mix(out + U64(width))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as compressed differences, by byte plane."""
    import zlib

    gaps = np.diff(values.astype(np.uint64), prepend=U64(0))
    top = int(gaps.max()) if len(gaps) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zlib.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zlib

    width = blob[0]
    planes = np.frombuffer(zlib.decompress(blob[1:]), dtype=np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    full[:, :width] = planes.T
    return np.cumsum(full.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def pack_plain(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes, in the order given."""
    import zlib

    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zlib.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpack_plain(blob: bytes) -> np.ndarray:
    import zlib

    width = blob[0]
    planes = np.frombuffer(zlib.decompress(blob[1:]), dtype=np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    full[:, :width] = planes.T
    return full.view("<u8").ravel().astype(np.uint64)
