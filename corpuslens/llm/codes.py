"""Vectors as short codes: one codebook for each part of a vector, fitted by Hamerly's form of
Lloyd's rounds.

Every part of every vector keeps its entry, one upper bound of the distance to that entry and
one lower bound of the distance to the second nearest.  After a round both move with the
entries; a part whose upper bound is strictly below the lower one (or below half the gap of its
entry to the next) keeps its entry unseen.  The others first get their upper bound anew, and
only if that is not enough all entries are compared, in whole numbers, ties to the lower index.

Work in Spark: the vectors and their bounds are one table in the shared folder, rewritten once
a round; the codebooks (entries x components, whatever the table's size) are broadcast; tasks
add up their parts' components by entry before anything is shuffled.

Defined results: vectors that are null or hold null or non-finite components are left out;
vectors shorter than the longest, and lengths that are no multiple of the parts, are followed
by zeros; null vec_ids come last in the choice of first entries, equal ones by their components;
repeated rows are coded each; an empty table gives no rows; other columns are ignored.
Components are whole numbers of at most 45 bits (``TOP``); an error says if there are larger
ones, whose squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop, got, kept, only, sent

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
TOP = 1 << 45
#: Bounds are kept so much wider than the square roots in doubles give them.
SLACK = 1e-9
#: Distances that are compared at once.
CELLS = 1 << 20
#: Labels with more than this share of all rows are joined by broadcast: at most 1 / HOT of them.
HOT = 1e-4
STATE = "vec_id long, label {label}, v array<long>, code array<int>, upper array<double>, lower array<double>, scans int, error long"


class Books:
    """The codebooks of one round, and how far their entries went since the last."""

    def __init__(self, entries: np.ndarray, top: int, before: Books | None = None) -> None:
        self.top = max(top, int(np.abs(entries).max()))
        self.width = entries.shape[2]
        # Below 2^53 sums of squares of whole numbers are exact in doubles, whatever their order.
        self.exact = self.width * (2 * self.top) ** 2 < 1 << 53
        self.entries = entries.astype(np.float64 if self.exact else object)
        self.moved, self.half = None, None
        if before is not None:
            step = entries.astype(object) - before.entries.astype(np.int64).astype(object)
            self.moved = np.sqrt((step * step).sum(2).astype(np.float64)) * (1 + SLACK)
            self.half = np.stack([self._half_gap(p) for p in range(len(entries))])

    def _half_gap(self, part: int) -> np.ndarray:
        if self.entries.shape[1] == 1:
            return np.full(1, np.inf)
        _, _, second = self.scan(part, self.entries[part], own=np.arange(self.entries.shape[1]))
        return np.sqrt(second) * (0.5 - SLACK)

    def scan(self, part: int, x: np.ndarray, own: np.ndarray | None = None):
        """Nearest entry, its squared distance, and the smallest squared distance of all others;
        with ``own``, the others than these."""
        book = self.entries[part]
        code, near, second = np.zeros(len(x), np.int64), [], np.zeros(len(x))
        step = max(1, CELLS // (len(book) * (1 if self.exact else self.width)))
        for lo in range(0, len(x), step):
            y = x[lo : lo + step]
            if self.exact:
                d = (y * y).sum(1)[:, None] - 2 * (y @ book.T) + (book * book).sum(1)
            else:
                d = ((y[:, None, :] - book[None]) ** 2).sum(2)
            best = d.argmin(1) if own is None else own[lo : lo + step]
            at = np.arange(len(y))
            near.append(d[at, best])
            d = d.astype(np.float64)
            d[at, best] = np.inf
            code[lo : lo + step], second[lo : lo + step] = best, d.min(1)
        return code, np.concatenate(near) if near else np.zeros(0), second

    def distance(self, part: int, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distances to the given entries, exact."""
        step = x - self.entries[part][code]
        return (step * step).sum(1)

    def parts(self, values: np.ndarray) -> np.ndarray:
        """Vectors (rows) as parts x rows x width, in the numbers that are compared."""
        kind = np.float64 if self.exact else object
        return values.reshape(len(values), len(self.entries), self.width).transpose(1, 0, 2).astype(kind)


def assign(batches: Iterator[pa.RecordBatch], shared, last: bool) -> Iterator[pa.RecordBatch]:
    """Every part's nearest entry and its bounds; in the last round also the exact errors."""
    books: Books = got(shared)
    n_parts = len(books.entries)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        table = lambda name: np.asarray(batch.column(name).flatten()).reshape(n, -1)
        x = books.parts(table("v"))
        first = books.moved is None
        code, upper, lower = (np.zeros((n, n_parts), t) for t in (np.int64, np.float64, np.float64)) if first else (table(c).copy() for c in ("code", "upper", "lower"))
        scans, error = np.asarray(batch.column("scans")).copy(), np.zeros(n, object)
        for p in range(n_parts):
            if first:
                open_ = np.arange(n)
            else:
                moved, own = books.moved[p], code[:, p]
                far = int(moved.argmax())
                rest = np.delete(moved, far).max() if len(moved) > 1 else 0.0
                upper[:, p] = (upper[:, p] + moved[own]) * (1 + SLACK)
                lower[:, p] -= np.where(own == far, rest, moved[far])
                lower[:, p] -= np.abs(lower[:, p]) * SLACK
                bound = np.maximum(lower[:, p], books.half[p][own])
                open_ = np.flatnonzero(~(upper[:, p] < bound))
                upper[open_, p] = np.sqrt(books.distance(p, x[p][open_], own[open_]).astype(np.float64)) * (1 + SLACK)
                open_ = open_[~(upper[open_, p] < bound[open_])]
            if len(open_):
                found, near, second = books.scan(p, x[p][open_])
                code[open_, p] = found
                upper[open_, p] = np.sqrt(near.astype(np.float64)) * (1 + SLACK)
                lower[open_, p] = np.sqrt(second) * (1 - SLACK)
                scans[open_] += 1
            if last:
                error += books.distance(p, x[p], code[:, p]).astype(np.int64 if books.exact else object)
        lists = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_parts + 1, n_parts, dtype=np.int32)), pa.array(a.ravel(), type=t))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), batch.column("v"), lists(code.astype(np.int32), pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64()), pa.array(scans, type=pa.int32()), pa.array(error.tolist(), type=pa.int64())],
            names=["vec_id", "label", "v", "code", "upper", "lower", "scans", "error"],
        )


def add_up(batches: Iterator[pa.RecordBatch], parts: int, entries: int, top: int) -> Iterator[pa.RecordBatch]:
    """Numbers and component sums of each entry's parts, one row an entry for each task."""
    sums, counts, rows = None, np.zeros((parts, entries), np.int64), 0

    def flush() -> pa.RecordBatch:
        part, entry = np.nonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), type=pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        v = np.asarray(batch.column("v").flatten()).reshape(n, parts, -1)
        code = np.asarray(batch.column("code").flatten()).reshape(n, parts)
        if sums is None:
            sums = np.zeros((parts, entries, v.shape[2]), np.int64)
        if (rows + n) * top >= 1 << 62:
            yield flush()
            sums[:], counts[:], rows = 0, 0, 0
        rows += n
        for p in range(parts):
            np.add.at(sums[p], code[:, p], v[:, p])
            counts[p] += np.bincount(code[:, p], minlength=entries)
    if rows:
        yield flush()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (entry numbers by part), error, and how often all entries were compared;
    and the codebooks (parts x entries x components)."""
    spark = vectors.sparkSession
    own = only(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("cast(embedding as array<double>)").alias("x"), "label")
    own = own.filter(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    length, largest = own.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    width = max(1, -(-(length or 0) // parts))
    top = int(scale * (largest or 0)) + 1
    if top > TOP:
        raise ValueError(f"components beyond {TOP} / {scale} are too large for whole squared distances")
    v = F.transform("x", lambda c: F.floor(c * float(scale)))
    v = F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("x"))).alias("v")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("code", "array<int>"), ("upper", "array<double>"), ("lower", "array<double>"))]
    state = kept(own.select("vec_id", "label", v, *nothing, F.lit(0).alias("scans"), F.lit(None).cast("long").alias("error")))
    schema = STATE.format(label=state.schema["label"].dataType.simpleString() if dict(state.dtypes)["label"] != "void" else "int")
    start = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # so many rows at most
    if not start:
        return state.select("vec_id", "label", "code", "error", "scans"), np.zeros((parts, 0, width), np.int64)
    entries = len(start)
    book = np.array([r["v"] for r in start], dtype=np.int64).reshape(entries, parts, width).transpose(1, 0, 2)
    now = Books(book, top)
    for turn in range(rounds + 1):
        shared, last = sent(spark, now), turn == rounds
        new = kept(state.mapInArrow(lambda batches, shared=shared, last=last: assign(batches, shared, last), schema))
        drop(state)
        state = new
        if last:
            break
        sums = state.select("v", "code").mapInArrow(lambda batches: add_up(batches, parts, entries, top), "part int, entry int, n long, sums array<long>")
        sums = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        book = book.copy()
        for r in sums.collect():  # parts x entries x components rows at most
            book[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
        now = Books(book, top, now)
    return state.select("vec_id", "label", "code", "error", "scans"), book


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hexadecimal, error, the error of all rows with the same label, and a digest
    of the codebooks."""
    codes, book = compress(vectors)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    total = codes.count()
    by_label = kept(codes.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")))
    hot = F.broadcast(by_label.filter(F.col("n") > HOT * total).select("label", F.col("label_error").alias("hot_error")))
    rest = by_label.filter(F.col("n") <= HOT * total).select("label", "label_error")
    same = lambda other: F.col("c.label").eqNullSafe(other["label"])
    out = codes.alias("c").join(hot, same(hot), "left").drop(hot["label"]).alias("c")
    out = out.join(rest, same(rest), "left")
    text = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select("vec_id", text.alias("code"), "error", F.coalesce("hot_error", "label_error").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
