"""Ranked lexical search of many items over all documents: a join seeded with thresholds.

One pass over the texts counts terms and keeps, for every document, those that some item asks
for.  For each asked term the documents that hold it and its k largest impacts are stored; an
item's kth score is at least the kth impact of any of its terms.  An item's terms are laid out by
their largest impact; those at the end that together stay below that threshold (a suffix bound)
cannot bring in a document on their own, so only the others make candidates.  A candidate whose
known part and suffix bound stay below the threshold goes; the rest are scored exactly, from the
same row.  Thresholds rise with what a task has found.  So postings are never shuffled: only the
k best of each task and item are.

Items come in blocks of at most ``ITEM_BYTES`` of text, each broadcast and searched on its own.

Defined results: documents without terms are not counted and not found; items without terms, or
none of whose terms occur, have no rows; repeated items (same id and text) are one; null item_ids
are items; repeated documents are found each, and equal scores go by doc_id, null last; an empty
table gives no rows; other columns are ignored; whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import find_words, text_blocks
from ._spark import drop, got, kept, only, sent
from .decontaminate import IS_WORD, LOWER

K = 20
#: Text of the items that are searched for together; their terms and places are a few times that.
ITEM_BYTES = 1 << 20
#: Pairs of a document's terms and items that a task looks at together.
PAIRS = 1 << 20
INDEX = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"


def terms_of(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(first row, last row + 1, all terms, their rows) of consecutive texts."""
    for lo, hi, raw, offsets in text_blocks(column):
        raw = LOWER[raw]
        start, end, row = find_words(raw, offsets, IS_WORD)
        at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        letters = np.ascontiguousarray(raw[IS_WORD[raw]])
        yield lo, hi, pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(letters)]), row


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def index_batches(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """doc_id, number of terms, and the asked terms (ascending) with their occurrences."""
    asked: pa.Array = got(vocabulary)
    for batch in batches:
        for lo, hi, words, row in terms_of(batch.column("text")):
            rows = hi - lo
            n = np.bincount(row, minlength=rows)
            term = pc.index_in(words, value_set=asked).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = term >= 0
            keys, counts = np.unique(row[hit] * len(asked) + term[hit], return_counts=True)
            of_row = np.bincount(keys // len(asked), minlength=rows)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, rows), pa.array(n), _lists(of_row, keys % len(asked)), _lists(of_row, counts)], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))


class Impacts:
    """What the corpus says of a term's occurrences: N documents with L terms."""

    def __init__(self, documents: int, length: int) -> None:
        self.documents, self.length = documents, length

    def __call__(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Impacts before the weight of the term."""
        m = 75 + (25 * n * self.documents) // self.length
        return (1_000_000_000 * counts) // (1000 * counts + 12 * m)

    def weights(self, df: np.ndarray) -> np.ndarray:
        return np.floor(1000 * np.log((2 * self.documents + 2) / (2 * df + 1))).astype(np.int64)


def _entries(batch: pa.RecordBatch):
    """Row, term and count of all entries of an index batch, and the rows' lengths."""
    terms, counts, n = batch.column("terms"), batch.column("counts"), np.asarray(batch.column("n"))
    size = np.asarray(pc.list_value_length(terms))
    row = np.repeat(np.arange(batch.num_rows), size)
    return row, np.asarray(terms.flatten()).astype(np.int64), np.asarray(counts.flatten()).astype(np.int64), n


def _best(group: np.ndarray, order: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the first k of every group, by the given keys (the first counts most)."""
    at = np.lexsort((*reversed(order), group))
    g = group[at]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return at[rank < k]


def term_batches(batches: Iterator[pa.RecordBatch], impacts: Impacts, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of each term, how many documents of this task hold it, and its k largest impacts here."""
    df, term, top = np.zeros(n_terms, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        row, t, counts, n = _entries(batch)
        df += np.bincount(t, minlength=n_terms)
        term, top = np.concatenate([term, t]), np.concatenate([top, impacts(counts, n[row])])
        keep = _best(term, [-top], k)
        term, top = term[keep], top[keep]
    if len(term):
        size = np.bincount(term, minlength=n_terms)
        some = np.flatnonzero(size)
        tops = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32)), pa.array(top))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some]), tops], names=["term", "df", "tops"])


class Join:
    """A block of items: which terms make candidates of which items, thresholds and bounds."""

    def __init__(self, item: np.ndarray, term: np.ndarray, repeats: np.ndarray, n_items: int, weight: np.ndarray, largest: np.ndarray, kth: np.ndarray, impacts: Impacts, k: int) -> None:
        self.impacts, self.weight, self.k, self.n_items, self.n_terms = impacts, weight, k, n_items, len(weight)
        self.threshold = np.zeros(n_items, np.int64)
        np.maximum.at(self.threshold, item, repeats * weight[term] * kth[term])
        bound = repeats * weight[term] * largest[term]
        order = np.lexsort((bound, item))
        item, term, repeats, bound = (a[order] for a in (item, term, repeats, bound))
        # Sums of bounds from the smallest on, within each item.
        so_far = np.cumsum(bound)
        begins = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=n_items))])
        before = np.concatenate([[0], so_far])[begins[item]]
        behind = so_far - before < self.threshold[item]
        self.suffix = np.zeros(n_items, np.int64)
        np.add.at(self.suffix, item[behind], bound[behind])
        head = np.flatnonzero(~behind)[np.argsort(term[~behind], kind="stable")]
        self.head_at = np.concatenate([[0], np.cumsum(np.bincount(term[head], minlength=self.n_terms))])
        self.head_item, self.head_repeats = item[head], repeats[head]
        self.tail_at = np.concatenate([[0], np.cumsum(np.bincount(item[behind], minlength=n_items))])
        self.tail_term, self.tail_repeats = term[behind], repeats[behind]


def _spread(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups ``which`` of a layout with borders ``at``: the asking place and each member."""
    size = at[which + 1] - at[which]
    asking = np.repeat(np.arange(len(which)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return asking, at[which][asking] + inside


def search_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The k best documents of this task for each item."""
    join: Join = got(shared)
    threshold = join.threshold.copy()
    item, score, doc, missing = (np.zeros(0, np.int64) for _ in range(4))
    for batch in batches:
        row, term, counts, n = _entries(batch)
        ids = batch.column("doc_id")
        no_id, ids = np.asarray(ids.is_null()).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False)
        impact = join.weight[term] * join.impacts(counts, n[row])
        keys = row * join.n_terms + term
        pairs = np.concatenate([[0], np.cumsum(join.head_at[term + 1] - join.head_at[term])])
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(pairs[edges], pairs[edges[lo]] + PAIRS, "right")) - 1)
            own = np.arange(edges[lo], edges[hi])
            lo = hi
            asking, member = _spread(join.head_at, term[own])
            if not len(member):
                continue
            entry = own[asking]
            pair, where = np.unique(row[entry] * join.n_items + join.head_item[member], return_inverse=True)
            known = np.zeros(len(pair), np.int64)
            np.add.at(known, where, join.head_repeats[member] * impact[entry])
            its = pair % join.n_items
            keep = (known + join.suffix[its] >= threshold[its]) & (known + join.suffix[its] > 0)
            its, at_row, known = its[keep], pair[keep] // join.n_items, known[keep]
            asking, member = _spread(join.tail_at, its)
            wanted = at_row[asking] * join.n_terms + join.tail_term[member]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there = keys[place] == wanted
            np.add.at(known, asking[there], join.tail_repeats[member[there]] * impact[place[there]])
            keep = (known > 0) & (known >= threshold[its])
            if not keep.any():
                continue
            item, score = np.concatenate([item, its[keep]]), np.concatenate([score, known[keep]])
            doc, missing = np.concatenate([doc, ids[at_row[keep]]]), np.concatenate([missing, no_id[at_row[keep]]])
            best = _best(item, [-score, missing, doc], join.k)
            item, score, doc, missing = item[best], score[best], doc[best], missing[best]
            full = np.flatnonzero(np.bincount(item, minlength=join.n_items) == join.k)
            last = np.searchsorted(item, full, "right") - 1
            threshold[full] = np.maximum(threshold[full], score[last])
    yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, mask=missing.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])


def _terms(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of some texts, and text, term and repeats of each term of each text."""
    words, rows = [], []
    for lo, _, found, row in terms_of(pa.array(texts, type=pa.string())):
        words.append(found)
        rows.append(row + lo)
    if not words:
        return pa.array([], type=pa.large_binary()), *(np.zeros(0, np.int64) for _ in range(3))
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    asked = coded.dictionary
    keys, repeats = np.unique(np.concatenate(rows) * max(1, len(asked)) + np.asarray(coded.indices).astype(np.int64), return_counts=True)
    return asked, keys // max(1, len(asked)), keys % max(1, len(asked)), repeats


def search(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = kept(only(items, "item_id", "text").select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct())
    id_type = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * total // item_bytes) if total > item_bytes else 1
    out, impacts = spark.createDataFrame([], schema), None
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.collect()  # a block's texts
        asked, item, term, repeats = _terms([r["text"] for r in rows])
        if not len(asked):
            continue
        vocabulary = sent(spark, asked)
        index = kept(docs.mapInArrow(lambda batches, v=vocabulary: index_batches(batches, v), INDEX))
        if impacts is None:
            impacts = Impacts(*(x or 0 for x in index.agg(F.count("*"), F.sum("n")).first()))
        if not impacts.documents:
            drop(index)
            break
        n_terms = len(asked)
        parts = kept(index.mapInArrow(lambda batches: term_batches(batches, impacts, n_terms, k), "term int, df long, tops array<long>"))
        best = Window.partitionBy("term").orderBy(F.desc("top"))
        tops = parts.select("term", F.explode("tops").alias("top")).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k)
        tops = tops.groupBy("term").agg(F.max("top").alias("largest"), F.min(F.when(F.col("at") == k, F.col("top"))).alias("kth"))
        df, largest, kth = (np.zeros(n_terms, np.int64) for _ in range(3))
        for r in parts.groupBy("term").agg(F.sum("df").alias("df")).join(tops, "term").collect():  # a block's terms
            df[r["term"]], largest[r["term"]], kth[r["term"]] = r["df"], r["largest"], r["kth"] or 0
        there = df[term] > 0
        join = Join(item[there], term[there], repeats[there], len(rows), np.where(df > 0, impacts.weights(df), 0), largest, kth, impacts, k)
        shared = sent(spark, join)
        found = index.mapInArrow(lambda batches, s=shared: search_batches(batches, s), FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), schema["item_id"]]))
        found = kept(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        drop(index, parts)
        out = out.unionByName(found)
    return out
