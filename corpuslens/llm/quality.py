"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of byte n-grams, so n-grams are exact integers and no vocabulary is cut.  Texts
are put into chunks where they lie, and a chunk's n-grams stand for it in all joins: counts
of the chunks' trusted documents are merged in shards; the sums for contexts, continuations
and lower orders are joins and aggregates of the count tables; every chunk sends its distinct
n-grams to shards that hold the same part of the model, and gets back their probabilities,
from which its documents have their perplexities.  Only the tables of up to two bytes, which
cannot exceed 66,000 rows, are broadcast; nothing that grows with the corpus comes to the
driver.  Chunks are a bucketed table, so neither join moves texts.

One trusted document in ``FOLDS`` is held out of the training; every document is kept or not
by a quantile of the held-out documents of its language.

Defined results: null and empty texts have their language's mean perplexity and are kept;
a null language is a language of its own; languages with few held-out documents take the
quantile of all; without trusted text to train on, or to hold out, the threshold is null and
all is kept; conflicting labels of a document count as bad; repeated documents are each
scored; other columns are ignored; an empty table gives no rows; whole texts are read.
Probabilities travel in steps of 1/2048 nat.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import pack_plain, pack_sorted, unpack_plain, unpack_sorted
from ._spark import drop, got, kept, only, remove, scratch, sent

ORDER, START = 5, 2
#: Of the held-out trusted documents of a language, and what others may exceed it by.
QUANTILE, SLACK = 0.995, 1.1
FOLDS = 5
#: Held-out documents that a language needs for a threshold of its own.
LANGUAGE_DOCS = 50
#: Bytes at the language's mean that every document is taken to have besides its own.
PRIOR_BYTES = 40
#: Text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES, BLOCK = 8 << 20, 1 << 20
#: Chunks whose n-grams one task looks up, about, and rows of the model that it holds.
TASK_CHUNKS, TASK_ROWS = 128, 1_000_000
#: Steps of a probability on its way to a chunk, for each nat.
STEPS = 2048
SLOT_BITS = 18
#: Languages whose limits are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
CHUNK = "chunk long, doc_ids array<long>, known array<boolean>, langs array<string>, sizes array<long>, text binary"


def gram_keys(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last ``ORDER`` bytes up to every byte as one number; texts begin after ``START``s."""
    ext = np.full(len(raw) + ORDER - 1, START, dtype=np.uint64)
    ext[ORDER - 1 :] = raw
    key = ext[ORDER - 1 :].copy()
    for j in range(1, ORDER):
        key |= ext[ORDER - 1 - j : len(ext) - j] << np.uint64(8 * j)
    for i in range(ORDER - 1):
        at = offsets[:-1][offsets[:-1] + i < offsets[1:]] + i
        own = np.uint64((1 << 8 * (i + 1)) - 1)
        before = np.uint64(sum(START << 8 * j for j in range(i + 1, ORDER)))
        key[at] = key[at] & own | before
    return key


def _blocks(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray | None = None):
    """(first row, last row + 1, keys of their bytes) of rows of about a block together; of the
    given rows only, if any are given."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
        own = offsets[lo : hi + 1] - offsets[lo]
        keys = gram_keys(raw[offsets[lo] : offsets[hi]], own)
        if rows is not None:
            keys = keys[np.repeat(rows[lo:hi], np.diff(own))]
        yield lo, hi, keys
        lo = hi


def make_chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a task as chunks: their texts together, compressed."""
    codec, held, size = pa.Codec("zstd", compression_level=3), [], 0

    def flush() -> pa.RecordBatch:
        rows, ids, langs, texts = zip(*held)
        blob = codec.compress(b"".join(texts), asbytes=True)
        cols = [pa.array([rows[0]]), pa.array([[i or 0 for i in ids]], type=pa.list_(pa.int64())), pa.array([[i is not None for i in ids]], type=pa.list_(pa.bool_())), pa.array([langs], type=pa.list_(pa.string())), pa.array([[len(t) for t in texts]], type=pa.list_(pa.int64())), pa.array([blob], type=pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["chunk", "doc_ids", "known", "langs", "sizes", "text"])

    for batch in batches:
        for row, doc, lang, text in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "lang")], batch.column("text")):
            text = text.as_buffer().to_pybytes() if text.is_valid else b""
            if held and (size + len(text) > chunk_bytes or len(held) >= 100_000):
                yield flush()
                held, size = [], 0
            held.append((row, doc, lang, text))
            size += len(text)
    if held:
        yield flush()


def _text_of(row) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(np.asarray(row["sizes"], dtype=np.int64))])
    raw = pa.Codec("zstd").decompress(row["text"], int(offsets[-1]), asbytes=True) if offsets[-1] else b""
    return np.frombuffer(raw, dtype=np.uint8), offsets


class Seen:
    """Keys met so far, by slots that hold one key each: most repeats are told apart at once."""

    def __init__(self) -> None:
        self.slots, self.numbers = np.full(1 << SLOT_BITS, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << SLOT_BITS, np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def put(self, keys: np.ndarray, numbers: np.ndarray | None = None) -> None:
        at = self.slot(keys)
        self.slots[at] = keys
        if numbers is not None:
            # Of keys with one slot the last written stays, in both tables.
            own = self.slots[at] == keys
            self.numbers[at[own]] = numbers[own]


def distinct_keys(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen, parts = Seen(), [np.zeros(0, np.uint64)]
    for _, _, keys in _blocks(raw, offsets):
        new = np.unique(keys[seen.slots[seen.slot(keys)] != keys])
        seen.put(new)
        parts.append(new)
    return np.unique(np.concatenate(parts))


def shard_of(pair: np.ndarray, bits: int) -> np.ndarray:
    """The shard of n-grams by the two bytes before the predicted one."""
    return (((pair * np.uint64(40503)) & np.uint64(0xFFFF)) >> np.uint64(16 - bits)).astype(np.int64)


def count_chunk(bits: int):
    """Packed n-grams of a chunk's training documents and their counts, by shard."""

    def cells(chunks, train):
        import pandas as pd

        out: dict[str, list] = {"shard": [], "keys": [], "counts": []}
        if len(chunks) and len(train):
            raw, offsets = _text_of(chunks.iloc[0])
            rows = np.zeros(len(offsets) - 1, dtype=bool)
            rows[np.asarray(train["at"].iloc[0], dtype=np.int64)] = True
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for _, _, own in _blocks(raw, offsets, rows):
                new, n = np.unique(own, return_counts=True)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
            shard = shard_of((keys >> np.uint64(8)) & np.uint64(0xFFFF), bits)
            for k in np.unique(shard).tolist():
                out["shard"].append(k)
                out["keys"].append(pack_sorted(keys[shard == k]))
                out["counts"].append(pack_plain(counts[shard == k].astype(np.uint64)))
        return pd.DataFrame(out).astype({"shard": "int32"})

    return cells


def merge_counts(pdf):
    import pandas as pd

    keys, where = np.unique(np.concatenate([unpack_sorted(x) for x in pdf["keys"]]), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([unpack_plain(x) for x in pdf["counts"]]))
    return pd.DataFrame({"key": keys.astype(np.int64), "n": counts.astype(np.int64)})


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney, from how many n-grams are there 1 to 4 times."""
    n1, n2, n3, n4 = counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """order, key, log probability, and log of the weight that the key leaves to shorter
    contexts when it is one, for all n-grams up to ``ORDER`` bytes (counts: key, n)."""
    tables = {ORDER: counts}
    for m in range(ORDER - 1, 0, -1):  # continuation counts: different bytes before
        tables[m] = kept(tables[m + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * m)) - 1)).alias("key")).agg(F.count("*").alias("n")))
    lower, out = None, []
    for m in range(1, ORDER + 1):
        d = discounts(tables[m])
        rows = tables[m].withColumn("context", F.shiftright("key", 8))
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("left"))
        rows = rows.join(contexts, "context").select("key", "context", (F.greatest(F.col("n") - cut, F.lit(0.0)) / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("gamma"))
        if lower is None:
            rows = rows.withColumn("p", F.col("own") + F.col("gamma") / 256)
        else:
            shorter = lower.select(F.col("key").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << (8 * (m - 1))) - 1))).join(shorter, "suffix").withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        lower = kept(rows.select("key", "context", "p", "gamma"))
        out.append(lower.select(F.lit(m).alias("order"), "key", F.log("p").alias("value")))
        out.append(lower.groupBy("context").agg(F.first("gamma").alias("gamma")).select(F.lit(-m).alias("order"), F.col("context").alias("key"), F.log("gamma").alias("value")))
    model = out[0]
    for x in out[1:]:
        model = model.unionByName(x)
    return kept(model)


class Table:
    """Values by key, in the order of the keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.float32), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys


class Model:
    """Log probabilities and log weights of contexts by order, all or one shard's."""

    def __init__(self, order: np.ndarray, key: np.ndarray, value: np.ndarray) -> None:
        self.tables = {m: Table(key[order == m].astype(np.uint64), value[order == m]) for m in [*range(1, ORDER + 1), *range(-ORDER, 0)]}

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of the last byte of every key given those before, backing off where unseen."""
        total, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for m in range(ORDER, 0, -1):
            gram = keys[open_] & np.uint64((1 << (8 * m)) - 1)
            value, seen = self.tables[m].get(gram)
            total[open_[seen]] += value[seen]
            left, known = self.tables[-m].get(gram[~seen] >> np.uint64(8))
            open_ = open_[~seen]
            total[open_[known]] += left[known]
        total[open_] -= math.log(256)
        return total


def pack_model(pdf):
    """One row for a shard of the model."""
    import pandas as pd

    order, key, value = pdf["order"].to_numpy(np.int8), pdf["key"].to_numpy(np.int64), pdf["value"].to_numpy(np.float32)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "orders": [order.tobytes()], "grams": [key.tobytes()], "values": [value.tobytes()]})


def ask_chunk(bits: int, salts: int):
    """A chunk's distinct n-grams by shard of the model, and the part of the shard's tasks that
    looks them up."""

    def cells(pdf):
        import pandas as pd

        out: dict[str, list] = {"shard": [], "salt": [], "chunk": [], "keys": []}
        for _, row in pdf.iterrows():
            keys = distinct_keys(*_text_of(row))
            shard = shard_of((keys >> np.uint64(8)) & np.uint64(0xFFFF), bits)
            for k in np.unique(shard).tolist():
                out["shard"].append(k)
                out["salt"].append(hash(int(row["chunk"])) % salts)
                out["chunk"].append(int(row["chunk"]))
                out["keys"].append(pack_sorted(keys[shard == k]))
        return pd.DataFrame(out).astype({"shard": "int32", "salt": "int32", "chunk": "int64"})

    return cells


def answer(low):
    """Quantised log probabilities of the n-grams that chunks ask for, in the order asked."""

    def cells(asked, part):
        import pandas as pd

        out: dict[str, list] = {"chunk": [], "shard": [], "values": []}
        if len(asked):
            parts = [got(low)]
            for _, row in part.iterrows():
                parts.append((np.frombuffer(row["orders"], np.int8), np.frombuffer(row["grams"], np.int64), np.frombuffer(row["values"], np.float32)))
            model = Model(*[np.concatenate(x) for x in zip(*parts)])
            for chunk, shard, keys in zip(asked["chunk"], asked["shard"], asked["keys"]):
                p = model.log_probabilities(unpack_sorted(keys))
                out["chunk"].append(chunk)
                out["shard"].append(shard)
                out["values"].append(pack_plain(np.clip(np.rint(-p * STEPS), 0, 65_535).astype(np.uint64)))
        return pd.DataFrame(out).astype({"chunk": "int64", "shard": "int32"})

    return cells


def score_chunk(bits: int):
    """Size and loss (negative log likelihood) of every document of a chunk."""

    def scores(chunks, told):
        import pandas as pd

        row = chunks.iloc[0]
        raw, offsets = _text_of(row)
        keys = distinct_keys(raw, offsets)
        shard = shard_of((keys >> np.uint64(8)) & np.uint64(0xFFFF), bits)
        value = np.zeros(len(keys))
        for k, values in zip(told["shard"], told["values"]):
            value[shard == k] = unpack_plain(values).astype(np.float64) / STEPS
        seen = Seen()
        seen.put(keys, np.arange(len(keys)))
        loss = np.zeros(len(offsets) - 1)
        for lo, hi, own in _blocks(raw, offsets):
            slot = seen.slot(own)
            at = seen.numbers[slot]
            miss = np.flatnonzero(seen.slots[slot] != own)
            at[miss] = np.searchsorted(keys, own[miss])
            total = np.concatenate([[0.0], np.cumsum(value[at])])
            edges = offsets[lo : hi + 1] - offsets[lo]
            loss[lo:hi] = total[edges[1:]] - total[edges[:-1]]
        ids = pd.array([int(i) if k else None for i, k in zip(row["doc_ids"], row["known"])], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "lang": list(row["langs"]), "size": np.diff(offsets), "loss": loss})

    return scores


def _power(x: float, most: int = 16) -> int:
    return min(most, max(4, math.ceil(math.log2(max(1.0, x)))))


def perplexities(docs: DataFrame, trusted: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame | None:
    """doc_id, lang, size and loss (negative log likelihood) of every document; ``trusted``
    has the doc_ids whose texts the model is trained on."""
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "lang", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    name, path = f"corpuslens_chunks_{uuid.uuid4().hex}", scratch(spark, "chunks")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # With at least as many buckets as shuffle partitions, joins on the chunk move only the other side.
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions") or 8), min(20_000, math.ceil(total / chunk_bytes / 4)))
    rows.mapInArrow(lambda batches: make_chunks(batches, chunk_bytes), CHUNK).write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    try:
        chunks = spark.table(name)
        n_chunks, bits = chunks.count(), _power(total / (64 << 20))
        members = chunks.select("chunk", F.posexplode(F.arrays_zip("doc_ids", "known")).alias("at", "d")).filter("d.known").select("chunk", "at", F.col("d.doc_ids").alias("doc_id")).join(trusted.hint("merge"), "doc_id", "left_semi")
        train = members.groupBy(F.col("chunk").alias("of")).agg(F.collect_list("at").alias("at"))  # at most the documents of a chunk
        cells = chunks.select("chunk", "sizes", "text").groupBy("chunk").cogroup(train.groupBy("of")).applyInPandas(count_chunk(bits), "shard int, keys binary, counts binary")
        counts = kept(cells.groupBy("shard").applyInPandas(merge_counts, "key long, n long"))
        if counts.isEmpty():
            return None
        model = kneser_ney(counts)
        few = F.abs("order") <= 2
        low = model.filter(few).select(F.col("order").cast("byte"), "key", F.col("value").cast("float")).toArrow()  # at most 256 * 256 + 2 * 256 + 1 rows
        low = sent(spark, (low["order"].to_numpy(), low["key"].to_numpy(), low["value"].to_numpy()))
        bits, salts = _power(model.count() / TASK_ROWS), max(1, math.ceil(n_chunks / TASK_CHUNKS))
        pair = F.when(F.col("order") > 0, F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(F.lit(0xFFFF))
        parts = model.filter(~few).withColumn("shard", _shard_column(pair, bits)).groupBy("shard").applyInPandas(pack_model, "shard int, orders binary, grams binary, values binary")
        parts = kept(parts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        asked = chunks.select("chunk", "sizes", "text").groupBy("chunk").applyInPandas(ask_chunk(bits, salts), "shard int, salt int, chunk long, keys binary")
        told = asked.groupBy("shard", "salt").cogroup(parts.groupBy("shard", "salt")).applyInPandas(answer(low), "chunk long, shard int, values binary")
        out = kept(chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(score_chunk(bits), "doc_id long, lang string, size long, loss double"))
        drop(counts, model)
        return out
    finally:
        spark.sql(f"drop table if exists {name}")
        remove(spark, path)


def _shard_column(pair: Column, bits: int) -> Column:
    """``shard_of`` as a column."""
    return F.shiftright((pair * 40503).bitwiseAND(F.lit(0xFFFF)), 16 - bits).cast("int")


def _language() -> Column:
    return F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("language")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, lang, perplexity, threshold and keep of every document; trusted are those
    labelled as of good quality."""
    trusted = only(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality")).filter("quality = 1").select("doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)) == 0
    scored = perplexities(docs, trusted.filter(~fold), chunk_bytes)
    if scored is None:
        return only(docs, "doc_id", "lang").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    # Always by a shuffle of ids: how many are trusted grows with the corpus.
    held = kept(scored.join(trusted.filter(fold).hint("merge"), "doc_id", "left_semi").select(_language(), "size", "loss"))
    mean = (F.sum("loss") / F.greatest(F.sum("size"), F.lit(1))).alias("mean")
    everywhere = held.agg(mean).first()["mean"] or 0.0
    means = held.groupBy("language").agg(mean)
    small = F.broadcast if means.count() <= BROADCAST_LANGUAGES else lambda df: df
    perplexity = F.exp((F.col("loss") + PRIOR_BYTES * F.coalesce("mean", F.lit(everywhere))) / (F.col("size") + PRIOR_BYTES)).alias("perplexity")
    held = held.join(small(means), "language").select("language", perplexity)
    overall = held.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("t")).first()["t"]
    limits = held.groupBy("language").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("limit"), F.count("*").alias("n"))
    limits = means.join(small(limits.filter(F.col("n") >= LANGUAGE_DOCS).drop("n")), "language", "left")
    threshold = (F.coalesce("limit", F.lit(overall).cast("double")) * SLACK).alias("threshold")
    out = scored.withColumn("language", _language()).join(small(limits), "language", "left").select("doc_id", "lang", perplexity, threshold)
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
