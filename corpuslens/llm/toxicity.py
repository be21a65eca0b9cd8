"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: negation, reporting verb, target, intent, harm verb, insult of one of
eight strengths, other.  Five weighted transducers - negation, reported speech, target,
threat, insult - are composed into one; a clause's weight is what the composed machine
gives along its classes, so an insult counts more beside a target and less when negated or
reported.  Insult strengths are learned: beginnings of words and whole words that mark
toxic texts in a bounded sample of labelled rows, beside a few fixed seed words.

Defined results: null and empty texts get the score of a text without matched clauses;
without labelled rows fixed calibration is used; conflicting labels of a document count as
toxic; labels that are null are ignored; repeated documents are each scored, equal texts alike;
an empty table gives no rows; other columns are ignored; whole texts are read, however long, and
every matched clause of theirs counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import BYTE_CODES, Roller, find_words, text_blocks
from ._spark import got, kept, only, sent

#: Labelled rows that the strengths are learned from, about, at most; bounds the marks too.
TRAINING_ROWS = 20_000
PREFIXES = (4, 5, 6, 7)
LEVELS = 8

#: Word lists of the grammar, in four languages.
NEGATIONS = "not no never isn't aren't wasn't don't ne pas jamais non nicht kein keine nie niemals nunca jamás".split()
REPORTING = "said says say told called reported quoted wrote claims claimed dit disait écrit sagte sagt schrieb nannte dijo dice escribió llamó".split()
TARGETS = "you your you're u he she they them him her people toi tu vous ton votre du dich dein ihr euch sie tú vosotros usted ustedes te".split()
INTENTS = "will gonna going want shall i'll we'll vais va vamos werde werden will voy vamos".split()
HARMS = "kill hurt beat destroy murder shoot stab burn hang tuer frapper détruire töten umbringen schlagen matar golpear destruir".split()
SEEDS = "idiot moron stupid loser scum trash worthless pathetic disgusting imbecile dumb filth vermin crétin imbécile connard débile ordure dummkopf trottel abschaum arschloch versager estúpido imbécil basura escoria inútil".split()

OTHER, NEGATION, REPORT, TARGET, INTENT, HARM = "o", "n", "r", "t", "w", "k"
INSULTS = "01234567"
NEGATED, REPORTED = "ABCDEFGH", "abcdefgh"
SEED_LEVEL = 4


class Machine:
    """A deterministic weighted transducer: (state, symbol) -> (state, symbol out, weight)."""

    def __init__(self, step, start, symbols: str) -> None:
        self.start, self.arcs, todo = 0, {}, [start]
        number = {start: 0}
        for s in todo:
            for x in symbols:
                t, out, weight = step(s, x)
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
                self.arcs[number[s], x] = (number[t], out, weight)

    def then(self, other: Machine, symbols: str) -> Machine:
        """The composition: this machine's output is the other's input; weights add up."""

        def step(state, x):
            a, b = state
            a, mid, w = self.arcs[a, x]
            b, out, v = other.arcs[b, mid]
            return (a, b), out, w + v

        return Machine(step, (0, 0), symbols)

    def weigh(self, classes: str) -> float:
        state, total = self.start, 0.0
        for x in classes:
            state, _, w = self.arcs[state, x]
            total += w
        return total


def _negation(left: int, x: str):
    if x == NEGATION:
        return 3, OTHER, 0.0
    if left and x in INSULTS:
        return 0, NEGATED[int(x)], 0.0
    if left and x == HARM:
        return 0, OTHER, 0.0
    return max(0, left - 1), x, 0.0


def _reported(left: int, x: str):
    if x == REPORT:
        return 4, OTHER, 0.0
    if left and x in INSULTS:
        return left, REPORTED[int(x)], 0.0
    return max(0, left - 1), x, 0.0


def _target(state: tuple[int, int], x: str):
    """Adds weight where a target stands within two words of a plain insult, on either side."""
    target, insult = state
    if x == TARGET:
        return (2, 0), x, 0.5 if insult else 0.0
    if x in INSULTS:
        return (0, 0 if target else 2), x, 0.5 if target else 0.0
    return (max(0, target - 1), max(0, insult - 1)), x, 0.0


def _threat(state: tuple[int, int], x: str):
    """Intent, then a harm verb within three words, then a target within two: a threat."""
    intent, harm = state
    if x == INTENT:
        return (3, 0), OTHER, 0.0
    if x == HARM:
        return (0, 2 if intent else 0), OTHER, 0.0
    if x == TARGET and harm:
        return (0, 0), OTHER, 2.5
    return (max(0, intent - 1), max(0, harm - 1)), x, 0.0


def _insult(seen: int, x: str):
    """Insults by strength; negated ones count for little, reported ones for half, later ones for less."""
    for symbols, share in ((INSULTS, 1.0), (NEGATED, 0.15), (REPORTED, 0.5)):
        if x in symbols:
            return 1, OTHER, (symbols.index(x) + 1) * 0.5 * share * (0.6 if seen else 1.0)
    return seen, x, 0.0


def grammar() -> Machine:
    base = OTHER + NEGATION + REPORT + TARGET + INTENT + HARM + INSULTS
    wide = base + NEGATED + REPORTED
    negated = Machine(_negation, 0, base)
    for step, start in ((_reported, 0), (_target, (0, 0)), (_threat, (0, 0)), (_insult, 0)):
        negated = negated.then(Machine(step, start, wide), base)
    return negated


_breaks = np.zeros(256, dtype=bool)
_breaks[[ord(c) for c in ".!?;:\n,|"]] = True
_word = np.zeros(256, dtype=bool)
_word[0x30:0x3A] = _word[0x41:0x5B] = _word[0x61:0x7B] = _word[0x80:] = True
_word[ord("'")] = True
BREAKS, IS_WORD = _breaks, _word


def _hash_words(words: list[str], roller: Roller) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    start, end, _ = find_words(raw, np.array([0, len(raw)]), IS_WORD)
    return roller.stretch(roller.prefix(BYTE_CODES[raw]), start, end)


def _marks(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, roller: Roller):
    """Hashes of whole words and of their beginnings; a mask says which words have each."""
    yield roller.stretch(prefix, start, end), np.ones(len(start), dtype=bool)
    for n in PREFIXES:
        long = end - start > n
        cut = np.where(long, start + n, end)
        yield roller.stretch(prefix, start, cut) ^ np.uint64(n), long


def _lowered(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def count_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of the task each mark stands; sums are sent on whenever
    they have grown to some size."""
    roller, held = Roller(), []

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
        return keys, *(np.bincount(inverse, weights=np.concatenate([h[i] for h in held]), minlength=len(keys)).astype(np.int64) for i in (1, 2))

    def batch_of(keys: np.ndarray, hits: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(hits), pa.array(rest)], names=["mark", "toxic", "other"])

    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, raw, offsets in text_blocks(_lowered(batch.column("text"))):
            start, end, row = find_words(raw, offsets, IS_WORD)
            for h, has in _marks(roller.prefix(BYTE_CODES[raw]), start, end, roller):
                own, where = h[has], row[has]
                order = np.lexsort((where, own))
                own, where = own[order], where[order]
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (where[1:] != where[:-1])
                keys, hit = own[new], toxic[lo:hi][where[new]].astype(np.int64)
                held.append((keys, hit, 1 - hit))
            if sum(len(k) for k, _, _ in held) > 1_500_000:
                held = [summed()]
                if len(held[0][0]) > 750_000:
                    yield batch_of(*held[0])
                    held = []
    if held:
        yield batch_of(*summed())


def count_contexts(batches: Iterator[pa.RecordBatch], candidates) -> Iterator[pa.RecordBatch]:
    """Candidate marks with the word before: copies of a text add nothing new."""
    roller, known = Roller(), candidates.value
    for batch in batches:
        toxic, rows = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.uint64), []
        for lo, hi, raw, offsets in text_blocks(_lowered(batch.column("text"))):
            start, end, row = find_words(raw, offsets, IS_WORD)
            before = None
            for h, has in _marks(roller.prefix(BYTE_CODES[raw]), start, end, roller):
                if before is None:
                    before = np.concatenate([np.zeros(1, np.uint64), h[:-1] >> np.uint64(33)]) if len(h) else h
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(has & (known[at] == h)) if len(known) else np.zeros(0, np.int64)
                rows.append(np.stack([h[hit], before[hit] * np.uint64(2) + toxic[lo:hi][row[hit]]]))
        if rows:
            marks, contexts = np.unique(np.concatenate(rows, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array((contexts >> np.uint64(1)).astype(np.int64)), pa.array((contexts & np.uint64(1)).astype(np.int64))], names=["mark", "context", "toxic"])


class Lexicon:
    """Classes of words by hash, and the composed grammar."""

    def __init__(self, levels: dict[int, int]) -> None:
        roller = Roller()
        table = {int(h): INSULTS[SEED_LEVEL] for h in _hash_words(SEEDS, roller)}
        for words, symbol in ((NEGATIONS, NEGATION), (REPORTING, REPORT), (TARGETS, TARGET), (INTENTS, INTENT), (HARMS, HARM)):
            table |= {int(h): symbol for h in _hash_words(words, roller)}
        for mark, level in levels.items():
            if level < 0:
                table.pop(mark, None)
            else:
                table[mark] = INSULTS[level]
        self.keys = np.array(sorted(table), dtype=np.uint64)
        self.symbols = np.array([ord(table[int(k)]) for k in self.keys], dtype=np.uint8)
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.machine = grammar()

    def classes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, roller: Roller) -> np.ndarray:
        out = np.full(len(start), ord(OTHER), dtype=np.uint8)
        for h, has in _marks(roller.prefix(BYTE_CODES[raw]), start, end, roller):
            maybe = np.flatnonzero(has & self.sieve[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            found = self.keys[at] == h[maybe]
            maybe, symbol = maybe[found], self.symbols[at[found]]
            old = out[maybe]
            insult = (symbol >= ord("0")) & (symbol <= ord("7"))
            better = (old == ord(OTHER)) | insult & ((old > ord("7")) | (symbol > old))
            out[maybe[better]] = symbol[better]
        return out


def clause_weights(column: pa.Array, lexicon: Lexicon, roller: Roller) -> np.ndarray:
    """The sum of the matched clauses' weights of each text."""
    total = np.zeros(len(column))
    for lo, _, raw, offsets in text_blocks(_lowered(column)):
        start, end, row = find_words(raw, offsets, IS_WORD)
        if not len(start):
            continue
        symbols = lexicon.classes(raw, start, end, roller)
        hot = (symbols >= ord("0")) & (symbols <= ord("7")) | (symbols == ord(HARM))
        if not hot.any():
            continue
        breaks = np.concatenate([[0], np.cumsum(BREAKS[raw])])[start] + row
        edges = np.concatenate([[0], np.flatnonzero(np.diff(breaks) | np.diff(row)) + 1, [len(start)]])
        for c in np.unique(np.searchsorted(edges, np.flatnonzero(hot), "right") - 1).tolist():
            a, b = edges[c], edges[c + 1]
            total[lo + row[a]] += lexicon.machine.weigh(symbols[a:b].tobytes().decode())
    return total


def weigh_batches(batches: Iterator[pa.RecordBatch], lexicon, text: str = "text") -> Iterator[pa.RecordBatch]:
    roller, lexicon = Roller(), got(lexicon)
    for batch in batches:
        weights = pa.array(np.log1p(np.maximum(clause_weights(batch.column(text), lexicon, roller), 0.0)))
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in batch.schema.names if n != text] + [weights], names=[n for n in batch.schema.names if n != text] + ["weight"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, lightly held towards a fixed one."""
    w, fixed = np.array([4.0, -2.5]), np.array([4.0, -2.5])
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.5 * (w - fixed)
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.1)), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS):
    """The broadcast lexicon, and slope and intercept of the score."""
    spark = docs.sparkSession
    known = only(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(~held_out(F.col("doc_id")))
    n = known.count()
    share = min(1.0, training_rows / max(n, 1))
    sample = F.broadcast(known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)))  # about training_rows rows of 12 bytes
    train = kept(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sample, "doc_id").select("text", "toxic"))
    size = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    rate = (size["t"] + 0.5) / (size["n"] + 1)
    marks = train.mapInArrow(count_marks, "mark long, toxic long, other long").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter("toxic >= 3 or other >= 3")
    likely = marks.filter((F.col("toxic") >= 3) & (F.col("toxic") > 2 * F.col("other")) & (F.col("toxic") > 4 * rate * (F.col("toxic") + F.col("other"))))
    candidates = spark.sparkContext.broadcast(np.array(sorted(r["mark"] % (1 << 64) for r in likely.select("mark").collect()), dtype=np.uint64))
    contexts = train.mapInArrow(lambda batches: count_contexts(batches, candidates), "mark long, context long, toxic long").distinct()
    by_mark = contexts.groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("other") + 0.5)) - math.log(rate / (1 - rate))
    surprise = 2 * (F.col("toxic") * F.log((F.col("toxic") + 1e-9) / ((F.col("toxic") + F.col("other")) * rate)) + F.col("other") * F.log((F.col("other") + 1e-9) / ((F.col("toxic") + F.col("other")) * (1 - rate))))
    least = 2 * math.log(20 * max(20, len(candidates.value)))
    told = by_mark.withColumn("odds", odds).withColumn("surprise", surprise).filter((F.col("toxic") > 5 * F.col("other")) & (F.col("odds") > 1.5) & (F.col("surprise") > least))
    levels = {r["mark"] % (1 << 64): min(LEVELS - 1, max(0, int(r["odds"] / 0.8))) for r in told.select("mark", "odds").collect()}
    seeds = [int(h) for h in _hash_words(SEEDS, Roller())]
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in seeds]
    for r in marks.filter(F.col("mark").isin(signed) & (F.col("other") >= 3) & (F.col("other") > 2 * F.col("toxic"))).collect():
        levels[r["mark"] % (1 << 64)] = -1  # a seed that these texts use otherwise
    lexicon = sent(spark, Lexicon(levels))
    pairs = train.mapInArrow(lambda batches: weigh_batches(batches, lexicon), "toxic int, weight double").groupBy("toxic", F.round("weight", 2).alias("weight")).agg(F.count("*").alias("n")).collect()
    x, y = np.array([r["weight"] for r in pairs for _ in range(r["n"])]), np.array([float(r["toxic"]) for r in pairs for _ in range(r["n"])])
    return lexicon, *(_fit(x, y) if len(x) and 0 < y.sum() < len(y) else (4.0, -2.5))


def scored(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The named columns of every document with score and predicted."""
    lexicon, slope, intercept = learn(docs, labels, training_rows)
    rows = only(docs, *columns).withColumn("own_text", F.col("text")) if "text" in columns else only(docs, *columns, "text").withColumnRenamed("text", "own_text")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "own_text"] + [T.StructField("weight", T.DoubleType())])
    weighed = rows.mapInArrow(lambda batches: weigh_batches(batches, lexicon, "own_text"), schema)
    score = 1 / (1 + F.exp(-(F.col("weight") * slope + intercept)))
    return weighed.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("weight")


def score_toxicity(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs, labels, ("doc_id",), training_rows)
    return out.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
