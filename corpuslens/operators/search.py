"""Full-text search over folded French stems: boolean match, rank, excerpts, keyword grids, an index.

A text is matched as one string of stems between blanks, so words and phrases are plain
substrings; a stop word keeps its place as a gap, which any word fills.  The index deals documents
to ranges by length, holds for every stem and range the postings and the largest count, and
answers a top-k query from the ranges that can still hold a better document.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed
from ..functions import french
from ..functions import spans as S
from ..functions import text as T
from ..storage import modest_batches

#: What stands for a stop word.
GAP = "-"
#: Documents of a range of the index, about; ranges that a top-k query reads first.
RANGE_DOCS, FIRST_RANGES = 20_000, 4
#: Words that a worker remembers the stems of, twice some 20 MB; places that it posts at once.
REMEMBERED, POSTED = 100_000, 100_000
#: Fixed value: what one occurrence of a query word weighs in a cover.
COVER_WEIGHT = 0.1


def stem(word: str) -> str | None:
    """The stem of a folded word; none for a stop word."""
    return None if word in french.STOP_WORDS else french.stem(word)


class _Stems(dict):
    """Stems of the words met lately: when they are many, those not met since are forgotten."""

    before: dict = {}

    def __missing__(self, word: str) -> str:
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[word] = out = self.before.get(word) or stem(word) or GAP
        return out


_known = _Stems()


@F.pandas_udf(StringType())
def _stem_words(normal: pd.Series) -> pd.Series:
    return normal.map(lambda t: None if t is None else f" {' '.join(map(_known.__getitem__, t.split()))} ")


def stemmed(text: Column) -> Column:
    """The stems of a text in order, with a blank before, between and after; gaps for stop words."""
    return _stem_words(T.normalise(text))


def tokens(stemmed_text: Column) -> Column:
    """The stems and gaps of a stemmed text."""
    return F.filter(F.split(stemmed_text, " "), lambda w: w != "")


class Query:
    """Web-style syntax: words are required, "phrases" too, or between alternatives, - negates.
    Nothing is a syntax error.

    ``groups`` are alternatives, each a list of stems in order, with None where a stop word leaves a
    gap; stop words alone ask for nothing.  ``words`` are the folded words that may be shown.
    """

    def __init__(self, text: str) -> None:
        if not text.strip():
            raise ValueError("empty query")
        self.text, self.groups, self.negated, self.words = text, [], [], []
        joined = False
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|(\S+))', text):
            raw = T.fold_word(phrase or word)
            if not minus and not phrase and raw in ("or", "ou"):
                joined = bool(self.groups)
                continue
            own = [stem(w) for w in re.findall("[a-z0-9]+", raw)]
            while own and own[-1] is None:
                own.pop()
            while own and own[0] is None:
                own.pop(0)
            if not own:
                continue
            if minus:
                self.negated.append(own)
            else:
                self.words += [w for w in re.findall(r"[^\W\d_]+", raw) if w not in self.words and w not in fixed.QUERY_WORDS]
                if joined:
                    self.groups[-1].append(own)
                else:
                    self.groups.append([own])
            joined = False

    def matches(self, stemmed_text: Column) -> Column:
        def there(phrase: list) -> Column:
            if None in phrase:
                return stemmed_text.rlike(" " + " ".join(w or "[^ ]+" for w in phrase) + " ")
            return F.contains(stemmed_text, F.lit(f" {' '.join(phrase)} "))

        out = F.lit(bool(self.groups or self.negated))
        for group in self.groups:
            any_of = there(group[0])
            for phrase in group[1:]:
                any_of = any_of | there(phrase)
            out = out & any_of
        for phrase in self.negated:
            out = out & ~there(phrase)
        return out

    def wanted(self) -> dict[str, list[int]]:
        """Stems with the numbers of the demands that they meet: a group of single words is one
        demand, and so is every word of a phrase."""
        out: dict[str, list[int]] = {}
        n = 0
        for group in self.groups:
            wide = self._wide(group)
            for phrase in ([w for w in p if w] for p in group):
                for k in range(wide):
                    own = out.setdefault(phrase[min(k, len(phrase) - 1)], [])
                    own += [n + k] if n + k not in own else []
            n += wide
        return out

    @staticmethod
    def _wide(group: list) -> int:
        return max(len(p) - p.count(None) for p in group)

    def demands(self) -> int:
        return sum(map(self._wide, self.groups))

    def rank(self, events: Column) -> Column:
        """Cover density: each shortest stretch that meets all demands counts less the more other
        words it holds.  ``events`` are (at, word) structs in order, of wanted stems only.  Phrases
        count word by word; whether the words stand together is for ``matches``."""
        meets = F.create_map(*[x for w, ks in self.wanted().items() for x in (F.lit(w), F.array(*[F.lit(k) for k in ks]))]) if self.groups else None
        if meets is None:
            return F.lit(0.0)
        spot = "struct<at:int,number:int>"
        none = F.array_repeat(F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("number")).cast(spot), self.demands())
        start = F.struct(none.alias("last"), F.lit(-1).alias("begun"), F.lit(0).alias("number"), F.lit(0.0).alias("sum"))

        def step(s: Column, e: Column) -> Column:
            here = F.struct(e["at"].alias("at"), s["number"].alias("number")).cast(spot)
            last = F.transform(s["last"], lambda x, k: F.when(F.array_contains(meets[e["word"]], k), here).otherwise(x))

            def add(last: Column) -> Column:
                low = F.array_min(last)
                new = low["at"] > s["begun"]
                noise = (e["at"] - low["at"]) - (s["number"] - low["number"])
                return F.struct(last.alias("last"), F.when(new, low["at"]).otherwise(s["begun"]).alias("begun"), (s["number"] + 1).alias("number"), (s["sum"] + F.when(new, COVER_WEIGHT / (1.0 + noise)).otherwise(0.0)).alias("sum"))

            return F.get(F.transform(F.array(last), add), 0)

        return F.aggregate(events, start, step, lambda s: s["sum"])

    def events(self, words: Column) -> Column:
        wanted = list(self.wanted())
        each = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
        return F.filter(each, lambda e: e["word"].isin(*wanted)) if wanted else F.slice(each, 1, 0)


def _best(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(F.desc("rank"), "id").limit(min(max(1, limit), fixed.SEARCH_MAX))


def _shown(top: DataFrame, q: Query, pii: DataFrame | None) -> DataFrame:
    """With the excerpts; texts are redacted before they are cut."""
    if pii is not None:
        own = pii.join(F.broadcast(top.select("id")), "id", "left_semi").groupBy("id").agg(F.collect_list(F.struct("start", "end", "kind", "confirmed")).alias("spans"))
        top = top.join(own, "id", "left").withColumn("text", S.redacted("text", "spans")).drop("spans")
    return top.withColumn("snippet", T.excerpt(F.col("text"), q.words))


def search(docs: DataFrame, query: str, limit: int = fixed.SEARCH_LIMIT, pii: DataFrame | None = None) -> DataFrame:
    """The best documents (id, text) with rank and snippet, found by reading the texts."""
    modest_batches(docs.sparkSession)
    q = Query(query)
    found = docs.withColumn("stemmed", stemmed(F.col("text"))).filter(q.matches(F.col("stemmed")))
    ranked = found.withColumn("rank", q.rank(q.events(tokens(F.col("stemmed"))))).drop("stemmed")
    return _shown(_best(ranked, limit), q, pii)


def count(docs: DataFrame, query: str) -> DataFrame:
    modest_batches(docs.sparkSession)
    return docs.filter(Query(query).matches(stemmed(F.col("text")))).agg(F.count("*").alias("hits"))


def _posted(batches):
    """range, id, stem, its count and places, of every stem of every document, some ``POSTED`` places
    at a time; and where the word is the stem itself, if that is not everywhere."""
    for batch in batches:
        which, words, ends, places, plain = [], [], [0], [], []

        def flush():
            at = pa.array(which, type=pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(places, type=pa.int32()))
            columns = [batch.column("range").take(at), batch.column("id").take(at), pa.array(words, type=pa.string()), pc.list_value_length(lists), lists, pa.array(plain, type=pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=["range", "id", "word", "n", "places", "plain"])

        for k, text in enumerate(batch.column("normal")):
            own: dict[str, list[int]] = {}
            forms = (text.as_py() or "").split()
            for at, word in enumerate(map(_known.__getitem__, forms)):
                if word != GAP:
                    own.setdefault(word, []).append(at)
            for word, at in own.items():
                which.append(k)
                words.append(word)
                places += at
                ends.append(len(places))
                same = [x for x in at if forms[x] == word]
                plain.append(None if len(same) == len(at) else same)
            if len(places) >= POSTED:
                yield flush()
                which, words, ends, places, plain = [], [], [0], [], []
        if places:
            yield flush()


def write_index(docs: DataFrame, path: str, range_docs: int = RANGE_DOCS) -> None:
    """The postings of documents (id, text), and of every stem and range how many there are and the
    largest count.

    A range holds documents of like length (by powers of two), so counts in one are alike and long
    documents, which rank high, are read first.  Ranges are files of their own, in order of stems:
    the write is as parallel as there are ranges, and a query's stems are found by file statistics.
    """
    modest_batches(docs.sparkSession)
    own = docs.select("id", T.normalise(F.col("text")).alias("normal"))
    kind = F.floor(F.log2(F.length("normal") + 1)).cast("int")
    sizes = {r["kind"]: -(-r["n"] // range_docs) for r in own.select(F.coalesce(kind, F.lit(0)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).collect()}  # some thirty rows
    wide = max(sizes, default=0) + 1
    begins = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(wide)])]).tolist()
    at = F.coalesce(kind, F.lit(0)) + 1
    first, many = (F.element_at(F.array(*[F.lit(int(x)) for x in xs]), at) for xs in (begins[:-1], [max(1, sizes.get(k, 0)) for k in range(wide)]))
    dealt = own.withColumn("range", (first + F.pmod(F.xxhash64("id"), many)).cast("int"))
    id_type = dict(docs.dtypes)["id"]
    posted = dealt.mapInArrow(_posted, f"range int, id {id_type}, word string, n int, places array<int>, plain array<int>")
    posted.repartition(max(1, begins[-1]), "range").sortWithinPartitions("range", "word", "id").write.mode("overwrite").partitionBy("range").parquet(f"{path}/postings")
    blocks = docs.sparkSession.read.parquet(f"{path}/postings").groupBy("word", "range").agg(F.count("*").alias("docs"), F.max("n").alias("most")) if begins[-1] else posted.select("word", "range", F.lit(0).cast("long").alias("docs"), F.col("n").alias("most"))
    blocks.repartitionByRange("word").sortWithinPartitions("word", "range").write.mode("overwrite").parquet(f"{path}/blocks")


def _asked(q: Query) -> list[str]:
    """All stems that decide a query; one of negated words only is refused: the index does not know
    documents without words."""
    if not q.groups:
        raise ValueError("a query needs a word to look for")
    return sorted({w for g in q.groups for p in g for w in p if w} | {w for p in q.negated for w in p if w})


def _found(spark: SparkSession, path: str, q: Query, ranges: list[int] | None = None, plain: bool = False) -> DataFrame:
    """id and rank of the documents that answer, from the postings of some ranges or of all."""
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("word").isin(*_asked(q)))
    rows = rows if ranges is None else rows.filter(F.col("range").isin(*ranges))
    rows = rows.withColumn("places", F.coalesce("plain", "places")) if plain else rows
    places = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("p"))  # at most the query's stems
    none = F.array().cast("array<int>")
    at = lambda w: F.coalesce(F.col("p")[w], none)

    def moved(w: str, k: int) -> Column:
        return F.transform(at(w), lambda x: x - k)

    def spots(w: str) -> Column:
        return F.transform(at(w), lambda x: F.struct(x.alias("at"), F.lit(w).alias("word")))

    def there(phrase: list) -> Column:
        out = at(phrase[0])
        for k, w in enumerate(phrase):
            out = F.array_intersect(out, moved(w, k)) if k and w else out
        return F.size(out) > 0

    match = F.lit(True)
    for group in q.groups:
        any_of = there(group[0])
        for phrase in group[1:]:
            any_of = any_of | there(phrase)
        match = match & any_of
    for phrase in q.negated:
        match = match & ~there(phrase)
    events = F.array_sort(F.flatten(F.array(*[spots(w) for w in q.wanted()])))
    return places.filter(match).select("id", q.rank(events).alias("rank"))


def find(spark: SparkSession, path: str, query: str, plain: bool = False) -> DataFrame:
    """id and rank of all documents that answer the query, from an index alone; where ``plain``, only
    by words that are the stems themselves, not by their other forms."""
    return _found(spark, path, Query(query), plain=plain)


def top(spark: SparkSession, path: str, query: str, limit: int = fixed.SEARCH_LIMIT) -> tuple[list[tuple], int, int]:
    """The best documents as (id, rank), and how many of how many ranges were read.

    A document's covers are at most as many as its occurrences of the asked stems, so a range cannot
    rank above the sum of their largest counts there.  Ranges are read from the largest bound on, a
    growing number at a time, until the next bound is below the last of the best.
    """
    q, limit = Query(query), min(max(1, limit), fixed.SEARCH_MAX)
    heads: dict[int, dict[str, int]] = {}
    for r in spark.read.parquet(f"{path}/blocks").filter(F.col("word").isin(*_asked(q))).collect():  # a row for each stem and range
        heads.setdefault(r["range"], {})[r["word"]] = r["most"]
    able = lambda own: all(any(all(w is None or w in own for w in p) for p in g) for g in q.groups)
    bounds = sorted(((COVER_WEIGHT * sum(own.get(w, 0) for w in q.wanted()), k) for k, own in heads.items() if able(own)), key=lambda x: (-x[0], x[1]))
    best: list[tuple] = []
    read, many = 0, FIRST_RANGES
    while read < len(bounds) and (len(best) < limit or bounds[read][0] >= best[-1][1]):
        ranges = [k for _, k in bounds[read : read + many]]
        best += [(r["id"], r["rank"]) for r in _best(_found(spark, path, q, ranges), limit).collect()]
        best = sorted(best, key=lambda x: (-x[1], x[0]))[:limit]
        read, many = read + len(ranges), many * 2
    return best, read, len(bounds)


def search_index(docs: DataFrame, path: str, query: str, limit: int = fixed.SEARCH_LIMIT, pii: DataFrame | None = None) -> DataFrame:
    """As ``search``, but texts are read for the best documents only: their ids, 200 at most, are a
    filter of the scan."""
    best, _, _ = top(docs.sparkSession, path, query, limit)
    ranked = docs.sparkSession.createDataFrame(best, f"id {dict(docs.dtypes)['id']}, rank double")
    wanted = docs.filter(F.col("id").isin(*[i for i, _ in best])) if best else docs.limit(0)
    return _shown(wanted.join(F.broadcast(ranked), "id"), Query(query), pii).orderBy(F.desc("rank"), "id")


def bites(folded: Column, term: str) -> Column:
    """A word of the folded text begins like the term."""
    return folded.rlike(r"\b" + re.escape(term[: max(4, len(term) - 2)]))


def keyword_grid(docs: DataFrame, grid: dict[str, str]) -> DataFrame:
    """topic, id, verbatim and summary of every topic whose query a document answers; one pass
    over the texts.  Excerpts are made of what is found, and only where they are asked for."""
    modest_batches(docs.sparkSession)
    queries = {topic: Query(query) for topic, query in grid.items()}
    own = docs.select("id", "text", stemmed(F.col("text")).alias("stemmed"))
    topics = F.array(*[F.when(q.matches(F.col("stemmed")), F.lit(topic)) for topic, q in queries.items()])
    found = own.select("id", "text", F.explode(F.filter(topics, lambda x: x.isNotNull())).alias("topic")).withColumn("folded", T.fold(F.col("text")))
    verbatims, summaries = [], []
    for topic, q in queries.items():
        own = F.col("topic") == topic
        terms = F.array_join(F.filter(F.array(*[F.when(bites(F.col("folded"), t), t) for t in q.words]), lambda x: x.isNotNull()), ", ")
        verbatim = F.regexp_replace(T.excerpt(F.col("text"), q.words), "^… | …$", "")
        verbatims.append(F.when(own, verbatim))
        summaries.append(F.when(own, F.concat(F.lit("mots-clés : "), terms)))
    return found.select("topic", "id", F.coalesce(*verbatims).alias("verbatim"), F.coalesce(*summaries).alias("summary"))


def uncovered(docs: DataFrame, instances: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents (id, num_words) without an instance, the longest first."""
    out = docs.join(instances.select("id").distinct(), "id", "left_anti").orderBy(F.desc_nulls_last("num_words"), "id")
    return out.limit(limit) if limit else out
