"""Quality of texts: the share of their longer words that a lexicon knows."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import modest_batches

#: Words of a lexicon that is looked up in the tasks' memory; with a larger one words are joined.
LEXICON_WORDS = 2_000_000
COUNTED = "id {id}, words long, known long"


def frequent_words(docs: DataFrame, least: int) -> DataFrame:
    """A lexicon from trusted texts: the words that are met ``10 ** least`` times or more in a
    billion (what is called a Zipf frequency of ``least``)."""
    words = docs.select(F.explode(T.quality_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n").alias("total"))
    return words.crossJoin(F.broadcast(total)).filter(F.col("n") * 10 ** (9 - least) >= F.col("total")).select("word")


def word_counts(docs: DataFrame, lexicon: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """id, longer words and how many of them the lexicon (word) holds, of texts (id, text).

    The lexicon's size is checked: up to ``most`` words every task looks whole batches of words up in
    a hash table; beyond, the distinct words of the texts are joined with it.
    """
    modest_batches(docs.sparkSession)
    own = docs.select("id", T.quality_words(F.coalesce("text", F.lit(""))).alias("words"))
    known = lexicon.select("word").filter("word is not null").distinct()
    head = known.limit(most + 1).toArrow()
    if head.num_rows > most:
        each = own.select("id", F.explode("words").alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
        found = each.join(known.withColumn("is_known", F.lit(True)), "word", "left").groupBy("id").agg(F.sum(F.when(F.col("is_known"), F.col("n")).otherwise(0)).alias("known"))
        return own.select("id", F.size("words").cast("long").alias("words")).join(found, "id", "left").select("id", "words", F.coalesce("known", F.lit(0)).alias("known"))
    held = docs.sparkSession.sparkContext.broadcast(head["word"].to_pylist())

    def look(batches):
        import numpy as np

        table = pa.array(held.value, type=pa.string())
        for batch in batches:
            lists = batch.column("words")
            sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            hits = np.concatenate([[0], np.cumsum(np.asarray(pc.is_in(lists.flatten(), value_set=table).cast(pa.int64())))])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(hits[ends] - hits[ends - sizes])], names=["id", "words", "known"])

    return own.mapInArrow(look, COUNTED.format(id=dict(docs.dtypes)["id"]))


def quality_scores(docs: DataFrame, lexicon: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """id, words, known and score (0 without longer words) of texts (id, text)."""
    counted = word_counts(docs, lexicon, most)
    return counted.withColumn("score", F.when(F.col("words") > 0, F.col("known") / F.col("words")).otherwise(0.0))
