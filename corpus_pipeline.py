"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return the columns of documents; the last returns the packed pieces.

Defined results, in every stage: null and empty texts stay as they are; repeated rows and
null doc_ids are rows of their own; other columns of the input are left out, and columns of
documents that it lacks are null; an empty table gives none; whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, near_dedup, packing, pii, toxicity
from corpuslens.llm._spark import kept, only, table
from corpuslens.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; the length follows the text."""
    return only(docs, *COLUMNS).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted toxic.  Texts without matched clauses stay; every row
    is judged by its own text, so equal texts go or stay together."""
    return _documents(toxicity.scored(docs, table(spark, sf_dir, "labels"), COLUMNS).filter("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates, the one with the smallest doc_id; of rows with
    that id and text, the smallest in the other columns.  Rows without text all stay."""
    return _documents(near_dedup.one_of_each(docs, COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages; documents at least half of whose words are such passages go.
    Wordless texts stay; null items and repeated ones change nothing."""
    return _documents(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"), columns=COLUMNS))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; overlapping spans become one, by the first
    kind.  Texts without any stay as they are, null ones null."""
    found = pii.find_pii(docs, *COLUMNS)
    return _documents(found.withColumn("text", F.when(F.size("spans") > 0, pii.redacted(F.col("text"), "spans")).otherwise(F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places: a piece for every 2,048 tokens or
    part of them, one for null and empty texts."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pii", redact_pii),
    ("packing", pack),
]

#: The transducers, samples and genetic algorithm are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs)
    return docs
