"""The topic loop: discover topics in chunks, merge alike ones, find parents, label documents.

A client is an injected function from a list of prompts to a list of answers (JSON texts).
It is called batch by batch inside tasks; answers that are no valid JSON of the schema are
dropped.  Every step gives a table; nothing is kept between steps but tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from . import taxonomy, topics

TOPICS = "struct<topics:array<struct<name:string,description:string>>>"
MERGES = "struct<groups:array<struct<target:string,merged:array<string>>>>"
PARENTS = "struct<parents:array<struct<name:string,description:string,children:array<string>>>>"
LABELS = "struct<labels:array<struct<name:string,rationale:string,extract:string>>>"
INSTRUCTIONS = {
    "topics": "List the topics of this text as JSON: {\"topics\": [{\"name\", \"description\"}]}.",
    "groups": "Which of these topics mean the same? JSON: {\"groups\": [{\"target\", \"merged\"}]}.",
    "parents": "Which wider topics hold these? JSON: {\"parents\": [{\"name\", \"description\", \"children\"}]}.",
    "labels": "Which of these topics does the text speak of? JSON: {\"labels\": [{\"name\", \"rationale\", \"extract\"}]}.",
}


def answers(prompts: DataFrame, client, schema: str) -> DataFrame:
    """id and parsed answer of every prompt (id, prompt); what cannot be parsed is dropped."""
    said = topics.ask(prompts.select(F.col("id").cast("string").alias("id"), "prompt"), client)
    parsed = said.select("id", F.from_json("answer", schema, {"mode": "PERMISSIVE"}).alias("answer"))
    first = schema.split("<")[1].split(":")[0]
    return parsed.filter(F.col("answer").isNotNull() & F.col(f"answer.{first}").isNotNull())


def text_chunks(docs: DataFrame, words: int) -> DataFrame:
    """doc, chunk number and text of documents (doc, text), up to a number of words each."""
    return docs.select("doc", F.posexplode(S.chunks(F.col("text"), words)).alias("chunk", "text")).filter(T.strip(F.col("text")) != "")


def discover(docs: DataFrame, client, words: int = 1500) -> DataFrame:
    """Topics that the client finds in the chunks, merged by name, with the documents they came from."""
    chunks = text_chunks(docs, words).withColumn("id", F.concat_ws(":", F.col("doc").cast("string"), F.col("chunk").cast("string")))
    said = answers(chunks.select("id", F.concat(F.lit(INSTRUCTIONS["topics"] + "\n"), "text").alias("prompt")), client, TOPICS)
    each = said.join(chunks.select("id", "doc", "chunk"), "id").select("doc", "chunk", F.posexplode("answer.topics").alias("at", "t")).filter(T.strip(F.coalesce("t.name", F.lit(""))) != "")
    # Places in the order of document, chunk and answer, by name: only the first of each name counts.
    rows = each.groupBy(T.strip(F.col("t.name")).alias("name")).agg(F.min(F.struct(F.col("doc").cast("string").alias("doc"), "chunk", "at")).alias("first"), F.min_by("t.description", F.struct(F.col("doc").cast("string"), "chunk", "at")).alias("description"), F.sort_array(F.collect_set(F.col("doc").cast("string"))).alias("sources"))
    place = (F.row_number().over(Window.orderBy("first", "name")) - 1).cast("int")  # of distinct names: a grid
    return rows.select(F.sha2("name", 256).alias("id"), "name", F.coalesce("description", F.lit("")).alias("description"), "sources", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.lit(False).alias("validated"), place.alias("pos"))


def _lists(grid: DataFrame, clusters: DataFrame, kind: str) -> DataFrame:
    """One prompt for each cluster (id, cluster) of more than one topic: its numbered names."""
    named = grid.join(clusters, "id").withColumn("chunk", F.concat_ws(":", F.col("level").cast("string"), F.col("cluster").cast("string")))
    many = named.groupBy("chunk").agg(F.count("*").alias("n")).filter("n > 1").select("chunk")
    rows = named.join(many, "chunk").withColumn("pos", F.row_number().over(Window.partitionBy("chunk").orderBy("pos", "id")))
    return topics.prompts_by_chunk(rows.select("chunk", "pos", "name", "validated")).select(F.col("chunk").alias("id"), F.concat(F.lit(INSTRUCTIONS[kind] + "\n"), "prompt").alias("prompt"))


def _nearest(rows: DataFrame, column: str, grid: DataFrame) -> DataFrame:
    """With the id of the topic whose name is most like the column."""
    found = topics.nearest_name(rows.select(F.col(column).alias("name")).distinct(), grid.select("name", "pos"))
    ids = grid.groupBy("name").agg(F.min_by("id", "pos").alias("found"))
    return rows.join(found.withColumnRenamed("name", column), column).join(ids.withColumnRenamed("name", "nearest"), "nearest").drop("nearest")


def factorise(grid: DataFrame, clusters: DataFrame, client) -> DataFrame:
    """The grid after topics of one cluster that mean the same are merged.  Names the client gives
    are taken as the most similar known ones; each topic joins one group at most, the first that
    claims it; validated topics are never merged into others."""
    said = answers(_lists(grid, clusters, "groups"), client, MERGES)
    groups = said.select("id", F.posexplode("answer.groups").alias("number", "g")).select("id", "number", F.col("g.target").alias("target_name"), F.explode("g.merged").alias("merged_name"))
    known = _nearest(_nearest(groups, "target_name", grid).withColumnRenamed("found", "target"), "merged_name", grid).withColumnRenamed("found", "merged")
    claims = known.filter("target <> merged").withColumn("turn", F.row_number().over(Window.partitionBy("merged").orderBy("id", "number", "target"))).filter("turn = 1")
    targets = known.select(F.col("target").alias("merged")).distinct()
    merges = claims.join(targets, "merged", "left_anti").select("target", "merged")
    return taxonomy.insert_merges(grid, merges)


def discover_parents(grid: DataFrame, clusters: DataFrame, client) -> DataFrame:
    """The grid with wider topics that the client names over clusters; a topic has one parent, the
    first that claims it."""
    said = answers(_lists(grid, clusters, "parents"), client, PARENTS)
    rows = said.select("id", F.posexplode("answer.parents").alias("number", "p")).filter(T.strip(F.coalesce("p.name", F.lit(""))) != "").select("id", "number", F.col("p.name").alias("parent_name"), F.col("p.description").alias("description"), F.explode("p.children").alias("child_name"))
    known = _nearest(rows, "child_name", grid).withColumnRenamed("found", "child")
    first = known.withColumn("turn", F.row_number().over(Window.partitionBy("child").orderBy("id", "number"))).filter("turn = 1")
    additions = first.select(F.sha2(F.concat(F.lit("parent:"), "parent_name"), 256).alias("id"), F.col("parent_name").alias("name"), F.coalesce("description", F.lit("")).alias("description"), "child")
    return taxonomy.insert_parents(grid, additions)


def label(docs: DataFrame, grid: DataFrame, client, words: int = 1500) -> DataFrame:
    """doc, name, rationale and extract: which of the topics found in a document it speaks of.

    Labels of topics that were not found there are dropped; of a name said twice the last counts.
    """
    own = grid.select("id", "name", "pos", "validated", F.explode("sources").alias("source"))
    chunks = text_chunks(docs, words).withColumn("id", F.concat_ws(":", F.col("doc").cast("string"), F.col("chunk").cast("string")))
    listed = topics.prompts_by_chunk(own.select(F.col("source").alias("chunk"), "pos", "name", "validated")).withColumnRenamed("chunk", "source")
    asked = chunks.join(listed, chunks["doc"].cast("string") == listed["source"])
    prompt = F.concat(F.lit(INSTRUCTIONS["labels"] + "\n"), "prompt", F.lit("\n\n"), "text")
    said = answers(asked.select("id", prompt.alias("prompt")), client, LABELS)
    rows = said.join(chunks.select("id", "doc", "chunk"), "id").select("doc", "chunk", F.posexplode("answer.labels").alias("at", "l")).select("doc", F.struct("chunk", "at").alias("pos"), "l.name", "l.rationale", "l.extract")
    there = own.select(F.col("source"), "name").distinct()
    found = rows.join(there, (rows["doc"].cast("string") == there["source"]) & (rows["name"] == there["name"]), "left_semi")
    return topics.last_labels(found).drop("pos")
