"""Topic tables (id, name, description, sources, parent, level, validated, pos): clean and check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialised
from . import hierarchy

COLUMNS = ("id", "name", "description", "sources", "parent", "level", "validated", "pos")


def merge_names(topics: DataFrame) -> DataFrame:
    """One topic for each name: the first of the highest level; children move to it, sources
    are joined in order of appearance, a missing parent is taken from the others."""
    w = Window.partitionBy("name").orderBy(F.desc("level"), "pos")
    ranked = topics.withColumn("winner", F.first("id").over(w))
    sources = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("sources", F.array().cast("array<string>")).alias("s")))), lambda x: x["s"])))
    merged = ranked.groupBy("winner").agg(sources.alias("all_sources"), F.min_by("parent", F.when(F.col("parent").isNotNull(), F.struct(-F.col("level"), F.col("pos")))).alias("any_parent"))
    ids = ranked.select(F.col("id").alias("old"), F.col("winner").alias("new"))
    out = topics.join(merged, topics["id"] == merged["winner"]).withColumn("sources", F.col("all_sources")).withColumn("parent", F.coalesce("parent", "any_parent"))
    return out.join(ids, F.col("parent") == F.col("old"), "left").withColumn("parent", F.coalesce("new", "parent")).select(*COLUMNS)


def drop_blank(topics: DataFrame) -> DataFrame:
    return topics.filter(T.strip(F.coalesce("name", F.lit(""))) != "")


def clear_parents(topics: DataFrame) -> DataFrame:
    """Parents that are not there, or are the topic itself, become none."""
    there = topics.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    out = topics.join(there, "parent", "left")
    return out.withColumn("parent", F.when(F.col("known") & (F.col("parent") != F.col("id")), F.col("parent"))).select(*COLUMNS)


def drop_childless(topics: DataFrame) -> DataFrame:
    """Topics above the lowest level without children go, until all have some."""
    while True:
        parents = topics.filter("parent is not null").select(F.col("parent").alias("id")).distinct()
        bare = topics.filter("level > 0").join(parents, "id", "left_anti").select("id")
        if bare.isEmpty():
            return topics
        topics = materialised(topics.join(bare, "id", "left_anti").select(*COLUMNS))


def sanitise(topics: DataFrame) -> DataFrame:
    return drop_childless(materialised(clear_parents(drop_blank(merge_names(topics)))))


def violations(topics: DataFrame) -> DataFrame:
    """kind and subject of everything that is wrong."""
    nodes = topics.select(F.col("id").alias("node"), "parent", "name")
    known = topics.select(F.col("id").alias("parent"))
    closed = hierarchy.closure(nodes)
    row = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("subject"))
    parts = [
        row(topics.groupBy("id").count().filter("count > 1"), "duplicate_id", "id"),
        row(topics.groupBy("name").count().filter("count > 1"), "duplicate_name", "name"),
        row(topics.filter("parent is not null").join(known, "parent", "left_anti"), "dangling_parent", "id"),
        row(topics.filter("parent = id"), "self_parent", "id"),
        row(topics.filter((T.strip(F.coalesce("name", F.lit(""))) == "") | (T.strip(F.coalesce("description", F.lit(""))) == "")), "empty_field", "id"),
        row(hierarchy.cyclic(nodes.filter("not (parent <=> node)"), closed), "cycle", "node"),
    ]
    # More than one way from an ancestor to a topic: only ids that are there twice allow it.
    ways = topics.filter("parent is not null").groupBy("id").agg(F.count_distinct("parent").alias("n")).filter("n > 1")
    parts.append(row(ways, "several_parents", "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def is_tree(topics: DataFrame) -> bool:
    """Whether every topic has one way up to one root, and there is one."""
    broken = violations(topics).filter("kind in ('duplicate_id', 'dangling_parent', 'self_parent', 'cycle', 'several_parents')")
    return broken.isEmpty() and topics.filter("parent is null").count() == 1


def insert_merges(topics: DataFrame, merges: DataFrame) -> DataFrame:
    """Merged topics (target, merged) go, unless validated; their children move to the target."""
    gone = merges.join(topics.filter(~F.coalesce("validated", F.lit(False))).select(F.col("id").alias("merged")), "merged", "left_semi").select("merged", "target")
    out = topics.join(gone.select(F.col("merged").alias("parent"), "target"), "parent", "left").withColumn("parent", F.coalesce("target", "parent")).drop("target")
    return sanitise(out.join(gone.select(F.col("merged").alias("id")), "id", "left_anti").select(*COLUMNS))


def insert_parents(topics: DataFrame, additions: DataFrame) -> DataFrame:
    """New parents (id, name, description, child): one level above their highest child."""
    own = additions.join(topics.select(F.col("id").alias("child"), F.col("level").alias("below")), "child")
    last = topics.agg(F.max("pos").alias("last"))
    new = own.groupBy("id").agg(F.first("name").alias("name"), F.first("description").alias("description"), (F.max("below") + 1).alias("level")).crossJoin(last)
    new = new.select("id", "name", "description", F.array().cast("array<string>").alias("sources"), F.lit(None).cast(topics.schema["parent"].dataType).alias("parent"), "level", F.lit(False).alias("validated"), (F.col("last") + 1).alias("pos"))
    up = additions.groupBy(F.col("child").alias("id")).agg(F.min("id").alias("up"))
    moved = topics.join(up, "id", "left").withColumn("parent", F.coalesce("up", "parent")).select(*COLUMNS)
    return sanitise(moved.unionByName(new))


def graph_elements(topics: DataFrame) -> DataFrame:
    """Nodes, and edges whose parent is known."""
    known = topics.select(F.col("id").alias("parent"))
    nodes = topics.select(F.lit("node").alias("kind"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.col("name").alias("label"))
    edges = topics.filter("parent is not null").join(known, "parent", "left_semi").select(F.lit("edge").alias("kind"), F.col("parent").alias("source"), F.col("id").cast("string").alias("target"), F.lit(None).cast("string").alias("label"))
    return nodes.unionByName(edges)
