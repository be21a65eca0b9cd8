"""Duplicate groups: shingles, MinHash bands, verified pairs, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import fixed
from ..functions import hashing
from ..functions import text as T
from ..storage import materialised, modest_batches
from .components import components

#: Members up to which all pairs of a band are candidates; those of larger bands are joined by
#: their rarest shingles.
SMALL_BAND = 32
#: Documents whose ids are broadcast, some 40 bytes each; the texts of more are shuffled.
BROADCAST_IDS = 500_000


def shingled(docs: DataFrame) -> DataFrame:
    """id, its distinct shingles as 64-bit hashes and its band keys; texts without words are left out."""
    longs = ST.ArrayType(ST.LongType())
    schema = ST.StructType([ST.StructField("id", docs.schema["id"].dataType), ST.StructField("shingles", longs), ST.StructField("keys", longs)])
    return docs.select("id", T.normalise(F.col("text")).alias("normal")).mapInArrow(hashing.shingle_batches, schema)


def _sets_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """id and shingles of the wanted documents."""
    wanted = materialised(wanted)
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return materialised(shingled(docs.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")).select("id", "shingles"))


def _pairs(members: DataFrame, key: str) -> DataFrame:
    return members.select(key, F.col("id").alias("a")).join(members.select(key, F.col("id").alias("b")), key).filter("a < b").select("a", "b")


def _by_rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share one of their rarest shingles: sets as similar as the threshold must.

    Of n shingles in one order for all sets, the rarest first, two sets that share t of all
    share one of the first n - ceil(t n) + 1 of each.
    """
    each = materialised(sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
    counted = each.join(each.groupBy("shingle").agg(F.count("*").alias("df")), "shingle")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle"))
    first = counted.withColumn("place", place).filter((F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1) & (F.col("df") > 1))
    return _pairs(materialised(first.select("shingle", "id")), "shingle")


def linked(docs: DataFrame, threshold: float = fixed.SIMILARITY, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of the first documents of equal sets, and the copies (first, id) of those.

    With ``exact``, candidates are found by rare shingles only: complete whatever the bands.
    """
    if threshold < fixed.SIMILARITY_FLOOR:
        raise ValueError("below this similarity the bands miss too much")
    modest_batches(docs.sparkSession)
    same = [F.xxhash64("shingles").alias("h1"), F.hash("shingles").alias("h2"), F.size("shingles").alias("n")]
    # Sets are as large as the texts: their keys are written, and only sets that share one are made again.
    ids = materialised(shingled(docs).select("id", *same, "keys"))
    first = materialised(ids.groupBy("h1", "h2", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    copies = ids.join(first.filter("copies > 1"), ["h1", "h2", "n"]).filter("id <> first").select("first", "id")
    ones = ids.join(first.select(F.col("first").alias("id")), "id", "left_semi")
    if exact:
        ones = _sets_of(ones.select("id").distinct(), docs)
        pairs = _by_rarest(ones, threshold)
    else:
        keyed = materialised(ones.select("id", F.explode("keys").alias("key")))
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        keyed = materialised(keyed.join(shared, "key"))
        ones = _sets_of(keyed.select("id").distinct(), docs)
        pairs = _pairs(keyed.filter(F.col("n") <= SMALL_BAND), "key")
        crowd = keyed.filter(F.col("n") > SMALL_BAND).select("id").distinct()
        if not crowd.isEmpty():
            pairs = pairs.unionByName(_by_rarest(ones.join(crowd, "id", "left_semi"), threshold))
    x, y = (ones.select(F.col("id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    scored = pairs.distinct().join(x, "a").join(y, "b")
    near = scored.select("a", "b", T.jaccard(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= threshold)
    return materialised(near), copies


def similar_pairs(docs: DataFrame, threshold: float = fixed.SIMILARITY, exact: bool = False) -> DataFrame:
    """a < b and their Jaccard similarity, for texts that reach the threshold; texts with the
    same shingles stand for one another, so copies are linked to their first only."""
    near, copies = linked(docs, threshold, exact)
    return near.unionByName(copies.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def earliest(docs: DataFrame, threshold: float = fixed.SIMILARITY) -> DataFrame:
    """id and the smallest id before it whose text is similar, for documents that have one."""
    near, copies = linked(docs, threshold)
    both = near.select(F.col("a").alias("first"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("first"), F.col("a").alias("other")))
    low = both.groupBy("first").agg(F.min("other").alias("low"))
    members = copies.select("first", "id", F.col("first").alias("own")).unionByName(low.select("first", F.col("first").alias("id"), F.lit(None).cast(docs.schema["id"].dataType).alias("own")))
    found = members.join(low, "first", "left").select("id", F.least("own", F.when(F.col("low") < F.col("id"), F.col("low"))).alias("earliest"))
    return found.filter("earliest is not null")


def groups(docs: DataFrame, threshold: float = fixed.SIMILARITY, exact: bool = False) -> DataFrame:
    """group_id (smallest member), id, size, places, similarity_min of every grouped document.

    ``docs`` has id, text and place; null places are not counted.
    """
    pairs = materialised(similar_pairs(docs, threshold, exact))
    roots = materialised(components(pairs.select("a", "b")))
    lowest = pairs.join(roots.select(F.col("node").alias("a"), "root"), "a").groupBy("root").agg(F.min("similarity").alias("similarity_min"))
    members = roots.join(docs.select(F.col("id").alias("node"), "place"), "node")
    facts = members.groupBy("root").agg(F.count("*").alias("size"), F.count_distinct("place").alias("places")).join(lowest, "root")
    return members.join(facts, "root").select(F.col("root").alias("group_id"), F.col("node").alias("id"), "size", "places", "similarity_min")


def largest(grouped: DataFrame, limit: int = fixed.TOP_GROUPS) -> DataFrame:
    """group_id, size and places of the groups in most places, then the largest."""
    one = grouped.select("group_id", "size", "places").distinct()
    return one.orderBy(F.desc("places"), F.desc("size"), "group_id").limit(limit)


def recopied(grouped: DataFrame, places: int = 2) -> DataFrame:
    """Documents whose group spans several places."""
    return grouped.filter(F.col("places") >= places).select("id").distinct()
