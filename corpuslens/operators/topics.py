"""Topic measures over detections (topic, doc, n): distribution, dominance, co-occurrence, strata, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import fixed
from ..functions import text as T
from ..storage import materialised
from .components import components


def weighted_detections(instances: DataFrame) -> DataFrame:
    """topic, doc and weight: a keyword detection counts the terms it lists, others one."""
    listed = F.startswith("summary", F.lit("mots-clés :"))
    weight = F.when(listed, F.size(F.split("summary", ","))).otherwise(1)
    return instances.groupBy("topic", "doc").agg(F.sum(weight).alias("n"))


def dominant(detections: DataFrame) -> DataFrame:
    """The topic of each document with the most detections; ties go to the smaller topic."""
    w = Window.partitionBy("doc").orderBy(F.desc("n"), "topic")
    return detections.withColumn("place", F.row_number().over(w)).filter("place = 1").select("doc", "topic", "n")


def distribution(detections: DataFrame, total: int) -> DataFrame:
    """documents, dominated documents and share of each topic, and what no topic covers."""
    docs = detections.groupBy("topic").agg(F.count_distinct("doc").alias("documents"))
    tops = dominant(detections).groupBy("topic").agg(F.count("*").alias("dominant"))
    share = F.col("documents") * 100.0 / total if total else F.lit(0.0)
    rows = docs.join(tops, "topic", "left").select(F.col("topic").cast("string").alias("topic"), "documents", F.coalesce("dominant", F.lit(0)).alias("dominant")).withColumn("share", share)
    seen = detections.agg(F.greatest(F.lit(total) - F.count_distinct("doc"), F.lit(0)).cast("long").alias("documents"))
    outside = seen.select(F.lit(fixed.OUTSIDE).alias("topic"), "documents", F.col("documents").alias("dominant")).withColumn("share", share)
    return rows.unionByName(outside)


def cooccurrence(detections: DataFrame) -> DataFrame:
    """a, b, documents with both and lift; the diagonal is 1."""
    pairs = detections.select("doc", "topic").distinct()
    n = pairs.agg(F.count_distinct("doc").alias("n_docs"))
    each = pairs.groupBy("topic").agg(F.count("*").alias("n"))
    both = pairs.withColumnRenamed("topic", "a").join(pairs.withColumnRenamed("topic", "b"), "doc").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    out = both.join(each.select(F.col("topic").alias("a"), F.col("n").alias("n_a")), "a").join(each.select(F.col("topic").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(F.broadcast(n))
    return out.select("a", "b", "n_both", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("n_both") * F.col("n_docs") / (F.col("n_a") * F.col("n_b"))).alias("lift"))


def stratum(population: Column, strata=fixed.POPULATION_STRATA) -> Column:
    out = F.when(population.isNull(), fixed.UNKNOWN)
    for low, high, name in strata:
        out = out.when((population >= low) & (population < high) if high is not None else population >= low, name)
    return out


def by_stratum(detections: DataFrame, populations: DataFrame) -> DataFrame:
    """Share of each stratum's documents that hold each topic, and of those that hold none."""
    docs = populations.select("doc", stratum(F.col("population")).alias("stratum"))
    size = docs.groupBy("stratum").agg(F.count_distinct("doc").alias("docs"))
    held = detections.select("doc", "topic").distinct().join(docs, "doc")
    hit = held.groupBy("stratum", F.col("topic").cast("string").alias("topic")).agg(F.count("*").alias("n"))
    none = docs.join(detections.select("doc").distinct(), "doc", "left_anti").groupBy("stratum").agg(F.count("*").alias("n")).withColumn("topic", F.lit(fixed.OUTSIDE))
    return hit.unionByName(none).join(size, "stratum").select("stratum", "topic", "n", (F.col("n") * 100.0 / F.col("docs")).alias("share"))


def reuse(detections: DataFrame, topics: DataFrame) -> DataFrame:
    """topics, unused topics, singletons, documents, mean topics a document."""
    pairs = detections.select("topic", "doc").distinct()
    per_topic = pairs.groupBy("topic").agg(F.count("*").alias("n"))
    every = topics.select("topic").distinct().join(per_topic, "topic", "left")
    a = every.agg(F.count("*").alias("topics"), F.count_if(F.col("n").isNull()).alias("unused"), F.count_if(F.col("n") == 1).alias("singletons"))
    b = pairs.agg(F.count_distinct("doc").alias("documents"), F.count("*").alias("attachments"))
    return a.crossJoin(b).withColumn("topics_per_document", F.when(F.col("documents") > 0, F.col("attachments") / F.col("documents")).otherwise(0.0))


def text_coverage(texts: DataFrame, verbatims: DataFrame, normal) -> DataFrame:
    """doc, text length, covered length and verbatims not found: the union of the first
    occurrences of each normalised verbatim."""
    t = texts.select("doc", normal(F.col("text")).alias("t"))
    v = verbatims.select("doc", normal(F.col("verbatim")).alias("v")).filter("v <> ''").groupBy("doc").agg(F.collect_list("v").alias("vs"))
    found = F.transform("vs", lambda x: F.struct(F.position(x, F.col("t")).alias("at"), F.length(x).alias("n")))
    spans = F.array_sort(F.filter("found", lambda x: x["at"] > 0))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    merge = lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["n"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(s["end"], x["at"]))).alias("sum"))
    out = t.join(v, "doc").withColumn("found", found)
    return out.select("doc", F.length("t").alias("length"), F.aggregate(spans, start, merge, lambda s: s["sum"]).alias("covered"), F.size(F.filter("found", lambda x: x["at"] == 0)).alias("missing"))


def _letters(names: list[str], number: dict[str, int]):
    """How often each name has each letter."""
    import numpy as np

    out = np.zeros((len(names), max(1, len(number))), np.int16)
    for k, name in enumerate(names):
        for c in name:
            if c in number:
                out[k, number[c]] += 1
    return out


def _matched(batches):
    """Of each name of a block the candidate of a block most like it, if it is at least as like as what
    is known: the best bounds first, and a ratio only where its bound can still win."""
    import difflib

    import numpy as np
    import pandas as pd

    for batch in batches:
        out = []
        for own, known in zip(batch["own"], batch["known"]):
            names, others = [x["name"] for x in own], [x["name"] for x in known]
            number = {c: k for k, c in enumerate(sorted({c for n in others for c in n}))}
            a, b = _letters(names, number), _letters(others, number)
            lengths = np.array([len(n) for n in others])
            for x, letters in zip(own, a):
                name, best, spot, compared = x["name"], x["ratio"], x["pos"], 0
                both = len(name) + lengths
                bound = np.where(both > 0, 2.0 * np.minimum(b, letters).sum(1) / np.maximum(both, 1), 1.0)
                found = None
                for k in np.argsort(-bound, kind="stable").tolist():
                    if best is not None and bound[k] < best:
                        break
                    pos = known[k]["pos"]
                    if best is not None and bound[k] == best and pos >= spot:
                        continue
                    compared += 1
                    ratio = difflib.SequenceMatcher(None, name, others[k]).ratio()
                    if best is None or ratio > best or (ratio == best and pos < spot):
                        best, spot, found = ratio, pos, others[k]
                out.append((name, best, spot, found, compared))
        yield pd.DataFrame(out, columns=["name", "ratio", "pos", "nearest", "compared"])


def nearest_name(names: DataFrame, candidates: DataFrame, level: int | None = None, block: int = 512) -> DataFrame:
    """For each name the candidate most like it by Ratcliff-Obershelp, the first (by ``pos``) of
    equals; and how many candidates it was compared with.

    ``candidates`` are a topic grid (name, pos, and level if one is asked for).  Names and candidates
    lie in blocks by length.  Those of one length meet first; what they find rules out other lengths,
    and then candidates by the letters they share, before any ratio is worked out.
    """
    grid = candidates if level is None else candidates.filter(F.col("level") == level)
    pos = dict(grid.dtypes)["pos"]
    found = f"name string, ratio double, pos {pos}, nearest string, compared long"

    def blocks(rows: DataFrame, as_: str) -> DataFrame:
        sized = rows.withColumn("length", F.length("name"))
        many = sized.groupBy("length").agg(F.ceil(F.count("*") / block).cast("int").alias("many"))
        sized = sized.join(many, "length").withColumn("part", F.pmod(F.xxhash64("name"), "many"))
        item = F.struct("name", "ratio", "pos") if as_ == "own" else F.struct("name", "pos")
        return sized.groupBy("length", "part").agg(F.collect_list(item).alias(as_), *([F.min(F.coalesce("ratio", F.lit(0.0))).alias("least")] if as_ == "own" else []))

    known = materialised(blocks(grid.filter("name is not null").groupBy("name").agg(F.min("pos").alias("pos")), "known"))
    asked = materialised(names.select(F.coalesce("name", F.lit("")).alias("name")).distinct())
    nothing = asked.select("name", F.lit(None).cast("double").alias("ratio"), F.lit(None).cast(pos).alias("pos"))
    seeds = materialised(blocks(nothing, "own").join(known, "length").select("own", "known").mapInPandas(_matched, found))
    best = F.min_by(F.struct("ratio", "pos", "nearest"), F.struct(-F.col("ratio"), F.col("pos")))
    seeded = seeds.groupBy("name").agg(best.alias("b")).select("name", "b.ratio", "b.pos")
    far = known.select(F.col("length").alias("other"), "known")
    able = (F.col("length") != F.col("other")) & (2.0 * F.least("length", "other") >= F.col("least") * (F.col("length") + F.col("other")))
    rest = blocks(asked.join(seeded, "name", "left"), "own").join(far, able).select("own", "known").mapInPandas(_matched, found)
    every = seeds.unionByName(rest)
    out = every.filter("nearest is not null").groupBy("name").agg(best.alias("b")).select("name", "b.nearest")
    compared = every.groupBy("name").agg(F.sum("compared").alias("compared"))
    out = asked.join(out, "name", "left").join(compared, "name", "left").select(F.col("name").alias("own"), "nearest", F.coalesce("compared", F.lit(0)).alias("compared"))
    return names.select("name").join(out, F.coalesce("name", F.lit("")) == F.col("own")).select("name", "nearest", "compared")


def reduced(vectors: DataFrame, dimensions: int = 5) -> DataFrame:
    """level, id and vector in few dimensions: principal components stand in for the reference's
    manifold projection, which has no counterpart here.  Never more dimensions than rows less two."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n, wide = vectors.count(), vectors.select(F.max(F.size("vector"))).first()[0] or 0
    k = min(dimensions, wide, n - 2)
    if k < 1:
        return vectors.select("level", "id", "vector")
    own = vectors.withColumn("v", array_to_vector(F.col("vector").cast("array<double>")))
    return PCA(k=k, inputCol="v", outputCol="p").fit(own).transform(own).select("level", "id", vector_to_array("p").alias("vector"))


def cluster_by_level(vectors: DataFrame, similarity: float = 0.8, block_rows: int = 1024) -> DataFrame:
    """level, id and cluster: vectors of one level whose cosine similarity chains reach the
    threshold; those without a neighbour are clusters of their own.  Clusters are numbered by a
    member.

    Simpler than ``density.clusters``: one threshold, no noise.  Every two blocks of a level meet in
    one task, which tells of them only a forest of what it joins.
    """
    rows = materialised(vectors.select("level", F.col("id"), F.col("vector").cast("array<double>").alias("vector")).withColumn("node", F.xxhash64(F.coalesce(F.col("level").cast("string"), F.lit("")), F.col("id").cast("string"))))
    sizes = rows.groupBy("level").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(sizes), "level").withColumn("block", F.pmod("node", "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meet = dealt.withColumn("other", other).select("level", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "vector")

    def join(pdf):
        import numpy as np
        import pandas as pd

        v, nodes = np.array(pdf["vector"].tolist(), dtype=float), pdf["node"].to_numpy()
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        near, root = v @ v.T >= similarity, np.arange(len(v))
        for _ in range(len(v)):
            low = np.where(near, root[None, :], len(v)).min(axis=1)
            low = np.minimum(low, root)
            if (low == root).all():
                break
            root = low
        other = np.flatnonzero(root != np.arange(len(v)))
        return pd.DataFrame({"a": nodes[root[other]], "b": nodes[other]})

    links = meet.groupBy("level", "i", "j").applyInPandas(join, "a long, b long")
    known = components(links)
    return rows.select("level", "id", "node").join(known, "node", "left").select("level", "id", F.coalesce("root", "node").alias("cluster"))


def embed(texts: DataFrame, model) -> DataFrame:
    """id and unit vector of texts (id, text) by an injected model, a list of texts to as many
    vectors; a zero vector stays zero."""

    def call(batches):
        for batch in batches:
            yield batch[["id"]].assign(vector=[list(map(float, v)) for v in model(batch["text"].fillna("").tolist())])

    schema = ST.StructType([texts.schema["id"], ST.StructField("vector", ST.ArrayType(ST.DoubleType()))])
    return texts.select("id", "text").mapInPandas(call, schema).select("id", T.l2_normalised(F.col("vector")).alias("vector"))


def ask(prompts: DataFrame, client, schema: str = "id string, answer string") -> DataFrame:
    """Answers of an injected client (list of prompts -> list of answers), batch by batch."""

    def call(batches):
        for batch in batches:
            yield batch[["id"]].assign(answer=client(batch["prompt"].tolist()))

    return prompts.select("id", "prompt").mapInPandas(call, schema)


def prompts_by_chunk(topics_of_chunk: DataFrame) -> DataFrame:
    """One numbered list of topics for each chunk (chunk, pos, name, validated)."""
    line = F.concat(F.col("pos").cast("string"), F.lit(". "), "name", F.when(F.col("validated"), " [validated]").otherwise(""))
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return topics_of_chunk.groupBy("chunk").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


def last_labels(labels: DataFrame) -> DataFrame:
    """One label for each document and name: the last (by pos)."""
    return labels.groupBy("doc", "name").agg(F.max_by(F.struct("rationale", "extract"), "pos").alias("l"), F.max("pos").alias("pos")).select("doc", "name", "pos", "l.*")
