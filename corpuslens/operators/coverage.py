"""What a corpus holds and what is left out, at page, register and place scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def excluded(needs_ocr: Column, transcribed: Column) -> Column:
    """Flagged as unreadable and not transcribed; an unknown flag is readable."""
    return needs_ocr.eqNullSafe(True) & ~F.coalesce(transcribed, F.lit(False))


def by_group(pages: DataFrame, group: str) -> DataFrame:
    """pages, excluded pages, whether any and whether all are excluded, for each group."""
    out = excluded(F.col("needs_ocr"), F.col("transcribed"))
    return pages.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("pages"), F.count_if(out).alias("excluded"), F.bool_or(out).alias("touched"), F.bool_and(out).alias("mute"))


def summary(pages: DataFrame, register: str, place: str) -> DataFrame:
    """Totals at the three scales in one row each."""
    out = excluded(F.col("needs_ocr"), F.col("transcribed"))
    rows = [pages.agg(F.lit("page").alias("scale"), F.count("*").alias("total"), F.count_if(out).alias("touched"), F.count_if(out).alias("mute"))]
    for scale, key in (("register", register), ("place", place)):
        g = by_group(pages, key)
        rows.append(g.agg(F.lit(scale).alias("scale"), F.count("*").alias("total"), F.count_if("touched").alias("touched"), F.count_if("mute").alias("mute")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def page_classes(pages: DataFrame, place: str) -> DataFrame:
    """native, transcribed, empty, drift and unprocessed pages of each place, with rates.

    ``pages`` has needs_ocr, transcription and booleans is_empty and is_drift of it.
    """
    state = (
        F.when(F.col("transcription").isNotNull() & F.col("is_empty"), "empty")
        .when(F.col("transcription").isNotNull() & F.col("is_drift"), "drift")
        .when(F.col("transcription").isNotNull(), "transcribed")
        .when(F.col("needs_ocr").eqNullSafe(True), "unprocessed")
        .otherwise("native")
    )
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("native", "transcribed", "empty", "drift", "unprocessed")]
    out = pages.withColumn("state", state).groupBy(place).agg(F.count("*").alias("pages"), *counts)
    return out.withColumn("native_rate", F.col("native") / F.col("pages")).withColumn("usable_rate", (F.col("native") + F.col("transcribed")) / F.col("pages"))


def histogram(scores: DataFrame, score: str, step: float = 0.1) -> DataFrame:
    """low bound and count of every bin of width ``step`` in [0, 1]; empty bins too, 1.0 in the last."""
    bins = round(1 / step)
    number = F.least((F.col(score) / F.lit(step)).cast("int"), F.lit(bins - 1))
    counted = scores.filter(F.col(score).isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sensitivity(scores: DataFrame, score: str, thresholds=fixed.THRESHOLDS) -> DataFrame:
    """How many scored rows lie under each threshold: one pass over the rows."""
    counted = scores.filter(F.col(score).isNotNull()).agg(*[F.count_if(F.col(score) < t).alias(f"t{i}") for i, t in enumerate(thresholds)], F.count("*").alias("scored"))
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("below"), F.col("scored")) for i, t in enumerate(thresholds)])
    return counted.select(F.explode(each).alias("x")).select("x.*")


def map_table(places: DataFrame, files: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Places (code, population) with distinct files, pages, flagged pages and documents; rates guarded."""
    f = files.groupBy("code").agg(F.count_distinct("file").alias("files"))
    p = pages.groupBy("code").agg(F.count("*").alias("pages"), F.count_if(F.col("needs_ocr").eqNullSafe(True)).alias("flagged"))
    d = documents.groupBy("code").agg(F.count("*").alias("documents"))
    out = places.join(f, "code", "left").join(p, "code", "left").join(d, "code", "left").fillna(0, ["files", "pages", "flagged", "documents"])
    return (
        out.withColumn("flagged_percent", F.when(F.col("pages") > 0, 100.0 * F.col("flagged") / F.col("pages")))
        .withColumn("per_thousand", F.when(F.col("population") > 0, 1000.0 * F.col("documents") / F.col("population")))
        .withColumn("mute", (F.col("pages") > 0) & (F.col("documents") == 0))
    )
