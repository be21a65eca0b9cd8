"""Files out: data sets, coverage reports, deposits of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def write_dataset(docs: DataFrame, path: str) -> None:
    """id,content CSV; quotes are doubled."""
    docs.select(F.col("id").cast("string"), F.col("text").alias("content")).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)


def write_place_report(places: DataFrame, path: str, *rates: str) -> None:
    """CSV with rates to three digits."""
    places.withColumns({r: F.format_string("%.3f", F.col(r)) for r in rates}).write.mode("overwrite").csv(path, header=True)


def report_json(summary: DataFrame) -> DataFrame:
    """The rows of a summary as one JSON text."""
    return summary.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*summary.columns)))).alias("report"))


def write_taxonomy(topics: DataFrame, path: str) -> None:
    """The topics of a grid as one JSON document that ``read_taxonomy`` reads: a grid is small."""
    own = F.struct(*[c for c in ("id", "name", "description", "sources", "parent", "level", "validated") if c in topics.columns])
    rows = topics.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", own.alias("t")))), lambda x: x["t"]).alias("topics"))).alias("value"))
    rows.write.mode("overwrite").text(path)


def deposit(texts: DataFrame, deposited: DataFrame | None, path: str) -> DataFrame:
    """Writes the texts (folder, name, text) that are new or changed, by content hash, as the next
    version beside the older ones; returns the manifest of all.  ``deposited`` reads what counts."""
    now = texts.withColumn("digest", F.sha2("text", 256))
    fresh = now if deposited is None else now.join(deposited.select("folder", "name", "digest"), ["folder", "name", "digest"], "left_anti")
    fresh.withColumn("written", F.current_timestamp()).write.mode("append").partitionBy("folder").parquet(path)
    return now.select("folder", "name", "digest")


def deposited(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every deposited text."""
    rows = spark.read.parquet(path)
    return rows.groupBy("folder", "name").agg(F.max_by(F.struct("text", "digest"), "written").alias("t")).select("folder", "name", "t.*")


def gold_lines(lines: DataFrame) -> DataFrame:
    """register, page, line and fingerprint of the lines to be judged by hand."""
    return lines.select("register", "page", "line", T.fingerprint(F.col("text")).alias("fingerprint"))
