"""The layered passes in their order: pages, documents, duplicates, typology, personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import spans as S
from ..operators import duplicates, layers, segmentation, typology
from ..storage import materialised


def segment_pass(pages: DataFrame, run: int, done: DataFrame | None = None) -> DataFrame:
    """Documents of registers not yet covered; ids follow register and position."""
    if done is not None:
        pages = pages.join(done.select("register").distinct(), "register", "left_anti")
    out = segmentation.segment(pages)
    return out.withColumn("id", F.xxhash64("register", "position")).withColumn("run_id", F.lit(run))


def duplicate_pass(documents: DataFrame, run: int, threshold: float = fixed.SIMILARITY) -> DataFrame:
    """Groups over documents (id, text, place) that are not blank."""
    return duplicates.groups(documents.filter(F.length(F.trim("text")) > 0), threshold).withColumn("run_id", F.lit(run))


def typology_pass(documents: DataFrame, grouped: DataFrame, run: int) -> DataFrame:
    marked = documents.join(duplicates.recopied(grouped).withColumn("recopied", F.lit(True)), "id", "left")
    return typology.classify(marked.filter("text <> ''")).withColumn("run_id", F.lit(run)).withColumn("confirmed", F.lit(None).cast("boolean"))


def pii_pass(documents: DataFrame, run: int) -> DataFrame:
    spans = documents.filter("text <> ''").select("id", F.explode(S.pii_spans("text")).alias("s"))
    return spans.select("id", "s.*", F.lit(None).cast("boolean").alias("confirmed"), F.lit(run).alias("run_id"))


def all_passes(pages: DataFrame, places: DataFrame, folder: str, runs: dict[str, int]) -> dict[str, DataFrame]:
    """Every pass over pages (register, page, text); layers are written by run and read back.
    ``places`` has register and place."""
    documents = materialised(segment_pass(pages, runs["segmentation"]).join(places, "register", "left"))
    grouped = materialised(duplicate_pass(documents.select("id", "text", "place"), runs["doublons"]))
    out = {"segmentation": documents, "doublons": grouped, "typologie": typology_pass(documents.select("id", "text"), grouped.select("id", "places"), runs["typologie"]), "anonymisation": pii_pass(documents.select("id", "text"), runs["anonymisation"])}
    for kind, rows in out.items():
        layers.write_layer(rows.drop("run_id"), f"{folder}/{kind}", runs[kind])
    spark = pages.sparkSession
    return {kind: spark.read.parquet(f"{folder}/{kind}") for kind in out}
