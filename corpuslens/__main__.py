"""Command line: passes over pages, search, measures and the registered queries.

    python -m corpuslens segment PAGES OUT            documents of registers (register, page, text)
    python -m corpuslens dedup DOCUMENTS OUT          duplicate groups (id, text, place)
    python -m corpuslens typology DOCUMENTS OUT       kinds of documents (id, text, recopied)
    python -m corpuslens pii DOCUMENTS OUT            spans of personal data (id, text)
    python -m corpuslens index DOCUMENTS OUT          a search index (id, text)
    python -m corpuslens search DOCUMENTS WORDS       the best documents, with --index from an index
    python -m corpuslens coverage PAGES               pages read and left out, by register and place
    python -m corpuslens quality DOCUMENTS OUT        share of known words (id, text), by --lexicon (word)
    python -m corpuslens cluster VECTORS OUT          clusters by density (level, id, vector)
    python -m corpuslens grid DOCUMENTS GRID OUT      keyword instances of a JSON grid {topic: query}
    python -m corpuslens taxonomy TOPICS              faults of a taxonomy (id, name, description, parent, ...)
    python -m corpuslens fidelity PAIRS OUT           error rates of transcriptions (page_id, reference, text)
    python -m corpuslens lots REQUESTS OUT            requests (id, size) in lots of --limit bytes
    python -m corpuslens names NAMES TOPICS OUT       the topic (name, pos) most like each name
    python -m corpuslens extract FOLDER OUT           pages of text files in a folder
    python -m corpuslens query NAME TABLES            a registered query, to OUT or shown

Tables are Parquet.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpuslens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("segment", "dedup", "typology", "pii", "index", "extract"):
        p = commands.add_parser(name)
        p.add_argument("source")
        p.add_argument("out")
        if name == "dedup":
            p.add_argument("--similarity", type=float, default=0.8)
    for name in ("quality", "cluster", "fidelity", "lots", "grid", "names"):
        p = commands.add_parser(name)
        p.add_argument("source")
        if name in ("grid", "names"):
            p.add_argument("grid")
        p.add_argument("out")
        if name == "quality":
            p.add_argument("--lexicon")
        if name == "cluster":
            p.add_argument("--least", type=int, default=5)
        if name == "lots":
            p.add_argument("--limit", type=int, default=fixed.LOT_BYTES)
    commands.add_parser("taxonomy").add_argument("source")
    p = commands.add_parser("search")
    p.add_argument("source")
    p.add_argument("words")
    p.add_argument("--index")
    p.add_argument("--limit", type=int, default=20)
    p = commands.add_parser("coverage")
    p.add_argument("source")
    p.add_argument("--json", action="store_true")
    p = commands.add_parser("query")
    p.add_argument("name")
    p.add_argument("source")
    p.add_argument("--out")
    return out


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """What a command gives; none if it only writes."""
    from . import queries
    from .functions import spans, text
    from .operators import coverage, density, duplicates, lexicon, search, segmentation, taxonomy, topics, transcription, typology
    from .sources import files, sinks

    if args.command == "query":
        return queries.QUERIES[args.name](spark, args.source)
    if args.command == "extract":
        texts = files.read_texts(spark, args.source)
        return texts.select(F.col("id").alias("file"), F.posexplode(F.split("content", "\f")).alias("page", "text")).withColumn("text", text.clean_page(F.col("text")))
    rows = spark.read.parquet(args.source)
    if args.command == "segment":
        return segmentation.segment(rows)
    if args.command == "dedup":
        return duplicates.groups(rows if "place" in rows.columns else rows.withColumn("place", F.lit(None).cast("string")), args.similarity)
    if args.command == "typology":
        return typology.classify(rows if "recopied" in rows.columns else rows.withColumn("recopied", F.lit(False)))
    if args.command == "pii":
        return rows.select("id", F.explode(spans.pii_spans("text")).alias("s")).select("id", "s.*")
    if args.command == "index":
        search.write_index(rows, args.out)
        return None
    if args.command == "quality":
        known = spark.read.parquet(args.lexicon) if args.lexicon else lexicon.frequent_words(rows, 2)
        return lexicon.quality_scores(rows, known)
    if args.command == "cluster":
        return density.clusters(rows, args.least)
    if args.command == "grid":
        lines = spark.read.text(args.grid, wholetext=True).first()["value"]
        return search.keyword_grid(rows, json.loads(lines))
    if args.command == "names":
        return topics.nearest_name(rows, spark.read.parquet(args.grid))
    if args.command == "taxonomy":
        return taxonomy.violations(rows)
    if args.command == "fidelity":
        return transcription.fidelity(rows)
    if args.command == "lots":
        return transcription.lots(rows, args.limit)
    if args.command == "search":
        found = search.search_index(rows, args.index, args.words, args.limit) if args.index else search.search(rows, args.words, args.limit)
        return found.select("id", "rank", "snippet")
    summary = coverage.summary(rows, "register", "place")
    return sinks.report_json(summary) if args.json else summary


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpuslens").getOrCreate()
    out = result(spark, args)
    if out is not None and getattr(args, "out", None):
        out.write.mode("overwrite").parquet(args.out)
    elif out is not None:
        out.show(1000, truncate=False)


if __name__ == "__main__":
    main()
