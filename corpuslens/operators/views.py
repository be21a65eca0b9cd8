"""What is shown of a corpus: run summaries, joined views, lists, labels and short reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T


# Runs
def run_quality(runs: DataFrame, rows: DataFrame, score: str = "quality_score") -> DataFrame:
    """run id and the mean score of its rows; null for runs without scored rows."""
    mean = rows.groupBy(F.col("run_id").alias("id")).agg(F.avg(score).alias("mean"))
    return runs.select("id").join(mean, "id", "left")


def run_counts(runs: DataFrame, topics: DataFrame, instances: DataFrame) -> DataFrame:
    """run id with the numbers of its topics and of its instances, zeros too."""
    out = runs.select("id")
    for name, rows in (("topics", topics), ("instances", instances)):
        out = out.join(rows.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias(name)), "id", "left")
    return out.fillna(0, ["topics", "instances"])


def most_common(rows: DataFrame, *keys: str) -> DataFrame:
    """How often each value is there, the most frequent first."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


# Lists
def first_shown(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first value of each key that is neither null nor empty."""
    some = F.when(F.col(value).isNotNull() & (F.col(value).cast("string") != ""), F.struct(order, value))
    return rows.groupBy(key).agg(F.min(some)[value].alias(value))


def names_of(rows: DataFrame, key: str, name: str, separator: str = ", ") -> DataFrame:
    """Each key's distinct names in one string, in order."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(name)), separator).alias("names"))


def top_topics(distribution: DataFrame, order: DataFrame, limit: int = fixed.TOP_TOPICS) -> DataFrame:
    """The topics with most documents, then in the order of their grid (topic, pos)."""
    top = distribution.filter(F.col("topic") != fixed.OUTSIDE).orderBy(F.desc("documents"), "topic").limit(limit)
    return top.join(order, "topic", "left").orderBy(F.asc_nulls_last("pos"), "topic")


def least_covered(covered: DataFrame, limit: int = fixed.LEAST_COVERED) -> DataFrame:
    """Documents (doc, length, covered) of which the smallest share is covered."""
    ratio = F.when(F.col("length") > 0, F.col("covered") / F.col("length")).otherwise(0.0)
    return covered.withColumn("ratio", ratio).orderBy("ratio", "doc").limit(limit)


def gold_candidates(pages: DataFrame) -> DataFrame:
    """Pages good and long enough to judge a transcription by."""
    low, high = fixed.GOLD_CHARS
    return pages.filter((F.col("quality_score") >= fixed.GOLD_QUALITY) & F.length("text").between(low, high))


# Filters
def of_place(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows of a place; an empty value stands for rows without one."""
    return rows.filter(F.col(column).eqNullSafe(F.lit(value or None)))


def topics_named(topics: DataFrame, names: list[str], level: int | None = None) -> DataFrame:
    out = topics.filter(F.col("name").isin(*names)) if names else topics.filter(F.lit(False))
    return out if level is None else out.filter(F.col("level") == level)


def topics_from(topics: DataFrame, source: str) -> DataFrame:
    """Topics that were found in a document."""
    return topics.filter(F.array_contains("sources", source))


def shown_topics(topics: DataFrame, level: int = 0, validated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Topics from a level on, validated ones only if asked, and the edges with both ends among them."""
    kept = topics.filter(F.col("level") >= level)
    kept = kept.filter("validated") if validated else kept
    edges = kept.filter("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"))
    return kept, edges.join(kept.select(F.col("id").alias("source")), "source", "left_semi")


# Joined views
def document_view(documents: DataFrame, contributions: DataFrame, places: DataFrame, members: DataFrame, groups: DataFrame, run: int | None) -> DataFrame:
    """Documents with their contribution, place and duplicate group of the run that is served;
    documents without any of them stay."""
    one = members.join(groups.filter(F.col("run_id") == F.lit(run)).select("group_id", "size", "places"), "group_id")
    out = documents.join(contributions.select(F.col("id").alias("contribution_id"), "city_code"), "contribution_id", "left")
    out = out.join(places.select(F.col("code").alias("city_code"), F.col("name").alias("place_name"), "official_name"), "city_code", "left")
    out = out.withColumn("place", F.coalesce(F.nullif("official_name", F.lit("")), "place_name")).drop("official_name", "place_name")
    return out.join(one.select(F.col("id"), "group_id", "size", "places"), "id", "left")


def with_parents(topics: DataFrame) -> DataFrame:
    """Topics with the name of their parent in the same run."""
    up = topics.select("run_id", F.col("external_id").alias("parent"), F.col("name").alias("parent_name"))
    return topics.join(up, ["run_id", "parent"], "left")


def transcribed(pages: DataFrame, transcriptions: DataFrame, run: int) -> DataFrame:
    """Pages that the run has a transcription of."""
    return pages.join(transcriptions.filter(F.col("run_id") == run).select("page_id"), "page_id", "left_semi")


def overlapping(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Spans of ``a`` (key, start, end) that share a character with a span of ``b`` of the same
    document: a document's spans are few, so each is compared inside the document's row."""
    others = b.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("others"))
    hit = F.exists("others", lambda o: (F.col("start") < o["end"]) & (o["start"] < F.col("end")))
    return a.join(others, key).filter(hit).drop("others")


def occurrences(instances: DataFrame, topics: DataFrame, documents: DataFrame, contributions: DataFrame) -> DataFrame:
    """Instances of topics with the register and page where they stand: the document's, or else
    the contribution's."""
    d = documents.select(F.col("id").alias("document_id"), F.col("register").alias("d_register"), F.col("start_page").alias("d_page"))
    c = contributions.select(F.col("id").alias("contribution_id"), F.col("pdf_file").alias("c_register"), F.col("start_page").alias("c_page"))
    t = topics.select("run_id", F.col("external_id").alias("topic"), "name")
    out = instances.join(t, ["run_id", "topic"]).join(d, "document_id", "left").join(c, "contribution_id", "left")
    return out.select("topic", "name", "document_id", "contribution_id", "verbatim", F.coalesce("d_register", "c_register").alias("register"), F.coalesce("d_page", "c_page").alias("page"))


def grids_reading(runs: DataFrame, segmentation: int) -> DataFrame:
    """Analysis runs whose corpus is the segmentation that is served."""
    return runs.filter((F.col("kind") == "analyse") & (F.col("corpus") == F.lit(f"segmentation:{segmentation}")))


def place_names(contributions: DataFrame, places: DataFrame) -> DataFrame:
    """Each contribution's code and the name shown for it: the official one, or else its spelling."""
    own = places.select(F.col("code").alias("city_code"), F.coalesce(F.nullif("official_name", F.lit("")), "name").alias("shown"))
    return contributions.join(own, "city_code", "left").select(F.col("id").alias("contribution_id"), "city_code", F.coalesce("shown", "city").alias("shown"))


def reading_labels(pages: DataFrame) -> DataFrame:
    """Contributions with their text in page order, where it comes from, and its lines and words."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    out = pages.groupBy("contribution_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.max("source").alias("source"))
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: T.strip(x) != ""))
    return out.select("contribution_id", "source", lines.alias("lines"), F.size(T.words(F.col("text"))).alias("words"), "text")


def map_points(table: DataFrame) -> DataFrame:
    """Places for a map: the root of the population against the largest, documents for a thousand
    people, the percentage of flagged pages, and whether nothing can be read of them."""
    root = F.sqrt(F.greatest(F.coalesce("population", F.lit(0)).cast("double"), F.lit(0.0)))
    most = table.agg(F.max(root).alias("most"))
    out = table.withColumn("root", root).crossJoin(F.broadcast(most))  # one row
    return out.withColumn("size", F.when(F.col("most") > 0, F.col("root") / F.col("most")).otherwise(0.0)).drop("root", "most")


def band_table(bands: DataFrame) -> DataFrame:
    """How many trees each band of heights holds, and their share; empty bands too."""
    counted = bands.groupBy("band").agg(F.count("*").alias("trees"))
    every = bands.sparkSession.createDataFrame([(b,) for b, _, _ in fixed.BANDS], "band string")
    total = F.sum("trees").over(Window.partitionBy())  # of a row for each band
    out = every.join(counted, "band", "left").fillna(0, ["trees"])
    return out.withColumn("share", F.when(total > 0, F.col("trees") * 100.0 / total).otherwise(0.0))


# Labels
def shown(c: Column) -> Column:
    """A value, or the mark of a missing one."""
    return F.coalesce(F.nullif(T.strip(c.cast("string")), F.lit("")), F.lit(fixed.MISSING))


def yes_no(c: Column) -> Column:
    return F.when(c.isNull(), fixed.MISSING).when(c, "oui").otherwise("non")


def percent(part: Column, whole: Column) -> Column:
    return F.when(part.isNotNull() & (whole > 0), F.format_string("%.1f %%", part * 100.0 / whole)).otherwise(fixed.MISSING)


def page_range(start: Column, end: Column) -> Column:
    """One page, or the first and the last."""
    one = F.concat(F.lit("p. "), start.cast("string"))
    return F.when(start.isNull(), fixed.MISSING).when(end.isNull() | (end == start), one).otherwise(F.concat(F.lit("p. "), start.cast("string"), F.lit("-"), end.cast("string")))


def page_link(url: Column, page: Column) -> Column:
    """A link to a page of a file; pages are counted from 1 there."""
    return F.when(url.isNotNull() & page.isNotNull(), F.concat(url, F.lit("#page="), (page + 1).cast("string")))


def bullets(names: Column) -> Column:
    """An array as a Markdown list."""
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), n)), "\n")


def report_lines(summary: DataFrame, *columns: str) -> DataFrame:
    """A summary of few rows as lines of text: name, value and, if asked, further columns."""
    parts = [F.concat(F.lit(f"{c}: "), shown(F.col(c))) for c in columns]
    return summary.select(F.concat_ws(", ", *parts).alias("line"))
