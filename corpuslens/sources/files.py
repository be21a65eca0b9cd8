"""Files in: discovery, page images, texts, CSV, delivered JSON, lots of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import fixed, schemas
from ..functions import text as T


def list_files(spark: SparkSession, path: str, categories: tuple[str, ...] = fixed.CATEGORIES, pattern: str = "*.pdf", skipped: str = "A_lire") -> DataFrame:
    """path, name, category and natural order of files anywhere below a folder; contents are not read.

    The order is that of the path below the folder.  A folder without such files is refused.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length")
    out = files.filter(~F.contains("path", F.lit(f"/{skipped}/"))).withColumn("name", F.element_at(F.split("path", "/"), -1))
    out = out.withColumn("category", T.category(F.col("name"))).filter(F.col("category").isin(*categories))
    if out.isEmpty():
        raise FileNotFoundError(f"no {pattern} of {', '.join(categories)} in {path}")
    below = F.substring_index(F.col("path"), path.rstrip("/") + "/", -1)
    return out.withColumn("order", T.natural_key(below))


def first_file(files: DataFrame) -> str:
    """The path of the first file in natural order."""
    return files.agg(F.min_by("path", "order")).first()[0]


def name_index(files: DataFrame) -> DataFrame:
    """name and path; a name that is there twice is refused when the rows are read."""
    one = files.groupBy("name").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    return one.filter(F.assert_true(F.col("n") == 1, F.concat(F.lit("two files named "), F.col("name"))).isNull()).select("name", "path")


def read_pages(spark: SparkSession, path: str, extract, schema: str = "file string, page int, text string", pattern: str = "*.pdf") -> DataFrame:
    """Pages of binary documents by a function from (path, content) to (page, text) pairs; a
    file that fails gives one row with a null page and the error as text."""

    def pages(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(file, n, text) for n, text in extract(file, content)]
                except Exception as error:  # noqa: BLE001  one bad file does not end the pass
                    rows.append((file, None, f"error: {error}"))
            yield pd.DataFrame(rows, columns=["file", "page", "text"]).astype({"page": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(pages, schema)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """id and content of a CSV file with quoted line ends."""
    return spark.read.schema("id string, content string").csv(path, header=True, multiLine=True, escape='"')


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """id (path) and content of whole text files."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("content"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Topics of a delivered taxonomy, with their place in the file."""
    return spark.read.schema(schemas.TAXONOMY_FILE).json(path, multiLine=True).select(F.posexplode("topics").alias("pos", "t")).select("t.*", "pos")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """external_doc_id and labels of a delivered data set; of labels with one name the last counts."""
    docs = spark.read.schema(schemas.LABELS_FILE).json(path, multiLine=True).select(F.explode("documents").alias("d"))
    later = lambda x, i: ~F.exists(F.slice("d.labels", i + 2, F.size("d.labels")), lambda y: y["name"].eqNullSafe(x["name"]))
    return docs.select(F.col("d.id").alias("external_doc_id"), F.filter("d.labels", later).alias("labels"))


def read_lexicon(path: str) -> dict[str, str]:
    """topic and query of a hand-written lexicon, refused if it is not that or a query is empty."""
    import json

    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict) or not all(isinstance(v, str) and v.strip() for v in found.values()):
        raise ValueError("a lexicon has a query for each topic")
    return found


def read_answers(spark: SparkSession, path: str, answer: ST.StructType) -> DataFrame:
    """id and parsed answer of JSONL lots; what cannot be parsed has a null answer."""
    rows = spark.read.schema("custom_id string, response string").json(path)
    return rows.select(F.col("custom_id").alias("id"), F.from_json("response", answer, {"mode": "PERMISSIVE"}).alias("answer"))
