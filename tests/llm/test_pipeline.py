"""The pipeline over the smallest tables, stage by stage, against plain expectations; on messy and
empty tables; and with workers that cannot import the package."""

import os
import re
import subprocess
import sys

import pytest

import corpus_pipeline
from corpuslens.llm._spark import kept


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = kept(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
        if name == "toxicity":
            clean = [i for i, t in labels.items() if t == 0 and i in texts]
            stayed = {r["doc_id"] for r in docs.collect()}
            assert sum(i in stayed for i in clean) >= 0.95 * len(clean)
        if name == "near_duplicates":
            rows = docs.collect()
            assert len({r["text"] for r in rows}) == len(rows)
        if name == "pii":
            assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) for r in docs.collect())
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").isEmpty()


LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))
MESSY = [(1, "Some plain text with a few words in it.", "en", "s", 1), (2, None, "en", "s", None), (3, "", None, None, 0), (None, "no id here but text", "fr", "s", 2), (4, "Some plain text with a few words in it.", "en", "s", 1), (4, "Some plain text with a few words in it.", "de", "a", 1), (5, " \n\t ", "de", "s", 1), (6, LONG, "en", "s", 1), (7, "é" * 300, None, "s", 1), (8, "...!!!", "es", "s", 1), (10, "write to x@y.org " * 30, "en", "s", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS_LEFT = {"toxicity": 11, "near_duplicates": 9, "decontamination": 11, "pii": 11}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_messy_and_empty_tables(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    clashes = ", row long, id long, band long, pid long, spans string, size string, key int, weight string, gone int, n_words string"
    messy = spark.createDataFrame([(*r, 1, 2, 3, 4, "s", "s", 5, "w", 6, "n") for r in MESSY], SCHEMA + clashes)
    got = stage(spark, messy, sf).collect()
    assert stage(spark, messy.limit(0), sf).count() == 0
    if name == "packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in MESSY} and sum(r["piece"] == 0 for r in got) == len(MESSY)
        return
    assert len(got) == ROWS_LEFT[name] and list(got[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert sum(r["text"] is None for r in got) == 1 and sum(r["text"] == "" for r in got) == 1 and any(r["text"] == LONG for r in got)
    if name == "near_duplicates":
        assert [(r["doc_id"], r["lang"]) for r in got if r["text"] == MESSY[0][1]] == [(1, "en")]
    if name == "pii":
        assert next(r for r in got if r["doc_id"] == 10)["text"] == "write to [email] " * 30
    narrow = spark.createDataFrame([(1, "one text only")], "doc_id long, text string")
    assert [tuple(r) for r in stage(spark, narrow, sf).collect()] == [(1, "one text only", None, None, 13)]


WITHOUT_PACKAGE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from corpuslens.llm import queries

def there(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("corpuslens") is not None))

assert spark.range(1).mapInPandas(there, "id long").first()[0] == 0
for name in ("op1_toxicity", "op4_quality", "op8_decontamination"):
    assert queries.QUERIES[name](spark, {sf!r}).count() > 0
print("all ran")
"""


def test_workers_need_no_copy_of_the_package(sf, tmp_path):
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", WITHOUT_PACKAGE.format(repo=repo, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]
