"""What the reviewer of round 4 found, each by a small table on which the code was wrong before."""

from time import perf_counter

import pytest
from test_findings_r03 import same_as_sql

from corpuslens.operators import segmentation
from corpuslens.queries import QUERIES


def test_plain_words_are_no_other_forms(spark, tmp_path):
    texts = ["a cup of tea witha spoon", "two tokens", "a token", "cup of tea with milk", "of les with", "of x withes y of z with", "tokens token tokens", "of withas", "witha of", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert same_as_sql(spark, tmp_path, "search_index_gaps")


SEGMENTED = ["segment_documents", "segment_signals", "segment_boundaries"]


@pytest.mark.parametrize("name", SEGMENTED)
def test_registers_are_those_of_their_sql(spark, tmp_path, name):
    """Ids below zero, and documents without a source or an id, which belong to no register."""
    text = "\n".join(["und so weiter " * 8, "the", "x of y", "e", "e", "e", "e", "e", "le,"])
    rows = [(i, text, "src1") for i in (-150, -100, -99, -65, -1, 0, 63, 64, 99, 100)] + [(5, text, None), (None, text, "src1"), (7, None, "src1"), (8, " \n", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert same_as_sql(spark, tmp_path, name)


@pytest.mark.parametrize("name", SEGMENTED)
def test_many_small_registers_take_no_time_each(spark, tmp_path, name):
    text = "\n".join(["und so weiter " * 8, "the", "x of y"])
    spark.range(0, 400_000, 100, 4).selectExpr("id as doc_id", f"'{text}' as text", "'src1' as source").write.parquet(f"{tmp_path}/documents.parquet")
    begun = perf_counter()
    QUERIES[name](spark, str(tmp_path)).collect()
    assert perf_counter() - begun < 20


def test_pages_of_one_number_are_read_line_by_line(spark):
    pages = spark.createDataFrame([("r", 1, "a\n\nf"), ("r", 1, "b\nd\ne"), ("r", 0, "x"), ("r", 2, "y")], "register string, page int, text string")
    assert [r["text"] for r in segmentation.segment(pages).collect()] == ["x\na\nb\nd\ne\nf\ny"]


def test_texts_are_not_dealt_out_for_cuts_alone(spark):
    """Of pages only numbers are shuffled, and no group of them is a call of its own."""
    pages = spark.createDataFrame([("r", 0, "a\nb"), ("r", 1, "c")], "register string, page int, text string")
    plan = segmentation.cuts(pages)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "text" not in plan
