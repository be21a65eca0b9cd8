"""Schemas of the corpus tables, so that nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "floats": T.ArrayType(T.FloatType()), "strings": T.ArrayType(T.StringType())}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns.items()])


RUN = _schema(id="long", kind="string", label="string", source="string", model="string", prompt_version="string", parameters="string", corpus="string", author="string", created_at="timestamp", active="boolean", notes="string")
PLACE = _schema(code="string", name="string", official_name="string", department="string", kind="string", parent_code="string", current_code="string", population="long", latitude="double", longitude="double")
CONTRIBUTION = _schema(id="long", city="string", city_code="string", pdf_file="string", start_page="int", end_page="int", is_handwritten="boolean")
PAGE = _schema(page_id="long", contribution_id="long", register="string", page="int", text="string", quality_score="double", needs_ocr="boolean", city="string", category="string")
TRANSCRIPTION = _schema(run_id="long", page_id="long", register="string", page="int", text="string", layout="string", quality_score="double")
DOCUMENT = _schema(run_id="long", id="long", contribution_id="long", register="string", city="string", position="int", start_page="int", end_page="int", text="string", signal="string", num_words="int")
DUPLICATE_GROUP = _schema(run_id="long", group_id="long", id="long", size="long", places="long", similarity_min="double")
PII_SPAN = _schema(run_id="long", id="long", start="int", end="int", kind="string", detector="string", confirmed="boolean")
TYPOLOGY = _schema(run_id="long", id="long", axis="string", value="string", detector="string", confirmed="boolean")
TOPIC = _schema(run_id="long", external_id="string", name="string", description="string", level="int", validated="boolean", parent="string")
INSTANCE = _schema(run_id="long", contribution_id="long", external_doc_id="string", document_id="long", topic="string", verbatim="string", summary="string")
EMBEDDING = _schema(run_id="long", id="long", vector="floats")
ANNOTATION = _schema(contribution_id="long", is_anonymized="boolean", is_of_interest="boolean")
TAXONOMY_FILE = T.StructType([T.StructField("topics", T.ArrayType(_schema(id="string", name="string", description="string", sources="strings", parent="string", level="int", validated="boolean")))])
LABELS_FILE = T.StructType([T.StructField("documents", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("labels", T.ArrayType(_schema(name="string", rationale="string", extract="string")))])))])
