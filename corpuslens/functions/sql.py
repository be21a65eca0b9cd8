"""The library's text functions for SQL: scalar functions and table functions by name."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from .spans import detect, redact_sql
from . import text as T

#: Scalar functions: name, and the column function of one text.
SCALARS = {"cl_fingerprint": T.fingerprint, "cl_category": T.category}
#: Functions that are written as SQL themselves, of a column x.
WRITTEN = {"cl_fold": T.fold_sql("x"), "cl_normalise": f"trim(regexp_replace({T.fold_sql('x')}, '[^a-z0-9]+', ' '))"}


@F.udtf(returnType="start int, end int, kind string, detector string")
class SpansOf:
    """Personal data in a text, a row for each span."""

    def eval(self, text: str):
        for start, end, kind, detector in detect(text or ""):
            yield Row(start=start, end=end, kind=kind, detector=detector)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; gives their names.

    Scalar functions are SQL themselves, so the optimiser sees through them.
    """
    text = spark.sql("select cast(null as string) as x")
    for name, f in SCALARS.items():
        analysed = text.select(f(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().expressions().head()
        spark.sql(f"create or replace temporary function {name}(x string) returns string return {analysed.child().sql()}")
    for name, body in WRITTEN.items():
        spark.sql(f"create or replace temporary function {name}(x string) returns string return {body}")
    spark.udtf.register("cl_spans", SpansOf)
    spans = "array<struct<start: int, end: int, kind: string, confirmed: boolean>>"
    spark.sql(f"create or replace temporary function cl_redact(x string, spans {spans}) returns string return {redact_sql('x', 'spans')}")
    return [*SCALARS, *WRITTEN, "cl_spans", "cl_redact"]
