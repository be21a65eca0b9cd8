"""WARC archives: write request, response, revisit and metadata records, read them back and
assemble one nested row per capture through the concurrent-to identifiers.

Archives are written and read by Spark's own writers and readers only, so any store that
Spark knows will do.  A record's text is one row of the text writer, whose line separator
is the record terminator of the format.

Every row has record identifiers of its own, made of its page id, its payload's digest and
its place in the table.

Defined results: null payloads are empty; empty and short payloads are always responses, as
are pages without an id; repeated page ids give a capture for each row, and of equal
payloads under one id all are responses; payloads are whole, however long; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import kept, only, scratch

END = "\r\n\r\n"
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 100
#: Bytes of payload in one archive file at most, and in a page that counts as large: files of
#: large pages hold as many as the largest of them allows.
FILE_BYTES, LARGE_BYTES = 1 << 30, 256 << 10
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, warc_type string, concurrent_to string, refers_to string, target_uri string, page_id long, digest string, block binary"


def _record(kind: str, page: Column, name: str, block: Column, *headers: Column) -> Column:
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:{name}:"), page, F.lit(">\r\n"), *headers,
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def archive_rows(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """The text of every record to write, three for each page."""
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", "%0A")
    pages = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    pages = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("long", F.octet_length("payload") >= revisit_bytes)
    first = pages.filter("long and page_id is not null").groupBy("digest").agg(F.min(F.struct("page_id", "row")).alias("original"), F.count("*").alias("n")).filter("n > 1").select("digest", "original")
    pages = pages.join(first, "digest", "left").withColumn("again", F.coalesce(F.col("long") & (F.col("original.page_id") < F.col("page_id")), F.lit(False)))
    ident = lambda page, row: F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("none")), "digest", row.cast("string"))
    page, response = ident(F.col("page_id"), F.col("row")), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    uri, concurrent = F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n")), F.concat(F.lit("WARC-Concurrent-To: <urn:capture:"), page, F.lit(">\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"))
    http, json = F.lit("Content-Type: application/http\r\n"), F.lit("Content-Type: application/json\r\n")
    request = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))
    refers = F.concat(F.lit("WARC-Refers-To: <urn:capture:"), ident(F.col("original.page_id"), F.col("original.row")), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))
    return pages.select(
        F.explode(F.array(
            _record("request", page, "request", request, uri, concurrent, http),
            F.when(F.col("again"), _record("revisit", page, "capture", response, uri, digest, refers, http)).otherwise(_record("response", page, "capture", F.concat(response, F.col("payload")), uri, digest, http)),
            _record("metadata", page, "metadata", F.concat(F.lit('{"page_id": '), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("}")), uri, concurrent, json),
        )).alias("value")
    )


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, large_bytes: int = LARGE_BYTES) -> None:
    """Archives under ``path``, in files of at most about ``file_bytes`` before compression."""
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) if "html" in pages.columns else F.lit(0)
    largest = pages.agg(F.max(size)).first()[0] or 0
    rows = archive_rows(pages, revisit_bytes)
    of_large = F.octet_length("value") >= large_bytes
    for part, most in ((rows, largest),) if largest < large_bytes else ((rows.filter(~of_large), large_bytes), (rows.filter(of_large), largest)):
        part.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, file_bytes // (most + 4096))).text(path)


def parse_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole archive files, cut by their content lengths."""
    import gzip
    import io

    names = ("record_id", "warc_type", "concurrent_to", "refers_to", "target_uri", "page_id", "digest", "block")
    schema = pa.schema([(n, pa.int64() if n == "page_id" else pa.binary() if n == "block" else pa.string()) for n in names])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for i in range(batch.num_rows):
            rows, held = [], 0
            with gzip.open(io.BytesIO(batch.column("content")[i].as_buffer())) as archive:
                while line := archive.readline():
                    if not line.strip():
                        continue
                    headers = {}
                    while (line := archive.readline()).strip():
                        key, _, value = line.decode().partition(":")
                        headers[key.lower()] = value.strip()
                    block = archive.read(int(headers["content-length"]))
                    ident = headers["warc-record-id"].strip("<>")
                    rows.append((ident, headers["warc-type"], headers.get("warc-concurrent-to", "").strip("<>") or None, headers.get("warc-refers-to", "").strip("<>") or None, headers.get("warc-target-uri"), None if ident.split(":")[2] == "none" else int(ident.split(":")[2]), headers.get("warc-payload-digest", "").removeprefix("sha256:") or None, block))
                    held += len(block)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record of the archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse_archives, RECORD)


def assemble(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata.

    Requests and metadata join their capture by concurrent-to.  The capture's own block is
    split into HTTP head and payload; a revisit has the payload of what it refers to only
    by reference.  Payload facts are taken before the join, which moves payloads only if
    they are kept.
    """
    captures = records.filter("warc_type in ('response', 'revisit')")
    payload = F.when(F.col("warc_type") == "response", F.expr("substring(block, position(X'0D0A0D0A', block) + 4)"))
    captures = captures.select(
        "record_id", "page_id", "target_uri",
        F.struct(
            "warc_type", "refers_to", "digest", F.expr("substring(block, 1, position(X'0D0A0D0A', block) + 3)").alias("head"),
            F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"), *[payload.alias("payload")] * keep_payload,
        ).alias("capture"),
    )
    others = records.filter("warc_type in ('request', 'metadata') and concurrent_to is not null")
    by = others.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.min(F.when(F.col("warc_type") == "request", F.col("block"))).alias("request"),
        F.min(F.when(F.col("warc_type") == "metadata", F.col("block"))).alias("metadata"),
    )
    return captures.join(by, "record_id", "left")


def capture_report(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back, and gives the payload facts of each page."""
    path = path or scratch(spark, "warc")
    write_archives(pages, path)
    nested = assemble(read_archives(spark, path), keep_payload=False)
    facts = kept(nested.select(
        "record_id", "page_id", F.col("capture.warc_type").alias("record_type"), F.col("capture.refers_to").alias("refers"), F.col("capture.payload_bytes").alias("n"),
        F.col("capture.payload_digest").alias("own"), F.col("capture.digest").alias("said"), F.col("request").isNotNull().alias("has_request"),
    ))
    # A revisit's payload is what it refers to: the response with the digest that it names.
    originals = facts.filter("record_type = 'response'").groupBy(F.col("own").alias("said")).agg(F.min("n").alias("n0"), F.min("own").alias("own0"))
    revisits = facts.filter("record_type = 'revisit'").join(originals, "said", "left").select("page_id", F.col("n0").alias("payload_bytes"), F.col("own0").alias("payload_digest"), "record_type", F.split_part("refers", F.lit(":"), F.lit(3)).cast("long").alias("refers_to"), "has_request")
    responses = facts.filter("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "has_request")
    return responses.unionByName(revisits)
