"""WARC archives of web captures, written as text records and read back by content length.

A capture is three records: the request, the response (or a revisit that refers to one), and the metadata. Reading takes
the records of all files, joins request and metadata to their response through the concurrent-to identifiers and gives one
nested row per capture.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import cut_lineage

LEAST_REVISIT_BYTES = 100
RECORDS_PER_FILE = 2_000
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF


def plan_captures(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                  least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, html, row, payload_bytes, payload_digest, refers_to, refers_row)``; a null payload is empty.

    Of equal payloads of ``least_bytes`` or more, that of the least id is the response the others refer to. Rows without id
    are responses of their own, and so are further rows of the id that is the response; where an id is repeated, ``row`` numbers the rows, so each capture
    has identifiers of its own. A digest that many pages share is counted before the shuffle. The digests that occur more than once
    are written first, so Spark knows their size: where it allows a broadcast, payloads are not shuffled.
    """
    own = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    repeated = not own.where("page_id is not null").groupBy("page_id").count().where("count > 1").isEmpty()
    own = own.withColumn("row", F.when(F.lit(repeated) | F.col("page_id").isNull(), F.monotonically_increasing_id()))
    if repeated:                     # the numbers must be the same wherever they are looked at
        own = cut_lineage(own)
    own = own.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn(
        "payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    first = cut_lineage(own.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(
        F.min(F.struct("page_id", "row")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("payload_digest", "first"))
    refers = (F.col("first").isNotNull()) & (F.col("page_id") != F.col("first.page_id"))
    return own.join(first, "payload_digest", "left").withColumn("refers_to", F.when(refers, F.col("first.page_id"))).withColumn(
        "refers_row", F.when(refers, F.col("first.row"))).drop("first")


def _fields(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; a field whose value is null is left out."""
    lines = [F.concat(F.lit(name + ": "), (v if isinstance(v, Column) else F.lit(v)).cast("string"), F.lit(CRLF)) for name, v in pairs]
    return F.concat_ws("", *lines)


def _record(kind: str, ident: Column, block: Column, *more: tuple[str, Column | str]) -> Column:
    return F.concat(F.lit("WARC/1.1" + CRLF), _fields(("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", DATE), *more,
                                                      ("Content-Length", F.octet_length(block))), F.lit(CRLF), block)


def _clean(url: Column) -> Column:
    """A URL as it may stand in a header: blanks and control characters escaped."""
    out = F.coalesce(url, F.lit("about:blank"))
    return F.regexp_replace(out, r"[\x00-\x20\x7f]", "%20")


def write_archives(captures: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Writes the records with Spark's text writer: each is one value, and its line end is the two CRLF that close a record."""
    uid = lambda page, row: F.concat_ws("-", F.coalesce(F.col(page).cast("string"), F.lit("none")), F.substring("payload_digest", 1, 12), F.col(row).cast("string"))
    ident = lambda kind: F.concat(F.lit(f"<urn:capture:{kind}:"), F.col("uid"), F.lit(">"))
    c = captures.withColumn("uid", uid("page_id", "row"))
    uri = _clean(F.col("url"))
    host = F.coalesce(F.regexp_extract(uri, "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    back = F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("<urn:capture:response:"), uid("refers_to", "refers_row"), F.lit(">")))
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    request = _record("request", ident("request"), F.concat(F.lit("GET / HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF)),
                      ("WARC-Concurrent-To", ident("response")), ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=request"))
    response = _record("response", ident("response"), F.concat(F.lit(HTTP_HEAD), F.col("html")), ("WARC-Target-URI", uri),
                       ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response"))
    revisit = _record("revisit", ident("response"), F.lit(HTTP_HEAD), ("WARC-Target-URI", uri), ("WARC-Refers-To", back),
                      ("WARC-Profile", REVISIT_PROFILE), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response"))
    notes = F.concat(_fields(("pageId", F.col("page_id")), ("payloadBytes", F.col("payload_bytes")), ("refersToPage", F.col("refers_to"))))
    metadata = _record("metadata", ident("metadata"), notes, ("WARC-Concurrent-To", ident("response")), ("WARC-Target-URI", uri),
                       ("Content-Type", "application/warc-fields"))
    records = c.select(F.explode(F.array(request, F.when(F.col("refers_to").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", RECORD_END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; blocks are taken by their stated length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield fields, data[start:stop]
        at = stop + 4


RECORD = ("record_id string, type string, uri string, concurrent_to string, refers_to_id string, digest string, block binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. Files are read whole, so ``records_per_file`` bounds what a task holds."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                data = content.as_py()
                if name.as_py().endswith(".gz"):
                    data = zlib.decompress(data, 31)
                rows: list[tuple] = []
                held = 0
                for f, block in parse_records(data):
                    rows.append((f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f.get("warc-concurrent-to"),
                                 f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "block" else pa.string()) for n, c in zip(names, zip(*rows))], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """``(record_id, type, request, response, metadata)``: one nested row per capture, joined through concurrent-to identifiers.

    A response whose request or metadata is missing keeps null in its place.
    """
    main = records.where(F.col("type").isin("response", "revisit")).select("record_id", "type", F.struct(
        "uri", "digest", "refers_to_id", "block").alias("response"))
    side = lambda kind: records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct(
        F.col("record_id").alias("id"), "uri", "block").alias(kind))
    return main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left").select(
        "record_id", "type", "request", "response", "metadata")


def payload(captures: DataFrame) -> Column:
    """The payload of a response: its block after the HTTP header."""
    return F.substring(F.col("response.block"), len(HTTP_HEAD) + 1, 2 ** 31 - 1 - len(HTTP_HEAD))


def capture_table(captures: DataFrame) -> DataFrame:
    """Per capture the page id, payload size and digest (worked out anew for responses), record type and the page referred to.

    A revisit takes its size from its metadata.
    """
    note = lambda name: F.regexp_extract(F.col("metadata.block").cast("string"), rf"(?m)^{name}: (\d+)\r?$", 1)
    number = lambda name: F.when(note(name) != "", note(name).cast("long"))
    full = F.col("type") == "response"
    body = payload(captures)
    return captures.select(
        number("pageId").alias("page_id"),
        F.when(full, F.octet_length(body).cast("long")).otherwise(number("payloadBytes")).alias("payload_bytes"),
        F.when(full, F.sha2(body, 256)).otherwise(F.col("response.digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), number("refersToPage").alias("refers_to"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
             sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)
"""
