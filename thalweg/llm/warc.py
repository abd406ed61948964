"""Web archives: writing captures as WARC records and assembling them again.

Each capture becomes three records, a request, a response (or revisit) and a
metadata record, in any files: Spark's text writer with a CRLF line end writes
the exact bytes. Assembly reads archives block by block by their Content-Length,
then joins the three kinds through their concurrent-to identifiers and gives one
nested row per capture. The rows of one payload may be a third of all: the
payloads' winners are found by a partial aggregation, and of the joins only the
split-on-skew kind reads the payloads.

``captures`` takes lengths and digests from the blocks that it reads, and a revisit's
page and length from the response whose record identifier its refers-to names.

Results for the odd cases: a null html is an empty payload; a null url is written
as an empty target and read back as null; rows with a null page_id are captures
of their own (their page_id is null again); rows repeated with one page_id are
captures of their own, of which the first is the response. Payloads under
``min_bytes`` are always responses. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder
from .words import slices

CRLF = "\r\n"
#: Captures in an archive file at most, and payload bytes: with large pages a file has fewer captures (one at least).
PER_FILE, FILE_BYTES = 500, 128 << 20
KINDS = {"request": "1", "response": "2", "revisit": "2", "metadata": "3"}
PARSED = "kind string, record_id string, concurrent_to string, refers_to string, url string, digest string, bytes long, payload binary, fields map<string,string>"


def block_digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def with_digests(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(rec, page_id, url, html, bytes, digest); rec numbers the rows."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            payload = [(x or "").encode() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(len, payload), pa.int64()), pa.array(map(block_digest, payload), pa.string())], [*b.schema.names, "bytes", "digest"])

    # row numbers hold from one reading to the next, as files are cut alike
    return rows.withColumn("rec", F.monotonically_increasing_id()).mapInArrow(run, "page_id long, url string, html string, rec long, bytes long, digest string")


def _uuid(rec: F.Column, kind: str) -> F.Column:
    digits = F.concat(F.lit("0" * 8), F.lpad(F.lower(F.hex(rec)), 16, "0"), F.lit("0000000"), F.lit(kind))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, date: str, headers: list[tuple[str, F.Column]], body: F.Column, length: F.Column) -> F.Column:
    """A record without the last of its two line ends, which the writer adds. A header without a value is left out."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {date}{CRLF}")]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("Content-Length: "), length.cast("string"), F.lit(CRLF * 2), body, F.lit(CRLF))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z") -> None:
    """Writes every capture's records to gzipped WARC files in ``path``."""
    rows = with_digests(pages, id_col, url_col, html_col)
    order = F.struct(F.col("page_id"), (-F.col("rec")).alias("first"))
    winners = rows.select("digest", "bytes", "page_id", "rec").where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max(order).alias("w"), F.count("*").alias("n")).where("n > 1")
    winners = winners.select("digest", "bytes", (-F.col("w.first")).alias("winner"))
    full = rows.join(winners, ["digest", "bytes"], "left")
    original = F.col("winner").isNull() | (F.col("winner") == F.col("rec"))
    # the target is one header line: a control character would end it
    target = F.regexp_replace("url", "[\\x00-\\x1f\\x7f]", "")
    request_line = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace(target, " ", "%20"), F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    to = _uuid(F.col("rec"), KINDS["response"])
    asked = _record("request", date, [("WARC-Record-ID", _uuid(F.col("rec"), KINDS["request"])), ("WARC-Concurrent-To", to), ("WARC-Target-URI", target), ("Content-Type", F.lit("application/http; msgtype=request"))], request_line, F.octet_length(request_line))
    html = F.coalesce("html", F.lit(""))
    got = _record("response", date, [("WARC-Record-ID", to), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("text/html; charset=utf-8"))], html, F.col("bytes"))
    again = _record(
        "revisit",
        date,
        [("WARC-Record-ID", to), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", _uuid(F.col("winner"), KINDS["response"])), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))],
        F.lit(""),
        F.lit(0),
    )
    fields = F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit("")) for name, value in (("pageId", F.col("page_id")),)])
    told = _record("metadata", date, [("WARC-Record-ID", _uuid(F.col("rec"), KINDS["metadata"])), ("WARC-Concurrent-To", to), ("WARC-Target-URI", target), ("Content-Type", F.lit("application/warc-fields"))], fields, F.octet_length(fields))
    records = full.select(F.concat(asked, F.lit(CRLF), F.when(original, got).otherwise(again), F.lit(CRLF), told).alias("value"))
    largest = pages.agg(F.max(F.octet_length(html_col))).first()[0] or 0
    per_file = max(1, min(PER_FILE, FILE_BYTES // max(largest, 1)))
    records.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.partition(":")[::2] for x in data[at:end].decode().split(CRLF)[1:])
        headers = {k.strip().lower(): v.strip() for k, v in head.items()}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size  # what stands between records is only line ends


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; ``payloads`` false leaves out the payload after its digest was taken anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        schema = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            for x in batch.column(0):
                data = x.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for h, block in parse_archive(data):
                    kind = h["warc-type"]
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    digest = block_digest(block) if kind == "response" else stated
                    if kind == "response" and stated not in (None, digest):
                        raise ValueError(f"{h['warc-record-id']}: the payload does not have its digest")
                    fields = [y.partition(": ")[::2] for y in block.decode().split(CRLF) if y] if kind == "metadata" else []
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri") or None, digest, len(block), block if payloads and kind == "response" else None, fields))
                columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, PARSED)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (or revisit) and metadata."""
    part = F.struct("record_id", "url", "digest", "bytes", "refers_to", "payload", "fields")
    answers = records.where(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), "kind", part.alias("response"))
    asked = records.where("kind = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "url", "bytes").alias("request"))
    told = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("metadata"))
    return answers.join(asked, "capture_id", "left").join(told, "capture_id", "left")


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, url) of every row, from archives written and read back."""
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col, min_bytes)
    rows = assemble(read_archives(spark, path, payloads=False))
    read = rows.select(
        F.col("metadata.fields")["pageId"].cast("long").alias("page"),
        F.col("response.bytes").alias("payload_bytes"),
        F.col("response.digest").alias("digest"),
        "kind",
        "capture_id",
        F.col("response.refers_to").alias("to"),
        F.col("response.url").alias("url"),
    )
    # a revisit's page and length are those of the response whose record it names; a response names itself
    origin = read.where("kind = 'response'").select(F.col("capture_id").alias("to"), F.col("page").alias("origin"), F.col("payload_bytes").alias("origin_bytes"))
    out = read.withColumn("to", F.coalesce("to", "capture_id")).join(origin, "to", "left")
    revisit = F.col("kind") == "revisit"
    return out.select(
        F.col("page").alias(id_col),
        F.when(revisit, F.col("origin_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, F.col("origin")).alias("refers_to"),
        "url",
    )
