"""WARC archives: write, read, and revisit resolution.

Archives are written by Spark's own text writer with CR LF CR LF as the record separator,
which is how WARC ends a record. So any file system that Spark knows can hold them, the
commit protocol makes retried tasks harmless, and no executor needs a local file. Each file is one gzip stream.
Reading goes by ``Content-Length``, never by the separator, since payloads may hold it.

Revisit resolution shuffles headers by payload digest (``max(page_id)`` combines before
the shuffle, so a digest of a third of all rows costs one row a task), joins each record
to the original response of its digest and writes archives with fresh headers; a revisit
record carries no payload. The join is a sort-merge join that Spark can split by itself when
a digest is hot.

Defined cases: a null payload is an empty one; a null page_id is smaller than any other;
rows that share both the payload and the largest page_id are all responses; an empty table
gives no records; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import gzip

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.session import work_path

SEPARATOR = "\r\n\r\n"
#: The digits of base 32 as Spark's conv() writes them, and the alphabet of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def headers(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest) of each row."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        base32_sha1(body.cast("binary")).alias("payload_digest"),
    )


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add record_type and refers_to: of equal payloads the one with the largest page_id stays a response."""
    big = F.col("payload_bytes") >= min_bytes
    originals = (
        records.where(big)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select(F.col("payload_digest").alias("o_digest"), F.col("payload_bytes").alias("o_bytes"), "original")
    )
    joined = records.join(
        originals, (F.col("payload_digest") == F.col("o_digest")) & (F.col("payload_bytes") == F.col("o_bytes")) & big, "left"
    )
    revisit = F.col("o_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select(
        *records.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def record_text(record: DataFrame) -> DataFrame:
    """Each resolved record as WARC text, without its final separator; fresh headers throughout."""
    uri = F.regexp_replace("url", r"[\r\n]+", " ")
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    block = F.concat(F.lit(_HTTP), body)

    def urn(page_id: Column) -> Column:
        name = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("null")), "payload_digest"))
        parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))

    revisit = F.col("record_type") == "revisit"
    head = [
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", uri),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id"))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.when(revisit & F.col("refers_to").isNotNull(), line("X-Refers-To-Page-Id", F.col("refers_to"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
    ]
    return record.select(F.concat(*head, F.lit(SEPARATOR), block).alias("value"))


def write_archives(resolved: DataFrame, path: str, records_per_file: int = 2000) -> None:
    """Write resolved records as ``*.txt.gz`` WARC files; a file holds at most ``records_per_file`` records."""
    (
        record_text(resolved)
        .write.option("lineSep", SEPARATOR)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, plain or gzip with one or many members."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, end = 0, len(content)
    while at < end:
        stop = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for row in content[at:stop].split(b"\r\n")[1:]:
            name, _, value = row.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        size = int(fields["content-length"])
        block = content[stop + 4 : stop + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is cut short")
        at = stop + 4 + size + 4
        revisit = fields["warc-type"] == "revisit"
        whole = lambda key: int(fields[key]) if key in fields else None
        yield {
            "page_id": whole("x-page-id"),
            "url": fields.get("warc-target-uri", ""),
            "record_type": fields["warc-type"],
            "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2],
            "payload_bytes": whole("x-payload-length"),
            "refers_to": whole("x-refers-to-page-id"),
            "payload": None if revisit else block.partition(b"\r\n\r\n")[2],
        }


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for content in batch.column(0):
            held, size = [], 0
            for record in parse_archive(content.as_py()):
                held.append(record)
                size += len(record["payload"] or b"")
                if size > 4 << 20 or len(held) >= 2000:
                    yield pa.RecordBatch.from_pylist(held, kinds)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, kinds)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``; a file is parsed whole by one task, so files should stay bounded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_parse_batches, RECORD_SCHEMA)


def rewrite_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Read archives, resolve their revisits anew and write deduplicated archives with fresh headers.

    Earlier revisit records regain the payload of the response that they refer to by digest.
    """
    read = read_archives(spark, source)
    kept = read.where("record_type = 'response'").select("payload_digest", "payload_bytes", "payload")
    bodies = kept.groupBy("payload_digest", "payload_bytes").agg(F.first("payload").alias("payload"))
    records = read.drop("payload", "record_type", "refers_to").join(bodies, ["payload_digest", "payload_bytes"], "left")
    write_archives(resolve_revisits(records.withColumn("payload", F.coalesce(F.col("payload").cast("string"), F.lit(""))), min_bytes), target)


def archive_pages(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Archive every page with revisits resolved and return what is read back from the archives."""
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    write_archives(resolve_revisits(headers(pages), min_bytes), path)
    return read_archives(spark, path)
