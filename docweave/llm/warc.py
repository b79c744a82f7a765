"""WARC archives: writing captures with revisits, reading them back, and transaction assembly.

A capture is a request, a response (or revisit) and a metadata record; request
and metadata name the response in ``WARC-Concurrent-To``. Spark's text writer
writes the records, whose separator is WARC's empty lines, so files are
committed as any Spark output is; the ``binaryFile`` source reads them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import materialize, shared_folder, sized_join

CRLF = "\r\n"
#: Records end with two line ends.
SEPARATOR = CRLF * 2


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of ``data``: five hexadecimal digits give four of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(kind: Column | str, rid: Column, headers: dict[str, Column], content_type: str, block: Column) -> Column:
    """The text of a record; headers that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), rid)]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers.items()]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(SEPARATOR), block)


def plan_revisits(pages: DataFrame, min_bytes: int = 0, *keep: str) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, bytes, digest, and the first capture (first_id, first_url) of its payload if it revisits one, and the columns ``keep``.

    Of equal payloads of at least ``min_bytes``, the rows with the smallest
    page_id are responses and the others revisit them; null ids come last, and
    if all are null, all are responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", " ")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), *keep)
    base = base.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    firsts = (
        base.where(F.col("bytes") >= min_bytes).select("page_id", "url", "digest").groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
        .where("n > 1 AND first IS NOT NULL").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    joined = sized_join(base, firsts, "digest", "left", 200_000)
    revisit = (F.col("first_id") != F.coalesce(F.col("page_id"), F.col("first_id") - 1)) & (F.col("bytes") >= min_bytes)
    return joined.select("page_id", "url", "payload", "bytes", "digest", *keep, *[F.when(revisit, F.col(c)).alias(c) for c in ("first_id", "first_url")])


#: Octets that a capture's headers have, about.
HEADERS = 2000


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", octets_per_file: int = 64 << 20) -> None:
    """Write a capture of three records per row of ``pages`` as ``.gz`` archives into ``folder``, each headed by a ``warcinfo`` record.

    Null and empty pages have an empty payload. Record ids follow from the
    page's id, url and payload, so a task that runs again writes the same. An
    archive ends with the capture with which its records pass
    ``octets_per_file``, as read: it is a row to the reader.
    """
    p = plan_revisits(pages.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), min_bytes, "_part", "_row")
    rows_of = Window.partitionBy("_part").orderBy("_row")
    before = F.coalesce(F.sum(F.when(F.col("first_id").isNull(), F.col("bytes")).otherwise(0) + HEADERS).over(rows_of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("archive", F.concat_ws("-", F.lpad(F.col("_part").cast("string"), 6, "0"), F.lpad(F.floor(before / octets_per_file).cast("string"), 6, "0")))
    p = p.withColumn("heads", ~F.col("archive").eqNullSafe(F.lag("archive").over(rows_of)))
    rid = _urn(F.lit("response"), F.col("page_id"), F.col("url"), F.col("digest"))
    refers = F.when(F.col("first_id").isNotNull(), _urn(F.lit("response"), F.col("first_id"), F.col("first_url"), F.col("digest")))
    revisit = F.col("first_id").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    common = {"WARC-Target-URI": F.col("url"), "WARC-Date": F.lit(date)}
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(SEPARATOR))
    response = _record(
        kind, rid,
        common | {"WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")), "WARC-Refers-To": refers,
                  "WARC-Profile": F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")},
        "application/http; msgtype=response", F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    with_response = {"WARC-Concurrent-To": rid}
    host, path = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*([^#]*)", 1)
    request = _record(
        "request", _urn(F.lit("request"), F.col("page_id"), F.col("url"), F.col("digest")), common | with_response, "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(SEPARATOR)),
    )
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record("metadata", _urn(F.lit("metadata"), F.col("page_id"), F.col("url"), F.col("digest")), common | with_response, "application/warc-fields", fields)
    about = _record("warcinfo", _urn(F.lit("warcinfo"), F.col("archive")), {"WARC-Date": F.lit(date), "WARC-Filename": F.concat("archive", F.lit(".warc.gz"))}, "application/warc-fields", F.lit(f"format: WARC File Format 1.1{CRLF}"))
    records = F.array_compact(F.array(F.when(F.col("heads"), about), request, response, metadata))
    rows = p.select("archive", "_row", F.posexplode(records).alias("_at", "value")).sortWithinPartitions("archive", "_row", "_at")
    rows.select("archive", "value").write.partitionBy("archive").option("lineSep", SEPARATOR).option("compression", "gzip").text(folder)


RECORD = "kind string, record_id string, concurrent_to string, refers_to string, uri string, date string, digest string, bytes long, true_digest string, fields string, payload binary"
_TYPES = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.string(), pa.binary()]


def _headers(f) -> dict[str, str]:
    """Header lines up to the empty one, names in lower case."""
    out = {}
    while (line := f.readline().rstrip(b"\r\n")):
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").lower()] = value.decode("utf-8", "replace").strip()
    return out


def parse_records(data: bytes) -> Iterator[tuple]:
    """The records of an archive, in the order of ``RECORD``; of responses with payload, its size and digest as read."""
    raw = io.BytesIO(data)
    f = gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw
    while line := f.readline():
        if not line.strip():
            continue
        h = _headers(f)
        block = f.read(int(h["content-length"]))
        kind, payload, size, true, fields = h.get("warc-type"), None, None, None, None
        if kind in ("response", "revisit"):
            b = io.BytesIO(block)
            b.readline()
            http = _headers(b)
            payload = b.read()
            size = len(payload) if kind == "response" else int(http.get("content-length", 0))
            true = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
        elif kind in ("metadata", "request"):
            fields = block.decode("utf-8", "replace")
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        yield kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, size, true, fields, payload


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in ``folder``, as in ``RECORD``; payloads are null unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), _TYPES)], names=names)
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_records(content.as_py()):
                    rows.append(r if with_payload else (*r[:-1], None))
                    size += len(r[-1] or b"") if with_payload else 0
                    if len(rows) == 5000 or size > 1 << 23:
                        yield make(rows)
                        rows, size = [], 0
                yield make(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, its request and its metadata, joined through concurrent-to ids.

    Captures without a request or metadata have nulls there; records whose
    response is missing give none. Archives that hold the same capture several
    times give it as often: equal records stand for each other.
    """
    own = F.col("kind").isin("response", "revisit")
    pick = lambda what, *cols: F.first(F.when(what, F.struct(*cols)), ignorenulls=True)
    http, request, meta = F.struct("kind", "record_id", "refers_to", "uri", "date", "digest", "true_digest", "bytes", "payload"), F.col("kind") == "request", F.col("kind") == "metadata"
    grouped = (
        records.withColumn("capture", F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to"))).where("capture IS NOT NULL")
        .groupBy("capture").agg(
            F.count(F.when(own, 1)).cast("int").alias("times"),
            F.first(F.when(own, http), ignorenulls=True).alias("response"),
            pick(request, F.col("record_id"), F.col("fields").alias("head")).alias("request"),
            pick(meta, F.col("record_id"), F.str_to_map(F.col("fields"), F.lit("\r\n"), F.lit(": ")).alias("fields")).alias("metadata"),
        )
    )
    return grouped.where("response IS NOT NULL").select(F.explode(F.array_repeat(F.lit(1), F.col("times"))), "capture", "response", "request", "metadata").drop("col")


def captures(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return per row: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the payload as read. A revisit's
    are those it declares; ``refers_to`` is the page of the record it names.
    Archives stay only where a ``folder`` is given.
    """
    spark = pages.sparkSession
    archives = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, archives, min_bytes, **options)
    flat = assemble(read_records(spark, archives, with_payload=False)).select(
        "capture", F.col("metadata.fields")["pageId"].alias("page"), F.col("response.kind").alias("record_type"), "response.refers_to",
        F.col("response.bytes").alias("payload_bytes"), F.coalesce("response.true_digest", "response.digest").alias("payload_digest"),
    )
    flat = materialize(flat.withColumn("page_id", F.expr("try_cast(nullif(page, '') AS BIGINT)")).drop("page"), "captures")
    if folder is None:
        where = spark._jvm.org.apache.hadoop.fs.Path(archives)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    named = flat.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("capture")).distinct()
    targets = flat.join(named, "capture", "left_semi").groupBy(F.col("capture").alias("refers_to")).agg(F.min("page_id").alias("target"))
    revisits = sized_join(flat.where("refers_to IS NOT NULL"), targets, "refers_to", "left", 200_000)
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return flat.where("refers_to IS NULL").select(*out, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*out, F.col("target").alias("refers_to")))
