"""Writing pages as WARC 1.1 archives and assembling captures from them.

Every page gives a response (or revisit), a request and a metadata record; the
latter two name the first in ``WARC-Concurrent-To``. A task renders archives
of about ``archive_bytes`` each, a warcinfo record first, and Spark's text
writer puts every one into a gzip file of its own in the shared folder, so
they may lie in any store Spark writes to. (That writer makes one gzip member
a file, not one a record.) Reading takes each archive whole, steps through it
by ``Content-Length``, joins the three kinds of record through their
concurrent-to identifiers, and emits one nested row per capture.

Of pages with equal payloads of at least ``min_bytes`` the one with the
smallest id is kept as response, and the others revisit it. Who revisits whom
is decided on ids and digests alone. A record's id follows from its page's
id, address and digest, so a task that runs again gives the same records.
Pages with the same id and payload are all responses; rows alike in all three
are written once each, numbered. A null id sorts last and comes back null; a
null page is an empty payload; a null address leaves its header out, and
characters that would end a header line are percent-encoded, in ids too. A
page longer than ``archive_bytes`` has an archive of its own. An empty table
gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import cleaning, drop_staged, rebatched, shared_dir, staged, struct_of

MIN_BYTES = 0
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f0c7d1e-5d0b-4c1c-9d55-0d3c1c0f1a77")
END = "\r\n\r\n"


def _header(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: str) -> str:
    size = len(block.encode())
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {size}"]
    return "\r\n".join(lines) + END + block


def _clean(url: str | None) -> str | None:
    """The address fit for one header line; what would break it is percent-encoded."""
    if url is None:
        return None
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, repr(parts))}>"


def archive_head(name: str) -> str:
    """The record that says what an archive is."""
    return _header("warcinfo", _record_id("archive", name), [("Content-Type", "application/warc-fields")], "software: siteloom\r\nformat: WARC File Format 1.1\r\n")


def records_of(page_id: object, url: str | None, html: str | None, size: int, digest: str, number: int, first: tuple | None) -> list[str]:
    """The three records of a page; ``first`` names the response it revisits (id, address), if it does, and then ``html`` is not needed."""
    own, where = _record_id("capture", page_id, url, digest, number), _clean(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"
    common = [("WARC-Target-URI", where), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        main = _header("response", own, common, http + html)
    else:
        main = _header("revisit", own, [*common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id("capture", *first, digest, 0))], http)
    try:
        parts = urlsplit(where or "")
        path, host = (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), parts.netloc
    except ValueError:
        path, host = "/", ""
    request = _header("request", _record_id("request", own), [("WARC-Target-URI", where), ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], f"GET {path} HTTP/1.1\r\nHost: {host}{END}")
    field = "" if page_id is None else f"page-id: {quote(str(page_id), safe='')}\r\n"
    about = _header("metadata", _record_id("metadata", own), [("WARC-Target-URI", where), ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], field)
    return [request, main, about]


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages' records below ``path``."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    slim = staged(rows.select("page_id", "url", "digest", F.octet_length("html").alias("size")))
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), F.col("page_id").alias("id"), F.col("url").alias("url"))
    equal = slim.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    alike = slim.groupBy("page_id", "url", "digest").agg(F.count("*").alias("times"))
    marked = alike.join(equal, "digest", "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.id"))
    # What is not simply a response, alone of its kind: few rows of a usual crawl, so that the pages need not move.
    special = marked.where(revisits | (F.col("times") > 1)).select(F.col("page_id").alias("of_id"), F.col("url").alias("of_url"), F.col("digest").alias("of_digest"), "times", F.when(revisits, F.col("first")).alias("first"))
    special = staged(special)
    joined = rows.join(special, F.col("page_id").eqNullSafe(F.col("of_id")) & F.col("url").eqNullSafe(F.col("of_url")) & (F.col("digest") == F.col("of_digest")), "left")
    once = joined.where("times IS NULL OR times = 1")
    if special.where("times > 1").take(1):
        once = once.unionByName(joined.where("times > 1").dropDuplicates(["page_id", "url", "digest"]))
    known = F.col("first").isNotNull()
    ready = once.select("page_id", "url", F.when(~known, F.col("html")).alias("html"), F.octet_length("html").alias("size"), "digest", F.coalesce("times", F.lit(1)).alias("times"), known.alias("known"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rebatched(batches, 8 << 20):
            for page_id, where, text, length, hexed, times, revisit, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                for number in range(times):
                    found = records_of(page_id, where, text, length, digest, number, (first_id, first_url) if revisit else None)
                    new = sum(len(x.encode()) + len(END) for x in found)
                    if held and size + new > archive_bytes:
                        yield _archive(held)
                        held, size = [], 0
                    held += found
                    size += new
        if held:
            yield _archive(held)

    with cleaning(pages.sparkSession):
        ready.mapInArrow(render, "value string").write.option("lineSep", END).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    drop_staged(slim, special)


def _archive(records: list[str]) -> pa.RecordBatch:
    """One row: the text of a whole archive but for its last line ends."""
    name = hashlib.sha256(records[0].encode()).hexdigest()
    return pa.RecordBatch.from_arrays([pa.array([END.join([archive_head(name), *records])], pa.string())], names=["value"])


def _plain(data: bytes) -> bytes:
    """An archive's records, whether it is compressed, in one member or many, or not."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``; the digest is that of the payload as read."""
    text = T.StringType()
    schema = struct_of(kind=text, record_id=text, concurrent_to=text, refers_to=text, url=text, declared_digest=text, payload_bytes=T.LongType(), payload_digest=text, fields=text, **({"payload": T.BinaryType()} if with_payload else {}))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse(_plain(content.as_buffer().to_pybytes())):
                    kind = h.get("warc-type")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    row = [kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None]
                    row += [None, None] if payload is None else [len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()]
                    row.append(block.decode() if kind == "metadata" else None)
                    rows.append(row + ([payload] if with_payload else []))
                if not rows:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(schema.names, zip(*rows, strict=True), strict=True)], names=schema.names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(take, schema)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, and its response, request and metadata.

    A request or metadata record belongs to the response or revisit it names;
    a metadata record may also name the capture's request. Of several, the one
    with the least record id counts.
    """
    main = records.where("kind IN ('response', 'revisit')")
    requests = records.where("kind = 'request'")
    about = records.where("kind = 'metadata'")
    via = requests.select(F.col("record_id").alias("via_id"), F.col("concurrent_to").alias("via_to"))
    about = about.join(via, about["concurrent_to"] == via["via_id"], "left").withColumn("concurrent_to", F.coalesce("via_to", "concurrent_to"))

    def least(kind: DataFrame, name: str) -> DataFrame:
        found = F.min(F.struct("record_id", "url", "fields"))
        return kind.where("concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("capture_id")).agg(found.alias(name))

    nested = main.select(F.col("record_id").alias("capture_id"), F.struct(*[F.col(c) for c in main.columns]).alias("response"))
    return nested.join(least(requests, "request"), "capture_id", "left").join(least(about, "metadata"), "capture_id", "left")


def round_trip(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages``, read them back, and say what became of each page."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/siteloom/{uuid.uuid4().hex}/warc"
    id_type = pages.schema[id_column].dataType
    write_archives(pages, path, id_column, url, html, min_bytes)
    field = F.col("metadata.fields")
    number = F.when(field.rlike(r"(?m)^page-id: "), F.url_decode(F.regexp_extract(field, r"page-id: (.*?)\r\n", 1))).cast(id_type)
    records = staged(read_records(spark, path))
    found = staged(captures(records).select("capture_id", number.alias("page_id"), F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("refers_to_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.coalesce("response.url", "request.url").alias("url")))
    drop_staged(records)
    first = found.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    whole = found.join(first, "refers_to_id", "left")
    return whole.select(F.col("page_id").alias(id_column), F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "first_digest").alias("payload_digest"), "record_type", "refers_to")
