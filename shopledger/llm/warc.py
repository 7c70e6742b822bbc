"""Legacy archive converter: ARC files of either version to WARC records, and back from WARC files.

An ARC record is a header line, whose fields depend on the file's version, and as many bytes as the line declares.
The converter reads them off, gives each record a WARC identifier, timestamp, type and digests that follow from its
content alone, and records an equal large payload only once; the version block of a file becomes a ``warcinfo``
record. WARC files are written by Spark's text writer, one line of several records each, whose line separator is the
end of a record, so they land in any store Spark can write to.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_path, small

#: Fields of a header line by version of the file; URLs come first and may hold blanks.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
NAMES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: The archive date of pages, which have none of their own.
PAGE_DATE = "20240101000000"
RECORDS = "page_id bigint, url string, ip string, date string, mime string, record_type string, truncated boolean, head binary, payload binary, payload_bytes bigint, payload_digest string"


def arc_date(text: str) -> str:
    """The WARC form of an ARC date of 8 to 14 digits; the epoch where it is no date."""
    digits = text + "00000000000000"[len(text):] if text.isascii() and text.isdigit() and 8 <= len(text) <= 14 else ""
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def arc_records(content: bytes) -> Iterator[dict]:
    """The records of an ARC file, its version block first, as the fields of their lines and ``block``."""
    version, at = None, 0
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].rstrip(b"\r").decode("utf-8", "replace")
        names = FIELDS[1 if version is None else version]
        values = line.rsplit(" ", len(names) - 1)
        if end < 0 or len(values) < len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {line[:80]!r}")
        fields = dict(zip(names, values))
        size = int(fields["length"])
        block = content[end + 1 : end + 1 + size]
        at = end + 1 + size
        if version is None:
            if not fields["url"].startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
        yield fields | {"block": block, "truncated": len(block) < size}


def header_value(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


def arc_files(pages: DataFrame, file_bytes: int = 8 << 20) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ``html``) as ARC files: one binary column ``content``, versions in turn.

    Files are closed at about ``file_bytes``. A null html is an empty payload; a null URL is written as ``-``; bytes
    that would break a header line are escaped. A null ``page_id`` is left out of the record.
    """

    def file(number: int, parts: list[bytes], version: int) -> bytes:
        about = b"%d 0 pages\n%s\n" % (version, NAMES[version])
        head = f"filedesc://pages-{TaskContext.get().partitionId()}-{number}.arc 0.0.0.0 {PAGE_DATE} text/plain"
        head += " 200 - - 0 pages.arc" * (version == 2)
        return head.encode() + b" %d\n" % len(about) + about + b"\n" + b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, number = [], 0, 0

        def close() -> pa.RecordBatch:
            content = file(number, parts, 1 + number % 2)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        for batch in batches:
            for page_id, url, html in zip(*[c for c in batch.columns]):
                page_id, url, payload = page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass")
                clean = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url or "") or "-"
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload)
                if page_id is not None:
                    head += b"\r\nX-Page-Id: %d" % page_id
                block = head + END + payload
                line = f"{clean} 0.0.0.0 {PAGE_DATE} text/html" + f" 200 - - {size} pages.arc" * (number % 2)
                parts.append(line.encode("utf-8", "surrogatepass") + b" %d\n" % len(block) + block + b"\n")
                size += len(parts[-1])
                if size >= file_bytes:
                    yield close()
                    size, number = 0, number + 1
        if parts:
            yield close()

    columns = [F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")]
    return pages.select(*columns).mapInArrow(run, "content binary")


def converted(files: DataFrame) -> DataFrame:
    """The records of ARC files (binary ``content``), one row each, with what their WARC records need.

    The version block is a ``warcinfo``; a block that begins as an HTTP message is a ``response`` of head and payload;
    anything else a ``resource``. A
    block shorter than declared is kept and marked truncated. An empty or null file has no records; a file that is
    no ARC file raises ``ValueError``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in RECORDS.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            first, *others = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), *map(pa.array, others)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for i, r in enumerate(arc_records(content.as_py() or b"")):
                    http = i > 0 and r["block"].startswith(b"HTTP/")
                    head, _, payload = r["block"].partition(END) if http else (b"", b"", r["block"])
                    page = header_value(head, b"X-Page-Id")
                    rows.append((
                        int(page) if page else None, r["url"], r["ip"], arc_date(r["date"]), r["mime"],
                        "response" if http else "resource" if i else "warcinfo", r["truncated"], head, payload, len(payload),
                        hashlib.sha1(payload).hexdigest(),
                    ))
                    size += len(payload)
                    if size >= 4 << 20:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    return files.select("content").mapInArrow(run, RECORDS)


def revisits(records: DataFrame, smallest: int = 1000, broadcast_rows: int = 500_000) -> DataFrame:
    """Marks all but one of the responses with an equal payload of at least ``smallest`` bytes as revisits.

    The one with the largest ``page_id`` stays (all rows that share that id); others get ``refers_to``. Records
    without ``page_id`` stay responses.
    """
    large = (F.col("payload_bytes") >= smallest) & F.col("page_id").isNotNull() & (F.col("record_type") == "response")
    kept = records.where(large).groupBy("payload_digest").agg(
        F.max("page_id").alias("_first"), F.min("page_id").alias("_other")
    ).where("_first <> _other").select(F.col("payload_digest").alias("_digest"), "_first")
    joined = records.join(small(kept, broadcast_rows), large & (F.col("payload_digest") == F.col("_digest")), "left")
    other = F.col("_first").isNotNull() & (F.col("page_id") != F.col("_first"))
    return joined.withColumn("record_type", F.when(other, "revisit").otherwise(F.col("record_type"))).withColumn(
        "refers_to", F.when(other, F.col("_first"))
    ).drop("_digest", "_first")


def record_id(page_id: int | None, url: str, digest: str) -> str:
    """An identifier that depends on the record alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}' if page_id is not None else f'{url} {digest}')}>"


def write(records: DataFrame, path: str, file_bytes: int = 16 << 20) -> None:
    """Write records as WARC files under ``path``; revisits carry the head of their message and no payload.

    A file is closed before the record that would take it over ``file_bytes``; a larger record is a file by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def file() -> pa.RecordBatch:
            content = END.join(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["records"])

        for batch in batches:
            for r in batch.to_pylist():
                http, again = r["record_type"] in ("response", "revisit"), r["record_type"] == "revisit"
                about = r["record_type"] == "warcinfo"
                block = (r["head"] + END if http else b"") + (b"" if again else r["payload"])
                fields = [
                    ("WARC-Type", r["record_type"]), ("WARC-Record-ID", record_id(r["page_id"], r["url"], r["payload_digest"])),
                    ("WARC-Date", r["date"]),
                    *([("WARC-Filename", r["url"])] if about else [("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"])]),
                    ("WARC-Block-Digest", "sha1:" + hashlib.sha1(block).hexdigest()),
                    ("WARC-Payload-Digest", "sha1:" + r["payload_digest"]),
                ]
                if r["page_id"] is not None:
                    fields.append(("WARC-Page-ID", r["page_id"]))
                if r["truncated"]:
                    fields.append(("WARC-Truncated", "length"))
                if again:
                    fields += [
                        ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To-Page-ID", r["refers_to"]),
                        ("WARC-Refers-To", record_id(r["refers_to"], "", r["payload_digest"])),
                    ]
                fields += [
                    ("Content-Type", "application/http; msgtype=response" if http else r["mime"]), ("Content-Length", len(block)),
                ]
                head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
                record = head.encode("utf-8", "surrogatepass") + block
                if held and size + len(record) > file_bytes:
                    yield file()
                    size = 0
                held.append(record)
                size += len(record)
        if held:
            yield file()

    files = records.mapInArrow(run, "records binary").select(F.col("records").cast("string").alias("value"))
    files.write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file."""
    at = 0
    while at < len(content):
        end = content.index(END, at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + len(END)
        size = int(fields["Content-Length"])
        yield fields, content[start : start + size]
        at = start + size + len(END)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under ``path``: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to``.

    Length and digest of a payload are taken from the bytes where the record has them; those of a revisit from its
    headers. The ``url`` of a ``warcinfo`` is its file's name. A digest that does not fit its payload raises ``ValueError``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_records(content.as_py()):
                    head, _, payload = block.partition(END) if "http" in fields["Content-Type"] else (b"", b"", block)
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), len(payload)
                    if fields["WARC-Type"] == "revisit":
                        size = int(header_value(head, b"Content-Length"))
                    elif hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                    number = lambda name: int(fields[name]) if name in fields else None
                    rows.append((
                        number("WARC-Page-ID"), fields.get("WARC-Target-URI", fields.get("WARC-Filename")), fields["WARC-Type"], size, digest,
                        number("WARC-Refers-To-Page-ID"),
                    ))
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), *map(pa.array, c[1:5]), pa.array(c[5], pa.int64())],
                        ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"],
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
    return files.mapInArrow(run, schema)


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """``pages`` taken through ARC files, the converter and WARC files, as ``read`` finds them again, ``warcinfo`` left out.

    Rows with equal ids are separate records; of equal payloads all rows with the largest id are responses. An empty
    table gives no rows.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(revisits(converted(arc_files(pages))), path)
    return read(spark, path).where("record_type <> 'warcinfo'")
