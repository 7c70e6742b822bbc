from __future__ import annotations

import hashlib

import pytest

from shopledger.llm import warc

LARGE, OTHER = "<p>é</p>" * 200, "x" * 1000
PAGES = [
    (1, "http://a.com/1", LARGE), (2, "http://a.com/2", LARGE), (3, "http://a.com/3", LARGE), (4, "http://a.com/4", "small"),
    (5, "http://a.com/5", "small"), (6, None, OTHER), (7, "http://a b\n.com/\x00", OTHER), (8, "http://a.com/8", None),
    (9, "http://a.com/9", ""), (None, "http://a.com/n", LARGE), (10, "http://a.com/10", "WARC/1.0\r\n\r\n" * 300), (3, "http://a.com/3", LARGE),
    (11, "http://a.com/11", "x" * 999), (12, "http://a.com/12", "x" * 999), (13, "http://a.com/13", "long " * 400_000), (14, "日本://é", "\n\n"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, record_type string, payload int")


def expected(rows):
    found = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        first = max(same) if len(payload) >= 1000 and page_id is not None else page_id
        again = first != page_id
        found.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(found, key=str)


def test_pages_through_both_formats(spark, tmp_path):
    path = f"{tmp_path}/warc"
    found = warc.archived(table(spark, PAGES), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(PAGES)
    records = [r for f in spark.read.format("binaryFile").load(path).collect() for r in warc.warc_records(f.content)]
    infos = [(f, b) for f, b in records if f["WARC-Type"] == "warcinfo"]
    assert infos and len({f["WARC-Filename"] for f, _ in infos}) == len(infos) and len(records) == len(PAGES) + len(infos)
    assert all(b.split(b"\n")[1] in warc.NAMES.values() and "WARC-Target-URI" not in f for f, b in infos)
    ids = {f["WARC-Record-ID"]: f for f, _ in records}
    for fields, block in records:
        assert fields["WARC-Date"] == "2024-01-01T00:00:00Z" and len(block) == int(fields["Content-Length"])
        assert fields["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest()
        if fields["WARC-Type"] == "revisit":
            original = ids[fields["WARC-Refers-To"]]
            assert original["WARC-Type"] == "response" and original["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
            assert original["WARC-Page-ID"] == fields["WARC-Refers-To-Page-ID"] and block.endswith(b"\r\n\r\n")
    escaped = [f["WARC-Target-URI"] for f, _ in records if f.get("WARC-Page-ID") == "7"]
    assert escaped == ["http://a%20b%0A.com/%00"]


def test_both_versions_and_many_files(spark):
    files = [r.content for r in warc.arc_files(table(spark, PAGES).coalesce(1), file_bytes=3000).collect()]
    assert {f.split(b"\n")[1][:1] for f in files} == {b"1", b"2"}
    records = [r for f in files for r in warc.arc_records(f)]
    records = [r for r in records if not r["url"].startswith("filedesc://")]
    assert len(records) == len(PAGES) and {("checksum" in r) for r in records} == {True, False}


def test_foreign_archive(spark):
    about = b"1 0 Old\nURL IP-address Archive-date Content-type Archive-length\n"
    file = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(about) + about + b"\n"
    file += b"http://x/a b 1.2.3.4 1996092314 text/html 24\nHTTP/1.0 200 OK\r\n\r\nhello\n"
    file += b"dns:x 1.2.3.4 19960923142104 text/dns 5\n1.2.3\n\nftp://x 1.2.3.4 junk text/plain 50\ncut off"
    found = warc.converted(spark.createDataFrame([(file,), (b"",), (None,)], "content binary"))
    got = {r.url: r for r in found.collect()}
    assert got["http://x/a b"].payload == b"hello" and got["http://x/a b"].date == "1996-09-23T14:00:00Z"
    assert (got["dns:x"].record_type, got["dns:x"].payload, got["dns:x"].date) == ("resource", b"1.2.3", "1996-09-23T14:21:04Z")
    assert got["ftp://x"].truncated and got["ftp://x"].date == "1970-01-01T00:00:00Z" and len(got) == 4
    info = got["filedesc://old.arc"]
    assert (info.record_type, info.payload, info.mime, info.page_id) == ("warcinfo", about, "text/plain", None)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Whatever the number and size of the records, a file holds one record or at most the bound."""
    rows = [(i, f"http://a.com/{i}", str(i) * (40_000 if i % 50 == 0 else 300)) for i in range(100)]
    records = warc.revisits(warc.converted(warc.arc_files(table(spark, rows).coalesce(2))))
    warc.write(records, f"{tmp_path}/warc", file_bytes=20_000)
    files = [r.content for r in spark.read.format("binaryFile").load(f"{tmp_path}/warc").collect()]
    held = [list(warc.warc_records(f)) for f in files]
    assert all(len(h) == 1 or len(f) <= 20_000 + 4 * len(h) for f, h in zip(files, held)) and max(map(len, held)) > 5
    found = warc.read(spark, f"{tmp_path}/warc").where("page_id is not null")
    assert sorted((r.page_id, r.payload_bytes) for r in found.collect()) == [(i, len(h)) for i, _, h in rows]


def test_no_archive_and_empty_table(spark):
    with pytest.raises(ValueError):
        list(warc.arc_records(b"http://x 1.2.3.4 19960923142103 text/html 5\nhello"))
    with pytest.raises(ValueError):
        list(warc.arc_records(b"<html>"))
    assert warc.archived(table(spark, [])).count() == 0
