import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from almanack.llm import warc

COPY = "<p>" + "copied " * 300 + "</p>"
PAGES = [
    (1, "http://a.example/", COPY), (5, "http://b.example/x y\r\n", COPY), (3, None, COPY), (None, "http://n.example/", COPY),
    (2, "http://c.example/", "short"), (4, "http://d.example/", "short"), (6, "http://e.example/", None), (7, "http://f.example/", ""),
    (8, "http://g.example/", "ü\r\n\r\n🎉" * 5000), (9, "http://h.example/", "x" * 1000), (10, "http://h.example/", "x" * 999), (9, "http://h.example/", "x" * 1000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int").repartition(3)


def wanted():
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = max((j for j, _, g in PAGES if (g or "") == (h or "") and j is not None), default=None)
        revisit = len(b) >= 1000 and first is not None and i != first
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk, most", [(100, 500), (1 << 18, 1 << 28)])
def test_round_trip(pages, chunk, most):
    manifest = warc.write_archives(pages, chunk=chunk, most=most)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    if most == 500:
        assert manifest.count() > 3
    records = warc.read_records(manifest, chunk=chunk)
    rows = records.collect()
    assert all(len(r.data) <= chunk for r in rows)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows if r.last), key=str) == wanted()
    bodies = {}
    for r in sorted(rows, key=lambda r: (r.archive, r.record, r.chunk)):
        bodies.setdefault((r.archive, r.record, r.page_id, r.record_type), []).append(bytes(r.data))
    texts = sorted(b"".join(v) for k, v in bodies.items() if k[3] == "response")
    want = sorted((h or "").encode() for (i, _, h), w in zip(sorted(PAGES, key=lambda p: str((p[0], len((p[2] or "").encode())))), wanted()) if w[3] == "response")
    assert sorted(map(len, texts)) == sorted(map(len, want))
    few = warc.read_records(manifest, data=False)
    assert few.count() == len(PAGES) and few.where("data is not null").count() == 0


def test_archives_are_plain_warc(pages):
    manifest = warc.write_archives(pages.where("page_id = 8"))
    files, path = warc._open(manifest.first().archive)
    with files.open_input_stream(path, compression=None) as f:
        data = gzip.decompress(f.read())
    head, http, body = data.split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and http.startswith(b"HTTP/1.1 200 OK")
    assert body == PAGES[8][2].encode() + b"\r\n\r\n"
    assert f"Content-Length: {len(http) + 4 + len(body) - 4}".encode() in head


def test_broken_archive(pages):
    manifest = warc.write_archives(pages.where("page_id = 8"))
    uri = manifest.first().archive
    files, path = warc._open(uri)
    with files.open_input_stream(path, compression=None) as f:
        data = f.read()
    with files.open_output_stream(path, compression=None) as f:
        f.write(data[: len(data) // 2])
    with pytest.raises(Exception):
        list(warc.read_archive(uri))


def test_many_groups_of_copies(pages, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    got = warc.typed_pages(pages).select("page_id", "size", "digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == wanted()


def test_empty(pages):
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0
