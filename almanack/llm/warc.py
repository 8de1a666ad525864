"""WARC archives written from and read into a chunked record table.

A payload is a run of rows (record, chunk number, bytes) of at most ``CHUNK`` bytes. The writer
streams them into gzip members, one member a record, the reader streams members back into such
rows; both carry the SHA-1 from chunk to chunk and hold no record as a whole.

A writer task names its files after its own attempt and reports them in the manifest only once
they are closed. The manifest is a settled table, so files of lost or repeated attempts are
never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import settle
from almanack.session import shared_path

CHUNK = 1 << 18
#: Payloads of fewer bytes are always written out.
LEAST_REVISIT = 1000
#: An archive that has reached this size is closed.
ARCHIVE = 256 << 20
#: Groups of copies above which their table is joined by a shuffle, not broadcast.
MOST_BROADCAST = 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long"
RECORDS = (
    "archive string, record long, chunk long, last boolean, page_id long, url string, record_type string, "
    "refers_to long, data binary, payload_bytes long, payload_digest string"
)


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


# ---- records --------------------------------------------------------------------------------


def typed_pages(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, size, digest, record_type, refers_to`` of every row.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest ``page_id``
    is the response and the others revisit it. Rows that repeat that id with that payload are
    responses too; without any id in the group so are all of them.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    copies = settle(
        rows.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    few = copies.count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(copies) if few else copies, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("first"))).withColumn(
        "record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    ).drop("first")


def chunk_rows(typed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records as rows of at most ``chunk`` bytes; a revisit, and an empty payload, is one empty row."""
    held = F.when(F.col("record_type") == "response", F.col("size")).otherwise(F.lit(0))
    parts = F.greatest(F.ceil(held / chunk), F.lit(1)).cast("long")
    return (
        typed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .withColumn("last", F.col("chunk") == parts - 1)
        .withColumn("data", F.when(F.col("record_type") == "response", F.expr(f"substring(payload, CAST(chunk * {chunk} AS INT) + 1, {chunk})")).otherwise(F.unhex(F.lit(""))))
        .drop("payload")
    )


# ---- writing --------------------------------------------------------------------------------


def _record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _head(r: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['size']}\r\n\r\n".encode()
    response = r["record_type"] == "response"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {r['record_type']}",
        f"WARC-Record-ID: {_record_id(r['page_id'], r['digest'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(r['url'] or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(r["digest"])).decode(),
        "Content-Type: application/http; msgtype=response",
    ]
    if r["page_id"] is not None:
        lines.append(f"X-Page-ID: {r['page_id']}")
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(r['refers_to'], r['digest'])}", f"X-Refers-To-Page-ID: {r['refers_to']}"]
    lines.append(f"Content-Length: {len(http) + (r['size'] if response else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class _Archive:
    def __init__(self, uri: str):
        self.uri, self.records, self.bytes = uri, 0, 0
        files, path = _open(uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = files.open_output_stream(path, compression=None)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.records, self.bytes


def _writer(folder: str, most: int):
    def run(batches):
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}"
        done: list[tuple[str, int, int]] = []
        archive = gz = digest = None
        for batch in batches:
            for r in batch.to_pylist():
                if archive is None:
                    archive = _Archive(f"{name}-{len(done):04d}.warc.gz")
                if r["chunk"] == 0:
                    gz, digest = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                    archive.put(gz.compress(_head(r)))
                digest.update(r["data"])
                archive.put(gz.compress(r["data"]))
                if r["last"]:
                    archive.put(gz.compress(b"\r\n\r\n") + gz.flush())
                    archive.records += 1
                    if r["record_type"] == "response" and digest.hexdigest() != r["digest"]:
                        raise ValueError(f"chunks of page {r['page_id']} are not its payload")
                    if archive.bytes >= most:
                        done.append(archive.close())
                        archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, chunk: int = CHUNK, most: int = ARCHIVE) -> DataFrame:
    """Write one record per row of ``pages`` and return the manifest of closed archives."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    chunks = chunk_rows(typed_pages(pages, least), chunk)
    rows = chunks.select("page_id", "url", "size", "digest", "record_type", "refers_to", "chunk", "last", "data")
    return settle(rows.mapInArrow(_writer(folder, most), MANIFEST))


# ---- reading --------------------------------------------------------------------------------


def _inflated(files: pyarrow.fs.FileSystem, path: str) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether a gzip member ends with them), in portions of bounded size."""
    with files.open_input_stream(path, compression=None) as stream:
        gz, left, inside = zlib.decompressobj(31), b"", False
        while True:
            raw = left or stream.read(1 << 16)
            if not raw:
                if inside:
                    raise EOFError(f"{path} ends inside a record")
                return
            data = gz.decompress(raw, 1 << 18)
            left = gz.unconsumed_tail or gz.unused_data
            inside = not gz.eof
            yield data, gz.eof
            if gz.eof:
                gz = zlib.decompressobj(31)


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in block.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().lower().decode(): v.strip().decode() for k, v in pairs}


def read_archive(uri: str, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one archive; the last of a record carries its length and SHA-1."""
    files, path = _open(uri)
    record, held, state = -1, b"", "head"
    for data, ends in _inflated(files, path):
        held += data
        if state == "head" and held.count(b"\r\n\r\n") >= 2:
            head, http, held = held.split(b"\r\n\r\n", 2)
            warc, page = _fields(head), _fields(http)
            record, number, digest, size = record + 1, 0, hashlib.sha1(), 0
            todo = int(warc["content-length"]) - len(http) - 4
            row = {
                "archive": uri, "record": record, "page_id": int(warc["x-page-id"]) if "x-page-id" in warc else None,
                "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"],
                "refers_to": int(warc["x-refers-to-page-id"]) if "x-refers-to-page-id" in warc else None,
            }
            state = "body"
        while state == "body" and (todo > chunk and len(held) >= chunk or todo <= chunk and len(held) >= todo):
            part, held = held[: min(chunk, todo)], held[min(chunk, todo) :]
            todo -= len(part)
            size += len(part)
            digest.update(part)
            out = row | {"chunk": number, "last": todo == 0, "data": part, "payload_bytes": None, "payload_digest": None}
            number += 1
            if todo == 0:
                stated = base64.b32decode(warc["warc-payload-digest"].split(":")[1]).hex()
                if row["record_type"] == "response" and stated != digest.hexdigest():
                    raise ValueError(f"record {record} of {uri} differs from its digest")
                response = row["record_type"] == "response"
                out |= {"payload_bytes": size if response else int(page["content-length"]), "payload_digest": digest.hexdigest() if response else stated}
                state = "tail"
            yield out
        if ends:
            if state != "tail" or held != b"\r\n\r\n":
                raise ValueError(f"record {record} of {uri} is broken")
            held, state = b"", "head"


def read_records(manifest: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest``; without ``data`` only last rows."""
    from pyspark.sql.types import StructType

    fields = [f.name for f in StructType.fromDDL(RECORDS)]

    def run(batches):
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                rows, held = [], 0
                for row in read_archive(uri, chunk):
                    if data or row["last"]:
                        rows.append(row if data else row | {"data": None})
                        held += len(rows[-1]["data"] or b"")
                    if len(rows) >= 10_000 or held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    kinds = {"record": pa.int64(), "chunk": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "data": pa.binary(), "payload_bytes": pa.int64(), "last": pa.bool_()}

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in fields], fields)

    # a task for each archive: they are large, and few
    files = max(1, manifest.count())
    return manifest.select("archive").repartition(files).mapInArrow(run, RECORDS)
