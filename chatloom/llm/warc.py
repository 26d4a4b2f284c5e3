"""WARC archives from a table of pages, and back.

Pages are range-partitioned and sorted by id; a partition's records, each a gzip member of its own,
go to files that are closed at a compressed size. Digests and headers are made anew from the
payload. A payload that occurs again is a revisit record that names the response. Files are
written under temporary names and renamed once whole; the writers' rows are the manifest. The
bytes depend on the pages alone, so a task that is run again makes the same files.

Defined results: null html is an empty payload, null url an empty target. Null page ids sort
first and are never the response while an equal payload has an id; rows that repeat the largest
page id of a payload are all responses, and so are all rows of a payload without any id. Rows of
one id follow each other in the order of their payloads' hashes. A very long payload is one record;
one record is held at a time. An empty table gives no file. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, open_fs, range_sorted, shared_dir, shuffle_width, tidy

FILE_BYTES = 64 << 20
#: The archive's date is part of the input, not of the run.
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, as a gzip member with a fixed time stamp."""
    digest = payload_digest(payload)
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_uri(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url.translate({10: None, 13: None})}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_uri(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(filename="", fileobj=out, mode="wb", compresslevel=6, mtime=0) as f:
        f.write(raw)
    return out.getvalue()


def read_records(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive opened as a binary stream."""
    with gzip.GzipFile(fileobj=raw) as f:
        while True:
            line = f.readline()
            while line == b"\r\n":
                line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                headers[name.strip().lower()] = value.strip()
            yield headers, f.read(int(headers["content-length"]))


def revisit_marks(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, h, last) of pages (page_id, html) whose payload, of at least min_bytes, occurs again: h is
    the payload's 64-bit hash, last the largest page id. Bodies are left behind after hashing."""
    rows = pages.where(F.octet_length("html") >= min_bytes).select("page_id", F.xxhash64("html").alias("h"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    last = rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1 and last is not null")
    # written first, so that the rows of a payload with many copies are split when AQE joins them
    last = materialise(last.select("digest", "last"), "last-copies")
    return rows.join(last, "digest").select("page_id", "h", "digest", "last").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write page_id, url, html of pages; returns the manifest (path, records, bytes, crc32).

    The bodies are shuffled once, to their range; a page's revisit mark travels there beside it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keys = rows.select("page_id", F.xxhash64("html").alias("h"))
    marks = revisit_marks(rows, min_bytes).select("page_id", "h", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit("").alias("html"), "last")
    rows = marks.unionByName(rows.select("page_id", F.xxhash64("html").alias("h"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("last")))
    rows = range_sorted(rows, keys, ["kind", "url", "html"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        part, saved, now = TaskContext.get().partitionId(), [], None
        last: dict[str, int] = {}
        marked = None

        def close() -> None:
            out, temporary, name, count, size, crc = now
            out.close()
            fs.move(temporary, f"{root}/{name}")
            saved.append((f"{folder}/{name}", count, size, crc))

        for b in batches:
            for row in range(b.num_rows):  # one body at a time
                page_id, h, kind, url, html, copy_of = (c[row].as_py() for c in b.columns)
                if (page_id, h) != marked:
                    last, marked = {}, (page_id, h)
                if kind == 0:
                    last[url] = copy_of
                    continue
                if now and now[4] >= file_bytes:
                    close()
                    now = None
                if not now:
                    name = f"pages-{part:08d}-{len(saved):06d}.warc.gz"
                    temporary = f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
                    now = [fs.open_output_stream(temporary, compression=None), temporary, name, 0, 0, 0]
                payload = html.encode()
                refers = last.get(hashlib.sha1(payload).hexdigest()) if last else None
                raw = record_bytes(page_id, url, payload, None if refers == page_id else refers)
                now[0].write(raw)
                now[3] += 1
                now[4] += len(raw)
                now[5] = zlib.crc32(raw, now[5])
        if now:
            close()
        cols = [*zip(*saved, strict=True)] if saved else [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "records", "bytes", "crc32"])

    return materialise(rows.mapInArrow(tidy(run), "path string, records long, bytes long, crc32 long"), "warc-manifest")


_READ = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, with_html: bool = True) -> DataFrame:
    """A row for each record. html is null for revisits (and throughout without with_html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = open_fs(path)
                rows = []
                with fs.open_input_stream(at, compression=None) as raw:
                    for headers, block in read_records(raw):
                        rows.append(_row(headers, block, with_html))
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return manifest.select("path").repartition(shuffle_width(manifest.sparkSession), "path").mapInArrow(tidy(run), _READ)


def _row(headers: dict[str, str], block: bytes, with_html: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["warc-type"] == "revisit"
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if revisit:  # the body is in the record that it refers to; its length in the HTTP head
        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    else:
        size = len(payload)
        if payload_digest(payload) != digest:
            raise ValueError(f"payload digest of {headers['warc-record-id']} does not hold")
    number = lambda name: int(headers[name]) if name in headers else None
    html = payload.decode() if with_html and not revisit else None
    return number("x-page-id"), headers["warc-target-uri"], html, size, digest, headers["warc-type"], number("x-refers-to-page-id")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages into a new shared folder; returns the manifest."""
    return write_archives(pages, shared_dir(pages.sparkSession, "warc"), min_bytes)
