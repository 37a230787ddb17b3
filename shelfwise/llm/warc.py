"""WARC archives: written with an index first, then read back by coalesced byte ranges of that index.

Each task writes its pages as gzip members into archives of its own and returns one index row per
record (archive, offset, length, URL, digest). A reader never scans an archive: it takes index rows,
sorted by place, joins neighbouring ranges into one read, and unpacks each record by itself. Index
rows are committed with Spark's table commit, so an archive of a task that died has no rows.

Cases: a null or empty payload is a record of no bytes. Rows with equal payloads share one response,
the row(s) with the smallest page_id (null counts as largest); all others revisit it. Rows that repeat
both page_id and payload have the same type. A null URL is written as ``about:blank``; line breaks in
a URL are percent-encoded. An empty table gives no archive and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import kept_columns, new_folder, open_store, settle, sized_parts

INDEX = ("page_id long, archive string, record_offset long, record_bytes long, url string, payload_digest string, "
         "record_type string")
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "payload binary")
WRITTEN = "2024-01-01T00:00:00Z"
EMPTY = b""


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, first_id, is_revisit: bool, digest: str) -> bytes:
    """One record, packed as a gzip member of its own."""
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    name = uuid5(NAMESPACE_URL, f"{page_id}:{digest}")
    head = [f"WARC/1.1\r\nWARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
            f"WARC-Date: {WRITTEN}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:uuid:{uuid5(NAMESPACE_URL, f'{first_id}:{digest}')}>",
                 f"X-Refers-To-Page-Id: {first_id}"]
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = answer if is_revisit else answer + payload
    whole = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out, archive, at = None, None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, first_id, is_revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    store.create_dir(root, recursive=True)
                    archive, at = f"{uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{archive}", compression=None)  # records are packed already
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = _digest(payload)
                packed = _record(page_id, url, payload, first_id, is_revisit, digest)
                out.write(packed)
                rows.append((page_id, archive, at, len(packed), url, digest, "revisit" if is_revisit else "response"))
                at += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                ["page_id", "archive", "record_offset", "record_bytes", "url", "payload_digest", "record_type"]) if rows else \
                pa.RecordBatch.from_pylist([], schema=_arrow_index())
        if out is not None:
            out.close()
    return write


def _arrow_index() -> pa.Schema:
    return pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64()), ("record_bytes", pa.int64()),
                      ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())])


def first_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, first_id) of payloads that occur more than once: the page every other one revisits.

    Only digests are shuffled, and the copies of a payload meet as one row per task."""
    keyed = kept_columns(pages, "page_id", "html").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    return (keyed.where(F.octet_length("payload") >= min_bytes)
            .groupBy(F.sha1("payload").alias("digest"))
            .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = 128 << 20) -> DataFrame:
    """Writes every page as a record below ``folder`` and returns the stored index, a row per record.

    The table of repeated payloads is stored first, so Spark knows its true size: it is broadcast
    only when small, else the pages are shuffled by digest and adaptive execution splits a digest
    that many pages share."""
    firsts = settle(first_pages(pages, min_bytes))
    rows = kept_columns(pages, "page_id", "url", "html").withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    typed = (rows.join(firsts, "digest", "left")
             .select("page_id", "url", "html", "first_id",
                     (F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))).alias("is_revisit")))
    return settle(typed.mapInArrow(_writer(folder, archive_bytes), INDEX))


def _reader(folder: str, with_payload: bool, gap: int, span: int):
    def unpack(packed: memoryview) -> tuple:
        head, _, block = zlib.decompress(packed, 31).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        answer, _, payload = block[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and _digest(payload) != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        size = int(answer.rsplit(b"Content-Length: ", 1)[1])
        page, first = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
        return (int(page) if page else None, fields["WARC-Target-URI"], size, digest, kind, int(first) if first else None,
                payload if with_payload and kind == "response" else None)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def ranges(rows):
        """Runs of neighbouring records that one read covers."""
        run = []
        for archive, at, size in rows:
            if run and (archive != run[0][0] or at - run[-1][1] - run[-1][2] > gap or at + size - run[0][1] > span):
                yield run
                run = []
            run.append((archive, at, size))
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for run in ranges(zip(*(c.to_pylist() for c in batch.columns))):
                archive, start = run[0][0], run[0][1]
                with store.open_input_file(f"{root}/{archive}") as source:
                    data = memoryview(source.read_at(run[-1][1] + run[-1][2] - start, start))
                found = [unpack(data[at - start:at - start + size]) for _, at, size in run]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
    return read


def read_records(index: DataFrame, folder: str, with_payload: bool = True, task_bytes: int = 32 << 20,
                 gap: int = 64 << 10, span: int = 8 << 20) -> DataFrame:
    """The records of the given index rows; a revisit has no payload of its own.

    Rows are dealt out by (archive, block of ``task_bytes``), so a large archive is read by many tasks."""
    total = index.agg(F.sum("record_bytes")).first()[0]
    blocks = index.select("archive", "record_offset", "record_bytes", F.floor(F.col("record_offset") / task_bytes).alias("block"))
    dealt = (blocks.repartition(2 * sized_parts(total, task_bytes), "archive", "block")
             .sortWithinPartitions("archive", "record_offset").select("archive", "record_offset", "record_bytes"))
    return dealt.mapInArrow(_reader(folder, with_payload, gap, span), RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives every page and reads all of it back through the index."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, min_bytes), folder, with_payload=False)
