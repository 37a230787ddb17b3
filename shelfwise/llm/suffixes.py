"""Repeated substrings across documents, by blockwise suffix sorting with a difference-cover sample.

Every ``depth``-byte string that also starts in a document with a smaller id is removed. Sorting all
suffixes of a corpus at once would ship each byte many times over; instead:

1. Cover sample. Positions i with i mod 21 in a perfect difference set of 5 residues are sampled. For
   any two positions there is a step below 21 that moves both onto sampled ones, so two equal strings
   of ``depth`` bytes share an equal sampled window of depth - 20 bytes. Each chunk of texts names its
   sampled windows (a fingerprint), and the names are sorted one bucket at a time over the corpus. A
   bucket is the names with the same leading bits; its size has a bound, whatever the corpus.
2. Ties. Only suffixes within reach of a sampled window that stands in two documents can tie over the
   whole depth. They alone are named over ``depth`` bytes and sorted, again a bucket at a time, with
   the least document of each name; the answer to a chunk is one bit for each of its names: whether a
   smaller document elsewhere has it.
3. Each chunk marks its removed bytes from these bits and its own documents.

Sorting within a bucket is by name, not by letters: only equal neighbours are looked at. Names are 64
bits of a hash of the whole window; two different strings share one with probability 2**-64.
A chunk's texts are written once to the shared folder, sorted names travel delta-coded, and each name
travels once per chunk, so a passage that a third of all documents hold is one row per chunk. Texts
equal to one of a smaller document are settled first by their digests.

Cases: a null text is empty. A text below ``depth`` bytes is kept whole. Rows with the same doc_id never
remove each other's bytes; a null doc_id counts as larger than all others. An empty table gives no
rows. A very long text is a chunk of its own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import kept_columns, new_folder, open_store, settle

PERIOD = 21
COVER = np.array([3, 6, 7, 12, 14])  # every difference 1..20 modulo 21 occurs exactly once
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LAST = (1 << 63) - 1


# Sorted numbers as bytes -------------------------------------------------------------------------
def _planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, so that equal high bytes compress away."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _from_planes(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes, dtype: str) -> np.ndarray:
    return np.cumsum(_from_planes(blob, dtype), dtype=dtype)


def _pack_bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def _unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8), count=n).astype(bool)


# Chunks ------------------------------------------------------------------------------------------
def _chunk_writer(folder: str, chunk_bytes: int):
    schema = pa.schema([("chunk", pa.string()), ("row", pa.int32()), ("key", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            store.create_dir(root, recursive=True)
            chunk = uuid4().hex
            pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary())}),
                           f"{root}/{chunk}.parquet", filesystem=store, compression="zstd", use_dictionary=False, write_statistics=False)
            n = len(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([chunk] * n), pa.array(range(n), pa.int32()), pa.array([_LAST if i is None else i for i in ids], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                text = text or b""
                if texts and held + len(text) > chunk_bytes:
                    yield flush()
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            yield flush()
    return run


class Chunk:
    """The texts of a chunk in one buffer, without those that are copies of a smaller document's text."""

    def __init__(self, folder: str, name: str, copies: list[int], depth: int, bucket_bits: int):
        store, root = open_store(folder)
        table = pq.read_table(f"{root}/{name}.parquet", filesystem=store)
        self.doc_ids, self.texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        self.depth, self.bits, self.copies = depth, bucket_bits, set(copies)
        self.rows = [k for k in range(len(self.texts)) if k not in self.copies and len(self.texts[k]) >= depth]
        sizes = np.array([len(self.texts[k]) for k in self.rows], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.keys = np.array([_LAST if self.doc_ids[k] is None else self.doc_ids[k] for k in self.rows], dtype=np.int64)
        self.size = int(sizes.sum())
        data = b"".join([*(self.texts[k] for k in self.rows), bytes(64)])
        self.eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))

    def _names(self, at: np.ndarray, width: int) -> np.ndarray:
        """64-bit names of the ``width``-byte windows at the given places."""
        h = np.full(len(at), width, dtype=np.uint64)
        for n, shift in enumerate([*range(0, width - 8, 8), width - 8]):
            for lo in range(0, len(at), 1 << 18):  # slices that stay in the cache
                part = (h[lo:lo + (1 << 18)] ^ self.eight[at[lo:lo + (1 << 18)] + shift]) * _ODD[n % 3]
                h[lo:lo + (1 << 18)] = (part ^ (part >> np.uint64(32))) * _ODD[(n + 1) % 3]
        return h ^ (h >> np.uint64(29))

    def _document(self, at: np.ndarray) -> np.ndarray:
        """Document of each of the ascending places."""
        return np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(np.searchsorted(at, self.ends), prepend=0))

    def samples(self):
        """(places, documents, order by name, names of the groups, first of each group in that order)."""
        width = self.depth - PERIOD + 1
        at = (np.arange(0, self.size, PERIOD)[:, None] + COVER).ravel()
        at = at[at < self.size]
        doc = self._document(at)
        fits = at + width <= self.ends[doc] if len(at) else np.zeros(0, dtype=bool)
        at, doc = at[fits], doc[fits]
        name = self._names(at, width) >> np.uint64(32 - self.bits)  # bucket bits and 32 more
        order = np.argsort(name, kind="stable")
        return (at, doc, order, *_groups(name[order]))

    def suffixes(self, answers: dict[int, bytes]):
        """As ``samples``, for the suffixes near a sampled window that two documents have."""
        at, doc, order, names, first = self.samples()
        found = np.zeros(len(names), dtype=bool)
        for bucket, lo, hi in self.buckets(names, 32):
            if bucket in answers:
                found[lo:hi] = _unpack_bits(answers[bucket], hi - lo)
        last = np.append(first[1:], len(order)) - 1
        found |= doc[order[first]] != doc[order[last]] if len(first) else False
        hit = np.zeros(len(order), dtype=bool)
        hit[order] = np.repeat(found, np.diff(np.append(first, len(order))))
        at, doc = at[hit], doc[hit]
        lo = np.maximum(at - PERIOD + 1, self.starts[doc])
        hi = np.minimum(at, self.ends[doc] - self.depth) + 1
        some = hi > lo
        edge = np.zeros(self.size + 1, dtype=np.int32)
        np.add.at(edge, lo[some], 1)
        np.add.at(edge, hi[some], -1)
        at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        doc = self._document(at)
        name = self._names(at, self.depth)
        order = np.argsort(name, kind="stable")
        return (at, doc, order, *_groups(name[order]))

    def buckets(self, names: np.ndarray, below: int) -> Iterator[tuple[int, int, int]]:
        """(bucket, first, end) of the runs of sorted names with the same leading bits."""
        edges = np.searchsorted(names, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(below))
        for bucket, (lo, hi) in enumerate(zip(edges, np.append(edges[1:], len(names)))):
            if hi > lo:
                yield bucket, int(lo), int(hi)

    def least_keys(self, doc: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(self.keys[doc[order]], first) if len(first) else np.empty(0, dtype=np.int64)


def _groups(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.empty(0, dtype=np.int64)
    return names[first], first


# Messages ----------------------------------------------------------------------------------------
MESSAGE = "bucket int, chunk string, names binary, docs binary, places binary"
ANSWER = "chunk string, bucket int, bits binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("names", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _send_samples(folder: str, depth: int, bits: int):
    low = np.uint64(0xFFFFFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk = Chunk(folder, name, copies or [], depth, bits)
                names = chunk.samples()[3]
                rows = [{"bucket": b, "chunk": name, "names": pack_sorted((names[lo:hi] & low).astype(np.uint32))}
                        for b, lo, hi in chunk.buckets(names, 32)]
                yield pa.RecordBatch.from_pylist(rows, schema=_MESSAGE)
    return run


def _answer_samples(rows: pa.Table) -> pa.Table:
    """One bucket: for each chunk, which of its names another chunk has too."""
    lists = [unpack_sorted(b, "<u4") for b in rows["names"].to_pylist()]
    names = np.concatenate(lists)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(names), dtype=bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    return _answers(rows, lists, shared)


def _answers(rows: pa.Table, lists: list[np.ndarray], flags: np.ndarray) -> pa.Table:
    edges = np.cumsum([0, *map(len, lists)])
    out = [{"chunk": c, "bucket": b, "bits": _pack_bits(flags[lo:hi])}
           for c, b, lo, hi in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), edges[:-1], edges[1:]) if flags[lo:hi].any()]
    return pa.Table.from_pylist(out, schema=_ANSWER)


def _by_bucket(answers: pa.Table, stage: int) -> dict[int, bytes]:
    return {b: bits for b, bits, s in zip(*(answers[c].to_pylist() for c in ("bucket", "bits", "stage"))) if s == stage}


def _send_suffixes(folder: str, depth: int, bits: int):
    low = np.uint64((1 << (64 - bits)) - 1)

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for name, copies in zip(chunks["chunk"].to_pylist(), chunks["copies"].to_pylist()):
            chunk = Chunk(folder, name, copies or [], depth, bits)
            _, doc, order, names, first = chunk.suffixes(_by_bucket(answers, 1))
            least = chunk.least_keys(doc, order, first)
            for b, lo, hi in chunk.buckets(names, 64 - bits):
                docs, places = np.unique(least[lo:hi], return_inverse=True)
                rows.append({"bucket": b, "chunk": name, "names": pack_sorted(names[lo:hi] & low), "docs": pack_sorted(docs),
                             "places": _planes(places.astype(np.uint32))})
        return pa.Table.from_pylist(rows, schema=_MESSAGE)
    return run


def _answer_suffixes(rows: pa.Table) -> pa.Table:
    """One bucket: for each chunk, which of its names a smaller document of another chunk has."""
    lists = [unpack_sorted(b, "<u8") for b in rows["names"].to_pylist()]
    docs = np.concatenate([unpack_sorted(d, "<i8")[_from_planes(p, "<u4")] for d, p in zip(rows["docs"].to_pylist(), rows["places"].to_pylist())])
    names = np.concatenate(lists)
    order = np.argsort(names, kind="stable")
    _, first = _groups(names[order])
    least = np.minimum.reduceat(docs[order], first)
    smaller = np.zeros(len(names), dtype=bool)
    smaller[order] = np.repeat(least, np.diff(np.append(first, len(order)))) < docs[order]
    return _answers(rows, lists, smaller)


RESULT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def _mark(folder: str, depth: int, bits: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", spans), ("kept", pa.binary())])

    def one(chunk: Chunk, answers: dict[int, bytes]) -> list[dict]:
        removed: dict[int, list[tuple[int, int]]] = {k: [(0, len(chunk.texts[k]))] for k in chunk.copies if len(chunk.texts[k]) >= depth}
        at, doc, order, names, first = answers["suffixes"]
        least = chunk.least_keys(doc, order, first)
        elsewhere = np.zeros(len(names), dtype=bool)
        for b, lo, hi in chunk.buckets(names, 64 - bits):
            if b in answers["bits"]:
                elsewhere[lo:hi] = _unpack_bits(answers["bits"][b], hi - lo)
        sizes = np.diff(np.append(first, len(order)))
        starts = np.zeros(len(order), dtype=bool)
        starts[order] = np.repeat(elsewhere, sizes) | (chunk.keys[doc[order]] > np.repeat(least, sizes))
        edge = np.zeros(chunk.size + 1, dtype=np.int32)
        edge[at[starts]] += 1
        edge[at[starts] + depth] -= 1
        covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        for n, k in enumerate(chunk.rows):
            own = covered[chunk.starts[n] + 1:chunk.ends[n] + 1].astype(np.int8)
            turns = np.flatnonzero(np.diff(own, prepend=0, append=0))
            if len(turns):
                removed[k] = list(zip(turns[::2].tolist(), turns[1::2].tolist()))
        out = []
        for k, text in enumerate(chunk.texts):
            gone = removed.get(k, [])
            kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)])) if gone else text
            out.append({"doc_id": chunk.doc_ids[k], "n_bytes": len(text), "removed": [{"start": s, "end": e} for s, e in gone], "kept": kept})
        return out

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for name, copies in zip(chunks["chunk"].to_pylist(), chunks["copies"].to_pylist()):
            chunk = Chunk(folder, name, copies or [], depth, bits)
            rows += one(chunk, {"suffixes": chunk.suffixes(_by_bucket(answers, 1)), "bits": _by_bucket(answers, 2)})
        return pa.Table.from_pylist(rows, schema=schema)
    return run


def repeated(docs: DataFrame, depth: int = 50, chunk_bytes: int = 6 << 20, bucket_names: int = 1 << 19) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): per row the removed byte spans and the bytes that remain."""
    if depth < PERIOD + 7:
        raise ValueError(f"depth must be at least {PERIOD + 7}")
    folder = new_folder(docs.sparkSession, "suffixes")
    placed = settle(kept_columns(docs, "doc_id", "text").mapInArrow(
        _chunk_writer(folder, chunk_bytes), "chunk string, row int, key long, n_bytes long, digest binary"))
    whole = placed.agg(F.sum("n_bytes").alias("bytes"), F.countDistinct("chunk").alias("chunks")).first()
    names = (whole["bytes"] or 0) * len(COVER) // PERIOD
    bits = min(24, max(4, (names // bucket_names).bit_length()))
    tasks = max(1, -(-whole["chunks"] // 2))
    firsts = placed.where(F.col("n_bytes") >= depth).groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    copies = placed.join(firsts, "digest").where("key > first").groupBy("chunk").agg(F.collect_list("row").alias("copies"))
    chunks = settle(placed.select("chunk").distinct().join(copies, "chunk", "left").select("chunk", "copies"))
    dealt = chunks.repartition(tasks, "chunk")

    samples = dealt.mapInArrow(_send_samples(folder, depth, bits), MESSAGE)
    first = settle(samples.groupBy("bucket").applyInArrow(_answer_samples, ANSWER).withColumn("stage", F.lit(1)))
    together = lambda answers: dealt.groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk"))
    suffixes = together(first).applyInArrow(_send_suffixes(folder, depth, bits), MESSAGE)
    second = settle(suffixes.groupBy("bucket").applyInArrow(_answer_suffixes, ANSWER).withColumn("stage", F.lit(2)))
    return together(first.unionByName(second)).applyInArrow(_mark(folder, depth, bits), RESULT)
