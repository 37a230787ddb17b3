"""Repeated word sequences by fixed-block anchors.

Every ``window``-word sequence that also starts earlier (in a document with a smaller id, or earlier in
the same document) is removed, word by word. Three steps over chunks of whole texts:

1. Anchors. The reference blocks are the non-overlapping runs of ``window // 2`` words of each document:
   any window holds a whole one. They are the index, and every rolling run of as many words of every
   document probes it. A rolling run that stands in the index and occurs twice is a hit. A chunk sends
   each of its distinct runs once, so a run that a third of all documents hold is one entry a chunk.
2. Extension. Each hit is extended by the words on both sides to every window that contains it. A block
   can stand in many contexts, so a hit isn't extended against one partner, but against all at once: the
   extended windows are named over all their words, and the least document of each name is found. A window
   whose name has an earlier place is an exact repeat.
3. Each chunk joins its repeats to maximal runs and takes their words out.

Block names have 32 bits besides those of their bucket; a chance hit only costs an extension. Window names
have 64 bits besides those of their bucket, drawn independently, and buckets grow in number with the corpus:
about 72 bits at 0.1 GB and 88 at 100 TB, so less than one pair of different windows shares a name at any
of these sizes. Names travel sorted and delta-coded, one message per chunk and bucket; both sizes are bounds.

Cases: a null text has no words. A text of fewer words than a window is kept whole. Rows with the same
doc_id don't remove each other's words, but each its own later repeats; a null doc_id counts as larger than
all others. Texts equal to one of a smaller document go whole. An empty table gives no rows. A very long
text is a chunk of its own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import kept_columns, new_folder, open_store, settle
from shelfwise.llm.suffixes import _LAST, _chunk_writer, _from_planes, _pack_bits, _planes, _unpack_bits, pack_sorted, unpack_sorted

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_P, _P_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SLICE = 1 << 18


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of a text."""
    blank = _BLANK[data]
    turns = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    return turns[::2], turns[1::2]


def _word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word: a polynomial of its bytes, mixed. Works on slices of the text."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, side="right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        powers = np.cumprod(np.full(hi - lo, _P, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data[lo:hi]] * powers, dtype=np.uint64)])
        back = np.cumprod(np.full(hi - lo, _P_INVERSE, dtype=np.uint64))
        first, end = starts[at:stop] - lo, ends[at:stop] - lo
        h = (sums[end] - sums[first]) * back[first]
        h = (h ^ (h >> np.uint64(31))) * _ODD[0] + (end - first).astype(np.uint64)
        out[at:stop] = h ^ (h >> np.uint64(29))
        at = stop
    return out


def _run_names(words: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """64-bit names of the ``width``-word runs at the given places."""
    out = np.empty(len(at), dtype=np.uint64)
    for lo in range(0, len(at), _SLICE):  # slices that stay in the cache
        places = at[lo:lo + _SLICE]
        h = np.full(len(places), seed, dtype=np.uint64)
        for n in range(width):
            h = (h ^ words[places + n]) * _ODD[(n + seed) % 3]
            h ^= h >> np.uint64(32)
        out[lo:lo + _SLICE] = h * _ODD[seed % 3]
    return out ^ (out >> np.uint64(29))


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value of the keys starts."""
    if not len(sorted_keys[0]):
        return np.empty(0, dtype=np.int64)
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Chunk:
    """The words of a chunk's texts in one array, without texts that are copies of a smaller document's."""

    def __init__(self, folder: str, name: str, copies: list[int], window: int, bits: int):
        store, root = open_store(folder)
        table = pq.read_table(f"{root}/{name}.parquet", filesystem=store)
        self.doc_ids, self.texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        self.window, self.bits, self.copies, self.rows = window, bits, set(copies), []
        names, sizes = [], []
        for k, text in enumerate(self.texts):
            if k in self.copies:
                continue
            data = np.frombuffer(text, dtype=np.uint8)
            starts, ends = word_places(data)
            if len(starts) >= window:
                self.rows.append(k)
                sizes.append(len(starts))
                names.append(_word_names(data, starts, ends))
        self.words = np.concatenate(names) if names else np.empty(0, np.uint64)
        self.ends = np.cumsum(np.array(sizes, dtype=np.int64))
        self.starts = self.ends - np.array(sizes, dtype=np.int64)
        self.keys = np.array([_LAST if self.doc_ids[k] is None else self.doc_ids[k] for k in self.rows], dtype=np.int64)

    def places(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, row) of every run of ``width`` words that lies in one document."""
        counts = self.ends - self.starts - width + 1
        row = np.repeat(np.arange(len(counts)), counts)
        return np.arange(len(row)) + row * (width - 1), row

    def runs(self):
        """(places, order by name, names, first of each name in that order, is a reference block): all rolling runs."""
        width = self.window // 2
        at, row = self.places(width)
        name = _run_names(self.words, at, width, 1) >> np.uint64(32 - self.bits)  # bucket bits and 32 more
        order = np.argsort(name, kind="stable")
        first = _firsts(name[order])
        block = (at - self.starts[row]) % width == 0 if len(at) else np.empty(0, dtype=bool)
        return at, order, name[order][first], first, block

    def windows(self, answers: dict[int, bytes]):
        """(places, rows, order, bucket and name of each group, first of each group): windows that contain a hit."""
        half, whole = self.window // 2, self.window
        at, order, names, first, _ = self.runs()
        found = np.zeros(len(names), dtype=bool)
        for bucket, lo, hi in self.buckets(names >> np.uint64(32)):
            if bucket in answers:
                found[lo:hi] = _unpack_bits(answers[bucket], hi - lo)
        hit = np.zeros(len(order), dtype=bool)
        hit[order] = np.repeat(found, np.diff(np.append(first, len(order))))
        before = np.zeros(len(self.words) + 1, dtype=np.int32)
        before[at[hit] + 1] = 1
        before = np.cumsum(before, dtype=np.int32)
        at, row = self.places(whole)
        some = before[at + whole - half + 1] > before[at] if len(at) else np.empty(0, dtype=bool)
        at, row = at[some], row[some]
        bucket = _run_names(self.words, at, whole, 2) >> np.uint64(64 - self.bits)
        name = _run_names(self.words, at, whole, 3)
        order = np.lexsort((name, bucket))
        bucket, name = bucket[order], name[order]
        first = _firsts(bucket, name)
        return at, row, order, bucket[first], name[first], first

    def buckets(self, of: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, first, end) of the runs of equal buckets."""
        edges = _firsts(of)
        yield from zip(of[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(of)])


# Messages ----------------------------------------------------------------------------------------
RUNS = "bucket int, chunk string, names binary, blocks binary, twice binary"
WINDOWS = "bucket int, chunk string, names binary, docs binary, places binary"
ANSWER = "chunk string, bucket int, bits binary"
_RUNS = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("names", pa.binary()), ("blocks", pa.binary()), ("twice", pa.binary())])
_WINDOWS = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("names", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("bits", pa.binary())])
_LOW = np.uint64(0xFFFFFFFF)


def _send_runs(folder: str, window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk = Chunk(folder, name, copies or [], window, bits)
                _, order, names, first, block = chunk.runs()
                twice = np.diff(np.append(first, len(order))) > 1
                blocks = np.logical_or.reduceat(block[order], first) if len(first) else block
                rows = [{"bucket": b, "chunk": name, "names": pack_sorted((names[lo:hi] & _LOW).astype(np.uint32)),
                         "blocks": _pack_bits(blocks[lo:hi]), "twice": _pack_bits(twice[lo:hi])} for b, lo, hi in chunk.buckets(names >> np.uint64(32))]
                yield pa.RecordBatch.from_pylist(rows, schema=_RUNS)
    return run


def _answers(rows: pa.Table, sizes: list[int], flags: np.ndarray) -> pa.Table:
    edges = np.cumsum([0, *sizes])
    out = [{"chunk": c, "bucket": b, "bits": _pack_bits(flags[lo:hi])}
           for c, b, lo, hi in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), edges[:-1], edges[1:]) if flags[lo:hi].any()]
    return pa.Table.from_pylist(out, schema=_ANSWER)


def _spread(flag_of_group: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), dtype=flag_of_group.dtype)
    out[order] = np.repeat(flag_of_group, np.diff(np.append(first, len(order))))
    return out


def _answer_runs(rows: pa.Table) -> pa.Table:
    """One bucket: for each chunk, which of its rolling runs stand in the index and occur twice."""
    lists = [unpack_sorted(b, "<u4") for b in rows["names"].to_pylist()]
    bits = lambda column: np.concatenate([_unpack_bits(b, len(x)) for b, x in zip(rows[column].to_pylist(), lists)])
    names, blocks, twice = np.concatenate(lists), bits("blocks"), bits("twice")
    order = np.argsort(names, kind="stable")
    first = _firsts(names[order])
    many = np.diff(np.append(first, len(order))) > 1
    hit = np.logical_or.reduceat(blocks[order], first) & (many | np.logical_or.reduceat(twice[order], first))
    return _answers(rows, [len(x) for x in lists], _spread(hit, order, first))


def _by_bucket(answers: pa.Table, stage: int) -> dict[int, bytes]:
    return {b: bits for b, bits, s in zip(*(answers[c].to_pylist() for c in ("bucket", "bits", "stage"))) if s == stage}


def _send_windows(folder: str, window: int, bits: int):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for name, copies in zip(chunks["chunk"].to_pylist(), chunks["copies"].to_pylist()):
            chunk = Chunk(folder, name, copies or [], window, bits)
            _, row, order, bucket, names, first = chunk.windows(_by_bucket(answers, 1))
            least = np.minimum.reduceat(chunk.keys[row[order]], first) if len(first) else np.empty(0, np.int64)
            for b, lo, hi in chunk.buckets(bucket):
                docs, places = np.unique(least[lo:hi], return_inverse=True)
                rows.append({"bucket": b, "chunk": name, "names": pack_sorted(names[lo:hi]), "docs": pack_sorted(docs), "places": _planes(places.astype(np.uint32))})
        return pa.Table.from_pylist(rows, schema=_WINDOWS)
    return run


def _answer_windows(rows: pa.Table) -> pa.Table:
    """One bucket: for each chunk, which of its windows a smaller document of another chunk has."""
    lists = [unpack_sorted(b, "<u8") for b in rows["names"].to_pylist()]
    docs = np.concatenate([unpack_sorted(d, "<i8")[_from_planes(p, "<u4")] for d, p in zip(rows["docs"].to_pylist(), rows["places"].to_pylist())])
    names = np.concatenate(lists)
    order = np.argsort(names, kind="stable")
    first = _firsts(names[order])
    least = _spread(np.minimum.reduceat(docs[order], first), order, first)
    return _answers(rows, [len(x) for x in lists], least < docs)


RESULT = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string"


def _repeats(chunk: Chunk, answers: dict[int, bytes], hits: dict[int, bytes]) -> dict[int, list[tuple[int, int]]]:
    """Maximal repeated runs of words of each row that earlier places have too."""
    at, row, order, bucket, names, first = chunk.windows(hits)
    elsewhere = np.zeros(len(names), dtype=bool)
    for b, lo, hi in chunk.buckets(bucket):
        if b in answers:
            elsewhere[lo:hi] = _unpack_bits(answers[b], hi - lo)
    least = np.minimum.reduceat(chunk.keys[row[order]], first) if len(first) else np.empty(0, np.int64)
    repeated = _spread(elsewhere, order, first) | (chunk.keys[row] > _spread(least, order, first))
    group = _spread(np.arange(len(first)), order, first)
    by_row = np.lexsort((at, row, group))
    later = np.ones(len(by_row), dtype=bool)
    later[_firsts(group[by_row], row[by_row])] = False
    repeated[by_row] |= later
    edge = np.zeros(len(chunk.words) + 1, dtype=np.int32)
    edge[at[repeated]] += 1
    edge[at[repeated] + chunk.window] -= 1
    covered = np.cumsum(edge)[:-1] > 0
    out = {}
    for n, k in enumerate(chunk.rows):
        turns = np.flatnonzero(np.diff(covered[chunk.starts[n]:chunk.ends[n]].astype(np.int8), prepend=0, append=0))
        if len(turns):
            out[k] = list(zip(turns[::2].tolist(), turns[1::2].tolist()))
    return out


def _mark(folder: str, window: int, bits: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", spans), ("kept", pa.string())])

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for name, copies in zip(chunks["chunk"].to_pylist(), chunks["copies"].to_pylist()):
            chunk = Chunk(folder, name, copies or [], window, bits)
            removed, rows = _repeats(chunk, _by_bucket(answers, 2), _by_bucket(answers, 1)), []
            for k, text in enumerate(chunk.texts):
                words = text.split()  # of bytes: at the same six blanks
                gone = removed.get(k, [])
                if k in chunk.copies and len(words) >= window:
                    gone = [(0, len(words))]
                kept = [w for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(words)]) for w in words[a:b]]
                rows.append({"doc_id": chunk.doc_ids[k], "n_words": len(words), "removed": [{"start": s, "end": e} for s, e in gone],
                             "kept": b" ".join(kept).decode("utf-8", "replace")})
            parts.append(pa.Table.from_pylist(rows, schema=schema))
        return pa.concat_tables(parts)
    return run


def repeated(docs: DataFrame, window: int = 20, chunk_bytes: int = 4 << 20, bucket_names: int = 1 << 21) -> DataFrame:
    """(doc_id, n_words, removed, kept): per row the removed spans of words, and the words that remain, joined by spaces."""
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    folder = new_folder(docs.sparkSession, "anchors")
    placed = settle(kept_columns(docs, "doc_id", "text").mapInArrow(
        _chunk_writer(folder, chunk_bytes), "chunk string, row int, key long, n_bytes long, digest binary"))
    whole = placed.agg(F.sum("n_bytes").alias("bytes"), F.countDistinct("chunk").alias("chunks")).first()
    bits = min(24, max(6, ((whole["bytes"] or 0) // 6 // bucket_names).bit_length()))
    tasks = max(1, whole["chunks"])
    firsts = placed.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    copies = placed.join(firsts, "digest").where("key > first").groupBy("chunk").agg(F.collect_list("row").alias("copies"))
    chunks = settle(placed.select("chunk").distinct().join(copies, "chunk", "left").select("chunk", "copies"))
    dealt = chunks.repartition(tasks, "chunk")

    runs = dealt.mapInArrow(_send_runs(folder, window, bits), RUNS)
    first = settle(runs.groupBy("bucket").applyInArrow(_answer_runs, ANSWER).withColumn("stage", F.lit(1)))
    together = lambda answers: dealt.groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk"))
    windows = together(first).applyInArrow(_send_windows(folder, window, bits), WINDOWS)
    second = settle(windows.groupBy("bucket").applyInArrow(_answer_windows, ANSWER).withColumn("stage", F.lit(2)))
    return together(first.unionByName(second)).applyInArrow(_mark(folder, window, bits), RESULT)
