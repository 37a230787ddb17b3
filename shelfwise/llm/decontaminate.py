"""Benchmark decontamination: a BM25 inverted index of test items, searched by every training passage.

The index is built with joins and grouping (document frequencies, lengths, impacts) and normalised so
that a passage holding all of an item's terms scores 1. Items of like length form blocks; for each
term and block the largest impact is kept (block-max). A document is cut into passages of twice the
longest item, stepping by that length, so a whole item always lies inside one passage. For every
passage the block bounds are summed first; only blocks whose bound reaches the threshold are scored
(the WAND test with a fixed threshold), and only items that reach it are verified: the word 3-grams of
the item's question and of its answer (its last sentence) must both be found in the passage.

The index travels to the tasks in shards of at most ``shard_items`` items, each a scan of its own, so
what is sent has a bound at any benchmark size.

Cases: null, empty or word-less texts and items never match. Items that repeat (same id and text)
count once; rows of documents that repeat are each searched. Texts of any length are searched whole.
An empty benchmark or table gives no rows. Extra columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import kept_columns, settle, sized_parts, slices

LEAK = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
K1, B = 1.2, 0.75
GRAM = 3
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&_-–—«»„“”‚‘’…¿¡"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, offsets): lower-cased words of all texts without punctuation at their edges."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = pc.utf8_trim(lists.flatten(), characters=_EDGES)
    keep = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return flat.filter(keep), before[offsets - offsets[0]]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item up to its last sentence, and of that; a single sentence is cut at two thirds."""
    parts = [p for p in _SENTENCE.split(text or "") if p.strip()]
    head, tail = (tokens(pa.array([p]))[0].to_pylist() for p in (" ".join(parts[:-1]), parts[-1] if parts else ""))
    if len(head) < GRAM or len(tail) < GRAM:
        whole = head + tail
        cut = max(1, len(whole) * 2 // 3)
        return whole[:cut], whole[cut:]
    return head, tail


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = tokens(batch.column(1))
        item = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item)), flat], ["item", "term"])


def impacts(items: DataFrame) -> DataFrame:
    """(item, item_terms, term, impact): the postings; the impacts of an item sum to 1."""
    rows = (items.select(F.struct("item_id", "text").alias("item")).select(F.xxhash64("item").alias("item"), F.col("item.text"))
            .mapInArrow(_item_terms, "item long, term string"))
    tf = settle(rows.groupBy("item", "term").agg(F.count("*").alias("tf")))
    sizes = tf.groupBy("item").agg(F.sum("tf").alias("item_terms"))
    whole = sizes.agg(F.count("*").alias("n"), F.avg("item_terms").alias("mean")).first()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(float(whole["n"] or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("item_terms") / F.lit(whole["mean"] or 1.0)))
    scored = tf.join(sizes, "item").join(df, "term").select("item", "item_terms", "term", weight.alias("weight"))
    total = scored.groupBy("item").agg(F.sum("weight").alias("total"))
    return scored.join(total, "item").select("item", "item_terms", "term", (F.col("weight") / F.col("total")).alias("impact"))


@dataclass
class Lengths:
    """Items of like length, at most twice the shortest: their blocks and the passages that suit them."""

    window: int
    bounds: np.ndarray                                       # (terms, blocks): the largest impact in each block
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (term ids, impacts, item numbers)


@dataclass
class Shard:
    """What tasks get of some items: block bounds for every term, and the postings of each block."""

    vocabulary: pa.Array
    lengths: list[Lengths]
    grams: list[tuple[np.ndarray, np.ndarray]]               # question and answer 3-grams by item number
    item_ids: list[int | None]


def _gram_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """Codes of the 3-grams of known words; those with an unknown word are left out."""
    if len(ids) < GRAM:
        return np.empty(0, dtype=np.int64)
    a, b, c = (ids[k:len(ids) - 2 + k].astype(np.int64) for k in range(GRAM))
    return np.unique(((a * size + b) * size + c)[(a >= 0) & (b >= 0) & (c >= 0)])


def build_shard(items: list[tuple], postings: list[tuple], block_items: int = 16) -> Shard:
    """items: (item key, item_id, text); postings: (item key, item_terms, term, impact)."""
    vocabulary = sorted({p[2] for p in postings})
    term_id = {t: k for k, t in enumerate(vocabulary)}
    sizes = {p[0]: p[1] for p in postings}
    known = sorted((i for i in items if i[0] in sizes), key=lambda i: (sizes[i[0]], i[0]))
    number = {i[0]: k for k, i in enumerate(known)}
    of_item: list[list[tuple[int, float]]] = [[] for _ in known]
    for key, _, term, impact in postings:
        of_item[number[key]].append((term_id[term], impact))
    lengths, at = [], 0
    while at < len(known):
        top = max(16, 1 << (sizes[known[at][0]] - 1).bit_length())
        stop = next((k for k in range(at, len(known)) if sizes[known[k][0]] > top), len(known))
        blocks = []
        for first in range(at, stop, block_items):
            numbers = np.arange(first, min(first + block_items, stop))
            terms = np.unique([t for k in numbers for t, _ in of_item[k]])
            matrix = np.zeros((len(terms), len(numbers)))
            for k in numbers:
                for t, impact in of_item[k]:
                    matrix[np.searchsorted(terms, t), k - first] = impact
            blocks.append((terms, matrix, numbers))
        bounds = np.zeros((len(vocabulary), len(blocks)), dtype=np.float32)
        for b, (terms, matrix, _) in enumerate(blocks):
            bounds[terms, b] = matrix.max(axis=1)
        lengths.append(Lengths(2 * sizes[known[stop - 1][0]], bounds, blocks))
        at = stop
    as_ids = lambda ws: np.array([term_id[w] for w in ws], dtype=np.int64)
    grams = [tuple(_gram_codes(as_ids(part), len(vocabulary)) for part in question_and_answer(i[2])) for i in known]
    return Shard(pa.array(vocabulary, pa.string()), lengths, grams, [i[1] for i in known])


def _passages(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the passages of all documents: ``window`` words, stepping by half of that."""
    sizes, step = np.diff(offsets), window // 2
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - step) // step)), 0)
    doc = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[doc] + place * step
    return starts, np.minimum(starts + window, offsets[doc + 1])


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    sizes = last - first
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows between the edges."""
    running = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, dtype=np.float64, out=running[1:])
    return running[edges[1:]] - running[edges[:-1]]


def search(shard: Shard, ids: np.ndarray, offsets: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple]:
    """(document row, item number, score, question share, answer share, first word) of every verified passage."""
    size = len(shard.vocabulary)
    for part in shard.lengths:
        starts, ends = _passages(offsets, part.window)
        slice_words = max(part.window, 1_500_000 // part.bounds.shape[1])
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(starts, starts[at] + slice_words)))
            s, e = starts[at:stop], ends[at:stop]
            at = stop
            word = ids[_spread(s, e)].astype(np.int64)
            passage = np.repeat(np.arange(len(s)), e - s)
            pairs = np.unique((passage * size + word)[word >= 0])  # a term counts once in a passage
            passage, term = np.divmod(pairs, size)
            edges = np.searchsorted(passage, np.arange(len(s) + 1))
            bound = _sums(part.bounds[term], edges) >= threshold - 1e-4
            for b in np.flatnonzero(bound.any(axis=0)):
                terms, matrix, numbers = part.blocks[b]
                chosen = np.flatnonzero(bound[:, b])
                own = term[_spread(edges[chosen], edges[chosen + 1])]
                where = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
                rows = np.where((terms[where] == own)[:, None], matrix[where], 0.0)
                scores = _sums(rows, np.concatenate([[0], np.cumsum(edges[chosen + 1] - edges[chosen])]))
                for p, k in np.argwhere(scores >= threshold):
                    first, last = s[chosen[p]], e[chosen[p]]
                    codes = _gram_codes(ids[first:last], size)
                    grams = shard.grams[numbers[k]]
                    shares = [np.isin(g, codes, assume_unique=True).mean() if len(g) else 1.0 for g in grams]
                    if min(shares) >= overlap and any(len(g) for g in grams):
                        doc = int(np.searchsorted(offsets, first, side="right")) - 1
                        yield doc, int(numbers[k]), float(scores[p, k]), *map(float, shares), int(first - offsets[doc])


def _searcher(shard: Shard, threshold: float, overlap: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                        ("answer_overlap", pa.float64()), ("first_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            flat, offsets = tokens(batch.column(1))
            ids = pc.fill_null(pc.index_in(flat, value_set=shard.vocabulary), -1).to_numpy(zero_copy_only=False)
            best: dict[tuple[int, int], tuple] = {}
            for doc, item, *rest in search(shard, ids, offsets, threshold, overlap):
                if (doc, item) not in best or rest[0] > best[doc, item][0]:
                    best[doc, item] = rest
            doc_ids = batch.column(0).to_pylist()
            rows = [(doc_ids[d], shard.item_ids[i], *rest) for (d, i), rest in best.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
    return run


def shards(benchmark: DataFrame, shard_items: int = 20_000) -> Iterator[Shard]:
    """The index, built over all items and handed out in bounded parts."""
    items = settle(kept_columns(benchmark, "item_id", "text").where("text is not null").dropDuplicates())
    keyed = items.select(F.xxhash64(F.struct("item_id", "text")).alias("item"), "item_id", "text")
    postings = settle(impacts(items))
    n = sized_parts(items.count(), shard_items, least=0)
    for s in range(n):
        part = F.pmod("item", F.lit(n)) == s
        shard = build_shard([tuple(r) for r in keyed.where(part).collect()], [tuple(r) for r in postings.where(part).collect()])
        if shard.item_ids:
            yield shard


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, shard_items: int = 20_000) -> DataFrame:
    """One row per (document, item) found in it, with the best passage's score and overlaps."""
    rows, out = kept_columns(docs, "doc_id", "text"), None
    for shard in shards(benchmark, shard_items):
        found = rows.mapInArrow(_searcher(shard, threshold, overlap), LEAK)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], LEAK) if out is None else out


def _keeper(shard: Shard, threshold: float, overlap: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            flat, offsets = tokens(batch.column(at))
            ids = pc.fill_null(pc.index_in(flat, value_set=shard.vocabulary), -1).to_numpy(zero_copy_only=False)
            keep = np.ones(batch.num_rows, dtype=bool)
            for doc, *_ in search(shard, ids, offsets, threshold, overlap):
                keep[doc] = False
            yield batch.filter(pa.array(keep))
    return run


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, shard_items: int = 20_000) -> DataFrame:
    """All rows and columns of the documents in which no test item is found; no shuffle of texts."""
    out = docs
    for shard in shards(benchmark, shard_items):
        out = out.mapInArrow(_keeper(shard, threshold, overlap, docs.columns.index("text")), docs.schema)
    return out
