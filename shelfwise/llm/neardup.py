"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all shingles of all documents, in 2**18 hashed counters (a fixed megabyte).
2. Per document: shingles of five lower-cased words, weight = count * (1 + ln((1 + N) / (1 + df)) / ln(2 + N)),
   so a rare shingle counts at most twice as much as one that every document has, and ``bands * rows``
   improved consistent weighted samples (Ioffe's scheme): for shingle s and sample k, with r, c ~
   Gamma(2, 1) and beta ~ U(0, 1) drawn from a hash of (s, k), t = floor(ln w / r + beta) and
   ln a = ln c - r (t + 1 - beta); the sample is the (s, t) of least a.
   Two documents agree in a sample with the probability of their weighted Jaccard similarity.
3. Texts with equal words are one node. Nodes that share a band meet in a bucket. A bucket of n members
   gives n - 1 pairs with its busiest node, then pairs with sixteen random nodes for each member that did
   not join that node's component. Of the nodes whose buckets are still split, all pairs
   that a prefix filter over their rarest shingles leaves follow, so none in a crowded bucket is missed.
   A pair is looked at only if its facts allow it: each node has 1024 parity bits of its shingles, and two
   sets differ in at least as many shingles as their bits do, and by at least the difference of their sums.
   Pairs are verified on whole texts by exact weighted Jaccard similarity (a pair whose plain counts
   already reach the threshold is a link too, so that no weight hides a copy).
4. Components of the verified pairs are the classes.

A bucket's members are dealt to many tasks when their texts are compared, with the one text all of
them are compared to. Only counters of fixed size reach the driver.

With 12 bands of 4 a pair of similarity 0.8 shares no band with probability 0.002. A node is 64 bits of
a hash of the words; n different texts share one with probability n**2 / 2**65.

Cases: documents without words (null, empty, blanks) each form a class of their own. Texts of fewer
than five words have one shingle, all their words. Rows that repeat fall in one class; a class is
named by its least doc_id (null if it has none). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.shared import BLANKS, columns_of, kept_columns, settle, slices

WORDS = 5
COUNTERS = 1 << 18
_RANGES = 64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_LAST = (1 << 63) - 1
_DRAWS = 16      # random nodes of a bucket that an unlinked member is tested against in one round
_ROUNDS = 1      # rounds of such draws, before all pairs that are still apart are tested
_BITS = 1024     # parity bits of a node
_BLOCK = 24_000  # shingles handled at once, so that work arrays stay in the cache


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every lower-cased word, offsets of the texts)."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    coded = flat.filter(keep).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return known[coded.indices.to_numpy()] if len(known) else known, before[offsets - offsets[0]]


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, offsets): texts under five words have one, texts without words none."""
    n = np.diff(offsets)
    sizes = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    out = np.empty(int(sizes.sum()), dtype=np.uint64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    if len(hashes) >= WORDS:
        m = len(hashes) - WORDS + 1
        rolled = hashes[:m] * _ODD[0]
        for k in range(1, WORDS):
            rolled = _mix(rolled) + hashes[k:m + k] * _ODD[k]
        long = np.flatnonzero(n >= WORDS)
        where = np.arange(int(sizes[long].sum())) - np.repeat(np.cumsum(sizes[long]) - sizes[long], sizes[long])
        out[where + np.repeat(edges[long], sizes[long])] = _mix(rolled[where + np.repeat(offsets[long], sizes[long])])
    for d in np.flatnonzero((n > 0) & (n < WORDS)):
        out[edges[d]] = xxhash.xxh64_intdigest(hashes[offsets[d]:offsets[d + 1]].tobytes())
    return out, edges


def weighted_sets(found: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles by document and hash, their counts, offsets)."""
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((found, doc))
    s, d = found[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])) if len(s) else np.empty(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(s)))
    return s[first], counts, np.searchsorted(d[first], np.arange(len(edges)))


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(COUNTERS, dtype=np.int64), 0
    for batch in (part for whole in batches for part in slices(whole, 0)):
        found, edges = shingles(*word_hashes(batch.column(0)))
        docs += batch.num_rows
        doc = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(edges))
        cells = np.unique(doc * COUNTERS + (found >> np.uint64(46)).astype(np.int64))
        df += np.bincount(cells % COUNTERS, minlength=COUNTERS)
    part = df.reshape(_RANGES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(_RANGES), pa.int32()), pa.array([docs if k == 0 else 0 for k in range(_RANGES)], pa.int64()),
                                      pa.array([p.astype("<i8").tobytes() for p in part], pa.binary())], ["part", "docs", "df"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, dtype="<i8") for b in rows["df"])
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "docs": [int(rows["docs"].sum())], "df": [total.tobytes()]})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """1 + ln((1 + N) / (1 + df)) / ln(2 + N) of every hashed counter, over all documents.

    The bounded form keeps edits of a text that has very many copies from outweighing what they share."""
    counted = docs.select("text").mapInArrow(_counters, "part int, docs long, df binary")
    parts = counted.groupBy("part").applyInPandas(_summed, "part int, docs long, df binary").collect()  # 64 rows of fixed size
    df, n = np.zeros((_RANGES, COUNTERS // _RANGES), dtype=np.int64), sum(p["docs"] for p in parts)
    for p in parts:
        df[p["part"]] = np.frombuffer(p["df"], dtype="<i8")
    return (1.0 + np.log((1.0 + n) / (1.0 + np.minimum(df.ravel(), n))) / np.log(2.0 + n)).astype(np.float32)


def _gamma_quantiles(levels: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    p = (np.arange(levels) + 0.5) / levels
    x = np.sqrt(2 * p) + 0.3 * p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
    return x.astype(np.float32)


class Sampler:
    """Improved consistent weighted samples of weighted sets."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        self.seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.r = _gamma_quantiles()

    def samples(self, s: np.ndarray, log_w: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """(documents, samples) codes; every document must have a shingle."""
        starts, sizes = edges[:-1], np.diff(edges)
        out = np.empty((len(starts), len(self.seeds)), dtype=np.uint64)
        scale, half = np.float32(1 / 65536), np.float32(0.5)
        shifted = np.empty_like(s)
        for k, seed in enumerate(self.seeds):
            h = s ^ seed
            for odd, down in ((_ODD[1], np.uint64(32)), (_ODD[3], np.uint64(29))):  # shingles are mixed already
                h *= odd
                h ^= np.right_shift(h, down, out=shifted)
            bits = h.view(np.uint16).reshape(-1, 4)
            r = self.r[bits[:, 0]]
            u = log_w / r
            u += bits[:, 1] * scale
            t = np.floor(u)
            # c is the sum of two exponentials, so it is -ln of the product of two uniforms
            c = (bits[:, 2] + half) * (scale * scale)
            c *= bits[:, 3] + half
            a = np.log(-np.log(c))
            a -= log_w
            u -= t
            u -= np.float32(1)
            u *= r
            a += u
            least = np.minimum.reduceat(a, starts)
            hits = np.flatnonzero(a == np.repeat(least, sizes))
            first = hits[np.searchsorted(hits, starts)]  # shingles are sorted, so ties fall alike everywhere
            out[:, k] = _mix(s[first] + t[first].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """(documents, bands) bucket keys."""
        grouped = codes.reshape(len(codes), self.bands, self.rows)
        key = _mix(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xFF51AFD7ED558CCD))[None, :]
        for k in range(self.rows):
            key = _mix(key ^ grouped[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        return key


def _node(hashes: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else None


def _weights(idf: np.ndarray, s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.float32) * idf[(s >> np.uint64(46)).astype(np.int64)]


def _sketcher(idf, sampler: Sampler):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in (part for whole in batches for part in slices(whole, 1)):
            hashes, offsets = word_hashes(batch.column(1))
            s, counts, edges = weighted_sets(*shingles(hashes, offsets))
            log_w = np.log(_weights(weights, s, counts))
            full = np.flatnonzero(np.diff(edges))
            keys, at = np.zeros((batch.num_rows, sampler.bands), dtype=np.uint64), 0
            while at < len(full):
                stop = max(at + 1, int(np.searchsorted(edges[full], edges[full[at]] + _BLOCK)))
                some = full[at:stop]
                lo, hi = edges[some[0]], edges[some[-1] + 1]
                own = np.append(edges[some], hi) - lo
                keys[some] = sampler.keys(sampler.samples(s[lo:hi], log_w[lo:hi], own))
                at = stop
            nodes = [_node(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            flat = pa.array(keys.view(np.int64).ravel(), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * sampler.bands, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), lists],
                                             ["doc_id", "text_key", "node", "bands"])
    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets given as (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - low
    return low / whole if whole else 0.0


def parities(s: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(documents, _BITS / 64) words of parity bits; a shingle's n-th occurrence is an element of its own."""
    turn = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    bit = _mix(np.repeat(s, counts) ^ (turn.astype(np.uint64) * _ODD[2])) % np.uint64(_BITS)
    doc = np.repeat(np.repeat(np.arange(len(edges) - 1), np.diff(edges)), counts)
    cells, times = np.unique(doc * _BITS + bit.astype(np.int64), return_counts=True)
    cells = cells[times % 2 == 1]
    out = np.zeros((len(edges) - 1) * _BITS // 64, dtype=np.uint64)
    np.bitwise_or.at(out, cells // 64, np.uint64(1) << (cells % 64).astype(np.uint64))
    return out.reshape(len(edges) - 1, -1)


_PARITIES = [f"b{k}" for k in range(_BITS // 64)]
FACTS = ", ".join(["node long, all_n double, all_w double", *[f"{b} long" for b in _PARITIES]])


def _facts(idf):
    """Sums of counts and of weights, and the parity bits of every node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in (part for whole in batches for part in slices(whole, 1)):
            hashes, offsets = word_hashes(batch.column(1))
            s, counts, edges = weighted_sets(*shingles(hashes, offsets))
            # an id may name several texts: only the node's own text counts
            own = np.array([_node(hashes[a:b]) == n for a, b, n in zip(offsets[:-1], offsets[1:], batch.column(0).to_pylist())], dtype=bool)
            sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[edges])
            bits = parities(s, counts, edges).view(np.int64)[own]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[own]), pa.array(sums(counts)[own]), pa.array(sums(_weights(weights, s, counts))[own]),
                                              *[pa.array(np.ascontiguousarray(b)) for b in bits.T]], ["node", "all_n", "all_w", *_PARITIES])
    return run


def _can_reach(threshold: float, by: str) -> str:
    """Whether the sets of facts ``a_`` and ``b_`` can reach the threshold, by counts (``n``) or by weights (``w``).

    Sets are similar if they differ in at most (1 - t) / (1 + t) of their sums; weights are 1 at least. The
    slack covers weights summed in single precision when a pair is verified."""
    share = (1 - threshold) / (1 + threshold) * (1 + 1e-3)
    bits = " + ".join(f"bit_count(a_{b} ^ b_{b})" for b in _PARITIES)
    return f"greatest({bits}, abs(a_all_{by} - b_all_{by})) <= {share} * (a_all_{by} + b_all_{by})"


def _prefixed(facts: DataFrame, side: str, key: str) -> DataFrame:
    return facts.select(F.col("node").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in facts.columns if c != "node"])


def _possible(pairs: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (node, center) that their facts don't rule out."""
    both = pairs.join(_prefixed(facts, "a", "node"), "node").join(_prefixed(facts, "b", "center"), "center")
    return both.where(" or ".join(_can_reach(threshold, k) for k in "nw")).select("node", "center")


def _verifier(idf, threshold: float):
    def weighted(text: str) -> tuple[int | None, tuple, tuple]:
        hashes, offsets = word_hashes(pa.array([text], pa.string()))
        s, counts, _ = weighted_sets(*shingles(hashes, offsets))
        return _node(hashes), (s, _weights(idf.value, s, counts)), (s, counts)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        center = int(rows["center"].iloc[0])
        # an id may name several texts, so each text is held against its node
        middle = next((x for t in rows.loc[rows["node"] == center, "text"] if (x := weighted(t))[0] == center), None)
        near = set()
        for node, text in zip(rows["node"], rows["text"]):
            if middle is None or node == center or node in near:
                continue
            own = weighted(text)
            if own[0] == node and any(similarity(a, b) >= threshold for a, b in zip(middle[1:], own[1:])):
                near.add(int(node))
        return pd.DataFrame({"a": pd.Series(sorted(near), dtype="int64"), "b": pd.Series([center] * len(near), dtype="int64")})
    return run


def _verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float, group: int = 200) -> DataFrame:
    """The pairs (node, center) that are similar; a center's members are dealt to groups of about ``group``."""
    sized = pairs.groupBy("center").agg(F.ceil(F.count("*") / group).alias("groups"))
    members = (pairs.join(texts, "node").join(sized, "center")
               .select("center", "node", "text", F.pmod(F.xxhash64("node"), "groups").alias("part")))
    centers = (sized.join(texts, sized["center"] == texts["node"])
               .select("center", "node", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part")))
    return members.unionByName(centers).groupBy("center", "part").applyInPandas(_verifier(idf, threshold), "a long, b long")


def _busiest(members: DataFrame) -> DataFrame:
    """(key, center): of each bucket the node with the most bucket mates, which stands in the middle of its kind."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    mates = members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("mates"))
    ranked = members.join(mates, "node")
    most = ranked.groupBy("key").agg(F.max("mates").alias("mates"))
    return ranked.join(most, ["key", "mates"]).groupBy("key").agg(F.min("node").alias("center"))


def _labels_of(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``nodes`` with the label of each, its own name where it has no link."""
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _shingled(idf):
    schema = pa.schema([("node", pa.int64()), ("shingle", pa.int64()), ("n", pa.float64()), ("w", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in (part for whole in batches for part in slices(whole, 1)):
            hashes, offsets = word_hashes(batch.column(1))
            s, counts, edges = weighted_sets(*shingles(hashes, offsets))
            # an id may name several texts: only the node's own text counts
            own = np.array([_node(hashes[a:b]) == n for a, b, n in zip(offsets[:-1], offsets[1:], batch.column(0).to_pylist())], dtype=bool)
            keep = np.repeat(own, np.diff(edges))
            node = np.repeat(batch.column(0).to_numpy(), np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(s.view(np.int64)[keep]), pa.array(counts[keep].astype(np.float64)),
                                              pa.array(_weights(weights, s, counts)[keep].astype(np.float64))], schema=schema)
    return run


def _left_apart(members: DataFrame, labels: DataFrame | None, texts: DataFrame, known: DataFrame, idf, threshold: float, deal: int = 500) -> DataFrame:
    """(node, center): every pair of different labels among nodes of crowded buckets that can reach the threshold.

    Similar texts share at least ``threshold`` of the weight of each. In one order of all shingles, the
    rarest first, the first shingle they share is therefore one from which on that much of either text
    is left, so only those shingles are joined, and at that shingle both must have the overlap left that
    the sum of the two asks for. What no other node has cannot be shared, which bounds the similarity of a
    pair from above, and so do the facts of both. A shingle's pairs are dealt to tasks
    on both sides."""
    named = _labels_of(members, labels)
    open_keys = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
    nodes = named.join(open_keys.where("low <> high and size > 2").select("key"), "key").select("node", "label").distinct()
    held = settle(texts.join(nodes.select("node"), "node").select("node", "text").mapInArrow(_shingled(idf), "node long, shingle long, n double, w double"))
    least = threshold * (1 - 1e-4)  # weights are summed in single precision when a pair is verified
    df = held.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    after = Window.partitionBy("node").orderBy(F.desc("df"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("node")
    left = (held.join(df, "shingle").join(known.select("node", "all_n", "all_w"), "node")
            .withColumns({"left_n": F.sum("n").over(after), "left_w": F.sum("w").over(after),
                          "common_n": F.sum("n").over(every), "common_w": F.sum("w").over(every)})
            .where((F.col("left_n") >= least * F.col("all_n")) | (F.col("left_w") >= least * F.col("all_w")))
            .select("node", "shingle", "left_n", "left_w", "common_n", "common_w"))
    postings = settle(left.join(nodes, "node").join(known, "node"))
    kinds = postings.groupBy("shingle", "label").agg(F.count("*").alias("size"))
    parts = kinds.groupBy("shingle").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("size"),
                                         F.max("size").alias("most")).where("size > most")
    parts = parts.select("shingle", "main", F.ceil((F.col("size") - F.col("most")) / deal).alias("rows"), F.ceil(F.col("size") / deal).alias("columns"))
    dealt = postings.join(parts, "shingle")
    part = lambda n: F.pmod(F.xxhash64("node"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    facts = ["node", "label", "all_n", "all_w", "left_n", "left_w", "common_n", "common_w", *_PARITIES]
    one = (dealt.where("label <> main").withColumns({"row": part("rows"), "column": each("columns")})
           .select("shingle", "row", "column", *[F.col(c).alias(f"a_{c}") for c in facts]))
    two = (dealt.withColumns({"column": part("columns"), "row": each("rows")})
           .select("shingle", "row", "column", "main", *[F.col(c).alias(f"b_{c}") for c in facts]))
    reach = " or ".join(f"(least(a_common_{k}, b_common_{k}, a_left_{k}, b_left_{k}) >= {least / (1 + least)} * (a_all_{k} + b_all_{k}) and {_can_reach(threshold, k)})"
                        for k in "nw")
    return (one.join(two, ["shingle", "row", "column"])
            .where(f"a_label <> b_label and (b_label = main or a_node < b_node) and ({reach})")
            .select(F.col("b_node").alias("node"), F.col("a_node").alias("center")).distinct())


def _linked(members: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame | None:
    """(node, label) of the nodes that have a verified link, or nothing.

    The first round tests every member of a bucket against its busiest node. In ``_ROUNDS``
    further ones, while links are found, those that are not in that node's component are tested
    against a few random nodes of each of their buckets. These rounds only join what is joined
    easily: at last every pair that is still apart and can be similar is tested."""
    first = settle(_busiest(members))
    facts = settle(texts.select("node", "text").mapInArrow(_facts(idf), FACTS))
    tested = labels = None
    for turn in range(_ROUNDS + 2):
        last = turn > _ROUNDS or (turn and not found)
        if not turn:
            pairs = members.join(first, "key").select("node", "center")
        elif last:
            pairs = _left_apart(members, labels, texts, facts, idf, threshold)
        else:
            named = _labels_of(members, labels).select("key", "node", "label")
            middle = first.join(labels.withColumnRenamed("node", "center"), "center", "left").select("key", F.coalesce("label", "center").alias("main"))
            apart = named.join(middle, "key").where("label <> main").select("key", "node", "label")
            masks = [int(m) for m in _mix(np.arange(_DRAWS * turn, _DRAWS * (turn + 1), dtype=np.uint64) + np.uint64(1)) >> np.uint64(1)]
            least = [F.min(F.col("node").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)) for m in masks]
            drawn = named.groupBy("key").agg(F.array(*least).alias("centers")).select("key", F.explode("centers").alias("center"))
            other = labels.select(F.col("node").alias("center"), F.col("label").alias("theirs"))
            pairs = (apart.join(drawn, "key").join(other, "center", "left").where("label <> coalesce(theirs, center)").select("node", "center"))
        pairs = pairs.where("node <> center").distinct()
        if tested is not None:
            both = tested.unionByName(tested.select(F.col("center").alias("node"), F.col("node").alias("center"))) if last else tested
            pairs = pairs.join(both, ["node", "center"], "left_anti")
        pairs = settle(_possible(pairs, facts, threshold))
        near = settle(_verified(pairs, texts, idf, threshold))
        found = near.limit(1).count() > 0
        if found:
            known = near if labels is None else near.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
            labels = components(known)
        if last:
            return labels
        tested = pairs if tested is None else tested.unionByName(pairs)


def labelled(docs: DataFrame, threshold: float = 0.8, bands: int = 12, rows: int = 4) -> DataFrame:
    """(doc_id, text_key, label): every row and the component of its text, null for a text without words."""
    docs = kept_columns(docs, "doc_id", "text")
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(docs))  # 2**18 floats
    sketched = settle(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        _sketcher(idf, Sampler(bands, rows)), "doc_id long, text_key long, node long, bands array<long>"))
    placed = sketched.where("node is not null").select("node", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    members = settle(placed.join(shared, "key").distinct())
    ids = F.coalesce("doc_id", F.lit(_LAST))
    involved = members.select("node").distinct()
    rep = sketched.select(ids.alias("id"), "node").join(involved, "node").groupBy("node").agg(F.min("id").alias("id"))
    texts = settle(docs.select(ids.alias("id"), "text").join(rep, "id").select("node", "text"))
    labels = _linked(members, texts, idf, threshold)
    named = sketched.select("doc_id", "text_key", "node")
    if labels is None:
        return named.select("doc_id", "text_key", F.col("node").alias("label"))
    return named.join(labels, "node", "left").select("doc_id", "text_key", F.coalesce("label", "node").alias("label"))


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = 12, rows: int = 4) -> DataFrame:
    """(doc_id, class_id, class_rows): every row and the least doc_id among its near duplicates."""
    named = settle(labelled(docs, threshold, bands, rows))
    of_class = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return named.join(of_class, "label", "left").select(
        "doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_rows", F.lit(1).cast("long")).alias("class_rows"))


def representatives(docs: DataFrame, threshold: float = 0.8, bands: int = 12, rows: int = 4) -> DataFrame:
    """One row of each class, that of the least doc_id (null counts as largest), and all rows without words; own columns."""
    named = settle(labelled(docs, threshold, bands, rows).where("label is not null").withColumn("__id", F.coalesce("doc_id", F.lit(_LAST))))
    least = named.groupBy("label").agg(F.min("__id").alias("__id"))
    keep = (named.join(least, ["label", "__id"]).groupBy("label", "__id").agg(F.min("text_key").alias("__text"))
            .select("__id", "__text"))
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(_LAST)), "__text": F.xxhash64("text")})
    same = Window.partitionBy("__id", "__text").orderBy("__text")  # rows that repeat one another entirely
    kept = keyed.join(keep, ["__id", "__text"]).withColumn("__n", F.row_number().over(same)).where("__n = 1")
    blank = docs.where(~F.coalesce("text", F.lit("")).rlike(BLANKS.replace("[", "[^", 1)))
    return kept.select(columns_of(docs)).unionByName(blank)
