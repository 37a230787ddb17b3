"""Language-model scores from a log-bilinear neural model, trained with noise-contrastive estimation.

Tokens are words (ASCII letters lower-cased) and one end token per text. The model predicts the class
of the next token from the classes of the two before it: h = r[c1] M1 + r[c2] M2, logits = h q + b, and
then the token within its class by counts, so the probabilities of all tokens, one unknown per rare
class included, sum to 1. The most frequent words are classes of their own; the others share classes
by their last two characters.

Gathered from all training texts: the count of every word (a shuffle that grows with the vocabulary),
and the counts of class triples (at most classes**3 rows). Training runs in Spark tasks on shards of
the triples, every one weighted by its count; each round returns the parameters of every task, which are averaged. Scores multiply all
context pairs with the output matrix at once, which gives exactly normalised class log-probabilities.

Counts reach the texts in two ways: the ``known_words`` most frequent words travel to the tasks (a
fixed number), all other words of a text are joined with the stored counts by word.

Cases: a null or empty text is just its end token. Rows that repeat are each scored and counted. A null
doc_id is held out by the crc32 of an empty text, that is not. Without training rows every count is 0
and the model is uniform. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import kept_columns, settle, slices

SINGLES, SHARED = 95, 32
CLASSES = 1 + SINGLES + SHARED  # class 0 is the end token, which also stands before a text
END = ""                        # the end token among the counted words; no word is empty


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, offsets)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return flat.filter(keep), before[offsets - offsets[0]]


def _training_texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(1).filter(pa.array([not is_held_out(d) for d in batch.column(0).to_pylist()], pa.bool_()))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 1, 4 << 20)):
        texts = _training_texts(batch)
        found = pc.value_counts(tokens(texts)[0])
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field("values"), pa.array([END], pa.string())]),
                                          pa.concat_arrays([found.field("counts"), pa.array([len(texts)], pa.int64())])], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all training texts; the end token is the empty word."""
    counted = docs.mapInArrow(_count_words, "word string, n long").where("n > 0")
    return settle(counted.groupBy("word").agg(F.sum("n").alias("n")))


def shared_class(words: pa.Array) -> np.ndarray:
    """Class of words that have none of their own, by their last two characters."""
    coded = pc.utf8_slice_codeunits(words, -2, 1 << 30).dictionary_encode()
    known = np.array([1 + SINGLES + zlib.crc32(w.encode()) % SHARED for w in coded.dictionary.to_pylist()], dtype=np.int64)
    return known[coded.indices.to_numpy()] if len(known) else np.empty(0, dtype=np.int64)


class Lexicon:
    """The most frequent words with counts and classes, and the totals of every class."""

    def __init__(self, words: list[str], counts: list[int], totals: dict[int, tuple[int, int]], n: int, v: int):
        self.words, self.counts = pa.array(words, pa.string()), np.array(counts, dtype=np.int64)
        self.classes = np.concatenate([np.arange(1, min(SINGLES, len(words)) + 1), shared_class(self.words[SINGLES:])]).astype(np.int64)
        self.n, self.v = n, v
        # what a word's class leaves of its probability: (count + 1) / (tokens + types + 1 unknown)
        self.class_mass = np.zeros(CLASSES)
        for c in range(1 + SINGLES, CLASSES):
            self.class_mass[c] = np.log10(sum(totals.get(c, (0, 0))) + 1)
        self.end_count = 0

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place among the frequent words or -1, class) of each word."""
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        classes = np.empty(len(place), dtype=np.int64)
        classes[place >= 0] = self.classes[place[place >= 0]]
        rare = np.flatnonzero(place < 0)
        classes[rare] = shared_class(words.take(pa.array(rare)))
        return place, classes


def lexicon(counts: DataFrame, known_words: int) -> Lexicon:
    top = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(known_words).collect()
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    singles = [r["word"] for r in top[:SINGLES]]
    kind = (F.crc32(F.encode(F.expr("right(word, 2)"), "UTF-8")) % SHARED + 1 + SINGLES).alias("class")
    totals = (counts.where((F.col("word") != END) & ~F.col("word").isin(singles)).groupBy(kind)
              .agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect())
    out = Lexicon([r["word"] for r in top], [r["n"] for r in top], {r["class"]: (r["n"], r["types"]) for r in totals}, whole[0], whole[1])
    out.end_count = whole[2]
    return out


def _sequence(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of class triples of all tokens, ends included, with both contexts; offsets; the classes)."""
    now = np.insert(classes, offsets[1:], 0)
    edges = offsets + np.arange(len(offsets))
    one = np.concatenate([[0], now[:-1]])[:len(now)]
    two = np.concatenate([[0, 0], now[:-2]])[:len(now)]
    two[edges[:-1]] = 0  # a text does not see the one before it
    return (two * CLASSES + one) * CLASSES + now, edges, now


def _count_triples(lex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CLASSES ** 3, dtype=np.int32)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words, offsets = tokens(_training_texts(batch))
            codes, _, _ = _sequence(lex.value.look_up(words)[1], offsets)
            some, n = np.unique(codes, return_counts=True)
            held[some] += n.astype(np.int32)
        codes = np.flatnonzero(held)
        for lo in range(0, len(codes), 100_000):
            some = codes[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some].astype(np.int64))], ["code", "n"])
    return run


# The model ---------------------------------------------------------------------------------------
def initial(size: int, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape)
    return {"r": draw(CLASSES, size), "m1": np.eye(size) + draw(size, size), "m2": draw(size, size), "q": draw(CLASSES, size), "b": np.zeros(CLASSES)}


def train_on(p: dict[str, np.ndarray], codes: np.ndarray, counts: np.ndarray, noise: np.ndarray, seed: int, steps: int,
             blocks: int = 8, samples: int = 48, rate: float = 0.15) -> dict[str, np.ndarray]:
    """Adagrad steps of noise-contrastive estimation on all triples, each with its count as weight.

    A pass deals the contexts into blocks, one step each; ``steps`` are filled up to whole passes. The ``samples``
    noise tokens of a true one enter by their expectation over all classes, so nothing is drawn."""
    rng = np.random.default_rng(seed)
    p = {k: v.copy() for k, v in p.items()}
    past = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    contexts, place = np.unique(codes // CLASSES, return_inverse=True)
    blocks = min(blocks, len(contexts))
    seen = np.zeros((len(contexts), CLASSES))
    np.add.at(seen, (place, codes % CLASSES), counts * (blocks / counts.sum()))
    false = seen.sum(axis=1, keepdims=True) * (samples * noise)
    log_noise = np.log(samples * noise)
    for _ in range(-(-steps // blocks)):
        for some in np.array_split(rng.permutation(len(contexts)), blocks):
            c2, c1 = contexts[some] // CLASSES, contexts[some] % CLASSES
            r1, r2 = p["r"][c1], p["r"][c2]
            h = r1 @ p["m1"] + r2 @ p["m2"]
            certain = 1 / (1 + np.exp(-np.clip(h @ p["q"].T + p["b"] - log_noise, -30, 30)))  # that a token is a true one
            up = seen[some] * (1 - certain) - false[some] * certain
            dh = up @ p["q"]
            g = {"q": up.T @ h, "b": up.sum(axis=0), "m1": r1.T @ dh, "m2": r2.T @ dh, "r": np.zeros_like(p["r"])}
            np.add.at(g["r"], c1, dh @ p["m1"].T)
            np.add.at(g["r"], c2, dh @ p["m2"].T)
            for k in p:
                past[k] += g[k] ** 2
                p[k] += rate * g[k] / np.sqrt(past[k])
    return p


def class_log_probabilities(p: dict[str, np.ndarray]) -> np.ndarray:
    """log10 P(class | two classes before), normalised, for every pair of contexts, as one flat table."""
    h = (p["r"] @ p["m2"])[:, None, :] + (p["r"] @ p["m1"])[None, :, :]
    logits = h.reshape(CLASSES ** 2, -1) @ p["q"].T + p["b"]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return (logits / np.log(10)).ravel()


def train(triples: DataFrame, size: int = 24, rounds: int = 4, tasks: int = 6, steps: int = 250) -> dict[str, np.ndarray]:
    """The model trained on all triples, in shards of whole contexts; each round averages the tasks' parameters."""
    p = initial(size)
    mass = np.ones(CLASSES)
    for r in triples.groupBy((F.col("code") % CLASSES).alias("c")).agg(F.sum("n").alias("n")).collect():
        mass[r["c"]] += r["n"]
    noise = mass / mass.sum()
    shape = {k: v.shape for k, v in p.items()}
    shards = settle(triples.repartition(tasks, F.expr(f"code div {CLASSES}")))

    def learner(start: dict[str, np.ndarray], turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if not rows:
                return
            codes, counts = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(codes)
            new = train_on(start, codes[order], counts[order], noise, 1000 * turn + TaskContext.get().partitionId(), steps, rate=0.15 / (1 + turn))
            flat = np.concatenate([new[k].ravel() for k in shape])
            yield pa.RecordBatch.from_arrays([pa.array([float(counts.sum())]), pa.array([flat.tobytes()], pa.binary())], ["weight", "p"])
        return run

    for turn in range(rounds):
        got = shards.mapInArrow(learner(p, turn), "weight double, p binary").collect()  # one small row per task
        if not got:
            break
        mean = sum(r["weight"] * np.frombuffer(r["p"]) for r in got) / sum(r["weight"] for r in got)
        at = 0
        for k in shape:
            n = int(np.prod(shape[k]))
            p[k], at = mean[at:at + n].reshape(shape[k]), at + n
    return p


# Scores ------------------------------------------------------------------------------------------
def _scorer(shared):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_part", pa.float64()), ("part", pa.float64()), ("rare", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, p = shared.value
        table = class_log_probabilities(p)
        log_count = np.log10(lex.counts + 1.0)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words, offsets = tokens(batch.column(1))
            place, classes = lex.look_up(words)
            known = place >= 0
            base = np.zeros(len(place))
            base[known] = log_count[place[known]]
            inside = np.where(classes > SINGLES, base - lex.class_mass[classes], 0.0)
            codes, edges, _ = _sequence(classes, offsets)
            starts = edges[:-1]
            by_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
            rows = batch.num_rows
            score = np.add.reduceat(table[codes], starts) if rows else np.empty(0)
            rare = words.filter(pa.array(~known))
            cut = np.concatenate([[0], np.cumsum(~known)])[offsets].astype(np.int32)
            doc_ids = batch.column(0).to_pylist()
            end_known = 1 if lex.end_count else 0
            yield pa.RecordBatch.from_arrays([
                pa.array((uuid4().int >> 66) + np.arange(rows), pa.int64()), pa.array(doc_ids, pa.int64()),
                pa.array([is_held_out(d) for d in doc_ids], pa.bool_()), pa.array(np.diff(offsets) + 1, pa.int64()),
                pa.array(by_text(known.astype(np.int64)) + end_known, pa.int64()), pa.array(by_text(base) + np.log10(lex.end_count + 1.0)),
                pa.array(score + by_text(inside)), pa.ListArray.from_arrays(pa.array(cut), rare)], schema=schema)
    return run


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_part double, part double, rare array<string>"


def scores(docs: DataFrame, known_words: int = 1 << 17) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every text."""
    sc = docs.sparkSession.sparkContext
    docs = kept_columns(docs, "doc_id", "text")
    counts = word_counts(docs)
    lex = lexicon(counts, known_words)
    told = sc.broadcast(lex)
    triples = settle(docs.mapInArrow(_count_triples(told), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    model = train(triples)
    rows = settle(docs.mapInArrow(_scorer(sc.broadcast((lex, model))), SCORED))
    rare = (rows.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row")
            .agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("more_known")))
    more = F.coalesce("more", F.lit(0.0))
    return (rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_part", "part").join(rare, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(lex.n).cast("long").alias("train_tokens"),
                    (F.col("base_part") + more - F.col("n_tokens") * F.log10(F.lit(float(lex.n + lex.v + 1)))).alias("base_score"),
                    (F.col("part") + more).alias("score")))
