import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from shelfwise.llm import decontaminate, lm, neardup, packing, pii, quality, queries
from tests.llm.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in queries.op10_lm_scores(spark, SMALL).collect()}


def check_base(rows, got):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = collections.Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for (i, t), g in zip(rows, got):
        ws = tokens(t)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(i), len(ws), sum(x in counts for x in ws), n)
        assert math.isclose(g.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ws), rel_tol=1e-9, abs_tol=1e-9)


def test_base_scores_equal_brute_force(small_docs, scored):
    check_base(small_docs, [scored[i] for i, _ in small_docs])


def test_the_model_beats_the_base_on_held_out_texts(scored):
    held = [g for g in scored.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_rare_words_meet_their_counts_by_join(docs, small_docs):
    rows = small_docs[:60]
    got = {r.doc_id: r for r in lm.scores(docs(rows), known_words=120).collect()}
    check_base(rows, [got[i] for i, _ in rows])


def test_class_probabilities_sum_to_one():
    table = lm.class_log_probabilities(lm.initial(8)).reshape(-1, lm.CLASSES)
    assert np.allclose((10 ** table).sum(axis=1), 1)


def test_words_of_a_class_sum_to_one():
    words = ["the"] + [f"w{k}" for k in range(95)] + ["xab", "yab", "zab"]
    counts = list(range(200, 200 - len(words), -1))
    kind = int(lm.shared_class(pa.array(["xab"]))[0])
    own = [k for k, w in enumerate(words[lm.SINGLES:], lm.SINGLES) if lm.shared_class(pa.array([w]))[0] == kind]
    lex = lm.Lexicon(words, counts, {kind: (sum(counts[k] for k in own), len(own))}, 0, 0)
    known = sum(10 ** (math.log10(counts[k] + 1) - lex.class_mass[kind]) for k in own)
    assert math.isclose(known + 10 ** -lex.class_mass[kind], 1)  # and one unknown


def test_noise_contrastive_training_learns_a_pattern():
    codes = np.array([(a * lm.CLASSES + b) * lm.CLASSES + (b + 1) % 5 for a in range(5) for b in range(5)])
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    p = lm.train_on(lm.initial(16), codes, np.ones(len(codes), dtype=np.int64), noise, 1, 400)
    table = lm.class_log_probabilities(p)
    assert table[codes].mean() > math.log10(0.5)


def test_training_weighs_all_counts_and_draws_none():
    codes, counts = np.array([3, 4, 5]), np.array([7_000_000, 2_000_000, 1_000_000])
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    p, q = (lm.train_on(lm.initial(16), codes, counts, noise, seed, 400) for seed in (1, 2))
    assert all(np.array_equal(p[k], q[k]) for k in p)
    assert np.allclose(10 ** lm.class_log_probabilities(p)[codes], counts / counts.sum(), atol=0.01)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = lm.scores(odd, known_words=50).collect()
    assert len(got) == len(rows) and all(math.isfinite(g.score) for g in got)
    key = lambda x: (str(x[0]), len(tokens(x[1])))
    check_base(sorted(rows, key=key), sorted(got, key=lambda g: (str(g.doc_id), g.n_tokens)))
    assert lm.scores(none).count() == 0


def test_the_pipeline_equals_its_stages_by_force(spark, table, small_docs):
    """Every stage's decision recomputed on what the one before kept."""
    judged = {r.doc_id for r in quality.judged(table("documents")).where("kept").collect()}
    rows = {i: t for i, t in small_docs if i in judged}
    kept = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    firsts = {r.class_id for r in neardup.classes(kept).collect()}
    rows = {i: t for i, t in rows.items() if i in firsts}
    items = [decontaminate.question_and_answer(r.text) for r in table("benchmark").collect()]
    words = lambda t: " ".join(decontaminate.tokens(pa.array([t]))[0].to_pylist())
    whole = [" ".join(q + a) for q, a in items]
    rows = {i: t for i, t in rows.items() if not any(w in words(t) for w in whole)}
    want = {}
    for i, t in rows.items():
        for kind, a, b in pii._merged(sum(pii.find(t), [])):
            t = f"{t[:a]}<{kind}>{t[b:]}"
        want[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1
    got = corpus_pipeline.run(spark, SMALL).collect()
    total = collections.Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert dict(total) == want
    bounds = packing.best_bounds(*map(list, zip(*collections.Counter(r.n_tokens for r in got).items())), 16)
    assert {r.bucket_tokens for r in got} == set(bounds)


def test_stages_keep_the_columns_and_survive_odd_rows(spark, odd, none):
    for rows in (odd, none):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SMALL)
            out.count()
            if name != "length_packing":
                assert set(out.columns) == set(docs.columns)
