import hashlib
import random

import numpy as np

from shelfwise.llm import anchors, queries
from tests.llm.conftest import SMALL


def by_force(rows, window):
    """Per row: doc_id, number of words, removed runs and kept text."""
    order = lambda i: float("inf") if i is None else i
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            s = tuple(w[k:k + window])
            least[s] = min(least.get(s, float("inf")), order(i))
    out = []
    for i, w in words:
        gone, seen = [False] * len(w), set()
        for k in range(len(w) - window + 1):
            s = tuple(w[k:k + window])
            if least[s] < order(i) or s in seen:
                gone[k:k + window] = [True] * window
            seen.add(s)
        runs = [(k, next((j for j in range(k, len(w)) if not gone[j]), len(w))) for k in range(len(w)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((i, len(w), tuple(runs), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, tuple((s.start, s.end) for s in r.removed), r.kept) for r in df.collect()), key=str)


def test_words_are_split_at_the_six_blanks():
    text = "  a\tb\x0bc\x0cd\re\nf g h\x1ci \x85j ".encode()
    starts, ends = anchors.word_places(np.frombuffer(text, dtype=np.uint8))
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()


def test_names_follow_words_not_places():
    text = np.frombuffer(b"one two  one\ttwo three " * 3000 + b"x" * 300_000 + b" one", dtype=np.uint8)
    starts, ends = anchors.word_places(text)
    names, words = anchors._word_names(text, starts, ends), text.tobytes().split()
    assert len(set(names.tolist())) == 4 == len(set(zip(words, names.tolist())))


def test_repeats_equal_brute_force_over_many_chunks(docs):
    rng = random.Random(4)
    shared = [rng.choice("ab cd ef gh é".split()) + str(rng.randrange(60)) for _ in range(300)]
    rows = []
    for i in range(80):
        a, n = rng.randrange(280), rng.choice([4, 5, 6, 7, 12, 40])
        own = [rng.choice("xyz") + str(rng.randrange(3)) for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(own + shared[a:a + n] + [f"u{i}"] + shared[:rng.randrange(12)])))
    rows += [(90, rows[3][1]), (91, rows[3][1]), (90, rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (92, None), (93, ""), (94, "a b c"), (95, "a b c"),
             (96, "same word " * 50), (97, " ".join(rows[7][1].split()))]
    assert found(anchors.repeated(docs(rows), window=6, chunk_bytes=700, bucket_names=64)) == by_force(rows, 6)


def test_a_passage_that_most_documents_hold_stays_once(docs):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(k, f"a{k} b{k} {passage} c{k}") for k in range(300)]
    got = found(anchors.repeated(docs(rows), chunk_bytes=2000))
    assert got == by_force(rows, 20) and sum(bool(r[2]) for r in got) == 299


def test_the_query_equals_brute_force_on_the_small_tables(spark, small_docs):
    want = {i: (n, sum(b - a for a, b in runs), hashlib.sha256(kept.encode()).hexdigest()) for i, n, runs, kept in by_force(small_docs, 20)}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op12_repeated_passages(spark, SMALL).collect()} == want


def test_odd_rows(odd, none):
    got = found(anchors.repeated(odd))
    assert got == by_force([(r.doc_id, r.text) for r in odd.collect()], 20)
    assert anchors.repeated(none).count() == 0
