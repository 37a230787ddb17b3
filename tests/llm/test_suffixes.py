import hashlib
import random

import numpy as np

from shelfwise.llm import queries, suffixes
from tests.llm.conftest import SMALL


def removed_by_force(rows, depth=50):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - depth + 1):
            first[b[k:k + depth]] = min(order(i), first.get(b[k:k + depth], float("inf")))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone, end = [], -1
        for k in range(len(b) - depth + 1):
            if first[b[k:k + depth]] < order(i):
                if gone and k <= end:
                    gone[-1][1] = end = k + depth
                else:
                    gone.append([k, k + depth])
                    end = k + depth
        out.append((i, len(b), tuple(map(tuple, gone))))
    return sorted(out, key=str)


def test_the_cover_meets_every_difference():
    steps = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert steps == set(range(suffixes.PERIOD))


def test_sorted_numbers_survive_packing():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 1000, dtype=np.uint64))
    assert (suffixes.unpack_sorted(suffixes.pack_sorted(x), "<u8") == x).all()


def test_spans_equal_brute_force_over_many_chunks(docs):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcd é") for _ in range(400))
    rows = []
    for i in range(60):
        a, n = rng.randrange(300), rng.choice([20, 49, 50, 51, 90])
        rows.append((i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(80))) + passage[a:a + n] + str(i) * 60 + passage[:rng.randrange(120)]))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (70, rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (72, None), (73, "")]
    got = suffixes.repeated(docs(rows), chunk_bytes=900, bucket_names=64).collect()
    assert sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.removed)) for r in got), key=str) == removed_by_force(rows)


def test_the_query_equals_brute_force_on_the_small_tables(spark, small_docs):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_suffix_dedup(spark, SMALL).collect()}
    text = {i: (t or "").encode() for i, t in small_docs}
    for i, n, gone in removed_by_force(small_docs):
        kept, at = b"", 0
        for a, b in gone:
            kept, at = kept + text[i][at:a], b
        assert got[i] == (n, sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept + text[i][at:]).hexdigest())


def test_odd_rows(odd, none):
    rows = suffixes.repeated(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id in (5, 6)}
    assert not by_id[5].removed and len(by_id[6].kept) == 0  # the copy goes whole
    assert suffixes.repeated(none).count() == 0
