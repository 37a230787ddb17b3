import itertools
import random
import re

from shelfwise.llm import packing, queries
from tests.llm.conftest import SMALL


def padding(sizes, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts))


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(150):
        sizes = rng.sample(range(1, 40), rng.randint(1, 9))
        counts, k = [rng.randint(1, 9) for _ in sizes], rng.randint(1, 5)
        got = packing.best_bounds(sizes, counts, k)
        best = min(padding(sizes, counts, [*s, max(sizes)]) for r in range(min(k, len(sizes)))
                   for s in itertools.combinations(sorted(sizes)[:-1], r))
        assert len(got) <= k and padding(sizes, counts, got) == best


def check(rows, texts, max_tokens, batch_tokens):
    """Every token in exactly one piece, every piece in one slot, every batch within its budget and full but the last."""
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    want = {}
    for i, t in texts:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        if n:
            want.setdefault(i, []).append(n + 1)
    for i, sizes in want.items():
        assert sum(n for _, n in seen[i]) == sum(sizes)
    assert set(seen) == set(want)
    slots = {(r.bucket, r.batch, r.slot) for r in rows}
    assert len(slots) == len(rows)
    for b in {r.bucket for r in rows}:
        own = [r for r in rows if r.bucket == b]
        room = batch_tokens // own[0].bucket_tokens
        assert all(r.n_tokens <= r.bucket_tokens and r.slot < room for r in own)
        assert {(r.batch, r.slot) for r in own} == {divmod(k, room) for k in range(len(own))}


def test_the_query_packs_every_token_once(spark, small_docs):
    check(queries.op3_packing(spark, SMALL).collect(), small_docs, 4096, 65536)


def test_odd_rows_and_many_shards(odd, none):
    rows = packing.packed(odd, buckets=3, max_tokens=500, batch_tokens=1000, shard_rows=7).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()], 500, 1000)
    assert packing.packed(none).count() == 0
