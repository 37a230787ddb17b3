import collections
import math

import pyarrow as pa

from shelfwise.llm import decontaminate as D
from shelfwise.llm import queries
from tests.llm.conftest import SMALL

ITEM = "What is the tallest tower in the old town of Velm? The tallest tower is the grey bell tower by the river."


def words(t):
    return D.tokens(pa.array([t]))[0].to_pylist()


def by_force(docs, items, threshold=0.6, overlap=0.5):
    """Every passage of every length class against every item, all scores in full."""
    tf = {k: collections.Counter(words(t)) for k, t in items}
    df = collections.Counter(t for c in tf.values() for t in c)
    n, mean = len(items), sum(sum(c.values()) for c in tf.values()) / len(items)
    impact = {}
    for k, c in tf.items():
        w = {t: math.log1p((n - df[t] + .5) / (df[t] + .5)) * f * 2.2 / (f + 1.2 * (.25 + .75 * sum(c.values()) / mean)) for t, f in c.items()}
        impact[k] = {t: x / sum(w.values()) for t, x in w.items()}
    sizes = {k: sum(c.values()) for k, c in tf.items()}
    top = lambda s: max(16, 1 << (s - 1).bit_length())
    window = {k: 2 * max(x for x in sizes.values() if top(x) == top(s)) for k, s in sizes.items()}
    grams = lambda ws: {tuple(ws[i:i + 3]) for i in range(len(ws) - 2)}
    found = set()
    for d, text in docs:
        ws = words(text)
        for k, t in items:
            for at in range(0, max(1, len(ws)), window[k] // 2):
                part = ws[at:at + window[k]]
                if sum(impact[k].get(x, 0) for x in set(part)) >= threshold:
                    q, a = (grams(p) for p in D.question_and_answer(t))
                    g = grams(part)
                    if all(len(x & g) >= overlap * len(x) for x in (q, a)):
                        found.add((d, k))
    return found


def test_the_query_equals_brute_force(spark, table, small_docs):
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, SMALL).collect()}
    assert got and got == by_force(small_docs, items)


def test_edited_items_are_found_and_parts_are_not(spark, docs):
    bench = spark.createDataFrame([(1, ITEM), (2, "Name the largest lake beyond the hills. It is the lake of seven islands."), (3, None), (4, "")],
                                  "item_id long, text string")
    rows = [(1, "filler words " * 200 + ITEM + " more filler" * 50), (2, ITEM.upper().replace("GREY", "GRAY")),
            (3, "What is the tallest tower in the old town?"), (4, "a clean text about towers and rivers in the old town")]
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs(rows), bench).collect()} == {(1, 1), (2, 1)}
    assert {r.doc_id for r in D.clean(docs(rows), bench).collect()} == {3, 4}
    split = {(r.doc_id, r.item_id) for r in D.leaks(docs(rows), bench, shard_items=1).collect()}  # shards change nothing
    assert split == {(1, 1), (2, 1)}


def test_odd_rows(spark, odd, none, table):
    assert D.leaks(odd, table("benchmark")).count() == 0
    assert D.clean(odd, table("benchmark")).count() == odd.count() and D.clean(odd, table("benchmark")).columns == odd.columns
    assert D.leaks(none, table("benchmark")).count() == 0
    assert D.leaks(odd, table("benchmark").where("false")).count() == 0
