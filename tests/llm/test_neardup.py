import random

import numpy as np
import pyarrow as pa

from shelfwise.llm import neardup, queries
from shelfwise.llm.components import components
from shelfwise.llm.shared import settle
from tests.llm.conftest import SMALL


def classes_by_force(rows, idf, threshold=0.8):
    sets = {}
    for k, (_, t) in enumerate(rows):
        s, counts, _ = neardup.weighted_sets(*neardup.shingles(*neardup.word_hashes(pa.array([t], pa.string()))))
        if len(s):
            sets[k] = ((s, counts * idf[(s >> np.uint64(46)).astype(np.int64)]), (s, counts))
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if top(a) != top(b) and any(neardup.similarity(x, y) >= threshold for x, y in zip(sets[a], sets[b])):
                label[top(b)] = top(a)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(top(k), []).append(rows[k][0])
    return sorted(sorted(g) for g in groups.values())


def grouped(got):
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, []).append(r.doc_id)
    return sorted(sorted(g) for g in groups.values())


def test_the_query_equals_all_pairs(spark, small_docs, table):
    idf = neardup.inverse_frequencies(table("documents"))
    assert grouped(queries.op7_near_duplicates(spark, SMALL).collect()) == classes_by_force(small_docs, idf)


def test_counters_hold_document_frequencies(docs):
    rows = [(i, "one two three four five" + (" six" if i < 3 else "")) for i in range(10)]
    idf = neardup.inverse_frequencies(docs(rows))
    levels = sorted(set(np.round(idf.astype(float), 4)))
    want = sorted({round(float(1 + np.log(11 / (1 + df)) / np.log(12)), 4) for df in (0, 3, 10)})
    assert np.allclose(levels, want, atol=2e-4)


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(7)
    s = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    wa, wb = rng.gamma(2, 1, 400).astype(np.float32), rng.gamma(2, 1, 400).astype(np.float32)
    wb[:250] = wa[:250]
    codes = neardup.Sampler(128, 8).samples(np.concatenate([s, s]), np.log(np.concatenate([wa, wb])), np.array([0, 400, 800]))
    want = neardup.similarity((s, wa), (s, wb))
    assert abs((codes[0] == codes[1]).mean() - want) < 4 * (want * (1 - want) / codes.shape[1]) ** 0.5


def test_facts_rule_out_no_similar_pair():
    rng = np.random.default_rng(2)
    pool = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(40):
        base = list(rng.choice(pool, rng.integers(5, 300)))
        for edits in (0, 1, 2, 5):
            new = list(base)
            for k in rng.integers(0, len(base), edits):
                new[k] = str(rng.choice(pool))
            texts.append(" ".join(new + base[:20] * int(rng.integers(0, 2))))
    s, counts, edges = neardup.weighted_sets(*neardup.shingles(*neardup.word_hashes(pa.array(texts, pa.string()))))
    bits, found = neardup.parities(s, counts, edges), 0
    sets = [(s[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            low = np.minimum(*[x[1][np.searchsorted(x[0], m := np.intersect1d(a[0], b[0]))] for x in (a, b)]).sum()
            differ = a[1].sum() + b[1].sum() - 2 * low
            lower = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            assert lower <= differ
            found += lower > differ / 4
    assert found > 1000  # and they rule out much


def test_a_large_group_of_edits_and_a_common_passage(docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(150)], [word() for _ in range(40)]
    rows = [(0, " ".join(base))]
    for i in range(1, 80):  # two edits leave 0.87
        edited = list(base)
        for k in rng.sample(range(150), 2):
            edited[k] = word()
        rows.append((i, " ".join(edited)))
    rows += [(i, " ".join([word() for _ in range(120)] + passage)) for i in range(100, 160)]
    rows += [(200, rows[70][1].upper()), (201, rows[80][1])]
    got = grouped(neardup.classes(docs(rows)).collect())
    assert got == sorted([list(range(80)) + [200], [100, 201], *[[i] for i in range(101, 160)]])
    kept = {r.doc_id for r in neardup.representatives(docs(rows)).collect()}
    assert kept == {g[0] for g in got}


def test_a_pair_inside_a_crowded_bucket_is_found_without_a_draw(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(90)])) for i in range(60)]
    for i in (7, 23):  # two copies with an edit, in one bucket with 60 texts that have little in common
        copy = rows[i][1].split()
        copy[100] = word()
        rows.append((100 + i, " ".join(copy)))
    node = {i: neardup._node(neardup.word_hashes(pa.array([t], pa.string()))[0]) for i, t in rows}
    members = spark.createDataFrame([(n, 1) for n in node.values()], "node long, key long")
    texts = spark.createDataFrame([(node[i], t) for i, t in rows], "node long, text string")
    idf = spark.sparkContext.broadcast(neardup.inverse_frequencies(docs(rows)))
    groups = {}
    for r in neardup._linked(members, texts, idf, 0.8).collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted((node[i], node[100 + i])) for i in (7, 23))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_odd_rows(odd, none):
    rows = neardup.classes(odd).collect()
    assert len(rows) == odd.count()
    named = sorted((r.doc_id, r.class_id, r.class_rows) for r in rows if r.doc_id is not None)
    assert named == [(1, 1, 3), (1, 1, 3), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 2), (6, 5, 2), (7, 7, 1)]
    kept = neardup.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "None"])
    assert neardup.classes(none).count() == 0 and neardup.representatives(none).count() == 0


def test_a_step_of_components_is_one_join_and_one_grouping(spark):
    edges = settle(spark.createDataFrame([(i, 50) for i in range(100) if i != 50], "a long, b long"))
    spark.sparkContext.setJobGroup("components", "a star: one step, and one that moves nothing")
    labels = components(edges)
    status = spark.sparkContext.statusTracker()
    stages = {k for j in status.getJobIdsForGroup("components") for k in status.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("", "")
    assert {r.label for r in labels.collect()} == {0}
    assert len(stages) <= 14  # the driver keeps a record of every task
