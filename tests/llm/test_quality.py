import re

import duckdb
import pytest

from shelfwise.llm import quality, queries
from shelfwise.llm.sql import ORACLE
from tests.compare import differences, duck
from tests.llm.conftest import SMALL


def repeat_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k:k + 3]), []).append(k)
    return len({k + o for places in seen.values() if len(places) > 1 for k in places for o in range(3)})


def test_the_query_equals_its_sql(spark):
    problems, rows, _ = differences(queries.op4_quality(spark, SMALL), duck(SMALL), ORACLE["op4_quality"])
    assert rows and not problems


TEXTS = ["a a a a a", "a b c a b c", "a b c d", "", None, "a b a b a b a b x y z", "x " * 300, "b a\na b\tb a a b b b a " * 9]


@pytest.mark.parametrize("bits", [24, 60, 2])
def test_repeated_windows_also_where_hashes_meet(spark, docs, monkeypatch, bits):
    monkeypatch.setattr(quality, "_POSITION_BITS", bits)
    sql = quality._over_text(quality._repeat_words("__words"))
    got = {r.doc_id: r.n for r in docs(list(enumerate(TEXTS))).selectExpr("doc_id", f"{sql} as n").collect()}
    assert got == {i: repeat_words(t) for i, t in enumerate(TEXTS)}


def test_the_cascade_keeps_what_the_verdict_keeps(table):
    kept = {r.doc_id for r in quality.judged(table("documents")).where("kept").collect()}
    out = quality.cascade(table("documents"))
    assert {r.doc_id for r in out.collect()} == kept and out.columns == table("documents").columns


def test_rules_are_ordered_by_rejection_per_cost(table):
    measured = quality.plan(table("documents"), repeats=1)
    value = [share / max(seconds, 1e-6) for _, seconds, share in measured]
    assert value == sorted(value, reverse=True) and {m[0].name for m in measured} == {r.name for r in quality.RULES}


def test_clean_texts_of_the_labels_stay(table):
    """No text labelled good is lost by any rule but the base ones."""
    judged = quality.judged(table("documents")).join(table("labels"), "doc_id")
    assert judged.where("quality = 1 and not base_failed and not kept").count() == 0
    assert judged.where("quality = 0 and not base_failed and kept").count() == 0


def test_no_python_on_the_main_path(table):
    plan = quality.judged(table("documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd, none):
    rows = quality.judged(odd).collect()
    assert len(rows) == odd.count() and all(r.base_failed for r in rows if r.doc_id in (1, 2, 3, 4, None))
    assert quality.cascade(odd).columns == odd.columns
    assert quality.judged(none).count() == 0 and quality.cascade(none).count() == 0


def test_duckdb_reads_the_same_words():
    assert duckdb.sql(r"SELECT regexp_extract_all('a' || chr(11) || 'b c', '[^\x20\x09-\x0D]+')").fetchall()[0][0] == ["a", "b", "c"]
