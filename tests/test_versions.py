from datetime import date, timedelta

import pytest

from shelfwise.sources import versions

ROWS = "k string, v int, seq long, day date"
START = date(2024, 1, 1)


def day(n):
    return START + timedelta(days=n)


@pytest.fixture
def store(spark, make, tmp_path):
    path = str(tmp_path / "table")
    schema = make(ROWS, []).schema

    class Store:
        def put(self, rows, label=None):
            return versions.upsert(spark, make(ROWS, rows), path, ["k"], "day", "seq", label)

        def rows(self, version=None):
            return sorted(tuple(r) for r in versions.read(spark, path, schema, "day", version).collect())

        def opened(self, days):
            return versions.read(spark, path, schema, "day", days=days).inputFiles()

        def possible(self, rows):
            return set(versions.possible_days(spark, path, make(ROWS, rows), ["k"]))
    return Store()


def test_the_newest_row_is_by_sequence_whatever_its_day_and_arrival(store):
    assert store.rows() == []
    assert store.put([("a", 1, 5, day(3)), ("b", 1, 5, day(3)), ("c", 1, 5, day(9)), ("c", 0, 4, day(8))]) == 1
    # a correction under an earlier day wins, a late old row loses, a day may lose its last row
    assert store.put([("c", 2, 6, day(1)), ("a", 9, 4, day(20)), ("d", 1, 1, day(3))]) == 2
    assert store.rows() == [("a", 1, 5, day(3)), ("b", 1, 5, day(3)), ("c", 2, 6, day(1)), ("d", 1, 1, day(3))]
    assert store.rows(version=1) == [("a", 1, 5, day(3)), ("b", 1, 5, day(3)), ("c", 1, 5, day(9))]
    assert store.put([]) == 2


def test_a_label_is_committed_once(store):
    assert store.put([("a", 1, 1, day(0))], "batch-0") == 1
    assert store.put([("a", 7, 9, day(0))], "batch-0") == 1
    assert store.rows() == [("a", 1, 1, day(0))]


def test_a_run_that_dies_leaves_the_old_version(store, monkeypatch):
    store.put([("a", 1, 1, day(0)), ("b", 1, 1, day(1))])
    before = store.rows()

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", dies)
        with pytest.raises(OSError):
            store.put([("a", 2, 2, day(1)), ("z", 1, 1, day(5))])
    assert store.rows() == before
    store.put([("a", 2, 2, day(1)), ("z", 1, 1, day(5))])
    assert store.rows() == [("a", 2, 2, day(1)), ("b", 1, 1, day(1)), ("z", 1, 1, day(5))]


def test_only_days_whose_filter_may_hold_a_key_are_read(store):
    store.put([(f"k{n}-{j}", j, 1, day(n)) for n in range(150) for j in range(4)])
    assert day(77) in store.possible([("k77-1", 0, 2, day(140))])
    found = store.possible([("k77-1", 0, 2, day(140)), ("k3-0", 0, 2, day(140)), ("new", 0, 2, day(140))])
    assert found >= {day(3), day(77)} and len(found) <= 3
    opened = store.opened(sorted(found))
    assert opened and {f.rsplit("day=", 1)[1][:10] for f in opened} == {str(d) for d in found}
    store.put([("k77-1", 50, 2, day(140))])
    assert [r for r in store.rows() if r[0] == "k77-1"] == [("k77-1", 50, 2, day(140))] and len(store.rows()) == 600


def test_filters_find_days_before_the_epoch(store):
    old = date(1969, 12, 30)
    store.put([("a", 1, 1, old), ("b", 1, 1, date(1970, 1, 1))])
    assert store.possible([("a", 0, 0, day(0))]) == {old}
    store.put([("a", 2, 2, day(0))])
    assert store.rows() == [("a", 2, 2, day(0)), ("b", 1, 1, date(1970, 1, 1))]
