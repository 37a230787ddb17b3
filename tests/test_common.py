import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from shelfwise.operators import common

D0 = date(2026, 1, 1)


def test_global_rank_equals_sorted_order_with_a_hot_group(spark, make):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(5)}", f"k{i}", float(rng.randrange(20))) for i in range(3000)]
    df = make("g string, k string, v double", rows).repartition(7)
    got = {(r.g, r.k): (r.rank_idx, r.rank_n) for r in common.global_rank(df, [F.desc("v"), F.asc("k")], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        for i, r in enumerate(ordered):
            assert got[(g, r[1])] == (i, len(ordered))
    whole = {r.k: r.rank_idx for r in common.global_rank(df, [F.desc("v"), F.asc("k")]).collect()}
    for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[1]))):
        assert whole[r[1]] == i


def test_global_rank_spreads_a_group_that_holds_all_rows(spark, make):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("false", "-1", "16")):
            spark.conf.set(k, v)
        ranked = common.global_rank(make("g string, k int", [("all", i) for i in range(4000)]), [F.asc("k")], ["g"])
        parts = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(parts) == 4000 and max(parts) < 2000


def test_fraction_class_cut_offs_are_half_even_with_minimum_sizes(spark):
    def classes(n):
        df = spark.range(n).select(common.fraction_class(F.col("id"), F.lit(n), 0.2, 0.5).alias("c"), "id").orderBy("id")
        return "".join(r.c for r in df.collect())
    assert classes(1) == "A"
    assert classes(2) == "AB"
    assert classes(10) == "AABBBCCCCC"
    assert classes(5) == "ABCCC"  # round(2.5) is 2
    assert classes(7) == "ABBBCCC"  # round(1.4) is 1, round(3.5) is 4


def test_top_per_group_matches_a_plain_ranking(make):
    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), i, rng.randrange(50)) for i in range(2000)]
    df = make("g string, i int, v int", rows)
    got = sorted((r.g, r.i) for r in common.top_per_group(df, ["g"], [F.desc("v"), F.asc("i")], 7).collect())
    want = [(g, r[1]) for g in "ab" for r in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1]))[:7]]
    assert got == sorted(want)


def test_latest_and_first_row_keep_whole_rows(make):
    df = make("k string, d date, v int", [("a", D0, 1), ("a", D0 + timedelta(1), 2), ("b", D0, 3)])
    assert sorted(tuple(r) for r in common.latest_row(df, ["k"], ["d"]).collect()) == [("a", D0 + timedelta(1), 2), ("b", D0, 3)]
    assert sorted(tuple(r) for r in common.first_row(df, ["k"], ["d"]).collect()) == [("a", D0, 1), ("b", D0, 3)]


def test_longest_streak_across_a_month_end(make):
    days = [date(2026, 1, 30), date(2026, 1, 31), date(2026, 2, 1), date(2026, 2, 2), date(2026, 2, 10), date(2026, 2, 11)]
    df = make("k string, d date", [("a", d) for d in days] + [("b", D0)])
    assert {r.k: r.streak for r in common.longest_streak(df, ["k"], "d").collect()} == {"a": 4, "b": 1}


def test_most_frequent_breaks_ties_by_value(make):
    df = make("k string, v string", [("a", "y"), ("a", "x"), ("b", "z"), ("b", "z"), ("b", "a")])
    assert {r.k: r.m for r in common.most_frequent(df, ["k"], "v", "m").collect()} == {"a": "x", "b": "z"}


def test_fill_from_keeps_old_values_where_new_is_unknown(make):
    old = make("k string, a int, b int", [("x", 1, 1), ("y", 2, 2)])
    new = make("k string, a int", [("x", None), ("y", 9)])
    got = sorted((r.k, r.a, r.b) for r in common.fill_from(old, new, ["k"], ["a"]).collect())
    assert got == [("x", 1, 1), ("y", 9, 2)]


def test_newest_first_orders_like_day_and_value(make):
    d = date(2026, 3, 1)
    rows = [(d, 5.0), (d, -2.5), (d, None), (date(1960, 1, 1), 99_999_999.0), (d, 5.0001), (None, 7.0), (date(2026, 3, 2), -99_999_999.0)]
    got = make("day date, v double", rows).orderBy(common.newest_first("day", "v")).collect()
    low = date.min
    assert [tuple(r) for r in got] == sorted(rows, key=lambda r: (r[0] or low, float("-inf") if r[1] is None else r[1]))
