"""The streamed alert lifecycle against the batch form, run by run, and its cases by hand."""

from datetime import date, timedelta

from pyspark.sql.types import StructField, StructType

from shelfwise.operators import alerts
from shelfwise.streaming import alert_stream

DDL = StructType([StructField(*f) for f in alert_stream.ALERT])
FIRST = date(2026, 3, 20)


def row(day, kind, sku, impact=1.0, text="x"):
    return (day, kind, "warning", sku, "L", None, None, text, f"{kind}|{sku}", impact)


def table(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def fixed(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_stream_equals_batch_over_runs(spark, make, tmp_path):
    """Keys stay, vanish, return, are given twice in a run; a run without alerts closes the auto-resolved ones; the
    other types stay open and go on; a row is acknowledged twice and the earlier mark counts."""
    days = [FIRST + timedelta(days=i) for i in range(5)]
    runs = [
        [row(days[0], "LOW_SUPPLY", "A"), row(days[0], "LOW_SUPPLY", "B"), row(days[0], "SUPPLIER_RISK", "S"), row(days[0], "LOW_SUPPLY", "A", 7.0, "more")],
        [row(days[1], "LOW_SUPPLY", "A", 2.0, "again"), row(days[1], "LOW_SUPPLY", "C")],
        [],
        [row(days[3], "LOW_SUPPLY", "A"), row(days[3], "SUPPLIER_RISK", "S", 5.0, "back")],
        [row(days[4], "LOW_SUPPLY", "A")],
    ]
    folder, log, checkpoint = (f"{tmp_path}/{x}" for x in ("landed", "log", "checkpoint"))
    state = None
    for i, (day, rows) in enumerate(zip(days, runs)):
        current = make(DDL, rows)
        state = fixed(spark, alerts.advance(alerts.empty_state(current) if state is None else state, current, day))
        alert_stream.land_run(current, folder, day)
        alert_stream.load(spark, folder, log, checkpoint)
        if i == 1:
            marks = make("alert_key string, alert_date date, acknowledged_by string, acknowledged_at date",
                         [("LOW_SUPPLY|A", day, "zoe", day + timedelta(days=1)), ("LOW_SUPPLY|A", day, "kim", day), ("LOW_SUPPLY|B", day, "kim", day)])
            state = fixed(spark, alerts.acknowledge(state, marks))
            alert_stream.land_marks(marks, folder, day)
        if i in (1, 2, 4):
            alert_stream.load(spark, folder, log, checkpoint)
            assert table(alert_stream.table(spark, log)) == table(state)
    assert {r["alert_key"]: r["days_active"] for r in state.where("alert_date = '2026-03-24' or alert_type = 'SUPPLIER_RISK'").collect()} == {
        "LOW_SUPPLY|A": 2, "SUPPLIER_RISK|S": 2}


def test_waiting_runs_are_read_in_order(spark, make, tmp_path):
    """Three runs land before one load: the missing middle day closes the row and the third starts a new one."""
    folder, log, checkpoint = (f"{tmp_path}/{x}" for x in ("landed", "log", "checkpoint"))
    for i, skus in enumerate(("AB", "B", "AB")):
        day = FIRST + timedelta(days=i)
        alert_stream.land_run(make(DDL, [row(day, "LOW_SUPPLY", s) for s in skus]), folder, day)
    alert_stream.load(spark, folder, log, checkpoint)
    got = {(r.alert_key[-1], r.first_seen_date.day): (r.alert_date.day, r.days_active, r.resolved, r.resolved_date and r.resolved_date.day)
           for r in alert_stream.table(spark, log).collect()}
    assert got == {("A", 20): (20, 1, True, 21), ("A", 22): (22, 1, False, None), ("B", 20): (22, 3, False, None)}


def test_a_run_that_lands_twice_changes_nothing(spark, make, tmp_path):
    folder, log, checkpoint = (f"{tmp_path}/{x}" for x in ("landed", "log", "checkpoint"))
    for _ in range(2):
        alert_stream.land_run(make(DDL, [row(FIRST, "LOW_SUPPLY", "A")]), folder, FIRST)
        alert_stream.load(spark, folder, log, checkpoint)
    assert [(r.days_active, r.resolved) for r in alert_stream.table(spark, log).collect()] == [(1, False)]
