"""Alert lifecycle as a stream: one state row per open alert key, closed by event-time timers.

The batch form (``operators.alerts.advance``) rewrites the whole alert table for each run. Here a run only
touches the keys it holds and those whose timer ends: every change of a row is appended to a log, and the
table is the last change of each row.

Runs land as files, at least one a day. A run moves the clock to its day, so a key that it does not hold
passes its timer once the run has been read. A row of an auto-resolved type is then closed on the day of that
run; other rows stay open and can be continued until the look-back ends. If several runs wait, because a load
failed, they are read in the order of their days and a missing day counts as a run without the key."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DoubleType, IntegerType, StringType, StructField, StructType,
                               TimestampType)

from shelfwise.operators.alerts import ALERT_COLUMNS, AUTO_RESOLVED, STATE_COLUMNS
from shelfwise.operators.common import day, latest_row
from shelfwise.streaming.incremental import file_stream

# Built field by field: workers import this module and have no session to parse a DDL text with.
ALERT = [(c, DateType() if c == "alert_date" else DoubleType() if c == "financial_impact" else StringType()) for c in ALERT_COLUMNS]
WHO = [("acknowledged_by", StringType()), ("acknowledged_at", DateType())]
LANDED = StructType([StructField(*f) for f in (*ALERT, ("event", StringType()), ("run_date", DateType()), *WHO, ("clock", TimestampType()))])
LOGGED = StructType([StructField(*f) for f in (
    *ALERT, ("first_seen_date", DateType()), ("days_active", IntegerType()), ("resolved", BooleanType()), ("resolved_date", DateType()),
    ("is_acknowledged", BooleanType()), *WHO, ("step", IntegerType()))])
NAMES = tuple(LOGGED.names)
DELAY = timedelta(hours=12)  # half a day: rows of the running day are never late, those of the day before always are
EPOCH = datetime(1970, 1, 1)


def _events(df: DataFrame, event: str, run_date: date) -> DataFrame:
    """Rows in the landed layout; marks come one second after the run they follow."""
    have = set(df.columns)
    fixed = {"event": F.lit(event), "run_date": day(run_date),
             "clock": F.lit(run_date.isoformat()).cast("timestamp_ntz").cast("timestamp")
             + F.expr(f"interval {int(event == 'mark')} second")}
    return df.select(*[(fixed[f.name] if f.name in fixed else F.col(f.name) if f.name in have else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in LANDED.fields])


def land_run(current: DataFrame, folder: str, run_date: date) -> None:
    """One run of the generators: one row per key (that with the largest impact) and a row that says the run took
    place, so that a run without alerts closes what was open."""
    rows = latest_row(current.select(*ALERT_COLUMNS), ["alert_key"], ["financial_impact"])
    took_place = current.sparkSession.range(1).select(day(run_date).alias("alert_date"))
    (_events(rows, "alert", run_date).unionByName(_events(took_place, "run", run_date))
     .write.mode("append").parquet(folder))


def land_marks(marks: DataFrame, folder: str, run_date: date) -> None:
    """Acknowledged rows (alert_key, alert_date, acknowledged_by, acknowledged_at), made after the run of ``run_date``."""
    _events(marks.where("acknowledged_at is not null"), "mark", run_date).write.mode("append").parquet(folder)


def _timer(last: date, days: int) -> int:
    """The clock (milliseconds) that a run more than ``days`` - 1 days after ``last`` passes, and no earlier one."""
    at = datetime(last.year, last.month, last.day) + timedelta(days=days) - DELAY
    return int((at - EPOCH).total_seconds() * 1000) - 1


def _gather(chunks: Iterator[pd.DataFrame]) -> list[tuple]:
    """Events of one key in order: per day the alert with the largest impact, then the marks."""
    best: dict[date, tuple] = {}
    marks: dict[tuple, tuple] = {}
    for chunk in chunks:
        for row in chunk.itertuples(index=False):
            if row.event == "alert":
                size = row.financial_impact if pd.notna(row.financial_impact) else float("-inf")
                held = best.get(row.run_date)
                if held is None or size > held[0]:
                    best[row.run_date] = (size, row)
            elif row.event == "mark":
                place = (row.run_date, row.alert_date)
                given = (row.acknowledged_at, row.acknowledged_by)
                marks[place] = min(marks.get(place, given), given, key=lambda g: (g[0], g[1] or ""))
    events = [(d, 0, row) for d, (_, row) in best.items()] + [(d, 1, (seen, *given)) for (d, seen), given in marks.items()]
    return sorted(events, key=lambda e: e[:2])


def _clean(value):
    return None if value is None or (isinstance(value, float) and pd.isna(value)) or value is pd.NaT else value


def follow(lookback: int, auto: tuple[str, ...]):
    """The state function of one alert key."""
    def wait(row: dict) -> int:
        return _timer(row["alert_date"], 1 if row["alert_type"] in auto else lookback + 1)

    def step(key, chunks, state):
        row = dict(zip(NAMES, state.get)) if state.exists else None
        out: list[tuple] = []

        def emit(changed: dict) -> None:
            changed["step"] += 1
            out.append(tuple(changed[n] for n in NAMES))

        def close(on: date) -> None:
            row.update(resolved=True, resolved_date=on)
            emit(row)

        if state.hasTimedOut:
            if row["alert_type"] in auto:
                reached = EPOCH + timedelta(milliseconds=state.getCurrentWatermarkMs()) + DELAY
                close(reached.date())
            state.remove()
        elif key[0] is not None:
            for when, kind, event in _gather(chunks):
                if kind == 1:
                    seen, at, by = event
                    if row and row["alert_date"] == seen and not row["is_acknowledged"]:
                        row.update(is_acknowledged=True, acknowledged_by=by, acknowledged_at=at)
                        emit(row)
                    continue
                if row and when <= row["alert_date"]:
                    continue  # that run, or a later one, has been read
                gap = (when - row["alert_date"]).days if row else None
                if row and row["alert_type"] in auto and gap > 1:
                    close(row["alert_date"] + timedelta(days=1))
                    row = None
                fresh = {c: _clean(getattr(event, c)) for c in ALERT_COLUMNS} | {"alert_date": when}
                if row and gap <= lookback:
                    row.update(fresh, days_active=row["days_active"] + 1)
                else:
                    row = fresh | {"first_seen_date": when, "days_active": 1, "resolved": False, "resolved_date": None,
                                   "is_acknowledged": False, "acknowledged_by": None, "acknowledged_at": None, "step": 0}
                emit(row)
            if row:
                state.update(tuple(row[n] for n in NAMES))
                state.setTimeoutTimestamp(max(wait(row), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=list(NAMES)).astype({"days_active": "Int32", "step": "Int32"})

    return step


def changes(landed: DataFrame, lookback: int = 30, auto: tuple[str, ...] = AUTO_RESOLVED) -> DataFrame:
    """Stream of landed runs and marks to a stream of changed alert rows."""
    return (landed.withWatermark("clock", f"{int(DELAY.total_seconds())} seconds").groupBy("alert_key")
            .applyInPandasWithState(follow(lookback, auto), LOGGED, LOGGED, "append", "EventTimeTimeout"))


def load(spark: SparkSession, folder: str, log: str, checkpoint: str, **rules) -> None:
    """Read everything that has landed, let the timers it ends run, and stop; the next call goes on from the checkpoint."""
    (changes(file_stream(spark, folder, LANDED), **rules).writeStream.format("parquet").option("path", log)
     .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination())


def table(spark: SparkSession, log: str) -> DataFrame:
    """The alert table: the last change of each row, known by its key and the day it was first seen."""
    logged = spark.read.schema(LOGGED).parquet(log)
    return latest_row(logged, ["alert_key", "first_seen_date"], ["step"]).select(*STATE_COLUMNS)
