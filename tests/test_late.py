"""Rows behind the watermark are stored beside the others."""

from datetime import datetime, timedelta

from pyspark.sql.types import StructType

from shelfwise.streaming import incremental

DDL = "id int, ts timestamp"


def at(day):
    return datetime(2026, 1, day)


def test_late_rows_are_kept_apart_and_counted(spark, make, tmp_path):
    """Two days of delay. A row exactly on the line is in time; one without a time is never late; the line is that of all
    earlier batches, not of the last one; a load without new files changes nothing."""
    landed, base, checkpoint = (f"{tmp_path}/{x}" for x in ("landed", "base", "checkpoint"))
    parts = [[(1, at(10)), (2, at(1)), (3, None)], [(4, at(8)), (5, at(7)), (6, None), (7, at(9))], [(8, at(7)), (9, at(12))], [(10, None)]]
    for part in parts:
        make(DDL, part).write.mode("append").parquet(landed)
        for _ in range(2):
            incremental.load_with_late(incremental.file_stream(spark, landed, StructType.fromDDL(DDL)), base, checkpoint, "ts", timedelta(days=2))
    rows = {r.id: (r.batch, r.late) for r in incremental.loaded_rows(spark, base).collect()}
    assert {i for i, (_, late) in rows.items() if late} == {5, 8}
    assert sorted(rows) == list(range(1, 11))
    lines = sorted((r.batch, r.reached, r.rows, r.late) for r in spark.read.parquet(f"{base}/loads").collect())
    assert lines == [(0, at(10), 3, 0), (1, at(10), 4, 1), (2, at(12), 2, 1), (3, at(12), 1, 0)]


def test_a_batch_that_runs_again_replaces_its_rows(spark, make, tmp_path):
    """A crash after the rows were stored and before the batch was noted as done."""
    landed, base, checkpoint = (f"{tmp_path}/{x}" for x in ("landed", "base", "checkpoint"))
    make(DDL, [(1, at(10)), (2, at(1))]).write.parquet(landed)
    load = lambda: incremental.load_with_late(incremental.file_stream(spark, landed, StructType.fromDDL(DDL)),
                                              base, checkpoint, "ts", timedelta(days=2))
    load()
    for name in (tmp_path / "checkpoint" / "commits").iterdir():
        name.unlink()
    load()
    assert spark.read.parquet(f"{base}/rows").count() == 2
    assert spark.read.parquet(f"{base}/loads").count() == 1
