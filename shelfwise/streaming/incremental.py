"""Incremental loading: file streams into stored tables, resumable and safe to repeat."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.operators.alerts import advance
from shelfwise.operators.forecast import freeze_features
from shelfwise.session import settle
from shelfwise.sources.sinks import upsert_days


def file_stream(spark: SparkSession, folder: str, schema: StructType, name: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """Parquet files landing in a folder; the checkpoint of the query remembers those already read."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def unique_stream(stream: DataFrame, id_col: str, time_col: str, delay: str = "7 days") -> DataFrame:
    """Drops repeats of an id that arrive within ``delay``; the state older than that is let go."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def load_available(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], day_col: str,
                   transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Load everything that has landed and stop. Each batch is upserted by key, so a batch that
    runs again after a failure, or a reloaded day, leaves the same table."""
    def store(batch: DataFrame, _: int) -> None:
        upsert_days(batch.sparkSession, transform(batch), path, keys, day_col)

    query = (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def load_with_late(stream: DataFrame, base: str, checkpoint: str, time_col: str, delay: timedelta) -> None:
    """Load everything that has landed; rows that a watermark would drop are stored beside the others, marked ``late``.

    A row is late if its time lies more than ``delay`` before the newest time of all earlier batches; one without a time
    never is. Rows are stored per batch, so a batch that runs again after a failure replaces its own rows only. Each batch
    also leaves one line of counts and the time it reached, taken while the rows are written."""
    rows, lines = f"{base}/rows", f"{base}/loads"

    def store(batch: DataFrame, number: int) -> None:
        spark, t = batch.sparkSession, F.col(time_col)
        reached = None
        if number > 0:
            (reached,), = spark.read.parquet(lines).where(F.col("batch") < number).agg(F.max("reached")).collect()  # at most one row
        late = F.lit(False) if reached is None else F.coalesce(t < F.lit(reached - delay), F.lit(False))
        seen = Observation()
        (batch.withColumns({"late": late, "batch": F.lit(number).cast("long")})
         .observe(seen, F.max(t).alias("newest"), F.count(F.lit(1)).alias("rows"), F.sum(late.cast("long")).alias("late"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "late").parquet(rows))
        got = seen.get
        newest = max((x for x in (got["newest"], reached) if x is not None), default=None)
        line = spark.range(1).select(F.lit(newest).cast("timestamp").alias("reached"), F.lit(got["rows"]).cast("long").alias("rows"),
                                     F.lit(got["late"] or 0).cast("long").alias("late"), F.lit(number).cast("long").alias("batch"))
        line.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(lines)

    (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())


def loaded_rows(spark: SparkSession, base: str) -> DataFrame:
    """What ``load_with_late`` has stored, ``late`` as a truth value again: folder names are text."""
    return spark.read.parquet(f"{base}/rows").withColumn("late", F.col("late").cast("boolean"))


def resume_from(stored: DataFrame, col: str, first: date, overlap_days: int = 30) -> DataFrame:
    """One row: where the next load starts, one chunk before the newest stored day."""
    top = F.date_sub(F.max(col), overlap_days)
    return stored.agg(F.greatest(F.coalesce(top, F.lit(first)), F.lit(first)).alias("load_from"))


def rows_to_load(source: DataFrame, stored: DataFrame, source_col: str, stored_col: str, first: date,
                 overlap_days: int = 30) -> DataFrame:
    """Source rows from the resume point on; the point is a scalar, so the scan skips what was loaded."""
    return source.where(F.col(source_col) >= resume_from(stored, stored_col, first, overlap_days).scalar())


def one_day(source: DataFrame, col: str, day: date) -> DataFrame:
    """The daily load: a filter the scan can prune by."""
    return source.filter((F.col(col) >= F.lit(day)) & (F.col(col) < F.lit(day + timedelta(days=1))))


def extend_streaks(stored: DataFrame, new: DataFrame, station: str | None = None) -> DataFrame:
    """Freeze streaks of newly landed days, continued from the newest stored day of the station before them."""
    keys = [station] if station else []
    start = new.groupBy(*keys).agg(F.min("log_date").alias("_start"))
    earlier = stored.join(start, station) if station else stored.join(F.broadcast(start), F.lit(True))  # one row
    last = earlier.where("log_date < _start").groupBy(*keys).agg(F.max_by("consecutive_freeze_days", "log_date").alias("streak"))
    return freeze_features(new, station, last.where("streak is not null"))


def advance_stored(spark: SparkSession, folder: str, version: int, current: DataFrame, as_of: date) -> int:
    """Alert state as numbered versions: read one, write the next; returns the number written.
    A run that fails half-way leaves the previous version whole."""
    state = spark.read.parquet(f"{folder}/version={version}")
    advance(settle(state), current, as_of).write.mode("overwrite").parquet(f"{folder}/version={version + 1}")
    return version + 1
