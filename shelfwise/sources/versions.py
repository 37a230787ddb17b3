"""A stored table by day whose upserts are one commit each.

Below the table's folder:

* ``data/commit=<id>/<day>=<date>``: rows, never changed once written;
* ``log``: one file per commit with a row per day it rewrote (version, day, commit, rows). The file appears
  by one rename, so a reader has all of a version or nothing of it. A run that dies before leaves rows that
  no log names;
* ``filter``: Bloom filters of the keys of every day, cut into bit slices: a row holds, for one filter bit,
  the days of a 64-day span that have it set. A key's possible days are the bitwise AND of its slices, so an
  upsert finds the few days that may hold its keys by one join, and reads no others. Bits are only ever
  added, before the commit; a stale bit costs a read and no row.

The newest row of a key is the one with the highest value of a sequence column, whichever day it stands
under and whenever it lands. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.operators.common import latest_row
from shelfwise.session import settle

FILTER_BITS = 1 << 20  # of a day; about ten for each key of a day keep needless reads below two in a hundred
_HASHES = 4
_SPAN = 64
LOG = "version long, day date, commit string, rows long, label string"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing is stored yet
        return None


def log(spark: SparkSession, path: str) -> DataFrame:
    """(version, day, commit, rows, label) of all commits."""
    found = _stored(spark, f"{path}/log", LOG)
    return spark.createDataFrame([], LOG) if found is None else found


def _newest(entries: DataFrame, version: int | None) -> DataFrame:
    """Of each day the entry that holds at the given version."""
    return latest_row(entries if version is None else entries.where(F.col("version") <= version), ["day"], ["version"])


def read(spark: SparkSession, path: str, schema: StructType, day_col: str, version: int | None = None, days: Sequence[date] | None = None) -> DataFrame:
    """The rows of a version (the last one by default); of the given days only, no other folder is opened."""
    held = _newest(log(spark, path), version).where("rows > 0")
    if days is not None:
        held = held.where(F.col("day").isin(list(days)))
    folders = [f"{path}/data/commit={r.commit}/{day_col}={r.day}" for r in held.collect()]  # at most the days of the table
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*schema.fieldNames())


# Filters -----------------------------------------------------------------------------------------
def _bits(keys: Sequence[str]) -> Column:
    """The filter bits of a key, one row each."""
    named = F.xxhash64(*keys)
    return F.explode(F.array(*[F.pmod(F.xxhash64(named, F.lit(k)), F.lit(FILTER_BITS)) for k in range(_HASHES)]))


def slices(rows: DataFrame, keys: Sequence[str], day_col: str) -> DataFrame:
    """(bit, span, days): for each filter bit the days of a span, as a bit set, that hold a key with it."""
    n = F.datediff(F.col(day_col), F.lit(date(1970, 1, 1)))
    return (rows.select(_bits(keys).alias("bit"), F.floor(n / _SPAN).alias("span"), F.pmod(n, F.lit(_SPAN)).alias("at"))
            .groupBy("bit", "span").agg(F.expr("bit_or(shiftleft(1L, at))").alias("days")))


def possible_days(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str]) -> list[date]:
    """The days that may hold one of the rows' keys: all that do, and by chance a few others."""
    stored = _stored(spark, f"{path}/filter", "bit long, span long, days long")
    if stored is None:
        return []
    probes = rows.select(*keys).distinct().select(F.xxhash64(*keys).alias("key"), _bits(keys).alias("bit"))
    wanted = stored.join(probes.select("bit").distinct(), "bit", "left_semi").groupBy("bit", "span").agg(F.bit_or("days").alias("days"))
    spans = (probes.join(wanted, "bit").groupBy("key", "span").agg(F.count("*").alias("n"), F.bit_and("days").alias("days"))
             .where(F.col("n") >= _HASHES).groupBy("span").agg(F.bit_or("days").alias("days")))
    each = spans.select("span", "days", F.explode(F.sequence(F.lit(0), F.lit(_SPAN - 1))).alias("at"))
    found = each.where("shiftrightunsigned(days, at) & 1 = 1").selectExpr(f"date_add(date'1970-01-01', cast(span * {_SPAN} + at as int)) as day")
    return [r.day for r in found.collect()]  # at most the days of the table


# Commits -----------------------------------------------------------------------------------------
def _commit(entries: DataFrame, path: str) -> None:
    """The one step that makes a version visible: a single file."""
    entries.coalesce(1).write.mode("append").parquet(f"{path}/log")


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str], day_col: str, seq_col: str, label: str | None = None) -> int:
    """Stores the newest row of every key and returns the version; a label that is committed already changes nothing.

    Of the stored days, those of the new rows and those that may hold their keys are read; the days of
    changed keys are written anew."""
    entries = log(spark, path)
    last = entries.agg(F.max("version"), F.max(F.when(F.col("label") == label, F.col("version")))).first()
    if label is not None and last[1] is not None:
        return last[1]
    new = settle(latest_row(new, list(keys), [seq_col]).select(*new.columns))
    touched = {r[0] for r in new.select(day_col).distinct().collect()}  # at most the days of the table
    if not touched:
        return last[0] or 0
    days = touched | set(possible_days(spark, path, new, keys))
    old = read(spark, path, new.schema, day_col, days=sorted(days))
    merged = settle(latest_row(old.unionByName(new), list(keys), [seq_col]).select(*new.columns))
    # a day that only seemed to hold a key, or holds its key for good, stays as it is
    gone = old.join(new.select(*keys), list(keys), "left_semi").select(day_col).distinct().collect()  # at most the days of the table
    changed = sorted(touched | {r[0] for r in gone})
    commit, version = uuid4().hex, (last[0] or 0) + 1
    rows = merged.where(F.col(day_col).isin(changed))
    rows.repartition(day_col, F.pmod(F.xxhash64(*keys), F.lit(8))).write.partitionBy(day_col).parquet(f"{path}/data/commit={commit}")
    slices(new.join(rows.select(*keys, seq_col), [*keys, seq_col], "left_semi"), keys, day_col).write.mode("append").parquet(f"{path}/filter")
    counted = {r[0]: r[1] for r in rows.groupBy(day_col).count().collect()}  # at most the days of the table
    _commit(spark.createDataFrame([(version, d, commit, counted.get(d, 0), label) for d in changed], LOG), path)
    return version


def load_available(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], day_col: str, seq_col: str,
                   transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Loads all that has landed and stops, each batch as one version; a batch that runs again is known by its label."""
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def store(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, transform(batch), path, keys, day_col, seq_col, f"{name}-{number}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
