"""Sinks: pure merges of old and new rows, and the few writers that store them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.parsing import spreadsheet_safe
from shelfwise.operators.common import fill_from, latest_row
from shelfwise.session import settle


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old rows of the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows win, so approvals survive a second run."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def update_columns(old: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Only the named columns change, and only where the new value is known."""
    return fill_from(old, new, keys, cols)


def retain(df: DataFrame, expired: Column) -> DataFrame:
    return df.filter(~F.coalesce(expired, F.lit(False)))


def replace_days(df: DataFrame, path: str, day_col: str) -> int:
    """Overwrite the days present in ``df`` and no other; returns the rows stored for them after
    checking that they are the rows given."""
    fixed = settle(df)
    (fixed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path))
    spark = df.sparkSession
    stored = spark.read.schema(df.schema).parquet(path).join(fixed.select(day_col).distinct(), day_col, "left_semi").count()
    given = fixed.count()
    if stored != given:
        raise RuntimeError(f"{path}: {given} rows given, {stored} stored")
    return stored


def upsert_days(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str], day_col: str) -> int:
    """Upsert into a table stored by day; the newest row per key wins.

    Rows are read and rewritten for the days of ``new`` and for the days its keys stood under before,
    found from the key columns alone. A day left without rows is stored as an empty one."""
    others = [c for c in new.columns if c not in keys and c != day_col]
    new = settle(latest_row(new, list(keys), [day_col, *others]).select(*new.columns))
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return replace_days(new, path, day_col)
    stored = spark.read.schema(new.schema).parquet(path)
    moved = stored.select(*keys, day_col).join(new.select(*keys), list(keys), "left_semi").select(day_col)
    days = [r[0] for r in new.select(day_col).union(moved).distinct().collect()]  # at most the days of the table
    merged = settle(upsert(stored.where(F.col(day_col).isin(days)).select(*new.columns), new, keys))
    left = {r[0] for r in merged.select(day_col).distinct().collect()}  # at most those days
    rows = replace_days(merged, path, day_col)
    for gone in sorted(set(days) - left):
        merged.drop(day_col).limit(0).write.mode("overwrite").parquet(f"{path}/{day_col}={gone}")
    return rows


def export_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every cell as text no spreadsheet runs as a formula."""
    return df.select(*[spreadsheet_safe(F.col(c)).alias(c) for c in columns])


def export_csv(df: DataFrame, columns: Sequence[str], order: Sequence[Column], path: str) -> None:
    """Sorted export in as many files as the sort has partitions."""
    export_rows(df.orderBy(*order), columns).write.mode("overwrite").option("header", True).csv(path)


def write_document(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").text(path)
