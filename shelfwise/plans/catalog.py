"""Named frames: each name is built once per session and folder, from other named frames."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from shelfwise.session import settle

# Last order date of the driver tables: the explicit "today" of every registered query.
AS_OF = date(2001, 8, 1)

_FRAMES: dict[str, Callable[["Catalog"], DataFrame]] = {}
_QUERIES: list[str] = []


def frame(fn: Callable[["Catalog"], DataFrame]):
    """Register a frame other frames read."""
    _FRAMES[fn.__name__] = fn
    return fn


def query(fn: Callable[["Catalog"], DataFrame]):
    """Register a frame that is also a public query."""
    _QUERIES.append(fn.__name__)
    return frame(fn)


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        from shelfwise.plans import registry
        registry.load()
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = _FRAMES[name](self)
        return self._built[name]

    def keep(self, name: str) -> None:
        """Store a frame that many of the next frames read, so that its joins are done once."""
        self._built[name] = settle(self[name])


def query_names() -> list[str]:
    return list(_QUERIES)
