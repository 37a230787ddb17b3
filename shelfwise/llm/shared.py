"""Small helpers of the training-data operators: columns, the shared folder, and word patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import settle, shared_folder

__all__ = ["BLANKS", "columns_of", "kept_columns", "new_folder", "open_store", "settle", "sized_parts", "slices",
           "words"]

# Characters that separate words, as a pattern both Java and RE2 read.
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def kept_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one reads as null, so extra or clashing columns never matter."""
    have = set(docs.columns)
    types = {"text": "string", "html": "string", "url": "string"}
    return docs.select(*[docs[f"`{n}`"] if n in have else F.lit(None).cast(types.get(n, "bigint")).alias(n) for n in names])


def columns_of(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the checkpoint folder, as a URI that pyarrow and Spark both read."""
    root = re.sub(r"^file:/+", "file:///", shared_folder(spark).rstrip("/"))
    return f"{root}/{kind}-{uuid4().hex}"


def open_store(uri: str):
    """(file system, path) of a URI of the shared folder, inside a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def slices(batch, column: int, text_bytes: int = 2 << 20) -> Iterator:
    """The batch in runs of rows with about ``text_bytes`` of text each, so work arrays have a bound."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + text_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def sized_parts(total_bytes: int, part_bytes: int, least: int = 1) -> int:
    """How many parts of about ``part_bytes`` hold ``total_bytes``."""
    return max(least, -(-int(total_bytes or 0) // part_bytes))
