"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfwise.session import settle

# Rows per partition are numbered in the low bits, the partition in the high bits.
_POSITION_BITS = 33


def day(as_of: date, offset: int = 0) -> Column:
    """Literal date ``as_of + offset`` days."""
    return F.lit(as_of + timedelta(days=offset))


def num(col: Column | str) -> Column:
    """Null counts as zero, as in every sum of the domain."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("double"), F.lit(0.0))


def total(col: Column | str) -> Column:
    """Sum at the stored type (exact for decimals), given back as double, 0 when empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(col).cast("double"), F.lit(0.0))


def total_if(cond: Column, col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(F.when(cond, col)).cast("double"), F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null."""
    return a / F.when(b != 0, b)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One hash placement over all shuffle partitions. Adaptive execution merges partitions by
    bytes; frames that are small but costly per row keep their parallelism this way."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def max_date(df: DataFrame, col: str) -> DataFrame:
    """One row holding the newest date: the anchor of the data-driven engines."""
    return df.agg(F.max(col).alias("anchor"))


def pop_std(sum_x: Column, sum_xx: Column, n) -> Column:
    """Population deviation over ``n`` slots from sums, so empty slots need no rows."""
    mean = sum_x / n
    return F.sqrt(F.greatest(sum_xx / n - mean * mean, F.lit(0.0)))


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key. An aggregate, not a window: map tasks already keep one row per key,
    so a key that holds a large share of the rows reaches the reducer as one row per task."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(c) for c in order]
    by = F.struct(*order, *[F.col(c) for c in rest if _orderable(df, c)])
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), by).alias("_row"))
            .select(*keys, "_row.*"))


def newest_first(day_col: Column | str, value: Column | str) -> Column:
    """(day, value) as one long for ``max_by``: a struct as ordering would sort all rows before the map
    side reduces them, a long lets them be hashed. On equal days the larger value is newer, compared at
    the four decimals of every stored quantity and price; null comes first on its day."""
    days = F.coalesce(F.unix_date(day_col), F.lit(-1_000_000)).cast("long")
    value = F.col(value) if isinstance(value, str) else value
    units = F.coalesce((value.try_cast("decimal(12,4)") * 10_000).cast("long"), F.lit(-10 ** 12))
    return days * (2 * 10 ** 12) + units


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Row with the smallest ordering value per key (ties: smallest remaining columns)."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    by = F.struct(*order, *[F.col(c) for c in rest if _orderable(df, c)])
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*rest), by).alias("_row"))
            .select(*keys, "_row.*"))


def _orderable(df: DataFrame, name: str) -> bool:
    return "map" not in df.schema[name].dataType.simpleString()


def newest_run(df: DataFrame, col: str) -> DataFrame:
    """Rows of the newest run only; the day is a scalar, so the scan skips all others."""
    return df.where(F.col(col) == df.agg(F.max(col)).scalar())


def global_rank(df: DataFrame, order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """Exact 0-based ``rank_idx`` and group size ``rank_n`` without a single-task window.

    The rows are range-partitioned on (group, order) and stored; a row's rank is its position in
    its partition plus the rows of earlier partitions, minus where its group starts. One large
    group spans many partitions. The only windowed frame has one row per partition.
    """
    keys = [F.col(g) for g in group]
    placed = settle(df.orderBy(*keys, *order)
                    .withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _POSITION_BITS)
    pos = F.col("_id").bitwiseAND((1 << _POSITION_BITS) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, so both the window and the broadcast are bounded.
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    ranked = (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
              .withColumn("_rank", F.col("_off") + pos))
    if not group:
        one_row = placed.agg(F.count(F.lit(1)).alias("rank_n"))
        out = ranked.crossJoin(F.broadcast(one_row)).withColumn("rank_idx", F.col("_rank"))
    else:
        # A row per group and partition: rows meet their group's span by both, so a large group stays spread.
        pieces = ranked.groupBy(*group, "_part").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
        spans = pieces.groupBy(*group).agg(F.min("_first").alias("_start"), F.sum("_n").alias("rank_n"))
        spans = pieces.select(*group, "_part").join(spans, list(group))
        out = ranked.join(spans, [*group, "_part"]).withColumn("rank_idx", F.col("_rank") - F.col("_start"))
    return out.drop("_id", "_part", "_off", "_rank", "_start")


def fraction_class(idx: Column, n: Column, a: float, ab: float) -> Column:
    """A below max(1, round(a*n)), B below max(A+1, round(ab*n)), else C (half-even rounding)."""
    a_end = F.greatest(F.lit(1), F.bround(n * F.lit(a)).cast("long"))
    b_end = F.greatest(a_end + 1, F.bround(n * F.lit(ab)).cast("long"))
    return F.when(idx < a_end, "A").when(idx < b_end, "B").otherwise("C")


def share_class(idx: Column, n: Column, a: float, b: float) -> Column:
    """A for the first max(1, round(a*n)) ranks, B for the next max(1, round(b*n)), else C."""
    a_count = F.greatest(F.lit(1), F.bround(n * F.lit(a)).cast("long"))
    b_count = F.greatest(F.lit(1), F.bround(n * F.lit(b)).cast("long"))
    return F.when(idx < a_count, "A").when(idx < a_count + b_count, "B").otherwise("C")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group with ``rank_in_group`` from 1.

    A salted first pass keeps k rows per (group, salt), so a group with a large share of the rows
    is cut down by many tasks before its final ranking sees at most k rows per salt."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    inner = Window.partitionBy(*group, "_salt").orderBy(*order)
    cut = salted.withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= k)
    outer = Window.partitionBy(*group).orderBy(*order)
    return (cut.drop("_salt", "_r").withColumn("rank_in_group", F.row_number().over(outer))
            .filter(F.col("rank_in_group") <= k))


def longest_streak(days: DataFrame, keys: Sequence[str], date_col: str) -> DataFrame:
    """Longest run of adjacent dates per key; ``days`` holds distinct (key, date)."""
    w = Window.partitionBy(*keys).orderBy(date_col)
    islands = days.withColumn("_island", F.date_sub(F.col(date_col), F.row_number().over(w)))
    runs = islands.groupBy(*keys, "_island").agg(F.count(F.lit(1)).alias("_len"))
    return runs.groupBy(*keys).agg(F.max("_len").alias("streak"))


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Modal value per key; ties go to the smallest value."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def fill_from(df: DataFrame, other: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Update-from join: non-null values of ``other`` replace those of ``df`` by key."""
    new = other.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = df.join(new, list(keys), "left")
    for c in cols:
        old = F.col(c) if c in df.columns else F.lit(None)
        joined = joined.withColumn(c, F.coalesce(F.col(f"_new_{c}"), old)).drop(f"_new_{c}")
    return joined
