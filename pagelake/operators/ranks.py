"""Ranking helpers that never put one key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import stored

BLOCK = 65536


def blocked_rank(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "rn", block: Column | None = None, width: int = BLOCK
) -> DataFrame:
    """row_number of ``order`` within ``keys``, counted in blocks.

    Rows are numbered inside (keys, block); a second, small aggregate holds how many rows the
    earlier blocks of the key have. ``block`` must not decrease with ``order``; for unique
    integer orders the default bounds a block to ``width`` rows however large its key is.
    Keys must not be null.
    """
    blk = F.floor(F.col(order) / F.lit(width)) if block is None else block
    marked = df.withColumn("_blk", blk)
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_blk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_blk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    )
    local = Window.partitionBy(*keys, "_blk").orderBy(order)
    numbered = marked.withColumn("_rn", F.row_number().over(local))
    return (
        numbered.join(offsets, [*keys, "_blk"])
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint"))
        .drop("_blk", "_rn", "_off")
    )


def in_ranges(df: DataFrame, order: Sequence[Column | str], out: str = "range", width: int = BLOCK) -> DataFrame:
    """The rows, written in ranges of ``order`` of about ``width`` rows, each with the number of its range.

    Spark samples the boundaries, so ranges follow the rows wherever their values lie; numbers rise with
    the order, and equal values share a range.
    """
    ranges = max(-(-df.count() // width), 1)
    return stored(df.repartitionByRange(ranges, *order).withColumn(out, F.spark_partition_id().cast("bigint")).sortWithinPartitions(*order), "ranges")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column | int, out: str, width: int = BLOCK
) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to each row; (keys, order) must be unique, keys not null.

    A task holds one range of a key; one row per range carries what earlier ranges of the key sum up to.
    """
    value = F.lit(value) if isinstance(value, int) else value
    rows = in_ranges(df.withColumn("_value", value), [*keys, *order], "_range", width)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"))
    )
    local = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_local", F.sum("_value").over(local)).join(offsets, [*keys, "_range"])
    return summed.withColumn(out, (F.col("_local") + F.col("_off")).cast("bigint")).drop("_value", "_range", "_local", "_off")


def ranged_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rn", width: int = BLOCK) -> DataFrame:
    """row_number of ``order`` within ``keys`` for orders of any type and spacing; sparse ids make no more ranges than dense ones."""
    return running_total(df, keys, order, 1, out, width)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per key. The rank filter becomes a window group limit before the shuffle,
    so each task forwards at most k rows per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
