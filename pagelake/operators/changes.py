"""Change rows: several may name one key, one of them counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_order(changes: DataFrame, keys: Sequence[str], time: str = "at") -> Column:
    """What the last change of a key is greatest by: ``time`` where there is one, then the row as text."""
    rest = [c for c in changes.columns if c not in keys and c != time]
    return F.struct(*([time] if time in changes.columns else []), F.to_json(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))


def one_per_key(changes: DataFrame, keys: Sequence[str], time: str = "at") -> DataFrame:
    """The last change of each key by ``time``; among equals, and without that column, the greatest row. An aggregate."""
    columns = [c for c in changes.columns if c not in keys]
    if not columns:
        return changes.distinct()
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), change_order(changes, keys, time)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in columns]).select(*changes.columns)
