"""Meeting of every query with every block of items, without a cross join and without the driver.

Items are dealt into blocks of bounded size by a key; queries are copied to each block, some hundred to a
strip. Both travel in one shuffle, sorted so that a block's items come before its queries: a task holds one
block and one strip at a time, whatever the number of either side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of a block, about, and the least that is worth a block of its own.
BLOCK = 32768
LEAST = 2048
# Queries that meet a block together.
STRIP = 256


def block_count(items: DataFrame, size: int = BLOCK) -> int:
    """Blocks of about ``size`` items; of fewer when else cores would idle."""
    n = items.count()
    return max(1, -(-n // size), min(items.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)))


def block_join(
    items: DataFrame, queries: DataFrame, key: Column, blocks: int, hold: Callable[[pa.Table], Any], find: Callable[[Any, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """Rows that ``find(held block, strip of queries)`` gives; ``hold`` prepares a block's items once.

    ``items`` and ``queries`` have the same columns. ``key`` deals items; equal keys share a block.
    """
    dealt = items.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), F.lit(0).alias("_kind"), "*")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_kind"), "*")
    both = dealt.unionByName(asked).repartition("_block").sortWithinPartitions("_block", "_kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if keys[lo, 0] != number:
                    number, parts, held = keys[lo, 0], [], None
                rows = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if keys[lo, 1] == 0:
                    parts.append(rows)
                    continue
                if held is None:
                    if not parts:
                        continue  # a block without items
                    held, parts = hold(pa.concat_tables(parts).combine_chunks()), []
                for at in range(0, rows.num_rows, STRIP):
                    yield from find(held, rows.slice(at, STRIP)).to_batches()

    return both.mapInArrow(work, schema)
