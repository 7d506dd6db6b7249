"""Shards of near equal bytes by sampled splitters.

A size-weighted sample of record keys gives quantile boundaries; records go to key ranges, whose bytes
are then summed exactly, and a range that came out overfull is divided by splitters of its own. Running sums
within ranges (in key order) place the shard borders to the record. The key is the text's hash, then
the doc_id: equal texts lie next to each other and share a shard unless their group is more than one hundredth of
a shard, in which case the border may go through it.

Nulls count as empty texts (size 1). Repeated rows are records of their own. An empty table gives an
empty result. Further columns are not read. Rows with a null doc_id come first among equal texts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import cut

SHARDS = 8
#: Keys drawn from the whole table, about, however large it is.
SAMPLE = 20_000
#: Rows a range should have; a table has at most MAX_RANGES of them at the first cut.
RANGE_ROWS = 20_000
MAX_RANGES = 4_096
OVERFULL = 1.5
WHOLE_GROUP = 0.01
LOWEST = -(1 << 63)


def _splitters(keys: DataFrame, total: int, parts: int) -> list[tuple[int, int]]:
    """parts - 1 quantile keys of a sample in which each record's chance is its share of the bytes."""
    chance = F.col("size") * F.lit(SAMPLE / max(total, 1))
    draw = F.pmod(F.xxhash64("h", "k", F.lit(17)), F.lit(1 << 30)) / F.lit(1 << 30)
    times = F.floor(chance + draw).cast("int")  # systematic: a record of several shares is drawn that often
    rows = keys.select("h", "k", times.alias("n")).filter("n > 0").collect()
    rows.sort()
    weights = np.cumsum([r["n"] for r in rows]) if rows else np.zeros(0)
    cuts = [int(np.searchsorted(weights, weights[-1] * i / parts)) for i in range(1, parts)] if rows else []
    return sorted({(rows[i]["h"], rows[i]["k"]) for i in cuts})


def _in_ranges(keys: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds ``part``, the number of splitters at or below the record's key."""
    high = np.array([h for h, _ in splitters], dtype=np.int64)
    schema = f"{', '.join(f'{n} {t}' for n, t in keys.dtypes)}, part int"
    where = [n for n, _ in keys.dtypes].index("h"), [n for n, _ in keys.dtypes].index("k")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in where)
            part = np.searchsorted(high, h, side="left")
            tied = np.flatnonzero(np.searchsorted(high, h, side="right") > part)
            for i in tied.tolist():
                part[i] = bisect_right(splitters, (int(h[i]), int(k[i])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], [*batch.schema.names, "part"])

    return keys.mapInArrow(work, schema)


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per record: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = cut(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("k"),
        )
    )
    rows, total = (x or 0 for x in keys.agg(F.count(F.lit(1)), F.sum("size")).first())
    parts = min(MAX_RANGES, max(4 * shards, -(-rows // RANGE_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    splitters = _splitters(keys, total, parts)
    while True:
        ranged = _in_ranges(keys, splitters)
        load = {r["part"]: r for r in ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
        over = [p for p, r in load.items() if r["bytes"] > OVERFULL * total / parts and r["n"] > 64]
        finer = set(splitters)
        if over:
            own = ranged.filter(F.col("part").isin(over))
            finer |= set(_splitters(own, sum(load[p]["bytes"] for p in over), 4 * len(over)))
        if len(finer) == len(splitters):
            break
        splitters = sorted(finer)
    ranged = cut(ranged)
    starts, at = [], 0
    for p in sorted(load):
        starts.append((p, at))
        at += load[p]["bytes"]
    begun = docs.sparkSession.createDataFrame(starts, "part int, before bigint")
    order = Window.partitionBy("part").orderBy("h", "k", "size")
    placed = ranged.withColumn("_sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.join(F.broadcast(begun), "part").withColumn("at", F.col("before") + F.col("_sum") - F.col("size"))
    goal = total / shards
    # Only groups that stay whole are looked up, so a text that a third of all rows hold is no key of this join.
    groups = cut(
        placed.groupBy("h").agg(F.min("at").alias("g_at"), F.sum("size").alias("g_size"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & (F.col("g_size") <= WHOLE_GROUP * goal)).drop("n")
    )
    middle = F.when(F.col("g_at").isNotNull(), F.col("g_at") + F.col("g_size") / 2).otherwise(F.col("at") + F.col("size") / 2)
    shard = F.least(F.floor(middle / F.lit(max(goal, 1e-9))), F.lit(shards - 1)).cast("int")
    dealt = cut(placed.join(groups, "h", "left").select("doc_id", "size", "text_crc32", "h", "k", "part", shard.alias("shard")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "part").orderBy("h", "k", "size")
    return (
        dealt.withColumn("_rn", F.row_number().over(own) - 1).join(earlier, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_rn") + F.col("before")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
