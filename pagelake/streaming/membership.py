"""Which hashes a stream has met before, without reading all of them again.

Hashes lie in parts by their own hash, beside one Bloom filter per part and delivery. A batch reads the filters
(two bytes a hash) and then only parts that may hold one of its hashes, so what it reads of the hashes
themselves grows with its hits. Filters only rule out: what they leave is compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import discard, stored
from pagelake.sources.tables import bucket

PARTS = 256
FILTER_BITS = 16
PROBES = 6


def _places(table: pa.Table, bits: int) -> np.ndarray:
    """Bits of a filter that each hash sets, a row per probe."""
    a, b = (table.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    a = a >> np.uint64(8)  # the low bits name the part, all hashes of a filter share them
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def _filter(table: pa.Table) -> pa.Table:
    bits = -(-max(table.num_rows * FILTER_BITS, 64) // 8) * 8
    held = np.zeros(bits, dtype=bool)
    held[_places(table, bits)] = True
    return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})


def _maybe(asked: pa.Table, filters: pa.Table) -> pa.Table:
    hit = np.zeros(asked.num_rows, dtype=bool)
    for raw in filters.column("bits").to_pylist() if asked.num_rows else []:
        held = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
        hit |= held[_places(asked, len(held))].all(axis=0)
    return asked.filter(pa.array(hit)).select(["part", "sha256"])


def _present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _probes(hashes: DataFrame) -> DataFrame:
    key = F.col("sha256")
    return hashes.select(bucket(key, PARTS).alias("part"), "sha256", F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b"))


def may_be_met(hashes: DataFrame, memory: str, delivery: str) -> DataFrame | None:
    """(part, sha256) of the distinct ``hashes`` that some filter of another delivery lets through; None without any filter."""
    filters = _present(hashes.sparkSession, f"{memory}/filters")
    if filters is None:
        return None
    others = filters.filter(F.col("delivery") != delivery).select("part", "bits")
    return _probes(hashes).groupBy("part").cogroup(others.groupBy("part")).applyInArrow(_maybe, "part int, sha256 string")


def met_before(hashes: DataFrame, memory: str, delivery: str) -> DataFrame | None:
    """(sha256) of the distinct ``hashes`` that another delivery brought, a table to ``discard``; None if none can be among them."""
    let_through = may_be_met(hashes, memory, delivery)
    if let_through is None:
        return None
    maybe = stored(let_through, "maybe-met")
    parts = [r.part for r in maybe.select("part").distinct().collect()]  # at most PARTS numbers
    if not parts:
        discard(maybe, free=False)
        return None
    held = hashes.sparkSession.read.parquet(f"{memory}/hashes").filter(F.col("part").isin(parts) & (F.col("delivery") != delivery))
    met = stored(maybe.join(held.select("part", "sha256"), ["part", "sha256"], "left_semi").select("sha256"), "met")
    discard(maybe, free=False)
    return met


def remember(hashes: DataFrame, memory: str, delivery: str) -> None:
    """Adds a delivery's distinct hashes; a repeated delivery replaces itself. Filters come last: without one a part is not read,
    and the delivery that failed in between comes again."""
    probes = _probes(hashes.filter(F.col("sha256").isNotNull())).withColumn("delivery", F.lit(delivery))

    def write(df: DataFrame, path: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    write(probes.select("sha256", "part", "delivery").repartition("part"), f"{memory}/hashes", "part", "delivery")
    write(probes.groupBy("part").applyInArrow(_filter, "part int, bits binary").withColumn("delivery", F.lit(delivery)), f"{memory}/filters", "delivery")
