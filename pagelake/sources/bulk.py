"""Scale-up of a page pool for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators.ranks import ranged_rank


def bulk_pages(pool: DataFrame, target: int | None = None, times: int | None = None, version_id: int = 0) -> DataFrame:
    """Cycles the pool (slide_id and any columns) to ``target`` pages of one version.

    Gives new ids, running page numbers and ``source_slide_id``. Copy counts differ by at most
    one: page n copies pool row (n - 1) mod pool size. With ``times`` the target is a multiple of
    the pool. Page numbers are a distributed range that meets the numbered pool; Spark sends a small pool
    to the pages and shuffles a large one. An empty pool gives no pages.
    """
    numbered = ranged_rank(pool, [], ["slide_id"], "nth")
    size = pool.count()
    total = size * times if target is None else target
    pages = pool.sparkSession.range(1, total + 1).select(F.col("id").alias("page_no"), (F.pmod(F.col("id") - 1, F.lit(max(size, 1))) + 1).alias("nth"))
    return (
        pages.join(numbered, "nth")
        .withColumn("source_slide_id", F.col("slide_id"))
        .withColumn("slide_id", F.col("page_no"))
        .withColumn("version_id", F.lit(version_id))
        .drop("nth")
    )
