"""Continuous ingest of pages and files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelake.functions.text import fingerprint
from pagelake.operators import search_index
from pagelake.operators.indexing import extract_elements, index_text, token_index
from pagelake.session import discard, stored
from pagelake.sources.tables import append_batch, latest_batch
from pagelake.streaming import membership

PAGE_KEYS = ("slide_id",)
ELEMENT_KEYS = ("slide_id", "element_index")


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what has arrived and stops; call again to go on from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def stream_slides(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """New pages into the page, element and index tables below ``target``.

    The stream holds raw pages (slide_id, version_id, page_no, title, native_text, notes_text,
    ai_summary, content, presentation_title) and, where it knows it, ``run_id``, the parse run that made them. Each
    micro-batch lands in its own partition, so a retried batch replaces itself. A run may arrive in any number of batches; a version
    belongs to the run that delivered it last (``read_slides``). With run_id the batch also becomes a segment of the search
    indexes (``page_search``, ``element_search``), without one pages replace each other one by one and nothing is indexed.
    """

    spark = stream.sparkSession  # a batch's own session plans without adaptive execution

    def land(batch: DataFrame, batch_id: int) -> None:
        pages = token_index(index_text(batch)).withColumn("fingerprint", fingerprint(F.col("native_text")))
        append_batch(pages.drop("content", "index_text"), f"{target}/slides", batch_id)
        runs = ["run_id"] if "run_id" in batch.columns else []
        elements = token_index(extract_elements(batch), "text")
        if runs:
            elements = elements.join(batch.select("slide_id", *runs), "slide_id")
        append_batch(elements, f"{target}/elements", batch_id)
        if runs and not batch.isEmpty():
            landed = lambda name: spark.read.parquet(f"{target}/{name}").filter(F.col("batch_id") == batch_id)
            # pages last: a batch's versions belong to its run once all of it can be found
            search_index.append_segment(landed("elements"), f"{target}/index/elements", ELEMENT_KEYS, batch_id * search_index.STEP, landed("slides"))
            search_index.append_segment(landed("slides"), f"{target}/index/pages", PAGE_KEYS, batch_id * search_index.STEP)

    return run_available(stream, land, checkpoint)


def read_slides(spark: SparkSession, target: str) -> DataFrame:
    """Pages as last delivered. With ``run_id`` those of each version's last run, whatever number of batches it took; none of an
    older parse stays. Without it each page's last delivery, as nothing tells which pages a version has lost."""
    rows = spark.read.parquet(f"{target}/slides")
    if "run_id" in rows.columns:
        last = rows.groupBy("version_id").agg(F.max_by("run_id", "batch_id").alias("run_id"))
        rows = rows.join(last, ["version_id", "run_id"], "left_semi")
    return latest_batch(rows, "slide_id")


def read_elements(spark: SparkSession, target: str) -> DataFrame:
    """Elements of the pages' last deliveries; a page redelivered without elements has none."""
    rows = spark.read.parquet(f"{target}/slides")
    if "run_id" in rows.columns:
        last = rows.groupBy("version_id").agg(F.max_by("run_id", "batch_id").alias("run_id"))
        rows = rows.join(last, ["version_id", "run_id"], "left_semi")
    live = rows.groupBy("slide_id").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{target}/elements").join(live, ["slide_id", "batch_id"], "left_semi").drop("batch_id")


def page_search(spark: SparkSession, target: str) -> search_index.SearchIndex:
    """The index of all pages that live; base and later segments are merged while reading."""
    return search_index.read_index(spark, f"{target}/index/pages", PAGE_KEYS)


def element_search(spark: SparkSession, target: str) -> search_index.SearchIndex:
    return search_index.read_index(spark, f"{target}/index/elements", ELEMENT_KEYS)


def compact_indexes(spark: SparkSession, target: str) -> None:
    """Rewrites both indexes as one segment each; for times when the stream stands."""
    search_index.compact(spark, f"{target}/index/pages", PAGE_KEYS)
    search_index.compact(spark, f"{target}/index/elements", ELEMENT_KEYS)


def stream_new_files(stream: DataFrame, known: DataFrame, delay: str = "1 day", time: str = "arrived_at") -> DataFrame:
    """Files whose sha256 is neither known nor seen earlier in the stream within ``delay``."""
    fresh = stream.join(known.select("sha256").distinct(), "sha256", "left_anti")
    return fresh.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])


def land_new_files(stream: DataFrame, known: DataFrame, target: str, checkpoint: str, time: str = "arrived_at") -> StreamingQuery:
    """Lands files whose sha256 is neither known nor landed before, however long ago; of equal ones in a batch the first.

    What has landed is remembered in parts behind filters (``membership``, below ``target`` + "-met"), so no state grows in the
    stream and a batch reads only parts that may hold its files. Each batch lands in a partition named by its stream's
    checkpoint and its number: a retried batch replaces itself, another stream's batches stay. Files without a hash always land.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def land(batch: DataFrame, batch_id: int) -> None:
        delivery = f"{name}-{batch_id}"
        rest = [c for c in batch.columns if c != "sha256"]
        fresh = batch.join(known.select("sha256").distinct(), "sha256", "left_anti")
        first = stored(fresh.groupBy("sha256").agg(F.min_by(F.struct(*rest), time).alias("f")), "arrived")
        met = membership.met_before(first.select("sha256"), f"{target}-met", delivery)
        new = first if met is None else stored(first.join(met, "sha256", "left_anti"), "arrived")
        rows = new.select("sha256", *[F.col("f")[c].alias(c) for c in rest], F.lit(delivery).alias("delivery"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").parquet(target)
        membership.remember(new.select("sha256"), f"{target}-met", delivery)
        for table in (first, met, new):
            if table is not None:
                discard(table, free=False)

    return run_available(stream, land, checkpoint)


def land_files(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    query = (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
