"""Latest job state per target from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelake.sources.tables import append_batch, latest_batch
from pagelake.streaming.ingest import run_available


def job_state(events: DataFrame) -> DataFrame:
    """(target_type, target_id, at, seq, status, progress) of each target's newest event.

    The order is event time, then sequence number, so a late event cannot turn a state back. One
    small struct per target is kept as state.
    """
    newest = F.max_by(F.struct("at", "seq", "status", "progress"), F.struct("at", "seq"))
    return events.groupBy("target_type", "target_id").agg(newest.alias("s")).select("target_type", "target_id", "s.*")


def stream_job_state(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps changed states per micro-batch below ``target``; ``read_job_state`` gives the last of each."""
    return run_available(job_state(events), lambda batch, n: append_batch(batch, target, n), checkpoint, "update")


def read_job_state(spark: SparkSession, target: str) -> DataFrame:
    return latest_batch(spark.read.parquet(target), ["target_type", "target_id"])
