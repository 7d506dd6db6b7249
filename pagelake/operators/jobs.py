"""The job table: listing, target names, durations, upserts and event collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.scalar import duration_ms, duration_text, idempotency_key
from pagelake.session import stored

LIST_LIMIT = 100


def list_jobs(jobs: DataFrame, *, target_id=None, job_type: str | None = None, status: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Newest jobs first."""
    df = jobs
    if target_id is not None:
        df = df.filter(F.col("target_id") == target_id)
    if job_type:
        df = df.filter(F.col("job_type") == job_type)
    if status:
        df = df.filter(F.col("status") == status)
    return df.orderBy(F.col("created_at").desc(), "job_id").limit(limit)


def with_targets(jobs: DataFrame, versions: DataFrame, slides: DataFrame, presentations: DataFrame) -> DataFrame:
    """Adds target_name, target_parent_id, target_parent_name and target_page_no.

    A version is named by its file, a page by its title; both by the file they belong to. Only targets of the jobs are
    named: their ids are written first, so that Spark knows their size and leaves pages where they lie when it is small.
    """
    wanted = stored(jobs.select("target_type", F.col("target_id").cast("bigint").alias("target_id")).distinct(), "job-targets")
    asked = lambda kind, column: wanted.filter(F.col("target_type") == kind).select(F.col("target_id").alias(column))
    files = presentations.select("presentation_id", F.col("title").alias("p_title"))
    known_versions = versions.select("version_id", "presentation_id", F.nullif("original_filename", F.lit("")).alias("v_name"))
    by_version = known_versions.join(asked("version", "version_id"), "version_id", "left_semi").join(files, "presentation_id", "left").select(
        F.lit("version").alias("target_type"), F.col("version_id").cast("bigint").alias("target_id"), F.col("v_name").alias("target_name"),
        F.col("presentation_id").alias("target_parent_id"), F.col("p_title").alias("target_parent_name"),
        F.lit(None).cast("bigint").alias("target_page_no"),
    )
    by_slide = (
        slides.select("slide_id", "version_id", "page_no", "title").join(asked("slide", "slide_id"), "slide_id", "left_semi")
        .join(known_versions, "version_id", "left").join(files, "presentation_id", "left")
        .select(
            F.lit("slide").alias("target_type"), F.col("slide_id").alias("target_id"), F.nullif("title", F.lit("")).alias("target_name"),
            F.col("presentation_id").alias("target_parent_id"), F.col("p_title").alias("target_parent_name"),
            F.col("page_no").cast("bigint").alias("target_page_no"),
        )
    )
    return jobs.join(by_version.unionByName(by_slide), ["target_type", "target_id"], "left")


def durations(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("duration_ms", duration_ms(F.col("started_at"), F.col("finished_at"))).withColumn(
        "duration", duration_text(F.col("started_at"), F.col("finished_at"))
    )


def upsert_requests(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds pending jobs for requests (job_type, target_type, target_id, stage, input_data) not known by key.

    ``jobs`` carries idempotency_key; a known key returns the job that exists.
    """
    keyed = requests.withColumn("idempotency_key", idempotency_key(F.col("job_type"), F.col("target_id"), F.col("input_data")))
    rows = keyed.join(jobs.select("idempotency_key"), "idempotency_key", "left_anti").dropDuplicates(["idempotency_key"])
    fresh = rows.select("job_type", "target_type", "target_id", "stage", "idempotency_key", F.lit("pending").alias("status"), F.lit(0).alias("progress"))
    return jobs.unionByName(fresh, allowMissingColumns=True)


def collapse_events(events: DataFrame) -> DataFrame:
    """One row per job from its start / success / failure events (idempotency_key, event, at, seq, error_code).

    The last event by (at, seq) decides; success clears the error and sets progress 100; a start
    after a success does not reopen the job. started_at is the start that opened the deciding run,
    the first one after the failure before it; finished_at the deciding end.
    """
    order = F.struct("at", "seq")
    is_start = F.col("event") == "start"
    state = events.groupBy("idempotency_key").agg(
        F.max_by("event", order).alias("last_event"),
        F.max_by("event", F.when(F.col("event") != "start", order)).alias("last_end"),
        F.max_by("error_code", F.when(F.col("event") != "start", order)).alias("end_error"),
        F.max(F.when(~is_start, order)).alias("end_order"),
        F.max(F.when(is_start, F.col("at"))).alias("last_start"),
        F.max(F.when(F.col("event") != "start", F.col("at"))).alias("ended_at"),
    )
    done = F.col("last_end") == "success"
    reopened = (F.col("last_event") == "start") & ~F.coalesce(done, F.lit(False))
    failed = (F.col("last_end") == "failure") & ~reopened
    ends = state.select("idempotency_key", "end_order", reopened.alias("reopened"))
    before = (
        events.filter(F.col("event") == "failure").join(ends, "idempotency_key").filter(F.col("reopened") | (order < F.col("end_order")))
        .groupBy("idempotency_key").agg(F.max(order).alias("last_failure"))
    )
    opened = (
        events.filter(is_start).join(before, "idempotency_key", "left").filter(F.col("last_failure").isNull() | (order > F.col("last_failure")))
        .groupBy("idempotency_key").agg(F.min("at").alias("run_start"))
    )
    return state.join(opened, "idempotency_key", "left").select(
        "idempotency_key",
        F.when(done, "success").when(reopened, "running").when(failed, "failed").otherwise("pending").alias("status"),
        F.when(done, 100).otherwise(0).alias("progress"),
        F.when(~F.coalesce(done, F.lit(False)), F.col("end_error")).alias("error_code"),
        F.coalesce("run_start", "last_start").alias("started_at"),
        F.when(done | failed, F.col("ended_at")).alias("finished_at"),
    )
