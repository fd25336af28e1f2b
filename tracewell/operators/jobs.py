"""Job tables: listing, retention, progress and state from an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINISHED = ["COMPLETED", "FAILED", "CANCELLED"]


def jobs_list(jobs: DataFrame, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest jobs first, all or one page, of one status when given."""
    rows = jobs.where(F.col("status") == status) if status else jobs
    page = rows.orderBy(F.desc("created_at"), "job_id").offset(offset)
    return page.limit(limit) if limit is not None else page


def expired_jobs(jobs: DataFrame, now: str, max_age_hours: int) -> DataFrame:
    """Ids of finished jobs older than the cutoff."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_interval(hours=F.lit(max_age_hours))
    return jobs.where(F.col("status").isin(FINISHED) & (F.col("created_at") < cutoff)).select("job_id")


def jobs_retention(jobs: DataFrame, now: str, max_age_hours: int = 24) -> DataFrame:
    """Jobs that stay. The rule is on the row itself, so no join is needed."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_interval(hours=F.lit(max_age_hours))
    return jobs.where(~(F.col("status").isin(FINISHED) & (F.col("created_at") < cutoff)))


def results_retention(results: DataFrame, removed: DataFrame) -> DataFrame:
    """Results whose job was not removed."""
    return results.join(removed, "job_id", "left_anti")


def jobs_progress(jobs: DataFrame) -> DataFrame:
    """Percent done, whole number, 0 when there is nothing to do."""
    return jobs.select("job_id", F.when(
        F.col("total_views") > 0, F.floor(F.col("processed_views") / F.col("total_views") * 100 + 0.5)).otherwise(0).alias("percent"))


def jobs_duration(jobs: DataFrame) -> DataFrame:
    """``Ns``, ``Nm Ns`` or ``Nh Nm``."""
    s = F.col("duration_s")
    whole = lambda x, by: F.floor(x / by).cast("long")
    return jobs.select(
        "job_id",
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", whole(s, 60), s % 60))
        .otherwise(F.format_string("%dh %dm", whole(s, 3600), whole(s % 3600, 60))).alias("duration"))


def jobs_latest_state(events: DataFrame) -> DataFrame:
    """Latest status of every job, its largest accepted value, number of events and how many were refused.

    All are aggregates of the log. A job is finished at its first final event, and any other event after that is a
    refused transition, which changes nothing, so no per-job ordering pass is needed: the first final time joins back
    on the job id.
    """
    order = F.struct("ts", "event_id")
    closed = events.groupBy("job_id").agg(
        F.min(F.when(F.col("status").isin(FINISHED), order)).alias("closed_at"),
        F.count(F.lit(1)).alias("n_events"))
    joined = events.join(closed, "job_id")
    accepted = F.col("closed_at").isNull() | (order <= F.col("closed_at"))
    return joined.groupBy("job_id").agg(
        F.max_by("status", F.when(accepted, order)).alias("status"),
        F.count_if(~accepted).alias("n_refused"), F.first("n_events").alias("n_events"), F.max(F.when(accepted, F.col("value"))).alias("max_value"))
