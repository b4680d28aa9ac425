"""Job queue, leases, schedules and rate limits, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def micros(t: Column | str) -> Column:
    """Microseconds since the epoch, of a timestamp with or without zone (UTC)."""
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def states(jobs: DataFrame, now: Column) -> DataFrame:
    """(id, status, next_state): what a worker's pass at ``now`` makes of each job.

    Requested cancellations end; running jobs with an expired lease go back to the queue, or
    fail once their attempts are spent; queued jobs that are due are claimable.
    """
    expired = (F.col("status") == "running") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now))
    spent = F.col("attempt_count") >= F.col("max_attempts")
    nxt = (
        F.when(F.col("status") == "cancel_requested", "cancelled").when(expired & spent, "failed").when(expired, "queued")
        .when((F.col("status") == "queued") & spent, "failed").when((F.col("status") == "queued") & (F.col("available_at") <= now), "claimable").otherwise(F.col("status"))
    )
    return jobs.select("id", "status", nxt.alias("next_state"))


def next_job(jobs: DataFrame, now: Column) -> DataFrame:
    due = (F.col("status") == "queued") & (F.col("available_at") <= now) & (F.col("attempt_count") < F.col("max_attempts"))
    return jobs.where(due).orderBy("available_at", "id").limit(1).select("id", "kind", "available_at")


def retries(jobs: DataFrame) -> DataFrame:
    """Failed jobs with attempts left, and when they may run again."""
    left = (F.col("status") == "failed") & (F.col("attempt_count") < F.col("max_attempts"))
    delay = T.retry_delay("attempt_count")
    return jobs.where(left).select("id", delay.alias("delay_seconds"), (F.col("available_at") + F.make_dt_interval(secs=delay)).alias("retry_at"))


def enqueue(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming jobs whose (kind, idempotency key) the queue lacks; each key once."""
    keys = existing.select("kind", "idempotency_key").distinct()
    new = incoming.dropDuplicates(["kind", "idempotency_key"])
    return new.join(keys, (new.kind.eqNullSafe(keys.kind)) & (new.idempotency_key.eqNullSafe(keys.idempotency_key)), "left_anti")


def next_run(last: Column, minutes: Column, now: Column) -> Column:
    """The first time after ``now`` on the grid of ``minutes`` from ``last``."""
    gap = F.floor((micros(now) - micros(last)) / (minutes.cast("bigint") * 60_000_000)) + 1
    step = F.make_dt_interval(mins=(gap * minutes).cast("int"))
    return F.when(last > now, last).otherwise(last + step)


def materialize(schedules: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs due from enabled schedules (id, kind, interval_minutes, enabled, next_run_at) that the queue lacks."""
    due = schedules.where(F.col("enabled") & (F.col("next_run_at") <= now)).select(
        F.col("id").alias("schedule_id"), "kind", F.concat_ws(":", F.lit("schedule"), "id", F.date_format("next_run_at", "yyyyMMddHHmm")).alias("idempotency_key"),
        F.col("next_run_at").alias("available_at"), next_run(F.col("next_run_at"), F.col("interval_minutes"), now).alias("next_run_at"),
    )
    return enqueue(jobs, due)


def rate_limit(events: DataFrame, key: str, ts: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Requests of the key in the window that ends with each, and whether that is over the limit.

    Counts every request, accepted or not: an upper bound of the stateful limiter, which is
    ``streaming.limits``.
    """
    w = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    n = F.count("*").over(w)
    return events.select("*", n.alias("in_window"), (n > limit).alias("over_limit"))
