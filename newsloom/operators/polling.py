"""Per-source polling state derived from the fetch log."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.intervals import interval

# Fixed values of the polling rules.
BURST_INTERVAL_S = 60
BURST_WINDOW = timedelta(minutes=30)
FAILURE_COOLDOWN = timedelta(minutes=30)
COOLDOWN_AFTER = 3


def consecutive_failures(fetch_logs: DataFrame) -> DataFrame:
    """Failures after the last success per source.

    Two partial aggregations instead of a window over each source's whole log: the second pass
    only compares a log row with one (source, last success) row. The log is the streamed side of an inner
    join, so only the table of sources can be broadcast; sources without a failure come back at the end.
    """
    order = F.struct("fetched_at", "log_id")
    success = F.col("status") == "success"
    last_ok = fetch_logs.groupBy("source_id").agg(F.max(F.when(success, order)).alias("_ok"))
    since = fetch_logs.filter(~success).join(last_ok, "source_id").filter(F.col("_ok").isNull() | (order > F.col("_ok")))
    counts = since.groupBy("source_id").agg(F.count("log_id").alias("consecutive_failures"))
    return last_ok.select("source_id").join(counts, "source_id", "left").na.fill(0, ["consecutive_failures"])


def poll_state(fetch_logs: DataFrame) -> DataFrame:
    """State after replaying the log: last fetch, failure run, burst end, cool-down end."""
    order = F.struct("fetched_at", "log_id")
    success = F.col("status") == "success"
    base = fetch_logs.groupBy("source_id").agg(
        F.max("fetched_at").alias("last_fetched_at"), F.max(F.when(~success, F.col("fetched_at"))).alias("_last_fail"),
        F.max(F.when(success & (F.col("inserted") > 0), F.col("fetched_at"))).alias("_last_burst"))
    failures = consecutive_failures(fetch_logs)
    joined = base.join(failures, "source_id")
    return joined.select(
        "source_id", "last_fetched_at", "consecutive_failures",
        (F.col("_last_burst") + interval(BURST_WINDOW)).alias("burst_until_at"),
        F.when(F.col("consecutive_failures") >= COOLDOWN_AFTER,
               F.col("_last_fail") + interval(FAILURE_COOLDOWN)).alias("disabled_until_at"))


def poll_decision(sources: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Whether each source is to be polled at ``now`` and why."""
    joined = sources.select("source_id", "polling_interval_s").join(state, "source_id", "left")
    wait = F.when(F.col("burst_until_at") > now, F.lit(BURST_INTERVAL_S)).otherwise(F.col("polling_interval_s"))
    next_due = F.col("last_fetched_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait)
    reason = (
        F.when(F.col("disabled_until_at") > now, "failure_cooldown").when(F.col("last_fetched_at").isNull(), "never_fetched")
        .when(next_due > now, "interval_not_elapsed").otherwise("due"))
    return joined.withColumn("reason", reason).withColumn("should_poll", F.col("reason").isin("never_fetched", "due"))
