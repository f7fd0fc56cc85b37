"""Structured Streaming forms of the ingest, alert and market jobs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import scoring
from newsloom.operators import quality
from newsloom.operators.market import POST_EVENT, PRE_EVENT
from newsloom.operators.polling import BURST_WINDOW, COOLDOWN_AFTER, FAILURE_COOLDOWN
from newsloom.plans.intervals import interval
from newsloom.plans.keys import top_per_key
from newsloom.streaming.files import VersionedTable, run_batches, wall

FRESHNESS = "168 hours"


def deduplicated_news(news: DataFrame, lateness: str = FRESHNESS) -> DataFrame:
    """Normalised, hashed news, one row per de-duplication key within the freshness window.

    The watermark runs on the effective time, so items older than the window are dropped where a
    batch run would skip them as stale. ``news`` needs a zoned ``effective_time``.
    """
    keyed = quality.with_dedup_key(quality.hashed_for_dedup(news))
    return keyed.withWatermark("effective_time", lateness).dropDuplicatesWithinWatermark(list(quality.KEY))


# --- source poll state ----------------------------------------------------------------------

POLL_SCHEMA = ("source_id string, last_fetched_at timestamp_ntz, consecutive_failures long, last_burst timestamp_ntz, "
               "last_fail timestamp_ntz")


def _poll_summary(logs: DataFrame) -> DataFrame:
    """What a batch of logs does to each source; folded map-side, whatever a source's share is."""
    order = F.struct("fetched_at", "log_id")
    ok = F.col("status") == "success"
    last_ok = logs.groupBy("source_id").agg(F.max(F.when(ok, order)).alias("_ok"))
    after = F.col("_ok").isNull() | (order > F.col("_ok"))
    return logs.join(last_ok, "source_id").groupBy("source_id").agg(
        F.max("fetched_at").alias("b_last"), F.count_if(~ok & after).alias("b_failures"),
        F.max(F.col("_ok").isNotNull()).alias("b_ok"), F.max(F.when(ok & (F.col("inserted") > 0), F.col("fetched_at"))).alias("b_burst"),
        F.max(F.when(~ok, F.col("fetched_at"))).alias("b_fail"))


def _merge_poll_state(old: DataFrame, batch: DataFrame) -> DataFrame:
    """State after a batch: failures add up unless the batch holds a success."""
    joined = old.join(_poll_summary(batch), "source_id", "full_outer")
    ok = F.coalesce("b_ok", F.lit(False))
    carried = F.when(ok, F.lit(0)).otherwise(F.coalesce("consecutive_failures", F.lit(0)))
    return joined.select(
        "source_id", F.greatest("last_fetched_at", "b_last").alias("last_fetched_at"),
        (carried + F.coalesce("b_failures", F.lit(0))).cast("long").alias("consecutive_failures"),
        F.greatest("last_burst", "b_burst").alias("last_burst"), F.greatest("last_fail", "b_fail").alias("last_fail"))


def run_poll_state(logs: DataFrame, folder: str) -> DataFrame:
    """Fold a fetch-log stream into the poll state of every source."""
    table = VersionedTable(logs.sparkSession, f"{folder}/state", POLL_SCHEMA)

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.store(_merge_poll_state(table.before(batch_id), batch), batch_id)

    run_batches(logs, handle, folder)
    return table.latest().select(
        "source_id", "last_fetched_at", "consecutive_failures", (F.col("last_burst") + interval(BURST_WINDOW)).alias("burst_until_at"),
        F.when(F.col("consecutive_failures") >= COOLDOWN_AFTER, F.col("last_fail") + interval(FAILURE_COOLDOWN)).alias("disabled_until_at"))


# --- escalation log -------------------------------------------------------------------------

RANK_SCHEMA = "cluster_id long, top int"


def _new_escalations(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of the batch that raise their cluster's rank above the state and above earlier rows."""
    rank = scoring.ranked(F.col("decision"), scoring.DECISION_RANK, -1)
    firsts = top_per_key(batch.withColumn("rank", rank).filter("rank > 0"), ["cluster_id", "rank"], (F.col("ts"), F.col("event_id")))
    earlier = Window.partitionBy("cluster_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rated = firsts.join(state, "cluster_id", "left").withColumn("_prior", F.max("rank").over(earlier))
    return rated.filter(F.col("rank") > F.greatest(F.coalesce("top", F.lit(0)), F.coalesce("_prior", F.lit(0)))).drop("top", "_prior")


def run_escalations(decisions: DataFrame, folder: str) -> DataFrame:
    """Append-only escalation log of a decision stream."""
    spark = decisions.sparkSession
    ranks = VersionedTable(spark, f"{folder}/ranks", RANK_SCHEMA)
    log = f"{folder}/log"

    def handle(batch: DataFrame, batch_id: int) -> None:
        state = ranks.before(batch_id)
        _new_escalations(batch, state).drop("rank").write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        fresh = spark.read.parquet(f"{log}/batch={batch_id}").select(
            "cluster_id", scoring.ranked(F.col("decision"), scoring.DECISION_RANK, 0).alias("top"))
        ranks.store(state.unionByName(fresh).groupBy("cluster_id").agg(F.max("top").cast("int").alias("top")), batch_id)

    run_batches(decisions, handle, folder)
    return spark.read.parquet(log).drop("batch")


# --- windowed counts ------------------------------------------------------------------------

def daily_counts(logs: DataFrame, lateness: str) -> DataFrame:
    return _counts(logs, F.window("fetched_at", "1 day"), lateness)


def sliding_counts(logs: DataFrame, lateness: str) -> DataFrame:
    return _counts(logs, F.window("fetched_at", "30 minutes", "5 minutes"), lateness)


def burst_sessions(logs: DataFrame, lateness: str) -> DataFrame:
    """Runs of fetches with less than thirty minutes between them."""
    return _counts(logs, F.session_window("fetched_at", "30 minutes"), lateness)


def _counts(logs: DataFrame, span: Column, lateness: str) -> DataFrame:
    grouped = logs.withWatermark("fetched_at", lateness).groupBy("source_id", span.alias("w")).agg(
        F.count(F.lit(1)).alias("fetches"), F.sum("inserted").alias("item_count"))
    return wall(grouped.select("source_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                               "fetches", "item_count"), "window_start", "window_end")


# --- interval join and feeds ----------------------------------------------------------------

def moves_with_events(moves: DataFrame, events: DataFrame, lateness: str, event_before: timedelta = POST_EVENT,
                      event_after: timedelta = PRE_EVENT) -> DataFrame:
    """Left outer join of moves with the events around them; state is bounded by the event window.

    ``moves``: ``symbol, ts``; ``events``: ``symbol, created_at, cluster_id``. A move without an
    event comes out with a null ``cluster_id`` once the watermark has passed its window.

    Both sides meet on symbol and stretch of time, as long as the window. A move is in one stretch, so it is matched or not in one
    place; an event is in each whose moves it can meet, two at most. No row meets all rows of a symbol.
    """
    before, after = _hours(event_before), _hours(event_after)
    width = max(before + after, 1) * 3_600_000_000

    def stretch(at: str, hours: int) -> Column:
        return F.floor((F.unix_micros(at) + F.lit(hours * 3_600_000_000)) / F.lit(width))

    left = moves.withWatermark("ts", lateness).withColumn("_stretch", stretch("ts", 0))
    right = events.withColumnRenamed("symbol", "event_symbol").withWatermark("created_at", lateness).withColumn(
        "_event_stretch", F.explode(F.sequence(stretch("created_at", -after), stretch("created_at", before))))
    near = F.expr(
        f"symbol = event_symbol AND _stretch = _event_stretch AND created_at >= ts - INTERVAL {before} HOURS "
        f"AND created_at <= ts + INTERVAL {after} HOURS")
    return left.join(right, near, "left_outer").drop("event_symbol", "_stretch", "_event_stretch")


def _hours(span: timedelta) -> int:
    return int(span.total_seconds() // 3600)


def change_stream(alerts: DataFrame, job_runs: DataFrame, commands: DataFrame) -> DataFrame:
    """One append stream of new alerts, finished pipeline runs and commands; the cursor is the checkpoint."""
    def part(rows: DataFrame, event: str, at: Column, item: str, state: str) -> DataFrame:
        return rows.select(at.alias("at"), F.lit(event).alias("event"), F.col(item).alias("item_id"), F.col(state).alias("state"))

    return (part(alerts, "alert.created", F.col("created_at"), "alert_id", "decision")
            .unionByName(part(job_runs, "pipeline.completed", F.col("completed_at"), "run_id", "status"))
            .unionByName(part(commands, "command.updated", F.coalesce("completed_at", "started_at", "created_at"), "command_id", "status")))


# --- micro-batch pipeline -------------------------------------------------------------------

Stage = tuple[str, Callable[[dict[str, DataFrame]], DataFrame], bool]
METRICS = "batch_id long, stage string, status string, row_count long, error string"


def run_pipeline(source: DataFrame, stages: list[Stage], folder: str) -> dict[str, DataFrame]:
    """Run stages on every micro-batch of ``source``; each writes its own table.

    A stage is ``(name, function of the tables so far, required)``. Its rows replace those of the
    same batch id, so a repeated batch changes nothing. A failing optional stage leaves the run
    degraded; a failing required stage stops the stream. Returns the stage tables and ``metrics``.
    """
    spark: SparkSession = source.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        tables, records = {"input": batch}, []
        for name, make, required in stages:
            counted = Observation()
            try:
                path = f"{folder}/{name}/batch={batch_id}"
                make(tables).observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
                tables[name] = spark.read.parquet(path)
                records.append((batch_id, name, "success", counted.get["rows"], None))
            except Exception as error:
                if required:
                    raise
                records.append((batch_id, name, "failed", 0, type(error).__name__))
        spark.createDataFrame(records, METRICS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/metrics/batch={batch_id}")

    run_batches(source, handle, folder)
    metrics = spark.read.schema(METRICS).parquet(f"{folder}/metrics")
    done = {r["stage"] for r in metrics.filter(F.col("status") == "success").select("stage").distinct().collect()}
    return {"metrics": metrics, **{name: spark.read.parquet(f"{folder}/{name}") for name, _, _ in stages if name in done}}


def run_status(metrics: DataFrame) -> DataFrame:
    """Status per batch: degraded when any stage failed."""
    return metrics.groupBy("batch_id").agg(
        F.when(F.count_if(F.col("status") == "failed") > 0, "degraded").otherwise("success").alias("status"),
        F.sum("row_count").alias("row_count"))


def rate_limits(responses: DataFrame, now: Column) -> DataFrame:
    """Latest 429 per provider and whether its cool-down still holds.

    ``responses``: ``provider, http_status, received_at, retry_after_s``.
    """
    limited = responses.filter(F.col("http_status") == 429)
    latest = limited.groupBy("provider").agg(F.max(F.struct("received_at", "retry_after_s")).alias("r"))
    until = F.col("r.received_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce("r.retry_after_s", F.lit(60)))
    return latest.select("provider", F.col("r.received_at").alias("limited_at"), until.alias("cooldown_until"),
                         (until > now).alias("cooling_down"))
