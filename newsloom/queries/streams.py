"""Streaming jobs, run over everything available and compared with batch SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scoring
from newsloom.operators import polling, quality
from newsloom.queries.base import query
from newsloom.queries.market import decision_sql
from newsloom.queries.quality import HASHED, KEYED
from newsloom.sources.tables import Desk, wall
from newsloom.streaming import files, jobs

NOW = "2024-01-20 00:00:00"


class StreamDesk(Desk):
    """The same derived tables over file streams of documents, events, orders and lineitem."""

    STREAMED = ("documents", "events", "orders", "lineitem")

    def table(self, name: str) -> DataFrame:
        if name in self.STREAMED:
            return files.stream_parquet(self.spark, self.folder, name)
        return super().table(name)


def streams(desk: Desk) -> StreamDesk:
    live = StreamDesk(desk.spark, desk.folder)
    live.sources = desk.sources  # a static dimension
    return live


@query("i1_stream_dedup", f"""
WITH hashed AS ({HASHED}), keyed AS ({KEYED})
SELECT DISTINCT CASE WHEN source_type = 'google-rss' AND snippet IS NOT NULL THEN 'text' ELSE 'url' END AS key_kind,
  CASE WHEN source_type = 'google-rss' AND snippet IS NOT NULL THEN text_hash ELSE url_hash END AS key_a,
  CASE WHEN source_type = 'google-rss' AND snippet IS NOT NULL THEN title_hash ELSE '' END AS key_b FROM keyed""")
def i1(desk: Desk) -> DataFrame:
    news = streams(desk).news.withColumn("effective_time", desk.effective_time.cast("timestamp"))
    kept = jobs.deduplicated_news(news).select(*quality.KEY)
    return files.run_to_table(kept, files.new_folder(desk.spark, "dedup"))


POLL_SQL = """
ok AS (SELECT source_id, max((fetched_at, log_id)) AS o FROM fetch_logs WHERE status = 'success' GROUP BY 1),
st AS (SELECT l.source_id, max(l.fetched_at) AS last_fetched_at, count(*) FILTER (l.status <> 'success' AND (ok.o IS NULL OR (l.fetched_at, l.log_id) > ok.o)) AS consecutive_failures,
   max(l.fetched_at) FILTER (l.status = 'success' AND l.inserted > 0) + INTERVAL 30 MINUTE AS burst_until_at, max(l.fetched_at) FILTER (l.status <> 'success') AS lf
  FROM fetch_logs l LEFT JOIN ok USING (source_id) GROUP BY 1),
state AS (SELECT source_id, last_fetched_at, consecutive_failures, burst_until_at, CASE WHEN consecutive_failures >= 3 THEN lf + INTERVAL 30 MINUTE END AS disabled_until_at FROM st)"""


@query("i2_poll_state", f"WITH {POLL_SQL} SELECT * FROM state")
def i2(desk: Desk) -> DataFrame:
    return polling.poll_state(desk.fetch_logs)


@query("i2_poll_decision", f"""
WITH {POLL_SQL}, d AS (SELECT s.source_id, s.polling_interval_s, t.*, TIMESTAMP '2024-01-30 23:40:00' AS now FROM sources s LEFT JOIN state t USING (source_id))
SELECT source_id, CASE WHEN disabled_until_at > now THEN 'failure_cooldown' WHEN last_fetched_at IS NULL THEN 'never_fetched'
  WHEN last_fetched_at + to_seconds(CASE WHEN burst_until_at > now THEN 60 ELSE polling_interval_s END) > now THEN 'interval_not_elapsed' ELSE 'due' END AS reason FROM d""")
def i2_decision(desk: Desk) -> DataFrame:
    made = polling.poll_decision(desk.sources, polling.poll_state(desk.fetch_logs), wall("2024-01-30 23:40:00"))
    return made.select("source_id", "reason")


@query("i2_stream_poll_state", f"WITH {POLL_SQL} SELECT * FROM state")
def i2_stream(desk: Desk) -> DataFrame:
    return jobs.run_poll_state(streams(desk).fetch_logs, files.new_folder(desk.spark, "poll"))


@query("i3_stream_escalations", f"""
WITH r AS (SELECT event_id, user_id AS cluster_id, ts, CAST(least(100, floor(value)) AS INT) AS score FROM events),
d AS (SELECT *, {decision_sql('score')} AS decision, CASE WHEN score >= 80 THEN 3 WHEN score >= 55 THEN 2 WHEN score >= 30 THEN 1 ELSE 0 END AS rk FROM r),
w AS (SELECT *, coalesce(max(rk) OVER (PARTITION BY cluster_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM d)
SELECT event_id, cluster_id, ts, score, decision FROM w WHERE rk > top""")
def i3(desk: Desk) -> DataFrame:
    score = F.least(F.lit(100), F.floor("value").cast("int"))
    decisions = streams(desk).table("events").select(
        "event_id", F.col("user_id").alias("cluster_id"), "ts", score.alias("score"), scoring.decide(score).alias("decision"))
    return jobs.run_escalations(decisions, files.new_folder(desk.spark, "escalations"))


def counted(desk: Desk, make, name: str) -> DataFrame:
    logs = files.zoned(streams(desk).fetch_logs, "fetched_at")
    return files.run_to_table(make(logs, "1 hour"), files.new_folder(desk.spark, name))


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("i4_daily_counts", f"""
SELECT source_id, date_trunc('day', fetched_at) AS window_start, date_trunc('day', fetched_at) + INTERVAL 1 DAY AS window_end, count(*) AS fetches,
  CAST(sum(inserted) AS BIGINT) AS item_count FROM fetch_logs GROUP BY 1, 2, 3 HAVING date_trunc('day', fetched_at) + INTERVAL 1 DAY <= {CLOSED}""")
def i4_daily(desk: Desk) -> DataFrame:
    return counted(desk, jobs.daily_counts, "daily")


@query("i4_sliding_counts", f"""
WITH w AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, fetched_at) - k * INTERVAL 5 MINUTE AS s FROM fetch_logs, range(6) r(k))
SELECT source_id, s AS window_start, s + INTERVAL 30 MINUTE AS window_end, count(*) AS fetches, CAST(sum(inserted) AS BIGINT) AS item_count FROM w
GROUP BY 1, 2, 3 HAVING s + INTERVAL 30 MINUTE <= {CLOSED}""")
def i4_sliding(desk: Desk) -> DataFrame:
    return counted(desk, jobs.sliding_counts, "sliding")


@query("i4_burst_sessions", f"""
WITH g AS (SELECT *, CASE WHEN fetched_at - lag(fetched_at) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM fetch_logs WINDOW w AS (PARTITION BY source_id ORDER BY fetched_at)),
s AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY fetched_at, log_id) AS n FROM g)
SELECT source_id, min(fetched_at) AS window_start, max(fetched_at) + INTERVAL 30 MINUTE AS window_end, count(*) AS fetches, CAST(sum(inserted) AS BIGINT) AS item_count
FROM s GROUP BY source_id, n HAVING max(fetched_at) + INTERVAL 30 MINUTE <= {CLOSED}""")
def i4_sessions(desk: Desk) -> DataFrame:
    return counted(desk, jobs.burst_sessions, "sessions")


def joined_moves(desk: Desk, **window: timedelta) -> DataFrame:
    live = streams(desk)
    moves = files.zoned(live.moves.select("move_id", "symbol", "ts"), "ts")
    d = F.col("doc_id")
    events = live.table("documents").select(F.concat(F.lit("N"), d % 25).alias("symbol"), d.alias("cluster_id"),
                                            (F.lit(1704067200) + d * 2400).cast("timestamp").alias("created_at"))
    rows = jobs.moves_with_events(moves, events, "1 hour", **window).select("move_id", "symbol", "cluster_id")
    return files.run_to_table(rows, files.new_folder(desk.spark, "moves"))


@query("i5_stream_event_move_join", """
SELECT m.move_id, m.symbol, d.doc_id AS cluster_id FROM moves m JOIN documents d ON m.symbol = 'N' || (d.doc_id % 25)
 AND TIMESTAMP '2024-01-01' + to_seconds(d.doc_id * 2400) BETWEEN m.ts - INTERVAL 4 HOUR AND m.ts + INTERVAL 24 HOUR""")
def i5(desk: Desk) -> DataFrame:
    return joined_moves(desk).filter(F.col("cluster_id").isNotNull())


@query("i5_stream_unmatched_moves", """
WITH e AS (SELECT 'N' || (doc_id % 25) AS symbol, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 2400) AS at_ FROM documents),
closed AS (SELECT least((SELECT max(ts) FROM events), (SELECT max(at_) FROM e)) - INTERVAL 1 HOUR AS t)
SELECT m.move_id, m.symbol FROM moves m, closed c WHERE m.ts + INTERVAL 2 HOUR < c.t AND NOT EXISTS (SELECT 1 FROM e WHERE e.symbol = m.symbol
  AND e.at_ BETWEEN m.ts - INTERVAL 2 HOUR AND m.ts + INTERVAL 2 HOUR)""")
def i5_unmatched(desk: Desk) -> DataFrame:
    near = timedelta(hours=2)
    rows = joined_moves(desk, event_before=near, event_after=near)
    return rows.filter(F.col("cluster_id").isNull()).select("move_id", "symbol")


@query("i6_change_stream", """
SELECT created_at AS "at", 'alert.created' AS event, alert_id AS item_id, decision AS state FROM alert_decisions
UNION ALL SELECT l_shipdate, 'pipeline.completed', l_orderkey, l_linestatus FROM lineitem
UNION ALL SELECT coalesce(completed_at, started_at, created_at), 'command.updated', command_id, status FROM commands""")
def i6(desk: Desk) -> DataFrame:
    live = streams(desk)
    finished = live.table("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("completed_at"),
                                             F.col("l_linestatus").alias("status"))
    feed = jobs.change_stream(live.alert_decisions, finished, live.commands)
    return files.run_to_table(feed, files.new_folder(desk.spark, "feed"))


@query("i7_microbatch_pipeline", f"""
WITH hashed AS ({HASHED}), keyed AS ({KEYED})
SELECT 'normalize' AS stage, 'success' AS status, count(*) AS row_count FROM news
UNION ALL SELECT 'dedupe', 'success', count(DISTINCT k) FROM keyed UNION ALL SELECT 'enrich', 'failed', 0
UNION ALL SELECT 'by_source', 'success', count(DISTINCT source_id) FROM news""")
def i7(desk: Desk) -> DataFrame:
    def keepers(tables: dict[str, DataFrame]) -> DataFrame:
        marked = quality.mark_exact_duplicates(tables["normalize"].withColumn("status", F.lit("normalized")))
        return marked.filter(F.col("status") == "normalized")

    stages = [
        ("normalize", lambda t: quality.normalize_and_hash(t["input"]), True), ("dedupe", keepers, True),
        ("enrich", lambda t: t["missing_table"], False),
        ("by_source", lambda t: t["normalize"].groupBy("source_id").agg(F.count(F.lit(1)).alias("items")), False)]
    out = jobs.run_pipeline(streams(desk).news, stages, files.new_folder(desk.spark, "pipeline"))
    return out["metrics"].select("stage", "status", "row_count")


@query("i8_rate_limits", f"""
WITH l AS (SELECT 'p' || (user_id % 4) AS provider, arg_max(CAST(value * 600 AS INT), ts) AS s, max(ts) AS limited_at FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '{NOW}' GROUP BY 1)
SELECT provider, limited_at, limited_at + to_seconds(s) AS cooldown_until, limited_at + to_seconds(s) > TIMESTAMP '{NOW}' AS cooling_down FROM l""")
def i8(desk: Desk) -> DataFrame:
    responses = desk.table("events").filter(F.col("ts") <= wall(NOW)).select(
        F.concat(F.lit("p"), F.col("user_id") % 4).alias("provider"), F.when(F.col("event_type") == "error", 429).otherwise(200).alias("http_status"),
        F.col("ts").alias("received_at"), F.round(F.col("value") * 600).cast("int").alias("retry_after_s"))
    return jobs.rate_limits(responses, wall(NOW))
