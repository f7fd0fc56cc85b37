"""Read models, reporting, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import reports, retention
from newsloom.queries.base import query
from newsloom.queries.market import INVESTIGATIONS_SQL, REVIEWS_SQL, investigations, reviews
from newsloom.sources.tables import Desk, wall

NOW = "2024-01-20 00:00:00"
SINCE, UNTIL = "2024-01-10 01:00:00", "2024-01-11 01:00:00"
RANGES_SQL = """
ranges AS (SELECT l.cluster_id, min(n.eff) AS report_start_at, max(n.eff) AS report_end_at
           FROM cluster_items l JOIN news n USING (news_id) GROUP BY 1)"""


def ranges(desk: Desk) -> DataFrame:
    return reports.report_ranges(desk.cluster_items, desk.news)


def news(desk: Desk) -> DataFrame:
    return desk.news.withColumn("status", F.when(F.col("news_id") % 3 == 0, "deduped").otherwise("normalized"))


NEWS_SQL = "listed AS (SELECT *, CASE WHEN news_id % 3 = 0 THEN 'deduped' ELSE 'normalized' END AS status FROM news)"


@query("g1_report_ranges", f"WITH {RANGES_SQL} SELECT * FROM ranges")
def g1(desk: Desk) -> DataFrame:
    return ranges(desk)


CRYPTO = "(list_contains(asset_classes, 'crypto') OR list_contains(regions, 'crypto'))"
VIETNAM = "(list_contains(regions, 'vietnam') OR list_contains(regions, 'vn') OR list_contains(asset_classes, 'vietnam_equity'))"
US = "(list_contains(regions, 'us') OR list_contains(regions, 'usa'))"


@query("g2_event_listing", f"""
WITH {RANGES_SQL} SELECT c.cluster_id, c.headline, c.final_score, r.report_end_at FROM clusters c LEFT JOIN ranges r USING (cluster_id)
WHERE c.final_score >= 20 AND c.headline ILIKE '%en%' AND {CRYPTO}
ORDER BY r.report_end_at DESC NULLS LAST, c.last_updated_at DESC, c.created_at DESC, c.cluster_id LIMIT 30 OFFSET 10""")
def g2(desk: Desk) -> DataFrame:
    rows = reports.list_events(desk.clusters, ranges(desk), min_score=20, q="EN", segment="crypto", limit=50, offset=10, max_items=40)
    return rows.select("cluster_id", "headline", "final_score", "report_end_at")


@query("g3_market_segments", f"""
SELECT cluster_id, {CRYPTO} AS crypto, {VIETNAM} AS vietnam, {US} AS us, NOT {CRYPTO} AND NOT {VIETNAM} AND NOT {US} AS global FROM clusters""")
def g3(desk: Desk) -> DataFrame:
    return desk.clusters.select("cluster_id", *[reports.in_segment(s).alias(s) for s in ("crypto", "vietnam", "us", "global")])


@query("g4_event_regions", "SELECT DISTINCT unnest(regions) AS region FROM clusters")
def g4_regions(desk: Desk) -> DataFrame:
    return reports.array_values(desk.clusters, "regions", "region")


@query("g4_news_facets", f"""
WITH {NEWS_SQL} SELECT DISTINCT 'status' AS facet, status AS value FROM listed UNION SELECT DISTINCT 'region', region FROM listed""")
def g4_news(desk: Desk) -> DataFrame:
    return reports.news_facets(news(desk))


@query("g5_news_listing", f"""
WITH {NEWS_SQL} SELECT news_id, title, created_at FROM listed WHERE status = 'normalized' AND region = 'us'
  AND lower(url) LIKE 'https://src1.example.com/%' AND (title ILIKE '%on%' OR snippet ILIKE '%on%' OR url ILIKE '%on%')""")
def g5(desk: Desk) -> DataFrame:
    rows = news(desk).withColumn("canonical_url", F.lit(None).cast("string"))
    return reports.list_news(rows, status="normalized", region="us", domain="src1.example.com", q="ON").select(
        "news_id", "title", "created_at")


@query("g6_event_timeline", """
SELECT l.cluster_id, l.news_id, l.added_at, l.reason, l.similarity_score, n.title, n.source_name, n.fetched_at, n.eff AS effective_time
FROM cluster_items l JOIN news n USING (news_id)""")
def g6(desk: Desk) -> DataFrame:
    return reports.event_timeline(desk.cluster_items, desk.news)


@query("g6_last_scores", """
SELECT cluster_id, string_agg(history_id || ':' || final_score, ' ' ORDER BY created_at DESC, history_id DESC) AS scores FROM (
  SELECT * FROM score_history QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, history_id DESC) <= 20)
GROUP BY cluster_id""")
def g6_scores(desk: Desk) -> DataFrame:
    rows = reports.last_scores(desk.score_history)
    return rows.select("cluster_id", F.array_join(F.transform(
        "scores", lambda s: F.concat_ws(":", s["history_id"], s["final_score"])), " ").alias("scores"))


@query("g7_alert_listing", f"""
WITH {RANGES_SQL} SELECT a.alert_id, a.cluster_id, a.decision, c.headline, c.status, r.report_end_at
FROM alert_decisions a JOIN clusters c USING (cluster_id) LEFT JOIN ranges r USING (cluster_id)
WHERE a.decision IN ('immediate_alert', 'watchlist_batch', 'daily_digest', 'digest_only')""")
def g7(desk: Desk) -> DataFrame:
    rows = reports.list_alerts(desk.alert_decisions, desk.clusters, ranges(desk))
    return rows.select("alert_id", "cluster_id", "decision", "headline", "status", "report_end_at")


DIGEST_SQL = f"""
picked AS (SELECT * FROM (SELECT * FROM clusters WHERE cluster_id IN (SELECT l.cluster_id FROM cluster_items l JOIN news n USING (news_id)
     WHERE n.eff >= TIMESTAMP '{SINCE}' AND n.eff < TIMESTAMP '{UNTIL}') ORDER BY final_score DESC, created_at DESC, cluster_id LIMIT 12)
  WHERE final_score >= 30)"""


def digest(desk: Desk) -> DataFrame:
    return reports.digest_events(desk.clusters, desk.cluster_items, desk.news, wall(SINCE), wall(UNTIL), threshold=30, limit=12)


@query("g8_digest_selection", f"WITH {DIGEST_SQL} SELECT cluster_id, headline, final_score FROM picked")
def g8(desk: Desk) -> DataFrame:
    return digest(desk).select("cluster_id", "headline", "final_score")


@query("g8_digest_preview", """
SELECT cluster_id, headline, final_score FROM clusters WHERE final_score >= 30 AND status NOT IN ('stale', 'false_signal', 'merged')
ORDER BY final_score DESC, last_updated_at DESC, cluster_id LIMIT 20""")
def g8_preview(desk: Desk) -> DataFrame:
    return reports.digest_preview(desk.clusters, 20).select("cluster_id", "headline", "final_score")


@query("g9_digest_headlines", f"""
SELECT c.cluster_id, coalesce(w.t, c.headline) AS digest_headline FROM clusters c LEFT JOIN (
  SELECT l.cluster_id, arg_max(n.title, (n.eff, -n.news_id)) AS t FROM cluster_items l JOIN news n USING (news_id)
  WHERE n.eff >= TIMESTAMP '{SINCE}' AND n.eff < TIMESTAMP '{UNTIL}' GROUP BY 1) w USING (cluster_id)""")
def g9(desk: Desk) -> DataFrame:
    return reports.digest_headlines(desk.clusters, desk.cluster_items, desk.news, wall(SINCE), wall(UNTIL))


@query("g10_digest_groups", f"""
WITH {DIGEST_SQL} SELECT upper(regions[1]) || ' / ' || asset_classes[1] AS "group",
  string_agg('- ' || final_score || ' ' || status || ': ' || headline || ' (' || source_count || ' sources)', chr(10)
             ORDER BY final_score DESC, cluster_id) AS lines FROM picked GROUP BY 1""")
def g10(desk: Desk) -> DataFrame:
    return reports.digest_text(digest(desk))


@query("g11_day_windows", """
SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 7 HOUR AS day_start,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 17 HOUR AS day_end,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR AS digest_start FROM events""")
def g11(desk: Desk) -> DataFrame:
    days = desk.table("events").select(F.col("ts").cast("date").alias("day")).distinct()
    start, end = reports.day_window(F.col("day"), "Asia/Ho_Chi_Minh")
    digest_start, _ = reports.day_window(F.col("day"), "Asia/Ho_Chi_Minh", start_hour=8)
    return days.select("day", start.alias("day_start"), end.alias("day_end"), digest_start.alias("digest_start"))


CURSOR = "2000-06-01 00:00:00"


@query("g12_change_feed", f"""
WITH feed AS (SELECT created_at AS at_, 'alert.created' AS event, alert_id AS item_id, decision AS state FROM alert_decisions
   WHERE created_at > TIMESTAMP '{CURSOR}'
  UNION ALL SELECT completed_at, 'pipeline.completed', run_id, status FROM job_runs WHERE job_name = 'pipeline' AND completed_at > TIMESTAMP '{CURSOR}'
  UNION ALL SELECT coalesce(completed_at, started_at, created_at), 'command.updated', command_id, status FROM commands
   WHERE created_at > TIMESTAMP '{CURSOR}' OR started_at > TIMESTAMP '{CURSOR}' OR completed_at > TIMESTAMP '{CURSOR}')
SELECT at_ AS "at", event, item_id, state FROM feed""")
def g12(desk: Desk) -> DataFrame:
    return reports.change_feed(desk.alert_decisions, desk.job_runs, desk.commands, wall(CURSOR))


PRICES = "(VALUES ('model-a', 0.005, 0.015), ('model-b', 0.00015, 0.0006), ('model-c', 0.00013, 0.0)) p(model, pp, cp)"


@query("g13_model_costs", f"""
WITH r AS (SELECT CAST(created_at AS DATE) AS day, m.model, analysis_type, prompt_tokens, completion_tokens,
   CAST(round_even(coalesce(prompt_tokens / 1000.0::DOUBLE * pp::DOUBLE + completion_tokens / 1000.0::DOUBLE * cp::DOUBLE, 0), 6) AS DECIMAL(20, 6)) AS cost
  FROM model_runs m LEFT JOIN {PRICES} USING (model) WHERE created_at >= TIMESTAMP '2024-01-10')
SELECT day, model, analysis_type, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost) AS DOUBLE) AS estimated_cost_usd
FROM r GROUP BY GROUPING SETS ((day), (model), (analysis_type), ())""")
def g13(desk: Desk) -> DataFrame:
    prices = desk.spark.createDataFrame(
        [("model-a", 0.005, 0.015), ("model-b", 0.00015, 0.0006), ("model-c", 0.00013, 0.0)],
        "model string, prompt_price double, completion_price double")
    return reports.model_costs(desk.model_runs, prices, wall("2024-01-10 00:00:00"))


FIELDS = ("score_modifier", "confidence")
COMPARE_SQL = """
latest AS (SELECT * FROM model_runs WHERE status = 'succeeded' AND model IN ('model-a', 'model-b')
  QUALIFY row_number() OVER (PARTITION BY target_id, analysis_type, prompt_version, model ORDER BY created_at DESC, run_id DESC) = 1),
wide AS (SELECT a.target_id, a.analysis_type, a.prompt_version, a.score_modifier AS score_modifier_a, b.score_modifier AS score_modifier_b,
  a.confidence AS confidence_a, b.confidence AS confidence_b, a.score_modifier = b.score_modifier AS same_score_modifier,
  a.confidence = b.confidence AS same_confidence FROM latest a JOIN latest b USING (target_id, analysis_type, prompt_version)
  WHERE a.model = 'model-a' AND b.model = 'model-b')"""


@query("g14_model_comparison", f"WITH {COMPARE_SQL} SELECT * FROM wide")
def g14(desk: Desk) -> DataFrame:
    return reports.compare_models(desk.model_runs, "model-a", "model-b", FIELDS)


@query("g14_model_agreement", f"""
WITH {COMPARE_SQL} SELECT analysis_type, prompt_version, count(*) AS targets, round_even(avg(CAST(same_score_modifier AS INT)), 6) AS agree_score_modifier,
  round_even(avg(CAST(same_confidence AS INT)), 6) AS agree_confidence FROM wide GROUP BY 1, 2""")
def g14_rate(desk: Desk) -> DataFrame:
    return reports.agreement(reports.compare_models(desk.model_runs, "model-a", "model-b", FIELDS), FIELDS)


@query("g15_response_recovery", """
SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN text END AS summary, CASE WHEN turn % 4 < 3 THEN CAST(conv_id AS INT) END AS score,
  ['plain', 'fenced', 'extracted', 'failed'][turn % 4 + 1] AS outcome FROM conversations""")
def g15(desk: Desk) -> DataFrame:
    body = F.to_json(F.struct(F.col("text").alias("summary"), F.col("conv_id").cast("int").alias("score"), "role"))
    kind = F.col("turn") % 4
    raw = (F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" I hope {this} helps.")))
           .otherwise(F.regexp_replace(body, "\"score\".*$", "")))
    responses = desk.table("conversations").select("conv_id", "turn", raw.alias("response"))
    rows = reports.recover_responses(responses, "response", "summary string, score int", ("summary", "score"))
    return rows.select("conv_id", "turn", "parsed.summary", "parsed.score", "outcome")


@query("g16_stage_metrics", """
SELECT s.run_id, s.stage, s.stage_status, s.duration_ms, r.started_at FROM job_stages s JOIN job_runs r USING (run_id) WHERE r.job_name = 'pipeline'""")
def g16(desk: Desk) -> DataFrame:
    return reports.flatten_stages(desk.job_runs).select("run_id", "stage", "stage_status", "duration_ms", "started_at")


@query("g17_slow_stages", """
WITH good AS (SELECT run_id, row_number() OVER (ORDER BY started_at, run_id) AS run_no FROM job_runs WHERE status = 'success' AND job_name = 'pipeline'),
w AS (SELECT s.run_id, g.run_no, s.stage, s.duration_ms, CAST(floor(avg(s.duration_ms) OVER f) AS BIGINT) AS average_ms
  FROM job_stages s JOIN good g USING (run_id) WINDOW f AS (PARTITION BY s.stage ORDER BY g.run_no RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT *, average_ms * 2 AS threshold_ms FROM w WHERE average_ms IS NOT NULL AND duration_ms > average_ms * 2""")
def g17(desk: Desk) -> DataFrame:
    runs = desk.job_runs.filter(F.col("job_name") == "pipeline")
    return reports.slow_stages(runs, desk.job_stages)


@query("g18_operational_checks", """
WITH now AS (SELECT TIMESTAMP '2024-01-20 12:00:00' AS t),
l AS (SELECT source_id, arg_max(status, (fetched_at, log_id)) AS s FROM fetch_logs, now WHERE fetched_at >= t - INTERVAL 24 HOUR GROUP BY 1),
found AS (SELECT 'worker_heartbeat' AS alert_type FROM (SELECT max(completed_at) AS m FROM job_runs WHERE job_name = 'pipeline' AND status = 'success'), now
    WHERE t - m > INTERVAL 600 SECOND
  UNION ALL SELECT 'source_failures' FROM (SELECT avg(CAST(s <> 'success' AS INT)) AS a FROM l) WHERE a > 0.5
  UNION ALL SELECT 'llm_provider_unreachable' FROM (SELECT count(*) AS n FROM model_runs, now WHERE status = 'failed' AND created_at >= t - INTERVAL 1 HOUR) WHERE n >= 3)
SELECT alert_type, alert_type IN (SELECT CASE WHEN event_type = 'click' THEN 'worker_heartbeat' ELSE 'other' END FROM events, now
   WHERE ts >= t - INTERVAL 1 HOUR AND event_type IN ('click', 'view')) AS suppressed FROM found""")
def g18(desk: Desk) -> DataFrame:
    sent = desk.table("events").filter(F.col("event_type").isin("click", "view")).select(
        F.when(F.col("event_type") == "click", "worker_heartbeat").otherwise("other").alias("alert_type"),
        F.lit("sent").alias("status"), F.col("ts").alias("attempted_at"))
    return reports.operational_checks(desk.job_runs, desk.fetch_logs, desk.model_runs, sent, wall("2024-01-20 12:00:00"))


@query("g19_job_failures", "SELECT run_id, job_name, started_at FROM job_runs WHERE status <> 'success'")
def g19_failures(desk: Desk) -> DataFrame:
    return reports.job_failures(desk.job_runs).select("run_id", "job_name", "started_at")


@query("g19_command_counts", "SELECT status, count(*) AS commands FROM commands GROUP BY 1")
def g19_commands(desk: Desk) -> DataFrame:
    return reports.command_counts(desk.commands)


@query("g19_reaped_commands", """
WITH s AS (SELECT *, status = 'running' AND started_at < TIMESTAMP '2001-07-01' - INTERVAL 900 SECOND AS stale FROM commands)
SELECT command_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN 'timed out (worker restart?)' END AS error_message,
  CASE WHEN stale THEN TIMESTAMP '2001-07-01' ELSE completed_at END AS completed_at FROM s""")
def g19_reap(desk: Desk) -> DataFrame:
    return reports.reap_stale_commands(desk.commands, wall("2001-07-01 00:00:00"), 900).select(
        "command_id", "status", "error_message", "completed_at")


@query("g19_alert_health", """
SELECT (SELECT count(*) FROM alert_decisions WHERE decision = 'immediate_alert' AND sent_at IS NULL) AS pending_immediate_alerts,
  (SELECT count(*) FROM deliveries WHERE status = 'failed') AS failed_deliveries,
  (SELECT arg_max(delivery_id, (attempted_at, delivery_id)) FROM deliveries) AS latest_delivery_id""")
def g19_health(desk: Desk) -> DataFrame:
    return reports.alert_health(desk.alert_decisions, desk.deliveries)


LINEAGE_SQL = f"""
{INVESTIGATIONS_SQL},
traced AS (SELECT d.doc_id AS raw_id, n.news_id, n.status, l.cluster_id, n.news_id IN (SELECT news_id FROM news_vectors) AS has_vector,
   (SELECT count(*) FROM news_entities e WHERE e.news_id = n.news_id) AS entity_count,
   (SELECT count(*) FROM alert_decisions a WHERE a.cluster_id = l.cluster_id) AS alert_count,
   (SELECT count(*) FROM investigations i WHERE i.target_type = 'event_cluster' AND i.target_id = l.cluster_id) AS investigation_count
  FROM documents d LEFT JOIN (SELECT * FROM listed WHERE language <> 'de') n ON n.news_id = d.doc_id
  LEFT JOIN cluster_items l ON l.news_id = n.news_id)"""


def traced(desk: Desk) -> DataFrame:
    raw = desk.table("documents").select(F.col("doc_id").alias("raw_id"))
    kept = news(desk).filter(F.col("language") != "de").withColumn("raw_id", F.col("news_id"))
    return reports.lineage(raw, kept, desk.cluster_items, desk.news_entities, desk.news_vectors, desk.alert_decisions,
                           investigations(desk))


@query("g20_lineage", f"WITH {NEWS_SQL}, {LINEAGE_SQL} SELECT * REPLACE (coalesce(has_vector, FALSE) AS has_vector) FROM traced")
def g20(desk: Desk) -> DataFrame:
    return traced(desk)


@query("g20_funnel", f"""
WITH {NEWS_SQL}, {LINEAGE_SQL} SELECT count(*) AS raw_items, count(news_id) AS news_items, count(*) FILTER (entity_count > 0) AS with_entities,
  count(*) FILTER (has_vector) AS with_vector, count(cluster_id) AS clustered, count(*) FILTER (alert_count > 0) AS alerted,
  count(*) FILTER (investigation_count > 0) AS investigated FROM traced""")
def g20_funnel(desk: Desk) -> DataFrame:
    return reports.funnel(traced(desk))


@query("g21_action_queue", f"""
WITH {RANGES_SQL}, {REVIEWS_SQL}, {INVESTIGATIONS_SQL},
li AS (SELECT * FROM investigations WHERE target_type = 'event_cluster'
  QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, run_id DESC) = 1)
SELECT 'alert' AS type, a.alert_id AS item_id, r.report_end_at AS "at" FROM alert_decisions a JOIN ranges r USING (cluster_id)
  WHERE a.decision = 'immediate_alert' AND r.report_end_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR
UNION ALL SELECT 'investigation', target_id, created_at FROM li WHERE status IN ('pending', 'running', 'investigating', 'failed')
  AND target_id IN (SELECT cluster_id FROM clusters)
UNION ALL SELECT 'catalyst', review_id, created_at FROM reviews WHERE detected_cluster_id IS NULL AND status IN ('pending', 'investigating')""")
def g21(desk: Desk) -> DataFrame:
    return reports.action_queue(desk.alert_decisions, ranges(desk), investigations(desk), desk.clusters, reviews(desk), wall(NOW))


@query("g22_score_trend", """
WITH e AS (SELECT cluster_id, count(*) AS points, arg_max(final_score, (created_at, history_id)) - arg_min(final_score, (created_at, history_id)) AS d
  FROM score_history GROUP BY 1)
SELECT cluster_id, points, CASE WHEN points >= 2 THEN d END AS delta, CASE WHEN points < 2 THEN NULL WHEN abs(d) < 1 THEN 'flat'
  WHEN d > 0 THEN '+' || d ELSE CAST(d AS VARCHAR) END AS trend FROM e""")
def g22(desk: Desk) -> DataFrame:
    return reports.score_trend(desk.score_history)


@query("g23_alert_articles", """
WITH e AS (SELECT CAST(json_extract(d.response, '$.result.message_id') AS BIGINT) AS message_id, a.alert_id, a.cluster_id
  FROM deliveries d JOIN alert_decisions a USING (alert_id) WHERE d.channel = 'telegram' AND d.status = 'sent'
  AND CAST(json_extract(d.response, '$.result.message_id') AS BIGINT) IN (SELECT DISTINCT c_custkey * 20 FROM customer)),
m AS (SELECT l.cluster_id, n.news_id, n.title, row_number() OVER (PARTITION BY l.cluster_id ORDER BY n.eff DESC, n.news_id DESC) AS position
  FROM cluster_items l JOIN news n USING (news_id))
SELECT e.message_id, e.alert_id, e.cluster_id, m.news_id, m.position, m.title FROM e JOIN m USING (cluster_id) WHERE m.position <= 10""")
def g23(desk: Desk) -> DataFrame:
    messages = desk.table("customer").select((F.col("c_custkey") * 20).alias("message_id"))
    return reports.alert_articles(messages, desk.deliveries, desk.alert_decisions, desk.cluster_items, desk.news)


@query("g24_summary_inputs", """
WITH r AS (SELECT l.cluster_id, l.news_id, l.added_at, n.fetched_at, n.language, n.source_score,
    trim(CASE WHEN n.news_id % 7 = 0 THEN ' ' ELSE n.content END) <> '' AS has_text FROM cluster_items l JOIN news n USING (news_id)),
c AS (SELECT cluster_id, count(*) AS news_item_count, count(*) FILTER (has_text) AS full_text_item_count FROM r GROUP BY 1),
t AS (SELECT cluster_id, language FROM (SELECT cluster_id, language, count(*) AS n, max(source_score) AS best, min((added_at, fetched_at, news_id)) AS f
   FROM r WHERE has_text GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, best DESC, f) = 1)
SELECT c.*, t.language AS predominant_language FROM c LEFT JOIN t USING (cluster_id)""")
def g24(desk: Desk) -> DataFrame:
    rows = desk.news.withColumn("content", F.when(F.col("news_id") % 7 == 0, " ").otherwise(F.col("content")))
    return reports.summary_inputs(desk.cluster_items, rows)


@query("e17_event_search", """
SELECT cluster_id, headline FROM clusters WHERE contains(lower(headline), 'nation_1')
  OR contains(lower(array_to_string(affected_entities || affected_tickers, chr(10))), 'nation_1')""")
def e17_events(desk: Desk) -> DataFrame:
    return reports.search_events(desk.clusters, "NATION_1").select("cluster_id", "headline")


@query("e17_news_search", "SELECT news_id FROM news WHERE title ILIKE '%der%' OR snippet ILIKE '%der%' OR url ILIKE '%der%'")
def e17_news(desk: Desk) -> DataFrame:
    return desk.news.filter(reports.any_contains("Der", "title", "snippet", "url")).select("news_id")


KEEP = {"fetch_logs": 6, "raw_items": 10, "news": 8, "clusters": 5, "alert_decisions": 9000}


def kept_tables(desk: Desk) -> dict[str, DataFrame]:
    return {
        "fetch_logs": desk.fetch_logs, "raw_items": desk.news.select(F.col("news_id").alias("raw_id"), "fetched_at"),
        "news": desk.news, "clusters": desk.clusters, "alert_decisions": desk.alert_decisions, "deliveries": desk.deliveries,
        "cluster_vectors": desk.cluster_vectors, "cluster_items": desk.cluster_items, "news_entities": desk.news_entities,
        "news_vectors": desk.news_vectors, "reviews": reviews(desk), "investigations": investigations(desk), "moves": desk.moves}


def cut(table: str) -> str:
    return f"TIMESTAMP '{NOW}' - INTERVAL {KEEP[table]} DAY"


GONE_SQL = f"""
{REVIEWS_SQL}, {INVESTIGATIONS_SQL},
gone AS (SELECT * FROM investigations i WHERE created_at < {cut('clusters')}
  OR (target_type = 'event_cluster' AND target_id NOT IN (SELECT cluster_id FROM clusters))
  OR (target_type = 'market_move' AND target_id NOT IN (SELECT move_id FROM moves))
  OR (target_type = 'missed_catalyst_review' AND target_id NOT IN (SELECT review_id FROM reviews)))"""


@query("h1_retention_preview", f"""
WITH {GONE_SQL}
SELECT 'fetch_logs' AS "table", count(*) AS stale_rows FROM fetch_logs WHERE fetched_at < {cut('fetch_logs')}
UNION ALL SELECT 'raw_items', count(*) FROM news WHERE fetched_at < {cut('raw_items')}
UNION ALL SELECT 'news', count(*) FROM news WHERE created_at < {cut('news')}
UNION ALL SELECT 'clusters', count(*) FROM clusters WHERE created_at < {cut('clusters')}
UNION ALL SELECT 'alert_decisions', count(*) FROM alert_decisions WHERE created_at < {cut('alert_decisions')}
UNION ALL SELECT 'investigations', count(*) FROM gone""")
def h1(desk: Desk) -> DataFrame:
    return retention.preview(kept_tables(desk), wall(NOW), KEEP)


@query("h2_retention_apply", f"""
WITH {GONE_SQL}, on_ AS (SELECT news_id FROM news WHERE created_at < {cut('news')}), oc AS (SELECT cluster_id FROM clusters WHERE created_at < {cut('clusters')})
SELECT 'fetch_logs' AS "table", count(*) AS deleted FROM fetch_logs WHERE fetched_at < {cut('fetch_logs')}
UNION ALL SELECT 'raw_items', count(*) FROM news WHERE fetched_at < {cut('raw_items')}
UNION ALL SELECT 'news', count(*) FROM on_ UNION ALL SELECT 'clusters', count(*) FROM oc
UNION ALL SELECT 'alert_decisions', count(*) FROM alert_decisions WHERE created_at < {cut('alert_decisions')}
UNION ALL SELECT 'deliveries', count(*) FROM deliveries WHERE alert_id IN (SELECT alert_id FROM alert_decisions WHERE created_at < {cut('alert_decisions')})
UNION ALL SELECT 'cluster_vectors', count(*) FROM cluster_vectors WHERE cluster_id IN (SELECT cluster_id FROM oc)
UNION ALL SELECT 'cluster_items', count(*) FROM cluster_items WHERE cluster_id IN (SELECT cluster_id FROM oc) OR news_id IN (SELECT news_id FROM on_)
UNION ALL SELECT 'news_entities', count(*) FROM news_entities WHERE news_id IN (SELECT news_id FROM on_)
UNION ALL SELECT 'news_vectors', count(*) FROM news_vectors WHERE news_id IN (SELECT news_id FROM on_)
UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE detected_cluster_id IN (SELECT cluster_id FROM oc)
UNION ALL SELECT 'investigations', count(*) FROM gone UNION ALL SELECT 'moves', 0""")
def h2(desk: Desk) -> DataFrame:
    before = kept_tables(desk)
    return retention.deleted_counts(before, retention.apply(before, wall(NOW), KEEP))


@query("h3_orphan_investigations", f"WITH {GONE_SQL} SELECT run_id, target_type, target_id FROM gone")
def h3(desk: Desk) -> DataFrame:
    return retention.orphan_investigations(kept_tables(desk), wall(NOW), KEEP).select("run_id", "target_type", "target_id")


@query("h4_table_census", "SELECT 'orders' AS \"table\", count(*) AS rows FROM orders " + " ".join(
    f"UNION ALL SELECT '{t}', count(*) FROM {t}" for t in ("lineitem", "events", "documents", "embeddings", "pages", "clusters", "news")))
def h4(desk: Desk) -> DataFrame:
    tables = {t: desk.table(t) for t in ("orders", "lineitem", "events", "documents", "embeddings", "pages")}
    return retention.census({**tables, "clusters": desk.clusters, "news": desk.news})
