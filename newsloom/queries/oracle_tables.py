"""The derived tables once more, as DuckDB SQL over the raw tables."""

from __future__ import annotations

from newsloom.sources.tables import ALIAS_WORDS, JOIN_REASONS


def sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def norm(expr: str) -> str:
    """Normalised text; the inputs hold no entities and are NFKC-stable, see the tests."""
    return rf"trim(regexp_replace(regexp_replace({expr}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


def fold(expr: str) -> str:
    return f"replace(replace(lower({expr}), 'ß', 'ss'), 'ς', 'σ')"


FRAGMENTS: dict[str, str] = {
    "sources": """
  SELECT source AS source_id, 'Source ' || n AS name,
         CASE n % 5 WHEN 0 THEN 'google-rss' WHEN 1 THEN 'crawler' ELSE 'rss' END AS source_type,
         CASE n % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'us' WHEN 2 THEN 'vietnam' ELSE 'crypto' END AS region,
         CASE n % 3 WHEN 0 THEN 'global_macro' WHEN 1 THEN 'equity' ELSE 'crypto' END AS asset_class,
         35 + (n * 7) % 61 AS source_score,
         CASE WHEN n % 6 <> 0 THEN 40 + (n * 11) % 50 END AS auto_quality_score,
         CASE WHEN n % 4 = 0 THEN 120 ELSE 86400 END AS polling_interval_s,
         n % 9 <> 8 AS enabled,
         'https://' || source || '.example.com/feed' AS url
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n FROM documents) d""",
    "news": """
  SELECT d.doc_id AS news_id, d.source AS source_id,
         split_part(d.text, chr(10), 1) AS title,
         CASE WHEN d.doc_id % 3 <> 0 THEN d.text END AS snippet,
         d.text AS content,
         'https://' || d.source || '.example.com/a/' || (d.doc_id % 700)
           || CASE WHEN d.doc_id % 2 = 1 THEN '?utm_source=x' ELSE '' END AS url,
         s.name AS source_name, s.source_type, s.source_score, s.region, s.asset_class, d.lang AS language,
         CASE WHEN d.doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(d.doc_id * 2400) END AS published_at,
         TIMESTAMP '2024-01-01' + to_seconds(d.doc_id * 2400 + 600) AS fetched_at,
         TIMESTAMP '2024-01-01' + to_seconds(d.doc_id * 2400 + 900) AS created_at,
         coalesce(CASE WHEN d.doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(d.doc_id * 2400) END,
                  TIMESTAMP '2024-01-01' + to_seconds(d.doc_id * 2400 + 600)) AS eff
  FROM documents d JOIN sources s ON s.source_id = d.source""",
    "cluster_items": f"""
  SELECT CAST(floor(doc_id / 4) AS BIGINT) AS cluster_id, doc_id AS news_id,
         {sql_list(JOIN_REASONS)}[doc_id % 5 + 1] AS reason,
         CAST(50 + doc_id % 50 AS INT) AS similarity_score,
         TIMESTAMP '2024-01-01' + to_seconds(doc_id * 2400 + 1200) AS added_at
  FROM documents""",
    "news_entities": """
  SELECT d.doc_id AS news_id, n.n_name AS name, 'N' || n.n_nationkey AS ticker, TRUE AS is_primary
  FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id % 25
  UNION ALL
  SELECT d.doc_id, n.n_name, NULL, FALSE
  FROM documents d JOIN nation n ON n.n_nationkey = (d.doc_id * 7 + 3) % 25""",
    "watchlist": f"""
  SELECT n_nationkey AS watch_id, n_name AS name, 'N' || n_nationkey AS symbol,
         substr('SABCD', n_nationkey % 5 + 1, 1) AS tier, n_nationkey % 7 <> 6 AS enabled,
         [{sql_list(ALIAS_WORDS)}[n_nationkey % 25 + 1], 'nation ' || n_nationkey] AS aliases,
         CASE n_nationkey % 3 WHEN 0 THEN 'vietnam' WHEN 1 THEN 'us' ELSE 'crypto' END AS region,
         CASE n_nationkey % 3 WHEN 2 THEN 'crypto' ELSE 'equity' END AS asset_class
  FROM nation""",
    "moves": """
  SELECT event_id AS move_id, 'N' || (user_id % 25) AS symbol, ts, '1d' AS win,
         CASE WHEN user_id % 2 = 0 THEN 'BINANCE' ELSE 'YAHOO' END AS exchange,
         CASE WHEN user_id % 25 % 3 = 2 THEN 'crypto' ELSE 'equity' END AS asset_class,
         (value - 35) / 10 AS price_change_pct,
         CASE WHEN event_type = 'purchase' THEN value * 2 END AS volume_change_pct,
         CASE WHEN event_type = 'view' THEN value / 30 END AS z_score,
         CAST(least(100, least(70, round_even(abs((value - 35) / 10) * 14, 0))
           + CASE WHEN event_type = 'purchase' AND value * 2 >= 50 THEN 35 ELSE 0 END
           + CASE WHEN event_type = 'view' AND value / 30 >= 2 THEN 20 ELSE 0 END) AS INT) AS move_score
  FROM events""",
    "fetch_logs": """
  SELECT event_id AS log_id, 'src' || (user_id % 20) AS source_id, ts AS fetched_at,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CAST(floor(value * 10) AS INT) AS duration_ms,
         CASE WHEN event_type = 'click' THEN 0 ELSE CAST(user_id % 7 AS INT) END AS inserted
  FROM events""",
    "clusters": """
  SELECT m.*, a.affected_entities, a.affected_tickers,
         CASE m.cluster_id % 10 WHEN 0 THEN 'stale' WHEN 1 THEN 'merged' WHEN 2 THEN 'confirmed'
              WHEN 3 THEN 'official' ELSE 'reported' END AS status,
         CAST((m.cluster_id * 37) % 101 AS INT) AS final_score,
         CASE WHEN (m.cluster_id * 37) % 101 >= 80 THEN 'immediate_alert'
              WHEN (m.cluster_id * 37) % 101 >= 55 THEN 'watchlist_batch'
              WHEN (m.cluster_id * 37) % 101 >= 30 THEN 'daily_digest' ELSE 'archive_only' END AS alert_level,
         CASE WHEN m.cluster_id % 6 = 0 THEN m.created_at + INTERVAL 2 HOUR END AS last_alerted_at,
         CASE WHEN m.cluster_id % 17 = 0 THEN m.created_at + INTERVAL 1 DAY END AS compacted_at
  FROM (SELECT l.cluster_id, arg_max(n.title, (n.eff, n.news_id)) AS headline,
               min(n.eff) AS first_seen_at, max(n.eff) AS last_updated_at, max(n.eff) AS created_at,
               list_sort(list(DISTINCT n.region)) AS regions, list_sort(list(DISTINCT n.asset_class)) AS asset_classes,
               CAST(count(*) AS INT) AS source_count,
               CAST(count(*) FILTER (n.source_score >= 75) AS INT) AS hq_source_count,
               max(n.source_score) AS top_source_score
        FROM cluster_items l JOIN news n USING (news_id) GROUP BY l.cluster_id) m
  JOIN (SELECT l.cluster_id, list_sort(list(DISTINCT e.name)) AS affected_entities,
               list_sort(list(DISTINCT e.ticker)) AS affected_tickers
        FROM cluster_items l JOIN news_entities e USING (news_id) WHERE e.is_primary GROUP BY l.cluster_id) a
    USING (cluster_id)""",
    "news_vectors": """
  SELECT vec_id AS news_id, 'local' AS provider, 'm1' AS model, label, CAST(len(embedding) AS INT) AS dims,
         embedding AS vector, CAST(embedding AS DOUBLE[]) AS v FROM embeddings""",
    "cluster_vectors": """
  SELECT e.vec_id AS cluster_id, 'local' AS provider, 'm1' AS model, CAST(len(e.embedding) AS INT) AS dims,
         e.embedding AS vector, CAST(e.embedding AS DOUBLE[]) AS v
  FROM embeddings e JOIN (SELECT DISTINCT cluster_id FROM cluster_items) c ON c.cluster_id = e.vec_id""",
    "alert_decisions": """
  SELECT o_orderkey AS alert_id, o_custkey AS cluster_id,
         CASE WHEN o_totalprice >= 400000 THEN 'immediate_alert' WHEN o_totalprice >= 275000 THEN 'watchlist_batch'
              WHEN o_totalprice >= 150000 THEN 'daily_digest' ELSE 'archive_only' END AS decision,
         CAST(floor(o_totalprice / 5000) AS INT) AS score,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS sent_at,
         CASE WHEN o_orderpriority LIKE '5%' THEN 'manual' END AS suppression_reason,
         o_orderdate AS created_at
  FROM orders""",
    "deliveries": """
  SELECT o_orderkey AS delivery_id, o_orderkey AS alert_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'telegram' ELSE 'webhook' END AS channel,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'sent' ELSE 'pending' END AS status,
         CAST(o_orderkey % 4 AS INT) AS attempt_count, o_orderdate AS attempted_at,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 5 MINUTE END AS next_attempt_at,
         '{"result": {"message_id": ' || (o_orderkey * 10) || '}}' AS response
  FROM orders""",
    "job_stages": """
  SELECT l_orderkey AS run_id, 'stage_' || l_linenumber AS stage, CAST(l_quantity * 100 AS INT) AS duration_ms,
         CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS stage_status, l_shipdate AS started_at
  FROM lineitem""",
    "model_runs": """
  SELECT event_id AS run_id, event_type AS analysis_type,
         user_id * 4 + CAST(floor(value) AS BIGINT) % 4 AS target_id,
         ['model-a', 'model-b', 'model-c', 'model-x'][event_id // 2 % 4 + 1] AS model,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status,
         ['v1', 'v2'][event_id % 2 + 1] AS prompt_version,
         CAST(json_extract(props, '$.k') AS INT) AS prompt_tokens,
         CAST(json_extract(props, '$.k') AS INT) * 3 % 50 AS completion_tokens,
         CAST(floor(value) AS INT) % 25 - 12 AS score_modifier,
         CAST(floor(value * 7) AS INT) % 101 AS confidence, ts AS created_at
  FROM events""",
    "job_runs": """
  SELECT run_id, CASE WHEN run_id % 4 <> 0 THEN 'pipeline' ELSE 'retention' END AS job_name,
         min(started_at) AS started_at, max(started_at) AS completed_at,
         CASE WHEN count(*) FILTER (stage_status = 'failed') > 0 THEN 'failed' ELSE 'success' END AS status
  FROM job_stages GROUP BY run_id""",
    "commands": """
  SELECT o_orderkey AS command_id, o_orderpriority AS command_type,
         CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'success' END AS status,
         o_orderdate AS created_at, o_orderdate + INTERVAL 10 MINUTE AS started_at,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at
  FROM orders""",
    "score_history": """
  SELECT event_id AS history_id, user_id AS cluster_id, CAST(least(100, floor(value)) AS INT) AS final_score, ts AS created_at
  FROM events""",
}
