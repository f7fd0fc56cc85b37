"""Normalise, de-duplicate, quality state."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.operators import quality
from newsloom.plans.intervals import interval
from newsloom.queries.base import query
from newsloom.queries.oracle_tables import fold, norm, sql_list
from newsloom.sources.tables import Desk, pick, wall

NOW = "2024-01-20 00:00:00"
CUT = "2024-01-12 00:00:00"
NOISE = ("tions ", "schrift", "queau")
HTTP = (200, 200, 200, 404, 500, 429, 403, 0, 410)

CANONICAL = r"""(CASE WHEN u.scheme = '' THEN 'https' ELSE lower(u.scheme) END) || '://' || lower(u.host)
  || (CASE WHEN u.path = '' THEN '/' ELSE u.path END)
  || (CASE WHEN len(u.kept) > 0 THEN '?' || array_to_string(u.kept, '&') ELSE '' END)"""


def split_url(table: str, row_id: str) -> str:
    pattern = text.URL_PATTERN.replace("'", "''")
    return f"""SELECT {row_id}, url, regexp_extract(trim(url), '{pattern}', 2) AS scheme,
      regexp_extract(trim(url), '{pattern}', 4) AS host, regexp_extract(trim(url), '{pattern}', 5) AS path,
      list_sort(list_filter(string_split(regexp_extract(trim(url), '{pattern}', 7), '&'),
        lambda p: p <> '' AND NOT list_contains({sql_list(text.TRACKING_PARAMS)}, lower(split_part(p, '=', 1))))) AS kept
      FROM {table}"""


HASHED = f"""
  SELECT n.* EXCLUDE (title, snippet, content), {norm('n.title')} AS title,
         nullif({norm("coalesce(n.snippet, '')")}, '') AS snippet, {norm('n.content')} AS content,
         c.canonical_url,
         sha256({fold(norm('n.title'))}) AS title_hash, sha256({fold('c.canonical_url')}) AS url_hash,
         sha256({fold(norm("n.title || ' ' || coalesce(n.snippet, '') || ' ' || n.content"))}) AS text_hash
  FROM news n JOIN (SELECT news_id, {CANONICAL} AS canonical_url FROM ({split_url('news', 'news_id')}) u) c USING (news_id)"""
KEYED = """
  SELECT *, CASE WHEN source_type = 'google-rss' AND snippet IS NOT NULL
                 THEN text_hash || title_hash ELSE 'url' || url_hash END AS k FROM hashed"""


def hashed(desk: Desk) -> DataFrame:
    return quality.normalize_and_hash(desk.news)


@query("b1_normalize_hash", f"WITH hashed AS ({HASHED}) SELECT news_id, title, title_hash, url_hash, text_hash FROM hashed")
def b1(desk: Desk) -> DataFrame:
    return hashed(desk).select("news_id", "title", "title_hash", "url_hash", "text_hash")


@query("b2_canonical_url_pages", f"""
SELECT page_id, {CANONICAL} AS canonical_url, sha256({fold(CANONICAL)}) AS url_hash FROM ({split_url('pages', 'page_id')}) u""")
def b2_pages(desk: Desk) -> DataFrame:
    pages = desk.table("pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical_url"))
    return pages.withColumn("url_hash", text.folded_hash(F.col("canonical_url")))


@query("b2_canonical_url_news", f"SELECT news_id, {CANONICAL} AS canonical_url FROM ({split_url('news', 'news_id')}) u")
def b2_news(desk: Desk) -> DataFrame:
    return desk.news.select("news_id", text.canonical_url(F.col("url")).alias("canonical_url"))


@query("b3_parse_timestamps", """
SELECT event_id, CASE event_id % 5
    WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 7 HOUR
    WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) + INTERVAL 330 MINUTE END AS parsed_at
FROM events""")
def b3(desk: Desk) -> DataFrame:
    kind = F.col("event_id") % 5
    rendered = (
        F.when(kind == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(kind == 1, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+07:00")))
        .when(kind == 2, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(kind == 3, F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" -0530")))
        .otherwise(F.col("props")))
    return desk.table("events").select("event_id", text.parse_datetime(rendered).alias("parsed_at"))


@query("b4_fresh_items", f"""
SELECT news_id FROM news WHERE coalesce(published_at, fetched_at) >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR""")
def b4(desk: Desk) -> DataFrame:
    return desk.news.filter(quality.is_fresh(F.col("published_at"), F.col("fetched_at"), wall(NOW), 72)).select("news_id")


@query("b5_noise_titles", f"""
SELECT news_id, {' OR '.join(f"contains({fold('title')}, '{p}')" for p in NOISE)} AS is_noise FROM news""")
def b5(desk: Desk) -> DataFrame:
    return desk.news.select("news_id", text.contains_any(F.col("title"), NOISE).alias("is_noise"))


@query("b6_pending_items", f"""
SELECT news_id AS raw_id, fetched_at FROM news
WHERE news_id NOT IN (SELECT news_id FROM news WHERE created_at < TIMESTAMP '{CUT}')
""")
def b6(desk: Desk) -> DataFrame:
    raw = desk.news.select(F.col("news_id").alias("raw_id"), "fetched_at", "created_at")
    done = raw.filter(F.col("created_at") < wall(CUT))
    return quality.pending(raw, done).select("raw_id", "fetched_at")


STATUS_SQL = f"""
hashed AS ({HASHED}), keyed AS ({KEYED}),
known AS (SELECT DISTINCT k FROM keyed WHERE created_at < TIMESTAMP '{CUT}'),
batch AS (SELECT *, {' OR '.join(f"contains({fold('title')}, '{p}')" for p in NOISE)} AS noise
          FROM keyed WHERE created_at >= TIMESTAMP '{CUT}'),
firsts AS (SELECT news_id FROM (SELECT news_id, k, row_number() OVER (
             PARTITION BY k ORDER BY fetched_at DESC, news_id DESC) AS rn FROM batch WHERE NOT noise)
           WHERE rn = 1 AND k NOT IN (SELECT k FROM known)),
statuses AS (SELECT news_id, CASE WHEN noise THEN 'ignored'
             WHEN news_id IN (SELECT news_id FROM firsts) THEN 'normalized' ELSE 'deduped' END AS status FROM batch)"""


def statuses(desk: Desk) -> DataFrame:
    rows = quality.hashed_for_dedup(desk.news)
    old = rows.filter(F.col("created_at") < wall(CUT))
    new = rows.filter(F.col("created_at") >= wall(CUT))
    return quality.assign_status(new, old, NOISE)


@query("b7_status_assignment", f"WITH {STATUS_SQL} SELECT news_id, status FROM statuses")
def b7(desk: Desk) -> DataFrame:
    return statuses(desk).select("news_id", "status")


DEDUPED_SQL = f"""
hashed AS ({HASHED}), keyed AS ({KEYED}),
marked AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY created_at, news_id) > 1
                          THEN 'deduped' ELSE 'normalized' END AS status FROM keyed)"""


def deduped(desk: Desk) -> DataFrame:
    return quality.mark_exact_duplicates(quality.hashed_for_dedup(desk.news).withColumn("status", F.lit("normalized")))


@query("b8_exact_duplicates", f"WITH {DEDUPED_SQL} SELECT news_id, status FROM marked")
def b8(desk: Desk) -> DataFrame:
    return deduped(desk).select("news_id", "status")


@query("b9_duplicates_by_url_and_title", f"""
WITH hashed AS ({HASHED})
SELECT news_id, CASE WHEN row_number() OVER (PARTITION BY url_hash, title_hash ORDER BY created_at, news_id) > 1
                     THEN 'deduped' ELSE 'normalized' END AS status FROM hashed""")
def b9_url_title(desk: Desk) -> DataFrame:
    rows = hashed(desk).withColumn("status", F.lit("normalized"))
    return quality.mark_duplicates_by(rows, ["url_hash", "title_hash"]).select("news_id", "status")


@query("b9_duplicates_by_active_url", f"""
WITH hashed AS ({HASHED})
SELECT news_id, CASE WHEN NOT (source_type = 'google-rss' AND snippet IS NOT NULL) AND
    row_number() OVER (PARTITION BY source_type = 'google-rss' AND snippet IS NOT NULL, url_hash
                       ORDER BY created_at, news_id) > 1 THEN 'deduped' ELSE 'normalized' END AS status FROM hashed""")
def b9_url(desk: Desk) -> DataFrame:
    rows = hashed(desk).withColumn("status", F.lit("normalized"))
    plain = ~((F.col("source_type") == quality.AGGREGATOR) & F.col("snippet").isNotNull())
    return quality.mark_duplicates_by(rows, ["url_hash"], plain).select("news_id", "status")


@query("b10_normalization_stats", f"""
WITH {STATUS_SQL},
fresh AS (SELECT coalesce(published_at, fetched_at) >= TIMESTAMP '{NOW}' - INTERVAL 168 HOUR AS f, {norm('title')} = '' AS bad FROM news)
SELECT count(*) AS rows_scanned, count(*) FILTER (bad) AS skipped_invalid, count(*) FILTER (NOT bad AND NOT f) AS skipped_stale,
       count(*) FILTER (NOT bad AND f) AS candidates,
       (SELECT count(*) FROM statuses) AS inserted_total,
       (SELECT count(*) FROM statuses WHERE status = 'normalized') AS inserted_normalized,
       (SELECT count(*) FROM statuses WHERE status = 'deduped') AS inserted_deduped,
       (SELECT count(*) FROM statuses WHERE status = 'ignored') AS inserted_ignored
FROM fresh""")
def b10(desk: Desk) -> DataFrame:
    return quality.normalization_stats(desk.news, statuses(desk), wall(NOW), 168)


FULL_TEXT_SQL = f"""
full_text AS (SELECT *, news_id % 5 = 0 AS full_text_available,
    ['pending', 'retry', 'extracted', 'skipped'][news_id % 4 + 1] AS full_text_status,
    CASE WHEN news_id % 3 <> 0 THEN created_at + INTERVAL 1 HOUR * (news_id % 200) END AS next_retry_at FROM marked)"""


def full_text_state(desk: Desk) -> DataFrame:
    n = F.col("news_id")
    return deduped(desk).select(
        "*", (n % 5 == 0).alias("full_text_available"),
        pick(("pending", "retry", "extracted", "skipped"), n % 4).alias("full_text_status"),
        F.when(n % 3 != 0, F.col("created_at") + F.make_dt_interval(F.lit(0), (n % 200).cast("int"))).alias("next_retry_at"))


@query("b11_full_text_backlog", f"""
WITH {DEDUPED_SQL}, {FULL_TEXT_SQL}
SELECT news_id, created_at, full_text_status FROM full_text
WHERE status = 'normalized' AND NOT full_text_available AND source_type <> 'google-rss'
  AND full_text_status IN ('pending', 'retry') AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOW}')""")
def b11(desk: Desk) -> DataFrame:
    return quality.full_text_backlog(full_text_state(desk), wall(NOW)).select("news_id", "created_at", "full_text_status")


ATTEMPTS_SQL = f"""
attempts AS (SELECT *, nullif([{', '.join(str(h) for h in HTTP)}][news_id % 9 + 1], 0) AS http_status,
    CASE WHEN news_id % 7 <> 0 THEN content ELSE ' ' END AS extracted_text,
    CASE WHEN news_id % 10 = 5 THEN 120 END AS retry_after_s, CAST(news_id % 12 AS INT) AS attempts_before,
    CASE WHEN source_id = 'src7' THEN TIMESTAMP '{NOW}' + INTERVAL 1 DAY
         WHEN source_id = 'src8' THEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY END AS limited_until FROM news),
flags AS (SELECT *, source_type = 'google-rss' AS agg, coalesce(limited_until > TIMESTAMP '{NOW}', FALSE) AS lim,
    coalesce(http_status IN (401, 403, 404, 410), FALSE) AS term, http_status IS NULL OR http_status >= 300 AS failed,
    trim(extracted_text) = '' AS empty,
    coalesce(nullif(trim(content), ''), nullif(trim(snippet), ''), nullif(trim(title), '')) AS fb,
    coalesce(http_status IN (408, 429) OR http_status >= 500, FALSE) AS again FROM attempts),
resolved AS (SELECT *,
    CASE WHEN agg THEN 'skipped' WHEN lim OR term OR (NOT failed AND empty) THEN
         CASE WHEN fb IS NOT NULL THEN 'fallback' ELSE 'skipped' END WHEN failed THEN 'retry' ELSE 'extracted' END AS full_text_status,
    CASE WHEN agg THEN 'google_rss_feed_only' WHEN lim THEN 'source_extraction_limited'
         WHEN term OR again THEN 'http_' || http_status WHEN failed THEN 'request_failed'
         WHEN empty THEN 'no_text_extracted' END AS last_error,
    CASE WHEN agg THEN attempts_before ELSE attempts_before + 1 END AS attempt_count,
    NOT agg AND NOT lim AND (term OR (NOT failed AND empty)) AS terminal_failure FROM flags),
timed AS (SELECT *,
    CASE WHEN full_text_status = 'retry' THEN TIMESTAMP '{NOW}' + to_seconds(CASE WHEN again AND retry_after_s IS NOT NULL
         THEN retry_after_s ELSE 60 * least(1440, 15 * CAST(power(2, least(attempt_count - 1, 10)) AS INT)) END) END AS next_retry_at,
    CASE full_text_status WHEN 'extracted' THEN extracted_text WHEN 'fallback' THEN fb END AS full_text FROM resolved)"""


def resolved(desk: Desk) -> DataFrame:
    n = F.col("news_id")
    status = F.element_at(F.array(*[F.lit(h) for h in HTTP]), (n % 9 + 1).cast("int"))
    attempts = desk.news.select(
        "*", F.nullif(status, F.lit(0)).alias("http_status"),
        F.when(n % 7 != 0, F.col("content")).otherwise(" ").alias("extracted_text"),
        F.when(n % 10 == 5, 120).alias("retry_after_s"), (n % 12).cast("int").alias("attempt_count"),
        F.when(F.col("source_id") == "src7", wall(NOW) + interval(timedelta(days=1)))
        .when(F.col("source_id") == "src8", wall(NOW) - interval(timedelta(days=1))).alias("limited_until"))
    return quality.resolve_extraction(attempts, wall(NOW))


@query("b12_extraction_outcomes", f"""
WITH {ATTEMPTS_SQL} SELECT news_id, full_text_status, last_error, attempt_count, next_retry_at,
       sha256(full_text) AS full_text_hash FROM timed""")
def b12(desk: Desk) -> DataFrame:
    return resolved(desk).select("news_id", "full_text_status", "last_error", "attempt_count", "next_retry_at",
                                 F.sha2("full_text", 256).alias("full_text_hash"))


@query("b13_extraction_stats", f"""
WITH {ATTEMPTS_SQL}, counts AS (
SELECT source_id, count(*) FILTER (NOT agg) AS attempted, count(*) FILTER (full_text_status = 'extracted') AS extracted,
   count(*) FILTER (full_text_status = 'fallback') AS fallback_used, count(*) FILTER (full_text_status = 'skipped') AS skipped,
   count(*) FILTER (terminal_failure) AS terminal_failures, count(*) FILTER (full_text_status = 'retry') AS retryable_failed
FROM timed GROUP BY source_id)
SELECT *, CASE WHEN terminal_failures >= 3 AND extracted = 0 THEN TRUE WHEN extracted > 0 THEN FALSE END AS limited,
   CASE WHEN terminal_failures >= 3 AND extracted = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 7 DAY END AS limited_until FROM counts""")
def b13(desk: Desk) -> DataFrame:
    return quality.extraction_stats(resolved(desk), wall(NOW))


@query("b14_effective_source_score", """
SELECT source_id, CAST(coalesce(round_even(source_score * 0.7 + auto_quality_score * 0.3, 0), source_score) AS INT) AS effective_score
FROM sources""")
def b14(desk: Desk) -> DataFrame:
    return desk.sources.select("source_id", scoring.effective_source_score(
        F.col("source_score"), F.col("auto_quality_score")).alias("effective_score"))


@query("b15_source_quality", f"""
WITH {DEDUPED_SQL},
f AS (SELECT source_id, count(*) AS fetch_total, count(*) FILTER (status = 'success') AS fetch_success FROM fetch_logs
      WHERE fetched_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY 1),
n AS (SELECT m.source_id, count(*) AS news_total, count(*) FILTER (m.status = 'deduped') AS deduped,
             sum((SELECT count(*) FROM cluster_items l WHERE l.news_id = m.news_id)) AS clustered
      FROM marked m WHERE m.created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY 1),
r AS (SELECT s.source_id, coalesce(fetch_total, 0) AS fetch_total, coalesce(news_total, 0) AS news_total,
   CASE WHEN fetch_total > 0 THEN CAST(round_even(fetch_success / fetch_total * 100, 0) AS INT) ELSE 60 END AS reliability,
   CASE WHEN news_total > 0 THEN CAST(round_even(deduped / news_total * 100, 0) AS INT) ELSE 0 END AS duplicate_rate,
   CASE WHEN news_total > 0 THEN CAST(round_even(clustered / news_total * 100, 0) AS INT) ELSE 0 END AS event_contribution
   FROM sources s LEFT JOIN f USING (source_id) LEFT JOIN n USING (source_id))
SELECT *, CAST(least(100, greatest(0, round_even(reliability * CAST(0.5 AS DOUBLE) + (100 - duplicate_rate) * CAST(0.2 AS DOUBLE)
   + event_contribution * CAST(0.3 AS DOUBLE), 0))) AS INT) AS quality_score FROM r""")
def b15(desk: Desk) -> DataFrame:
    rated = quality.source_quality(desk.sources, desk.fetch_logs, deduped(desk), desk.cluster_items, wall(NOW))
    return rated.select("source_id", "fetch_total", "news_total", "reliability", "duplicate_rate", "event_contribution",
                        "quality_score")


HEALTH_SQL = f"""
logs AS (SELECT * FROM fetch_logs WHERE fetched_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY),
fails AS (SELECT s.source_id, count(l.log_id) FILTER (l.status <> 'success' AND l.fetched_at > coalesce(ok, TIMESTAMP '1970-01-01')) AS n
  FROM sources s LEFT JOIN fetch_logs l USING (source_id)
  LEFT JOIN (SELECT source_id, max(fetched_at) AS ok FROM fetch_logs WHERE status = 'success' GROUP BY 1) o USING (source_id)
  GROUP BY 1),
health AS (SELECT s.source_id, s.name, s.enabled, s.region, l.latest_status, l.last_fetched_at, l.average_latency_ms,
    coalesce(f.n, 0) AS consecutive_failures,
    CASE WHEN NOT s.enabled THEN 'disabled' WHEN f.n >= 3 OR coalesce(l.latest_status = 'error', FALSE) THEN 'failing'
         WHEN f.n > 0 THEN 'degraded' ELSE 'healthy' END AS health_status
  FROM sources s LEFT JOIN (SELECT source_id, arg_max(status, (fetched_at, log_id)) AS latest_status, max(fetched_at) AS last_fetched_at,
       CAST(round_even(avg(duration_ms), 0) AS INT) AS average_latency_ms FROM logs GROUP BY 1) l USING (source_id)
  LEFT JOIN fails f USING (source_id))"""


def health(desk: Desk) -> DataFrame:
    from newsloom.operators.polling import consecutive_failures

    return quality.source_health(desk.sources, desk.fetch_logs, consecutive_failures(desk.fetch_logs), wall(NOW))


@query("b16_source_health", f"WITH {HEALTH_SQL} SELECT * FROM health")
def b16(desk: Desk) -> DataFrame:
    return health(desk)


@query("b16_daily_item_counts", f"""
SELECT source_id, CAST(fetched_at AS DATE) AS day, CAST(sum(inserted) AS BIGINT) AS item_count FROM fetch_logs
WHERE fetched_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 1, 2""")
def b16_daily(desk: Desk) -> DataFrame:
    return quality.daily_item_counts(desk.fetch_logs, wall(NOW))


@query("b17_health_counts", f"""
WITH {HEALTH_SQL} SELECT count(*) FILTER (health_status = 'healthy') AS healthy, count(*) FILTER (health_status = 'degraded') AS degraded,
  count(*) FILTER (health_status = 'failing') AS failing, count(*) FILTER (health_status = 'disabled') AS disabled FROM health""")
def b17(desk: Desk) -> DataFrame:
    return quality.health_counts(health(desk))


@query("b18_page_domains", rf"""
SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '{text.URL_PATTERN}', 4)), ':\d*$', '') AS domain FROM pages
WHERE regexp_extract(url, '{text.URL_PATTERN}', 4) <> ''""")
def b18_list(desk: Desk) -> DataFrame:
    return quality.list_domains(desk.table("pages").withColumn("canonical_url", F.lit(None).cast("string")))


@query("b18_filter_domain", "SELECT news_id, url FROM news WHERE lower(url) LIKE 'https://src3.example.com/%'")
def b18_filter(desk: Desk) -> DataFrame:
    news = desk.news.withColumn("canonical_url", text.canonical_url(F.col("url")))
    return quality.filter_by_domain(news, " SRC3.example.com").select("news_id", "url")
