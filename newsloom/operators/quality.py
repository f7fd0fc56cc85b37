"""Normalisation, de-duplication and source quality."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.plans.intervals import interval
from newsloom.plans.keys import flag_first, top_per_key

AGGREGATOR = "google-rss"
# Fixed values of the extraction rules.
TERMINAL_HTTP = (401, 403, 404, 410)
LIMITED_MIN_FAILURES = 3
LIMITED_COOLDOWN = timedelta(days=7)
KEY = ("key_kind", "key_a", "key_b")


def normalize_and_hash(news: DataFrame) -> DataFrame:
    """Clean title, snippet and content; add canonical URL and the three hashes."""
    title = text.normalize_text(F.col("title"))
    clean = news.select(
        "*", title.alias("_t"), text.normalize_text(F.col("snippet")).alias("_s"),
        text.normalize_text(F.col("content")).alias("_c"), text.canonical_url(F.col("url")).alias("canonical_url"))
    whole = text.squeeze(F.concat_ws(" ", "_t", "_s", "_c"))
    return clean.select(
        *[c for c in news.columns if c not in ("title", "snippet", "content")],
        F.col("_t").alias("title"), F.nullif(F.col("_s"), F.lit("")).alias("snippet"),
        F.nullif(F.col("_c"), F.lit("")).alias("content"), "canonical_url",
        text.folded_hash(F.col("_t")).alias("title_hash"),
        text.folded_hash(F.col("canonical_url")).alias("url_hash"),
        text.folded_hash(whole).alias("text_hash"))


def hashed_for_dedup(news: DataFrame) -> DataFrame:
    """As ``normalize_and_hash`` for the duplicate rules alone: only aggregator rows with a snippet are keyed by their
    text, so snippet and content of all others are neither cleaned nor hashed. The content is left out.
    """
    by_text = (F.col("source_type") == AGGREGATOR) & F.col("snippet").isNotNull()
    gated = news.select(*[c for c in news.columns if c not in ("snippet", "content")],
                        *[F.when(by_text, F.col(c)).alias(c) for c in ("snippet", "content")])
    return normalize_and_hash(gated).drop("content")


def with_dedup_key(news: DataFrame) -> DataFrame:
    """Aggregator rows with a snippet are keyed by text and title, all others by URL."""
    by_text = (F.col("source_type") == AGGREGATOR) & F.col("snippet").isNotNull()
    return news.select(
        "*", F.when(by_text, "text").otherwise("url").alias("key_kind"),
        F.when(by_text, F.col("text_hash")).otherwise(F.col("url_hash")).alias("key_a"),
        F.when(by_text, F.col("title_hash")).otherwise("").alias("key_b"))


def is_fresh(published: Column, fetched: Column, now: Column, hours: int) -> Column:
    return F.coalesce(published, fetched) >= now - interval(timedelta(hours=hours))


def pending(raw: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw rows without a normalised row, newest first."""
    rows = raw.join(done.select("raw_id"), "raw_id", "left_anti")
    if limit is None:
        return rows
    return rows.orderBy(F.col("fetched_at").desc(), F.col("raw_id").desc()).limit(limit)


def assign_status(batch: DataFrame, active: DataFrame, noise_patterns: Sequence[str] = (),
                  row_id: str = "news_id") -> DataFrame:
    """ignored / deduped / normalized for a batch of hashed rows, newest first.

    ``active`` holds the already normalised rows. A noise row never claims its key. Active keys
    are distinct before the join and the first row of a key is found by a per-key top-1, so a key
    shared by a third of the batch is never gathered.
    """
    keyed = with_dedup_key(batch).withColumn("_noise", text.contains_any(F.col("title"), noise_patterns))
    known = with_dedup_key(active).select(*KEY).distinct()
    firsts = top_per_key(keyed.filter(~F.col("_noise")), KEY, (F.col("fetched_at").desc(), F.col(row_id).desc()))
    keepers = firsts.join(known, list(KEY), "left_anti").select(row_id, F.lit(True).alias("_keeps"))
    return keyed.join(keepers, row_id, "left").withColumn(
        "status", F.when(F.col("_noise"), "ignored").when(F.col("_keeps"), "normalized").otherwise("deduped")
    ).drop("_noise", "_keeps", *KEY)


def mark_exact_duplicates(news: DataFrame, row_id: str = "news_id") -> DataFrame:
    """Among ``normalized`` rows every one but the first per key becomes ``deduped``."""
    active = F.col("status") == "normalized"
    flagged = flag_first(with_dedup_key(news), KEY, (F.col("created_at"), F.col(row_id)), row_id, "_first", active)
    return flagged.withColumn(
        "status", F.when(active & ~F.col("_first"), "deduped").otherwise(F.col("status"))).drop("_first", *KEY)


def mark_duplicates_by(news: DataFrame, keys: Sequence[str], among: Column | None = None,
                       row_id: str = "news_id") -> DataFrame:
    """Backfill form: the same marking on explicit keys."""
    active = (F.col("status") == "normalized") if among is None else (F.col("status") == "normalized") & among
    flagged = flag_first(news, keys, (F.col("created_at"), F.col(row_id)), row_id, "_first", active)
    return flagged.withColumn(
        "status", F.when(active & ~F.col("_first"), "deduped").otherwise(F.col("status"))).drop("_first")


def normalization_stats(raw: DataFrame, statuses: DataFrame, now: Column, hours: int) -> DataFrame:
    """One row of counts: scanned, invalid, stale, candidates and rows per status."""
    title = text.normalize_text(F.col("title"))
    invalid = (title == "") | F.coalesce(F.col("url"), F.lit("")).eqNullSafe("")
    fresh = is_fresh(F.col("published_at"), F.col("fetched_at"), now, hours)
    scanned = raw.agg(
        F.count(F.lit(1)).alias("rows_scanned"), F.count_if(invalid).alias("skipped_invalid"),
        F.count_if(~invalid & ~fresh).alias("skipped_stale"), F.count_if(~invalid & fresh).alias("candidates"))
    inserted = statuses.agg(
        F.count(F.lit(1)).alias("inserted_total"),
        *[F.count_if(F.col("status") == s).alias(f"inserted_{s}") for s in ("normalized", "deduped", "ignored")])
    # both sides are single aggregate rows; the constant key makes that a plain one-row join
    return scanned.withColumn("_k", F.lit(1)).join(inserted.withColumn("_k", F.lit(1)), "_k").drop("_k")


def full_text_backlog(news: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    due = news.filter(
        (F.col("status") == "normalized") & ~F.col("full_text_available") & (F.col("source_type") != AGGREGATOR)
        & F.col("full_text_status").isin("pending", "retry")
        & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    return due if limit is None else due.orderBy(F.col("created_at").desc(), F.col("news_id")).limit(limit)


def resolve_extraction(attempts: DataFrame, now: Column) -> DataFrame:
    """Apply fetch results to news rows.

    Needs ``source_type, limited_until, http_status, extracted_text, retry_after_s, attempt_count,
    content, snippet, title``; a null ``http_status`` is a transport failure.
    """
    skip = F.col("source_type") == AGGREGATOR
    limited = F.coalesce(F.col("limited_until") > now, F.lit(False))
    status = F.col("http_status")
    terminal = F.coalesce(status.isin(*TERMINAL_HTTP), F.lit(False))
    failed = status.isNull() | (status >= 300)
    empty = F.trim(F.coalesce("extracted_text", F.lit(""))) == ""
    fallback = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("content", "snippet", "title")])
    outcome = (
        F.when(skip, "skipped")
        .when(limited | terminal | (~failed & empty), F.when(fallback.isNotNull(), "fallback").otherwise("skipped"))
        .when(failed, "retry").otherwise("extracted"))
    retryable = status.isin(408, 429) | (status >= 500)
    reason = (
        F.when(skip, "google_rss_feed_only").when(limited, "source_extraction_limited")
        .when(terminal | retryable, F.concat(F.lit("http_"), status))
        .when(failed, "request_failed").when(empty, "no_text_extracted"))
    attempts_now = F.when(skip, F.col("attempt_count")).otherwise(F.col("attempt_count") + 1)
    # the exponent is bounded so that the power stays an exact integer; 15 * 2^7 already exceeds a day
    backoff = F.least(F.lit(24 * 60), F.lit(15) * F.pow(F.lit(2), F.least(attempts_now - 1, F.lit(10)))).cast("int") * 60
    wait = F.when(retryable & F.col("retry_after_s").isNotNull(), F.greatest(F.col("retry_after_s"), F.lit(0))).otherwise(backoff)
    out = attempts.select(
        "*", outcome.alias("_outcome"), reason.alias("last_error"), attempts_now.alias("_attempts"),
        fallback.alias("_fallback"), wait.alias("_wait"),
        (~skip & ~limited & (terminal | (~failed & empty))).alias("terminal_failure"))
    return out.withColumn("full_text_status", F.col("_outcome")).withColumn(
        "full_text", F.when(F.col("_outcome") == "extracted", F.col("extracted_text"))
        .when(F.col("_outcome") == "fallback", F.col("_fallback"))).withColumn(
        "next_retry_at", F.when(F.col("_outcome") == "retry",
                                now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_wait")))).withColumn(
        "attempt_count", F.col("_attempts")).drop("_outcome", "_attempts", "_fallback", "_wait")


def extraction_stats(resolved: DataFrame, now: Column) -> DataFrame:
    """Outcome counts per source and the limiting flag with its end time."""
    def n(status: str) -> Column:
        return F.count_if(F.col("full_text_status") == status)

    counts = resolved.groupBy("source_id").agg(
        F.count_if(F.col("source_type") != AGGREGATOR).alias("attempted"), n("extracted").alias("extracted"),
        n("fallback").alias("fallback_used"), n("skipped").alias("skipped"),
        F.count_if("terminal_failure").alias("terminal_failures"), n("retry").alias("retryable_failed"))
    limited = (F.col("terminal_failures") >= LIMITED_MIN_FAILURES) & (F.col("extracted") == 0)
    return counts.withColumn("limited", F.when(limited, True).when(F.col("extracted") > 0, False)).withColumn(
        "limited_until", F.when(limited, now + interval(LIMITED_COOLDOWN)))


def source_quality(sources: DataFrame, fetch_logs: DataFrame, news: DataFrame, links: DataFrame, now: Column,
                   days: int = 30) -> DataFrame:
    """Reliability, duplicate rate, event contribution and the weighted quality score."""
    since = now - interval(timedelta(days=days))
    fetches = fetch_logs.filter(F.col("fetched_at") >= since).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("fetch_total"), F.count_if(F.col("status") == "success").alias("fetch_success"))
    recent = news.filter(F.col("created_at") >= since).select("news_id", "source_id", "status")
    per_item = links.groupBy("news_id").agg(F.count(F.lit(1)).alias("_links"))
    counts = recent.join(per_item, "news_id", "left").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("news_total"), F.count_if(F.col("status") == "deduped").alias("deduped"),
        F.sum(F.coalesce("_links", F.lit(0))).alias("clustered"))
    joined = sources.select("source_id").join(fetches, "source_id", "left").join(counts, "source_id", "left").na.fill(0)

    def pct(part: str, total: str, default: int) -> Column:
        return F.when(F.col(total) > 0, scoring.whole(F.col(part) / F.col(total) * 100)).otherwise(F.lit(default))

    rated = joined.select(
        "*", pct("fetch_success", "fetch_total", 60).alias("reliability"),
        pct("deduped", "news_total", 0).alias("duplicate_rate"),
        pct("clustered", "news_total", 0).alias("event_contribution"))
    score = (F.col("reliability") * F.lit(0.50) + (100 - F.col("duplicate_rate")) * F.lit(0.20)
             + F.col("event_contribution") * F.lit(0.30))
    return rated.withColumn("quality_score", scoring.clamp(scoring.whole(score)).cast("int"))


def source_health(sources: DataFrame, fetch_logs: DataFrame, failure_counts: DataFrame, now: Column, days: int = 7,
                  failing_statuses: Sequence[str] = ("error",)) -> DataFrame:
    """Latest fetch, mean latency and the status ladder per source."""
    logs = fetch_logs.filter(F.col("fetched_at") >= now - interval(timedelta(days=days)))
    latest = logs.groupBy("source_id").agg(
        F.max_by("status", F.struct("fetched_at", "log_id")).alias("latest_status"),
        F.max("fetched_at").alias("last_fetched_at"), scoring.whole(F.avg("duration_ms")).alias("average_latency_ms"))
    joined = sources.select("source_id", "name", "enabled", "region").join(latest, "source_id", "left").join(
        failure_counts.select("source_id", "consecutive_failures"), "source_id", "left").na.fill(
        0, ["consecutive_failures"])
    failing = (F.col("consecutive_failures") >= 3) | F.coalesce(F.col("latest_status").isin(*failing_statuses), F.lit(False))
    return joined.withColumn(
        "health_status", F.when(~F.col("enabled"), "disabled").when(failing, "failing")
        .when(F.col("consecutive_failures") > 0, "degraded").otherwise("healthy"))


def daily_item_counts(fetch_logs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    logs = fetch_logs.filter(F.col("fetched_at") >= now - interval(timedelta(days=days)))
    return logs.groupBy("source_id", F.col("fetched_at").cast("date").alias("day")).agg(
        F.sum("inserted").alias("item_count"))


def health_counts(health: DataFrame) -> DataFrame:
    return health.agg(*[
        F.count_if(F.col("health_status") == s).alias(s) for s in ("healthy", "degraded", "failing", "disabled")])


def news_domain(canonical: Column, url: Column) -> Column:
    """Host name without user part and port; null when there is none."""
    host = text.url_host(F.coalesce(canonical, url))
    return F.nullif(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", ""), F.lit(""))


def list_domains(news: DataFrame) -> DataFrame:
    return news.select(news_domain(F.col("canonical_url"), F.col("url")).alias("domain")).filter(
        F.col("domain").isNotNull()).distinct()


def filter_by_domain(news: DataFrame, domain: str) -> DataFrame:
    return news.filter(news_domain(F.col("canonical_url"), F.col("url")) == domain.lower().strip())
