"""Read models and reporting."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.quality import filter_by_domain
from newsloom.plans.intervals import interval
from newsloom.plans.keys import number_rows, previous_window_mean, top_per_key

# Fixed values of the reports.
SEGMENTS = {
    "crypto": (("crypto",), ("crypto",)),
    "vietnam": (("vietnam", "vn"), ("vietnam_equity",)),
    "us": (("us", "usa"), ()),
}
ACTIONABLE = ("immediate_alert", "watchlist_batch", "daily_digest", "digest_only")
ACTION_WINDOW = timedelta(hours=48)
ACTION_STATUSES = ("pending", "running", "investigating", "failed")
MODEL_PRICING_PER_1K = (
    ("openai/gpt-4.1-mini", 0.0004, 0.0016), ("gpt-4o", 0.005, 0.015), ("gpt-4o-mini", 0.00015, 0.0006),
    ("openai/text-embedding-3-large", 0.00013, 0.0),
)


def effective_time() -> Column:
    return F.coalesce("published_at", "fetched_at", "created_at")


def page(rows: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int = 0,
         max_items: int | None = None) -> DataFrame:
    """One page in a total order; ``max_items`` caps how deep the listing goes."""
    if max_items is not None:
        limit = max(0, max_items - offset) if limit is None else max(0, min(limit, max_items - offset))
    if limit is None and not offset:
        return rows
    out = rows.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def report_ranges(links: DataFrame, news: DataFrame) -> DataFrame:
    """First and last effective time of each cluster's members."""
    times = news.select("news_id", effective_time().alias("_t"))
    return links.select("cluster_id", "news_id").join(times, "news_id").groupBy("cluster_id").agg(
        F.min("_t").alias("report_start_at"), F.max("_t").alias("report_end_at"))


def in_segment(segment: str) -> Column:
    """Market segment by region and asset class; ``global`` is whatever no other segment holds."""
    def member(name: str) -> Column:
        regions, classes = SEGMENTS[name]
        hit = F.arrays_overlap("regions", F.array(*[F.lit(r) for r in regions]))
        return hit | F.arrays_overlap("asset_classes", F.array(*[F.lit(c) for c in classes])) if classes else hit

    if segment == "global":
        return ~member("crypto") & ~member("vietnam") & ~member("us")
    return member(segment)


def list_events(clusters: DataFrame, ranges: DataFrame, *, status: str | None = None, min_score: int | None = None,
                q: str | None = None, region: str | None = None, segment: str | None = None, limit: int | None = None,
                offset: int = 0, max_items: int | None = None) -> DataFrame:
    rows = clusters
    if status:
        rows = rows.filter(F.col("status") == status)
    if min_score is not None:
        rows = rows.filter(F.col("final_score") >= min_score)
    if q:
        rows = rows.filter(F.contains(F.lower("headline"), F.lit(q.lower())))
    if region:
        rows = rows.filter(F.array_contains("regions", region))
    if segment:
        rows = rows.filter(in_segment(segment))
    joined = rows.join(ranges, "cluster_id", "left")
    order = (F.col("report_end_at").desc_nulls_last(), F.col("last_updated_at").desc(), F.col("created_at").desc(),
             F.col("cluster_id"))
    return page(joined, order, limit, offset, max_items)


def array_values(rows: DataFrame, column: str, out: str) -> DataFrame:
    return rows.select(F.explode(column).alias(out)).filter(F.trim(out) != "").distinct()


def news_facets(news: DataFrame) -> DataFrame:
    """Distinct statuses and regions as (facet, value) rows."""
    pairs = F.explode(F.create_map(F.lit("status"), F.col("status"), F.lit("region"), F.col("region"))).alias("facet", "value")
    return news.select(pairs).filter(F.coalesce("value", F.lit("")) != "").distinct()


def list_news(news: DataFrame, *, status: str | None = None, domain: str | None = None, source_id: str | None = None,
              region: str | None = None, q: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = news
    if status:
        rows = rows.filter(F.col("status") == status)
    if source_id:
        rows = rows.filter(F.col("source_id") == source_id)
    if region:
        rows = rows.filter(F.col("region") == region)
    if domain:
        rows = filter_by_domain(rows, domain)
    if q:
        rows = rows.filter(any_contains(q, "title", "snippet", "url"))
    return page(rows, (F.col("created_at").desc(), F.col("news_id").desc()), limit, offset)


def any_contains(q: str, *columns: str | Column) -> Column:
    """Case-insensitive substring test over several text columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return hit


def search_events(clusters: DataFrame, q: str) -> DataFrame:
    names = F.array_join(F.concat("affected_entities", "affected_tickers"), "\n")
    return clusters.filter(any_contains(q, "headline", names))


def event_timeline(links: DataFrame, news: DataFrame) -> DataFrame:
    """Members of all events as rows sorted by event and time; a huge event spreads over range partitions."""
    rows = links.select("cluster_id", "news_id", "added_at", "reason", "similarity_score").join(
        news.select("news_id", "title", "source_name", "fetched_at", effective_time().alias("effective_time")), "news_id")
    return rows.orderBy("cluster_id", "added_at", "fetched_at", "news_id")


def last_scores(history: DataFrame, k: int = 20) -> DataFrame:
    """The latest ``k`` score-history rows per event as one short list, newest first."""
    top = top_per_key(history, ["cluster_id"], (F.col("created_at").desc(), F.col("history_id").desc()), k)
    entry = F.struct("created_at", "history_id", "final_score")
    return top.groupBy("cluster_id").agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("scores"))


def list_alerts(alerts: DataFrame, clusters: DataFrame, ranges: DataFrame, decision: str | None = None,
                limit: int | None = None, offset: int = 0, max_items: int | None = None) -> DataFrame:
    wanted = F.col("decision") == decision if decision else F.col("decision").isin(*ACTIONABLE)
    rows = alerts.filter(wanted).join(clusters.select("cluster_id", "headline", "status"), "cluster_id").join(
        ranges, "cluster_id", "left")
    order = (F.col("report_end_at").desc_nulls_last(), F.col("created_at").desc(), F.col("alert_id").desc())
    return page(rows, order, limit, offset, max_items)


def digest_events(clusters: DataFrame, links: DataFrame, news: DataFrame, since: Column, until: Column, threshold: int,
                  limit: int = 50, threshold_first: bool = False) -> DataFrame:
    """Top events with a member in [since, until); the limit is applied before the threshold unless asked."""
    at = effective_time()
    active = news.filter((at >= since) & (at < until)).select("news_id").join(
        links.select("cluster_id", "news_id"), "news_id").select("cluster_id").distinct()
    rows = clusters.join(active, "cluster_id", "left_semi")
    keep = F.col("final_score") >= threshold
    order = (F.col("final_score").desc(), F.col("created_at").desc(), F.col("cluster_id"))
    if threshold_first:
        return rows.filter(keep).orderBy(*order).limit(limit)
    return rows.orderBy(*order).limit(limit).filter(keep)


def digest_preview(clusters: DataFrame, limit: int) -> DataFrame:
    """Dashboard preview: live events of digest score."""
    rows = clusters.filter((F.col("final_score") >= 30) & ~F.col("status").isin("stale", "false_signal", "merged"))
    return rows.orderBy(F.col("final_score").desc(), F.col("last_updated_at").desc(), F.col("cluster_id")).limit(limit)


def digest_headlines(clusters: DataFrame, links: DataFrame, news: DataFrame, since: Column, until: Column) -> DataFrame:
    """Latest member title inside the window, else the cluster's own headline."""
    at = effective_time()
    inside = news.filter((at >= since) & (at < until)).select("news_id", "title", at.alias("_t"))
    latest = links.select("cluster_id", "news_id").join(inside, "news_id").groupBy("cluster_id").agg(
        F.max_by("title", F.struct(F.col("_t"), -F.col("news_id"))).alias("_title"))
    return clusters.join(latest, "cluster_id", "left").select(
        "cluster_id", F.coalesce("_title", "headline").alias("digest_headline"))


def digest_group() -> Column:
    region = F.coalesce(F.try_element_at("regions", F.lit(1)), F.lit("global"))
    asset = F.coalesce(F.try_element_at("asset_classes", F.lit(1)), F.lit("market"))
    return F.concat(F.upper(region), F.lit(" / "), asset)


def digest_text(events: DataFrame) -> DataFrame:
    """Lines of a digest grouped by region and asset class; ``events`` is the already limited selection."""
    line = F.format_string("- %d %s: %s (%d sources)", "final_score", "status", "headline", "source_count")
    rows = events.select(digest_group().alias("group"), F.struct(
        (-F.col("final_score")).alias("s"), F.col("cluster_id").alias("id"), line.alias("line")).alias("r"))
    return rows.groupBy("group").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("lines"))


def day_window(day: Column, zone: str, start_hour: int = 0) -> tuple[Column, Column]:
    """[start, next start) of a local day as UTC wall times."""
    def utc(local: Column) -> Column:
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)

    shift = F.make_dt_interval(F.lit(0), F.lit(start_hour))
    first = day.cast("date").cast("timestamp_ntz") + shift
    return utc(first), utc(F.date_add(day.cast("date"), 1).cast("timestamp_ntz") + shift)


def change_feed(alerts: DataFrame, job_runs: DataFrame, commands: DataFrame, since: Column,
                limit: int | None = None) -> DataFrame:
    """New alerts, finished pipeline runs and touched commands after ``since``, oldest first.

    The cursor to continue from is the largest ``at`` of the returned rows, so rows cut by the
    limit come again.
    """
    a = alerts.filter(F.col("created_at") > since).select(
        F.col("created_at").alias("at"), F.lit("alert.created").alias("event"), F.col("alert_id").alias("item_id"),
        F.col("decision").alias("state"))
    j = job_runs.filter((F.col("job_name") == "pipeline") & (F.col("completed_at") > since)).select(
        F.col("completed_at").alias("at"), F.lit("pipeline.completed").alias("event"), F.col("run_id").alias("item_id"),
        F.col("status").alias("state"))
    touched = (F.col("created_at") > since) | (F.col("started_at") > since) | (F.col("completed_at") > since)
    c = commands.filter(F.coalesce(touched, F.lit(False))).select(
        F.coalesce("completed_at", "started_at", "created_at").alias("at"), F.lit("command.updated").alias("event"),
        F.col("command_id").alias("item_id"), F.col("status").alias("state"))
    feed = a.unionByName(j).unionByName(c)
    return feed if limit is None else feed.orderBy("at", "event", "item_id").limit(limit)


def model_costs(runs: DataFrame, prices: DataFrame, since: Column) -> DataFrame:
    """Tokens and cost per day, per model, per analysis type and in total, in one pass."""
    priced = runs.filter(F.col("created_at") >= since).join(prices, "model", "left")
    cost = F.bround(F.coalesce(
        F.col("prompt_tokens") / 1000 * F.col("prompt_price") + F.col("completion_tokens") / 1000 * F.col("completion_price"),
        F.lit(0.0)), 6).cast("decimal(20,6)")
    rows = priced.select(
        F.col("created_at").cast("date").alias("day"), "model", "analysis_type", "prompt_tokens", "completion_tokens",
        cost.alias("cost"))
    sums = [F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
            F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
            F.sum("cost").cast("double").alias("estimated_cost_usd")]
    day, model, kind = F.col("day"), F.col("model"), F.col("analysis_type")
    return rows.groupingSets([[day], [model], [kind], []], day, model, kind).agg(*sums)


def compare_models(runs: DataFrame, model_a: str, model_b: str, fields: Sequence[str]) -> DataFrame:
    """Latest succeeded results of two models on the same target and prompt, side by side."""
    rows = runs.filter((F.col("status") == "succeeded") & F.col("model").isin(model_a, model_b))
    key = ["target_id", "analysis_type", "prompt_version"]
    latest = top_per_key(rows, [*key, "model"], (F.col("created_at").desc(), F.col("run_id").desc()))

    def of(model: str, field: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(field)))

    wide = latest.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), *[of(m, f).alias(f"{f}_{s}") for f in fields for m, s in ((model_a, "a"), (model_b, "b"))])
    return wide.filter("_n = 2").drop("_n").select(
        "*", *[F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")).alias(f"same_{f}") for f in fields])


def agreement(compared: DataFrame, fields: Sequence[str]) -> DataFrame:
    return compared.groupBy("analysis_type", "prompt_version").agg(
        F.count(F.lit(1)).alias("targets"),
        *[F.bround(F.avg(F.col(f"same_{f}").cast("int")), 6).alias(f"agree_{f}") for f in fields])


@F.pandas_udf(T.StringType())
def _first_json_object(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def cut(value: str | None) -> str | None:
        start = -1 if value is None else value.find("{")
        if start < 0:
            return None
        try:
            return value[start:decoder.raw_decode(value, start)[1]]
        except ValueError:
            return None

    return texts.map(cut)


def recover_responses(raw: DataFrame, column: str, schema: str, required: Sequence[str]) -> DataFrame:
    """Typed rows from model responses: as is, without a code fence, else the first JSON object in the text.

    Only rows the first two forms cannot read are handed to Python.
    """
    def typed(c: Column) -> Column:
        parsed = F.from_json(c, schema)
        whole = F.is_variant_null(F.try_parse_json(c)).isNotNull()
        complete = whole
        for field in required:
            complete = complete & parsed[field].isNotNull()
        return F.when(complete, parsed)

    text = F.col(column)
    fence = F.regexp_extract(F.trim(text), r"(?s)^```[^\n]*\n(.*)\n\s*```$", 1)
    tried = raw.withColumn("_plain", typed(F.trim(text))).withColumn(
        "_fenced", F.when(F.col("_plain").isNull(), typed(F.trim(fence))))
    cut = _first_json_object(F.when(F.col("_plain").isNull() & F.col("_fenced").isNull(), text))
    tried = tried.withColumn("_cut", cut).withColumn("_inner", typed(F.col("_cut")))
    outcome = (F.when(F.col("_plain").isNotNull(), "plain").when(F.col("_fenced").isNotNull(), "fenced")
               .when(F.col("_inner").isNotNull(), "extracted").otherwise("failed"))
    return tried.withColumn("parsed", F.coalesce("_plain", "_fenced", "_inner")).withColumn(
        "outcome", outcome).drop("_plain", "_fenced", "_cut", "_inner")


STAGES = "struct<stages:array<struct<stage:string,status:string,duration_ms:int>>>"


def flatten_stages(job_runs: DataFrame) -> DataFrame:
    """One row per stage from the JSON result of pipeline runs."""
    rows = job_runs.filter(F.col("job_name") == "pipeline").select(
        "run_id", "started_at", F.explode(F.from_json("result", STAGES).getField("stages")).alias("s"))
    return rows.select("run_id", "started_at", "s.stage", F.col("s.status").alias("stage_status"), "s.duration_ms")


def slow_stages(runs: DataFrame, stages: DataFrame, window: int = 20, factor: int = 2) -> DataFrame:
    """Stages of successful runs slower than ``factor`` x the mean over up to ``window`` prior successful runs."""
    good = number_rows(runs.filter(F.col("status") == "success").select("run_id", "started_at"),
                       (F.col("started_at"), F.col("run_id")), "run_no")
    placed = stages.join(good.select("run_id", "run_no"), "run_id")
    rated = previous_window_mean(placed, ["stage"], "run_no", "duration_ms", window, "average_ms")
    return rated.filter((F.col("average_ms_n") > 0) & (F.col("duration_ms") > F.col("average_ms") * factor)).select(
        "run_id", "run_no", "stage", "duration_ms", "average_ms", (F.col("average_ms") * factor).alias("threshold_ms"))


def operational_checks(job_runs: DataFrame, fetch_logs: DataFrame, runs: DataFrame, sent: DataFrame, now: Column,
                       interval_s: int = 300) -> DataFrame:
    """Alerts that hold at ``now``, each suppressed when the same type was sent within the last hour."""
    done = job_runs.filter((F.col("job_name") == "pipeline") & (F.col("status") == "success")).agg(
        F.max("completed_at").alias("t"))
    beat = done.filter(now - F.col("t") > interval(timedelta(seconds=2 * interval_s))).select(
        F.lit("worker_heartbeat").alias("alert_type"))
    recent = fetch_logs.filter(F.col("fetched_at") >= now - interval(timedelta(hours=24)))
    latest = recent.groupBy("source_id").agg(F.max_by("status", F.struct("fetched_at", "log_id")).alias("s"))
    share = latest.agg(F.avg((F.col("s") != "success").cast("int")).alias("share")).filter("share > 0.5").select(
        F.lit("source_failures").alias("alert_type"))
    failed = runs.filter((F.col("status") == "failed") & (F.col("created_at") >= now - interval(timedelta(hours=1)))).agg(
        F.count(F.lit(1)).alias("n")).filter("n >= 3").select(F.lit("llm_provider_unreachable").alias("alert_type"))
    muted = sent.filter((F.col("status") == "sent") & (F.col("attempted_at") >= now - interval(timedelta(hours=1)))).select(
        "alert_type", F.lit(True).alias("suppressed")).distinct()
    return beat.unionByName(share).unionByName(failed).join(muted, "alert_type", "left").select(
        "alert_type", F.coalesce("suppressed", F.lit(False)).alias("suppressed"))


def job_failures(job_runs: DataFrame, limit: int | None = None) -> DataFrame:
    return page(job_runs.filter(F.col("status") != "success"), (F.col("started_at").desc(), F.col("run_id").desc()), limit)


def command_counts(commands: DataFrame) -> DataFrame:
    return commands.groupBy("status").agg(F.count(F.lit(1)).alias("commands"))


def reap_stale_commands(commands: DataFrame, now: Column, timeout_s: int) -> DataFrame:
    """Running commands started before the timeout become failed."""
    stale = F.coalesce((F.col("status") == "running") & (
        F.col("started_at") < now - interval(timedelta(seconds=timeout_s))), F.lit(False))
    return commands.withColumn("_stale", stale).withColumn(
        "status", F.when(F.col("_stale"), "failed").otherwise(F.col("status"))).withColumn(
        "error_message", F.when(F.col("_stale"), "timed out (worker restart?)")).withColumn(
        "completed_at", F.when(F.col("_stale"), now).otherwise(F.col("completed_at"))).drop("_stale")


def alert_health(alerts: DataFrame, deliveries: DataFrame) -> DataFrame:
    a = alerts.agg(F.count_if((F.col("decision") == "immediate_alert") & F.col("sent_at").isNull()).alias(
        "pending_immediate_alerts"))
    d = deliveries.agg(F.count_if(F.col("status") == "failed").alias("failed_deliveries"),
                       F.max_by("delivery_id", F.struct("attempted_at", "delivery_id")).alias("latest_delivery_id"))
    return a.withColumn("_k", F.lit(1)).join(d.withColumn("_k", F.lit(1)), "_k").drop("_k")


def lineage(raw: DataFrame, news: DataFrame, links: DataFrame, entities: DataFrame, vectors: DataFrame,
            alerts: DataFrame, investigations: DataFrame) -> DataFrame:
    """Every raw item with what became of it; side tables are reduced to one row per key first."""
    def per(rows: DataFrame, key: str, n: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias(n))

    runs = investigations.filter(F.col("target_type") == "event_cluster").select(F.col("target_id").alias("cluster_id"))
    out = raw.select("raw_id").join(news.select("raw_id", "news_id", "status"), "raw_id", "left")
    out = out.join(per(entities, "news_id", "entity_count"), "news_id", "left")
    out = out.join(vectors.select("news_id", F.lit(True).alias("has_vector")).distinct(), "news_id", "left")
    out = out.join(links.select("news_id", "cluster_id"), "news_id", "left")
    out = out.join(per(alerts, "cluster_id", "alert_count"), "cluster_id", "left")
    out = out.join(per(runs, "cluster_id", "investigation_count"), "cluster_id", "left")
    return out.select(
        "raw_id", "news_id", "status", "cluster_id", F.coalesce("has_vector", F.lit(False)).alias("has_vector"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entity_count", "alert_count", "investigation_count")])


def funnel(traced: DataFrame) -> DataFrame:
    return traced.agg(
        F.count(F.lit(1)).alias("raw_items"), F.count("news_id").alias("news_items"),
        F.count_if(F.col("entity_count") > 0).alias("with_entities"), F.count_if("has_vector").alias("with_vector"),
        F.count("cluster_id").alias("clustered"), F.count_if(F.col("alert_count") > 0).alias("alerted"),
        F.count_if(F.col("investigation_count") > 0).alias("investigated"))


def action_queue(alerts: DataFrame, ranges: DataFrame, investigations: DataFrame, clusters: DataFrame, reviews: DataFrame,
                 now: Column) -> DataFrame:
    """Recent immediate alerts, events whose latest investigation is open, unmatched open reviews."""
    at = F.coalesce("report_end_at", "report_start_at")
    a = alerts.filter(F.col("decision") == "immediate_alert").join(ranges, "cluster_id").filter(
        at >= now - interval(ACTION_WINDOW)).select(F.lit("alert").alias("type"), F.col("alert_id").alias("item_id"), at.alias("at"))
    latest = top_per_key(investigations.filter(F.col("target_type") == "event_cluster"), ["target_id"],
                         (F.col("created_at").desc(), F.col("run_id").desc()))
    i = latest.filter(F.lower("status").isin(*ACTION_STATUSES)).select(
        F.col("target_id").alias("cluster_id"), F.col("created_at").alias("at")).join(
        clusters.select("cluster_id"), "cluster_id", "left_semi").select(
        F.lit("investigation").alias("type"), F.col("cluster_id").alias("item_id"), "at")
    r = reviews.filter(F.col("detected_cluster_id").isNull() & F.lower("status").isin("pending", "investigating")).select(
        F.lit("catalyst").alias("type"), F.col("review_id").alias("item_id"), F.col("created_at").alias("at"))
    return a.unionByName(i).unionByName(r)


def score_trend(history: DataFrame) -> DataFrame:
    """Last minus first score per event; ``flat`` below one point, null with fewer than two rows."""
    order = F.struct("created_at", "history_id")
    ends = history.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("points"),
        (F.max_by("final_score", order) - F.min_by("final_score", order)).alias("_d"))
    label = (F.when(F.col("points") < 2, F.lit(None)).when(F.abs("_d") < 1, "flat")
             .when(F.col("_d") > 0, F.concat(F.lit("+"), F.col("_d"))).otherwise(F.col("_d").cast("string")))
    return ends.select("cluster_id", "points", F.when(F.col("points") >= 2, F.col("_d")).alias("delta"),
                       label.alias("trend"))


def alert_articles(messages: DataFrame, deliveries: DataFrame, alerts: DataFrame, links: DataFrame, news: DataFrame,
                   k: int = 10) -> DataFrame:
    """Chat message ids to the alert they delivered and its event's newest ``k`` articles."""
    sent = deliveries.filter((F.col("channel") == "telegram") & (F.col("status") == "sent")).select(
        "alert_id", "attempted_at", "delivery_id",
        F.get_json_object("response", "$.result.message_id").cast("bigint").alias("message_id"))
    found = top_per_key(messages.select("message_id").distinct().join(sent, "message_id"), ["message_id"],
                        (F.col("attempted_at").desc(), F.col("delivery_id").desc()))
    events = found.join(alerts.select("alert_id", "cluster_id"), "alert_id").select("message_id", "alert_id", "cluster_id")
    members = links.select("cluster_id", "news_id").join(
        events.select("cluster_id").distinct(), "cluster_id", "left_semi").join(
        news.select("news_id", "title", effective_time().alias("at")), "news_id")
    newest = top_per_key(members, ["cluster_id"], (F.col("at").desc(), F.col("news_id").desc()), k, rank="position")
    return events.join(newest, "cluster_id").select("message_id", "alert_id", "cluster_id", "news_id", "position", "title")


def summary_inputs(links: DataFrame, news: DataFrame) -> DataFrame:
    """Per event: members, members with text, and the predominant language of those with text."""
    rows = links.select("cluster_id", "news_id", "added_at").join(
        news.select("news_id", "language", "source_score", "fetched_at",
                    (F.trim(F.coalesce("content", F.lit(""))) != "").alias("has_text")), "news_id")
    counts = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("news_item_count"), F.count_if("has_text").alias("full_text_item_count"))
    by_language = rows.filter("has_text").groupBy("cluster_id", "language").agg(
        F.count(F.lit(1)).alias("n"), F.max("source_score").alias("best"),
        F.min(F.struct("added_at", "fetched_at", "news_id")).alias("first"))
    top = top_per_key(by_language, ["cluster_id"], (F.col("n").desc(), F.col("best").desc(), F.col("first")))
    return counts.join(top.select("cluster_id", F.col("language").alias("predominant_language")), "cluster_id", "left")
