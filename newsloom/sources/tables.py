"""The news desk's tables, derived from a folder of Parquet inputs.

``Desk`` turns the generic tables of a data folder (documents, events, nation, orders, lineitem,
embeddings, pages, conversations) into the shapes the operators work on. Nothing here is cached
or collected; every property is a plan over the input files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
# One everyday word per watchlist entry, so that text matching has something to find.
ALIAS_WORDS = (
    "the", "of", "and", "to", "in", "is", "le", "la", "les", "de", "des", "et", "der", "die", "das",
    "und", "ist", "el", "los", "las", "en", "que", "con", "por", "un",
)
JOIN_REASONS = (
    "strong_title_topic_overlap", "specific_entity_overlap_with_title_support",
    "ticker_overlap_with_title_support", "specific_entity_overlap_without_title_support",
    "weak_entity_overlap_requires_arbitration",
)


def wall(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def seconds(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c)


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Desk:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def sources(self) -> DataFrame:
        n = F.substring("source", 4, 10).cast("int")
        return self.table("documents").select("source").distinct().select(
            F.col("source").alias("source_id"),
            F.concat(F.lit("Source "), n).alias("name"),
            F.when(n % 5 == 0, "google-rss").when(n % 5 == 1, "crawler").otherwise("rss").alias("source_type"),
            F.when(n % 4 == 0, "global").when(n % 4 == 1, "us").when(n % 4 == 2, "vietnam").otherwise("crypto").alias("region"),
            F.when(n % 3 == 0, "global_macro").when(n % 3 == 1, "equity").otherwise("crypto").alias("asset_class"),
            (35 + (n * 7) % 61).alias("source_score"),
            F.when(n % 6 != 0, 40 + (n * 11) % 50).alias("auto_quality_score"),
            F.when(n % 4 == 0, 120).otherwise(86400).alias("polling_interval_s"),
            (n % 9 != 8).alias("enabled"),
            F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/feed")).alias("url"),
        )

    @cached_property
    def news(self) -> DataFrame:
        # the title is cut out before the join, so that who wants no more of the text does not shuffle it
        docs = self.table("documents").select("doc_id", "text", "source", "lang", F.substring_index("text", "\n", 1).alias("title"))
        sources = self.sources.select("source_id", F.col("name").alias("source_name"), "source_type",
                                      "source_score", "region", "asset_class")
        made = wall(EPOCH) + seconds(F.col("doc_id") * 2400)
        return docs.join(sources, docs["source"] == sources["source_id"]).select(
            F.col("doc_id").alias("news_id"), "source_id", "title",
            F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("snippet"),
            F.col("text").alias("content"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), F.col("doc_id") % 700,
                     F.when(F.col("doc_id") % 2 == 1, "?utm_source=x").otherwise("")).alias("url"),
            "source_name", "source_type", "source_score", "region", "asset_class",
            F.col("lang").alias("language"),
            F.when(F.col("doc_id") % 11 != 0, made).alias("published_at"),
            (made + seconds(F.lit(600))).alias("fetched_at"),
            (made + seconds(F.lit(900))).alias("created_at"),
        )

    @property
    def effective_time(self) -> Column:
        return F.coalesce("published_at", "fetched_at", "created_at")

    @cached_property
    def cluster_items(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").select(
            F.floor(d / 4).alias("cluster_id"), d.alias("news_id"),
            pick(JOIN_REASONS, d % 5).alias("reason"),
            (50 + d % 50).cast("int").alias("similarity_score"),
            (wall(EPOCH) + seconds(d * 2400 + 1200)).alias("added_at"),
        )

    @cached_property
    def news_entities(self) -> DataFrame:
        docs = self.table("documents").select("doc_id")
        nation = self.table("nation").select("n_nationkey", "n_name")
        first = docs.join(nation, nation["n_nationkey"] == docs["doc_id"] % 25).select(
            F.col("doc_id").alias("news_id"), F.col("n_name").alias("name"),
            F.concat(F.lit("N"), "n_nationkey").alias("ticker"), F.lit(True).alias("is_primary"))
        second = docs.join(nation, nation["n_nationkey"] == (docs["doc_id"] * 7 + 3) % 25).select(
            F.col("doc_id").alias("news_id"), F.col("n_name").alias("name"),
            F.lit(None).cast("string").alias("ticker"), F.lit(False).alias("is_primary"))
        return first.unionByName(second)

    @cached_property
    def watchlist(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            k.alias("watch_id"), F.col("n_name").alias("name"), F.concat(F.lit("N"), k).alias("symbol"),
            pick(("S", "A", "B", "C", "D"), k % 5).alias("tier"),
            (k % 7 != 6).alias("enabled"),
            F.array(pick(ALIAS_WORDS, k % 25), F.concat(F.lit("nation "), k)).alias("aliases"),
            F.when(k % 3 == 0, "vietnam").when(k % 3 == 1, "us").otherwise("crypto").alias("region"),
            F.when(k % 3 == 2, "crypto").otherwise("equity").alias("asset_class"),
        )

    @cached_property
    def moves(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("move_id"), F.concat(F.lit("N"), F.col("user_id") % 25).alias("symbol"),
            "ts", F.lit("1d").alias("win"),
            F.when(F.col("user_id") % 2 == 0, "BINANCE").otherwise("YAHOO").alias("exchange"),
            F.when(F.col("user_id") % 25 % 3 == 2, "crypto").otherwise("equity").alias("asset_class"),
            ((F.col("value") - 35) / 10).alias("price_change_pct"),
            F.when(F.col("event_type") == "purchase", F.col("value") * 2).alias("volume_change_pct"),
            F.when(F.col("event_type") == "view", F.col("value") / 30).alias("z_score"),
        )

    @cached_property
    def fetch_logs(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("log_id"), F.concat(F.lit("src"), F.col("user_id") % 20).alias("source_id"),
            F.col("ts").alias("fetched_at"),
            F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
            F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
            F.when(F.col("event_type") == "click", 0).otherwise((F.col("user_id") % 7).cast("int")).alias("inserted"),
        )

    @cached_property
    def clusters(self) -> DataFrame:
        """One row per cluster; headline and sets come from its members."""
        links = self.cluster_items.select("cluster_id", "news_id")
        news = self.news.select("news_id", "title", "source_score", "region", "asset_class",
                                self.effective_time.alias("eff"))
        entities = self.news_entities.filter("is_primary").select("news_id", "name", "ticker")
        members = links.join(news, "news_id")
        summary = members.groupBy("cluster_id").agg(
            F.max_by("title", F.struct("eff", "news_id")).alias("headline"),
            F.min("eff").alias("first_seen_at"), F.max("eff").alias("last_updated_at"),
            F.max("eff").alias("created_at"),
            F.array_sort(F.collect_set("region")).alias("regions"),
            F.array_sort(F.collect_set("asset_class")).alias("asset_classes"),
            F.count(F.lit(1)).cast("int").alias("source_count"),
            F.count_if(F.col("source_score") >= 75).cast("int").alias("hq_source_count"),
            F.max("source_score").alias("top_source_score"),
        )
        affected = links.join(entities, "news_id").groupBy("cluster_id").agg(
            F.array_sort(F.collect_set("name")).alias("affected_entities"),
            F.array_sort(F.collect_set("ticker")).alias("affected_tickers"))
        c = F.col("cluster_id")
        score = ((c * 37) % 101).cast("int")
        return summary.join(affected, "cluster_id").select(
            "*",
            F.when(c % 10 == 0, "stale").when(c % 10 == 1, "merged").when(c % 10 == 2, "confirmed")
            .when(c % 10 == 3, "official").otherwise("reported").alias("status"),
            score.alias("final_score"),
            F.when(score >= 80, "immediate_alert").when(score >= 55, "watchlist_batch")
            .when(score >= 30, "daily_digest").otherwise("archive_only").alias("alert_level"),
            F.when(c % 6 == 0, F.col("created_at") + seconds(F.lit(7200))).alias("last_alerted_at"),
            F.when(c % 17 == 0, F.col("created_at") + seconds(F.lit(86400))).alias("compacted_at"),
        )

    @cached_property
    def news_vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("news_id"), F.lit("local").alias("provider"), F.lit("m1").alias("model"),
            F.col("label").alias("label"), F.size("embedding").alias("dims"), F.col("embedding").alias("vector"))

    @cached_property
    def cluster_vectors(self) -> DataFrame:
        """Cluster vectors: the stored vectors whose id is a cluster id."""
        clusters = self.cluster_items.select("cluster_id").distinct()
        return self.table("embeddings").join(clusters, F.col("vec_id") == F.col("cluster_id")).select(
            "cluster_id", F.lit("local").alias("provider"), F.lit("m1").alias("model"),
            F.size("embedding").alias("dims"), F.col("embedding").alias("vector"))

    @cached_property
    def alert_decisions(self) -> DataFrame:
        price = F.col("o_totalprice")
        score = F.floor(price / 5000).cast("int")
        return self.table("orders").select(
            F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("cluster_id"),
            F.when(price >= 400000, "immediate_alert").when(price >= 275000, "watchlist_batch")
            .when(price >= 150000, "daily_digest").otherwise("archive_only").alias("decision"),
            score.alias("score"),
            F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("sent_at"),
            F.when(F.col("o_orderpriority").startswith("5"), "manual").alias("suppression_reason"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("delivery_id"), k.alias("alert_id"),
            F.when(k % 2 == 0, "telegram").otherwise("webhook").alias("channel"),
            F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "sent")
            .otherwise("pending").alias("status"),
            (k % 4).cast("int").alias("attempt_count"),
            F.col("o_orderdate").alias("attempted_at"),
            F.when(k % 3 != 0, F.col("o_orderdate") + seconds(F.lit(300))).alias("next_attempt_at"),
            F.concat(F.lit('{"result": {"message_id": '), k * 10, F.lit("}}")).alias("response"),
        )

    @cached_property
    def job_stages(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("run_id"), F.concat(F.lit("stage_"), "l_linenumber").alias("stage"),
            (F.col("l_quantity") * 100).cast("int").alias("duration_ms"),
            F.when(F.col("l_returnflag") == "R", "failed").otherwise("success").alias("stage_status"),
            F.col("l_shipdate").alias("started_at"))

    @cached_property
    def model_runs(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(
            F.col("event_id").alias("run_id"), F.col("event_type").alias("analysis_type"),
            (F.col("user_id") * 4 + F.floor(F.col("value")) % 4).alias("target_id"),
            pick(("model-a", "model-b", "model-c", "model-x"), F.floor(F.col("event_id") / 2) % 4).alias("model"),
            F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"),
            pick(("v1", "v2"), F.col("event_id") % 2).alias("prompt_version"),
            k.alias("prompt_tokens"), (k * 3 % 50).alias("completion_tokens"),
            (F.floor(F.col("value")).cast("int") % 25 - 12).alias("score_modifier"),
            (F.floor(F.col("value") * 7).cast("int") % 101).alias("confidence"),
            F.col("ts").alias("created_at"))

    @cached_property
    def job_runs(self) -> DataFrame:
        """Runs with their stages as a JSON result."""
        entry = F.struct("stage", F.col("stage_status").alias("status"), "duration_ms")
        runs = self.job_stages.groupBy("run_id").agg(
            F.min("started_at").alias("started_at"), F.max("started_at").alias("completed_at"),
            F.count_if(F.col("stage_status") == "failed").alias("_failed"), F.array_sort(F.collect_list(entry)).alias("stages"))
        return runs.select(
            "run_id", F.when(F.col("run_id") % 4 != 0, "pipeline").otherwise("retention").alias("job_name"),
            "started_at", "completed_at", F.when(F.col("_failed") > 0, "failed").otherwise("success").alias("status"),
            F.to_json(F.struct("stages")).alias("result"))

    @cached_property
    def commands(self) -> DataFrame:
        done = F.col("o_orderstatus") != "O"
        return self.table("orders").select(
            F.col("o_orderkey").alias("command_id"), F.col("o_orderpriority").alias("command_type"),
            F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "failed")
            .otherwise("success").alias("status"),
            F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + seconds(F.lit(600))).alias("started_at"),
            F.when(done, F.col("o_orderdate") + seconds(F.lit(3600))).alias("completed_at"))

    @cached_property
    def score_history(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("history_id"), F.col("user_id").alias("cluster_id"),
            F.least(F.lit(100), F.floor("value").cast("int")).alias("final_score"), F.col("ts").alias("created_at"))
