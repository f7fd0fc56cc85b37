"""Retention windows and cascading deletes, expressed as the rows that stay."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.intervals import interval

# How long each table is kept, in days.
KEEP_DAYS = {"fetch_logs": 14, "raw_items": 60, "news": 180, "clusters": 1095, "alert_decisions": 365}
AGE_COLUMN = {"fetch_logs": "fetched_at", "raw_items": "fetched_at", "news": "created_at", "clusters": "created_at",
              "alert_decisions": "created_at"}


def cutoff(table: str, now: Column, keep_days: dict[str, int] = KEEP_DAYS) -> Column:
    return now - interval(timedelta(days=keep_days[table]))


def orphan_investigations(tables: dict[str, DataFrame], now: Column, keep_days: dict[str, int] = KEEP_DAYS) -> DataFrame:
    """Investigations that are too old or whose target row is gone from its table."""
    known = (
        tables["clusters"].select(F.lit("event_cluster").alias("target_type"), F.col("cluster_id").alias("target_id"))
        .unionByName(tables["moves"].select(F.lit("market_move").alias("target_type"), F.col("move_id").alias("target_id")))
        .unionByName(tables["reviews"].select(F.lit("missed_catalyst_review").alias("target_type"),
                                              F.col("review_id").alias("target_id"))).distinct()
        .withColumn("_known", F.lit(True)))
    checked = F.col("target_type").isin("event_cluster", "market_move", "missed_catalyst_review")
    rows = tables["investigations"].join(known, ["target_type", "target_id"], "left")
    return rows.filter((F.col("created_at") < cutoff("clusters", now, keep_days)) | (checked & F.col("_known").isNull())).drop("_known")


def preview(tables: dict[str, DataFrame], now: Column, keep_days: dict[str, int] = KEEP_DAYS) -> DataFrame:
    """Rows each table would lose."""
    counts = [
        tables[t].agg(F.count_if(F.col(AGE_COLUMN[t]) < cutoff(t, now, keep_days)).alias("stale_rows")).select(
            F.lit(t).alias("table"), "stale_rows") for t in KEEP_DAYS]
    counts.append(orphan_investigations(tables, now, keep_days).agg(F.count(F.lit(1)).alias("stale_rows")).select(
        F.lit("investigations").alias("table"), "stale_rows"))
    return reduce(DataFrame.unionByName, counts)


def apply(tables: dict[str, DataFrame], now: Column, keep_days: dict[str, int] = KEEP_DAYS) -> dict[str, DataFrame]:
    """The tables after retention; children of stale rows go with them."""
    def stale(t: str) -> Column:
        return F.col(AGE_COLUMN[t]) < cutoff(t, now, keep_days)

    old_news = tables["news"].filter(stale("news")).select("news_id")
    old_clusters = tables["clusters"].filter(stale("clusters")).select("cluster_id")
    old_alerts = tables["alert_decisions"].filter(stale("alert_decisions")).select("alert_id")
    kept = dict(tables)
    for t in KEEP_DAYS:
        kept[t] = tables[t].filter(~F.coalesce(stale(t), F.lit(False)))
    kept["deliveries"] = tables["deliveries"].join(old_alerts, "alert_id", "left_anti")
    kept["cluster_vectors"] = tables["cluster_vectors"].join(old_clusters, "cluster_id", "left_anti")
    kept["cluster_items"] = tables["cluster_items"].join(old_clusters, "cluster_id", "left_anti").join(
        old_news, "news_id", "left_anti")
    kept["news_entities"] = tables["news_entities"].join(old_news, "news_id", "left_anti")
    kept["news_vectors"] = tables["news_vectors"].join(old_news, "news_id", "left_anti")
    kept["reviews"] = tables["reviews"].join(
        old_clusters, tables["reviews"]["detected_cluster_id"] == old_clusters["cluster_id"], "left_anti")
    gone = orphan_investigations(tables, now, keep_days).select("run_id")
    kept["investigations"] = tables["investigations"].join(gone, "run_id", "left_anti")
    return kept


def census(tables: dict[str, DataFrame], out: str = "rows") -> DataFrame:
    """Row count per table."""
    counts = [df.agg(F.count(F.lit(1)).alias(out)).select(F.lit(name).alias("table"), out) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def deleted_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table lost."""
    return census(before, "rows_before").join(census(after, "rows_after"), "table").select(
        "table", (F.col("rows_before") - F.col("rows_after")).alias("deleted"))
