"""Events against price moves: scores, reports, unexplained moves."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.operators.entities import tier_for
from newsloom.plans.intervals import interval, interval_extreme, interval_join
from newsloom.plans.keys import top_per_key
from newsloom.plans.lineage import cut_lineage

# Fixed values of the event window.
PRE_EVENT = timedelta(hours=24)
POST_EVENT = timedelta(hours=4)
CATALYST_MIN_SCORE = 70
REVIEW_TTL = timedelta(hours=24)


def with_move_score(moves: DataFrame) -> DataFrame:
    return moves.withColumn("move_score", scoring.move_score(
        F.col("price_change_pct"), F.col("volume_change_pct"), F.col("z_score")))


def event_symbols(clusters: DataFrame, *, folded: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per cluster and distinct ticker or entity name."""
    empty = F.array().cast("array<string>")
    values = F.concat(F.coalesce("affected_tickers", empty), F.coalesce("affected_entities", empty))
    values = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    if folded:
        values = F.transform(values, text.casefold)
    return clusters.select("cluster_id", "created_at", *extra, F.explode(F.array_distinct(values)).alias("symbol"))


def event_move_pairs(clusters: DataFrame, moves: DataFrame, before: timedelta = PRE_EVENT,
                     after: timedelta = POST_EVENT) -> DataFrame:
    """Every event with every move of one of its symbols inside its window (case-folded symbols)."""
    events = event_symbols(clusters, folded=True)
    at = F.col("created_at")
    folded = moves.withColumn("symbol", text.casefold(F.col("symbol")))
    return interval_join(events, folded, keys=["symbol"], low=at - interval(before), high=at + interval(after),
                         right_ts="ts")


def narrow_events(clusters: DataFrame) -> DataFrame:
    """What the score rules read of clusters, written once, so that clusters are not derived again for each use."""
    return cut_lineage(clusters.select("cluster_id", "created_at", "affected_tickers", "affected_entities"))


def best_move_scores(clusters: DataFrame, moves: DataFrame) -> DataFrame:
    """Best move score per event.

    Null when none of the event's symbols moved within the span of the whole batch, 0 when they
    moved but outside the event's own window.
    """
    return _best_move_scores(narrow_events(clusters), moves)


def _best_move_scores(clusters: DataFrame, moves: DataFrame) -> DataFrame:
    events = event_symbols(clusters, folded=False)
    at = F.col("created_at")
    scored = with_move_score(moves)
    best = interval_extreme(
        events, scored, row_id=["cluster_id"], keys=["symbol"], low=at - interval(PRE_EVENT),
        high=at + interval(POST_EVENT), right_ts="ts", value=F.col("move_score"), largest=True, out="_best")
    span = clusters.agg(F.struct((F.min("created_at") - interval(PRE_EVENT)).alias("low"),
                                 (F.max("created_at") + interval(POST_EVENT)).alias("high")).alias("span")).scalar()
    moved = moves.filter((F.col("ts") >= span["low"]) & (F.col("ts") <= span["high"])).select("symbol").distinct()
    seen = events.join(moved, "symbol", "left_semi").select("cluster_id").distinct().withColumn("has_moves", F.lit(True))
    joined = clusters.select("cluster_id").join(seen, "cluster_id", "left").join(best, "cluster_id", "left")
    has = F.coalesce("has_moves", F.lit(False))
    return joined.select("cluster_id", F.when(has, F.coalesce("_best", F.lit(0))).cast("int").alias("move_score"),
                         has.alias("has_moves"))


def cluster_tiers(clusters: DataFrame, watchlist: DataFrame) -> DataFrame:
    return tier_for(event_symbols(clusters, folded=False), watchlist, "cluster_id", "symbol")


def score_clusters(clusters: DataFrame, moves: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Tier, move score, score components and decision of every cluster."""
    events = narrow_events(clusters)
    joined = clusters.join(cluster_tiers(events, watchlist), "cluster_id", "left").join(
        _best_move_scores(events, moves), "cluster_id", "left")
    score = scoring.score_event(
        top_source_score=F.col("top_source_score"), source_count=F.col("source_count"), tier=F.col("tier"),
        hq_source_count=F.col("hq_source_count"), status=F.col("status"), move_score=F.col("move_score"),
        is_stale=F.col("status") == "stale")
    return joined.withColumn("breakdown", score).withColumn("decision", scoring.decide(F.col("breakdown.final_score")))


def rescore(clusters: DataFrame, moves: DataFrame, watchlist: DataFrame, now: Column) -> DataFrame:
    """Score-history rows for all clusters; the alert level the new score would have rides along."""
    return score_clusters(clusters, moves, watchlist).select(
        "cluster_id", "breakdown.*", F.col("decision").alias("alert_level"), now.alias("created_at"))


def event_move_report(clusters: DataFrame, moves: DataFrame, since: Column, limit: int | None = None,
                      around: timedelta = timedelta(hours=24)) -> DataFrame:
    """Recent events with nearby moves, one row per pair, exact-case symbols, newest events first."""
    events = clusters.filter(F.col("created_at") >= since).select(
        "cluster_id", "headline", "final_score", "created_at", "affected_tickers", "affected_entities")
    if limit is not None:
        events = events.orderBy(F.col("created_at").desc(), F.col("cluster_id")).limit(limit)
    exploded = event_symbols(events, folded=False, extra=("headline", "final_score"))
    at = F.col("created_at")
    return interval_join(exploded, moves, keys=["symbol"], low=at - interval(around), high=at + interval(around),
                         right_ts="ts")


def movers(moves: DataFrame, since: Column, asset_class: str | None = None, min_change: float | None = None,
           limit: int | None = None) -> DataFrame:
    rows = moves.filter(F.col("ts") >= since)
    if asset_class is not None:
        rows = rows.filter(F.col("asset_class") == asset_class)
    if min_change is not None:
        rows = rows.filter((F.col("price_change_pct") >= min_change) | (F.col("price_change_pct") <= -min_change))
    return rows if limit is None else rows.orderBy(F.col("ts").desc(), F.col("move_id").desc()).limit(limit)


def latest_snapshots(clusters: DataFrame, moves: DataFrame, k: int = 20,
                     around: timedelta = timedelta(hours=24)) -> DataFrame:
    """Latest move per symbol, window and exchange around each event; the newest ``k`` per event."""
    events = clusters.select(
        "cluster_id", (F.coalesce("first_seen_at", "created_at") - interval(around)).alias("lo"),
        (F.col("last_updated_at") + interval(around)).alias("hi"),
        F.explode(F.array_distinct("affected_tickers")).alias("symbol"))
    latest = interval_extreme(
        events, moves, row_id=["cluster_id", "symbol"], keys=["symbol"], low=F.col("lo"), high=F.col("hi"),
        right_ts="ts", value=F.struct("ts", "move_id", "price_change_pct"), largest=True, out="m",
        right_group=["win", "exchange"])
    flat = latest.select("cluster_id", "symbol", "win", "exchange", "m.ts", "m.move_id", "m.price_change_pct")
    return top_per_key(flat, ["cluster_id"], (F.col("ts").desc(), F.col("move_id").desc()), k)


def missed_catalysts(moves: DataFrame, reviews: DataFrame, clusters: DataFrame, window: str) -> DataFrame:
    """Review rows for strong moves of symbols without a review, with the earliest matching event."""
    reviewed = reviews.filter(F.col("move_window") == window).select("symbol").distinct()
    strong = with_move_score(moves.filter(F.col("win") == window)).filter(
        F.col("move_score") >= CATALYST_MIN_SCORE).join(reviewed, "symbol", "left_anti")
    at = F.col("ts")
    match = interval_extreme(
        strong, event_symbols(clusters, folded=False), row_id=["move_id"], keys=["symbol"], low=at - interval(POST_EVENT),
        high=at + interval(PRE_EVENT), right_ts="created_at", value=F.struct("created_at", "cluster_id"),
        largest=False, out="_match")
    found = F.col("_match.cluster_id")
    return strong.join(match, "move_id", "left").select(
        "move_id", "symbol", F.col("win").alias("move_window"), "price_change_pct", "volume_change_pct",
        found.alias("detected_cluster_id"), F.when(found.isNotNull(), "resolved").otherwise("pending").alias("status"))


def expire_reviews(reviews: DataFrame, now: Column) -> DataFrame:
    old = (F.col("detected_cluster_id").isNull() & F.col("status").isin("pending", "investigating")
           & (F.col("created_at") < now - interval(REVIEW_TTL)))
    return reviews.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))
