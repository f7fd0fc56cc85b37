"""Market joins, scoring, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.operators import alerts, market
from newsloom.queries.base import query
from newsloom.queries.oracle_tables import sql_list
from newsloom.sources.tables import EPOCH, Desk, seconds, wall

NOW = "2024-01-20 00:00:00"
SYMBOLS = """
syms AS (SELECT cluster_id, created_at, unnest(list_distinct(affected_tickers || affected_entities)) AS symbol FROM clusters)"""
BEST_MOVES = f"""{SYMBOLS},
own AS (SELECT s.cluster_id, max(m.move_score) AS best FROM syms s JOIN moves m ON m.symbol = s.symbol
        AND m.ts BETWEEN s.created_at - INTERVAL 24 HOUR AND s.created_at + INTERVAL 4 HOUR GROUP BY 1),
span AS (SELECT min(created_at) - INTERVAL 24 HOUR AS lo, max(created_at) + INTERVAL 4 HOUR AS hi FROM clusters),
moved AS (SELECT DISTINCT symbol FROM moves, span WHERE ts BETWEEN lo AND hi),
best AS (SELECT c.cluster_id, c.cluster_id IN (SELECT cluster_id FROM syms JOIN moved USING (symbol)) AS has_moves,
    CASE WHEN c.cluster_id IN (SELECT cluster_id FROM syms JOIN moved USING (symbol)) THEN coalesce(o.best, 0) END AS move_score
  FROM clusters c LEFT JOIN own o USING (cluster_id))"""
TIERS = """
ctiers AS (SELECT s.cluster_id, arg_max(w.tier, CASE w.tier WHEN 'S' THEN 5 WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 ELSE 1 END) AS tier
  FROM syms s LEFT JOIN watchlist w ON w.enabled AND (lower(w.name) = lower(s.symbol) OR lower(w.symbol) = lower(s.symbol)
     OR list_contains(list_transform(w.aliases, lambda a: lower(a)), lower(s.symbol))) GROUP BY 1)"""


def score_sql(source: str) -> str:
    """Score components over columns top, n, hq, tier, status, move, dup, stale of ``source``."""
    return f"""
sc1 AS (SELECT *, least(100, greatest(0, top)) AS src,
    CASE upper(trim(coalesce(tier, ''))) WHEN 'S' THEN 100 WHEN 'A' THEN 90 WHEN 'B' THEN 75 WHEN 'C' THEN 55 ELSE 35 END AS rel,
    least(80, 40 + 10 * n) AS c0 FROM {source}),
sc2 AS (SELECT *, CASE WHEN hq >= 1 THEN least(100, c0 + least(15, 5 * hq)) ELSE c0 END AS c1,
    CASE WHEN move IS NULL THEN 0 ELSE least(100, greatest(0, move)) END AS mkt FROM sc1),
sc3 AS (SELECT *, CASE WHEN status IN ('confirmed', 'official') THEN greatest(95, CASE WHEN hq >= 2 THEN greatest(c1, 85) ELSE c1 END)
    ELSE CASE WHEN hq >= 2 THEN greatest(c1, 85) ELSE c1 END END AS conf FROM sc2),
sc4 AS (SELECT *, CASE WHEN move IS NULL
      THEN (src * 0.25::DOUBLE + rel * 0.35::DOUBLE + conf * 0.25::DOUBLE) / 0.85::DOUBLE
      ELSE src * 0.25::DOUBLE + rel * 0.35::DOUBLE + conf * 0.25::DOUBLE + mkt * 0.15::DOUBLE END AS b0,
    CASE WHEN src <= 40 THEN 0.85::DOUBLE WHEN src >= 55 THEN 1.0::DOUBLE
         ELSE 0.85::DOUBLE + ((src - 40) / 15::DOUBLE) * 0.15::DOUBLE END AS noise FROM sc3),
sc5 AS (SELECT *, CASE WHEN dup THEN b0 * 0.70::DOUBLE ELSE b0 END AS b1 FROM sc4),
sc6 AS (SELECT *, CASE WHEN stale THEN b1 * 0.70::DOUBLE ELSE b1 END AS b2 FROM sc5),
sc7 AS (SELECT *, CASE WHEN noise < 1 THEN b2 * noise ELSE b2 END AS b3 FROM sc6),
scored AS (SELECT *, CAST(conf AS INT) AS confidence_score, CAST(rel AS INT) AS relevance_score,
    CAST(src AS INT) AS source_score, CAST(mkt AS INT) AS market_move_score, CAST(mkt AS INT) AS impact_score,
    CASE WHEN dup THEN 20 ELSE 100 END AS novelty_score,
    CAST(round_even(CASE WHEN move IS NULL THEN rel * 0.65::DOUBLE + conf * 0.35::DOUBLE
         ELSE rel * 0.45::DOUBLE + mkt * 0.35::DOUBLE + conf * 0.20::DOUBLE END, 0) AS INT) AS urgency_score,
    CAST(round_even(b0 - b1, 0) AS INT) AS duplicate_penalty, CAST(round_even(b1 - b2, 0) AS INT) AS stale_penalty,
    CAST(round_even(b2 - b3, 0) AS INT) AS noise_penalty,
    CAST(least(100, greatest(0, round_even(b3, 0))) AS INT) AS score FROM sc7)"""


def decision_sql(score: str, hi: str = "80", mid: str = "55", low: str = "30") -> str:
    return (f"CASE WHEN {score} >= {hi} THEN 'immediate_alert' WHEN {score} >= {mid} THEN 'watchlist_batch' "
            f"WHEN {score} >= {low} THEN 'daily_digest' ELSE 'archive_only' END")


FULL_SCORE = f"""{BEST_MOVES}, {TIERS},
inp AS (SELECT c.cluster_id, c.top_source_score AS top, c.source_count AS n, c.hq_source_count AS hq, t.tier, c.status,
     b.move_score AS move, FALSE AS dup, c.status = 'stale' AS stale FROM clusters c LEFT JOIN ctiers t USING (cluster_id)
     LEFT JOIN best b USING (cluster_id)),
{score_sql('inp')}"""
COMPONENTS = ("source_score, impact_score, relevance_score, novelty_score, urgency_score, market_move_score, confidence_score, "
              "duplicate_penalty, noise_penalty, stale_penalty, score AS final_score")


@query("flagship_alert_candidates", f"""
WITH {FULL_SCORE} SELECT cluster_id, n AS source_count, hq AS hq_source_count, top AS top_source_score, tier, move AS move_score,
  score AS final_score, {decision_sql('score')} AS decision FROM scored""")
def flagship(desk: Desk) -> DataFrame:
    scored = market.score_clusters(desk.clusters, desk.moves, desk.watchlist)
    return scored.select("cluster_id", "source_count", "hq_source_count", "top_source_score", "tier", "move_score",
                         F.col("breakdown.final_score").alias("final_score"), "decision")


@query("f1_event_score", f"""
WITH inp AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 111 AS INT) - 5 AS top, CAST(l_suppkey % 7 AS INT) AS n,
  CAST(l_suppkey % 4 AS INT) AS hq, ['S', 'A', 'B', 'C', 'D', NULL, ' a '][l_partkey % 7 + 1] AS tier,
  CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'reported' ELSE 'rumor' END AS status,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity * 3 AS INT) - 20 END AS move,
  l_linestatus = 'F' AS dup, l_partkey % 3 = 0 AS stale FROM lineitem),
{score_sql('inp')}
SELECT l_orderkey, l_linenumber, l_partkey, {COMPONENTS} FROM scored""")
def f1(desk: Desk) -> DataFrame:
    part = F.col("l_partkey")
    tier = F.element_at(F.array(*[F.lit(t) for t in ("S", "A", "B", "C", "D", None, " a ")]), (part % 7 + 1).cast("int"))
    status = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "reported").otherwise("rumor")
    score = scoring.score_event(
        top_source_score=(part % 111).cast("int") - 5, source_count=(F.col("l_suppkey") % 7).cast("int"), tier=tier,
        hq_source_count=(F.col("l_suppkey") % 4).cast("int"), status=status,
        move_score=F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_quantity") * 3).cast("int") - 20),
        is_duplicate=F.col("l_linestatus") == "F", is_stale=part % 3 == 0)
    return desk.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("s")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "s.*")


@query("f2_alert_decision", f"""
SELECT cluster_id, {decision_sql('final_score', '70', '55', '20')} AS decision,
  CASE WHEN final_score >= 70 THEN 'score_above_immediate_threshold' WHEN final_score >= 55 THEN 'score_above_watchlist_threshold'
       WHEN final_score >= 20 THEN 'score_above_digest_threshold' ELSE 'score_below_digest_threshold' END AS reason FROM clusters""")
def f2(desk: Desk) -> DataFrame:
    policy = F.lit('{"immediate_threshold": "70", "watchlist_threshold": "high", "digest_threshold": 20}')
    name = F.when(F.col("r_regionkey") == 0, "alert_policy").otherwise(F.concat(F.lit("other_"), "r_regionkey"))
    settings = desk.table("region").select(name.alias("key"), policy.alias("value"))
    levels = alerts.thresholds(settings)
    decision = scoring.decide(F.col("final_score"), **levels)
    return desk.clusters.select("cluster_id", decision.alias("decision")).withColumn(
        "reason", scoring.decision_reason(F.col("decision")))


@query("f3_move_score", "SELECT move_id, move_score FROM moves")
def f3(desk: Desk) -> DataFrame:
    return market.with_move_score(desk.moves).select("move_id", "move_score")


@query("f4_event_move_pairs", f"""
WITH {SYMBOLS} SELECT s.cluster_id, m.move_id FROM syms s JOIN moves m ON lower(m.symbol) = lower(s.symbol)
  AND m.ts BETWEEN s.created_at - INTERVAL 24 HOUR AND s.created_at + INTERVAL 4 HOUR""")
def f4(desk: Desk) -> DataFrame:
    return market.event_move_pairs(desk.clusters, desk.moves).select("cluster_id", "move_id")


@query("f5_best_move_score", f"WITH {BEST_MOVES} SELECT * FROM best")
def f5(desk: Desk) -> DataFrame:
    return market.best_move_scores(desk.clusters, desk.moves)


@query("f6_event_move_report", f"""
WITH {SYMBOLS} SELECT c.cluster_id, c.headline, c.final_score, m.move_id, m.symbol, m.price_change_pct
FROM syms s JOIN clusters c USING (cluster_id) JOIN moves m ON m.symbol = s.symbol
 AND m.ts BETWEEN s.created_at - INTERVAL 24 HOUR AND s.created_at + INTERVAL 24 HOUR
WHERE c.created_at >= TIMESTAMP '2024-01-10'""")
def f6(desk: Desk) -> DataFrame:
    pairs = market.event_move_report(desk.clusters, desk.moves, wall("2024-01-10 00:00:00"))
    return pairs.select("cluster_id", "headline", "final_score", "move_id", "symbol", "price_change_pct")


@query("f7_movers", """
SELECT move_id, symbol, ts, price_change_pct FROM moves
WHERE ts >= TIMESTAMP '2024-01-10' AND asset_class = 'equity' AND (price_change_pct >= 3 OR price_change_pct <= -3)""")
def f7(desk: Desk) -> DataFrame:
    rows = market.movers(desk.moves, wall("2024-01-10 00:00:00"), asset_class="equity", min_change=3.0)
    return rows.select("move_id", "symbol", "ts", "price_change_pct")


@query("f8_latest_snapshots", """
WITH p AS (SELECT c.cluster_id, m.move_id, m.symbol, m.win, m.exchange, m.ts, row_number() OVER (
             PARTITION BY c.cluster_id, m.symbol, m.win, m.exchange ORDER BY m.ts DESC, m.move_id DESC) AS rn
           FROM clusters c JOIN moves m ON list_contains(c.affected_tickers, m.symbol)
             AND m.ts BETWEEN c.first_seen_at - INTERVAL 24 HOUR AND c.last_updated_at + INTERVAL 24 HOUR)
SELECT cluster_id, move_id, symbol, win, exchange, ts FROM p WHERE rn = 1
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, move_id DESC) <= 20""")
def f8(desk: Desk) -> DataFrame:
    return market.latest_snapshots(desk.clusters, desk.moves).select("cluster_id", "move_id", "symbol", "win", "exchange", "ts")


REVIEWS_SQL = """
reviews AS (SELECT c_custkey AS review_id, 'N' || (c_custkey % 25) AS symbol,
    CASE WHEN c_custkey % 25 < 5 THEN '1d' ELSE '1w' END AS move_window,
    ['pending', 'investigating', 'resolved', 'dismissed'][c_custkey % 4 + 1] AS status,
    CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 250 END AS detected_cluster_id,
    TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 1800) AS created_at FROM customer)"""


def reviews(desk: Desk) -> DataFrame:
    k = F.col("c_custkey")
    return desk.table("customer").select(
        k.alias("review_id"), F.concat(F.lit("N"), k % 25).alias("symbol"),
        F.when(k % 25 < 5, "1d").otherwise("1w").alias("move_window"),
        F.element_at(F.array(*[F.lit(s) for s in ("pending", "investigating", "resolved", "dismissed")]),
                     (k % 4 + 1).cast("int")).alias("status"),
        F.when(k % 3 == 0, k % 250).alias("detected_cluster_id"),
        (wall(EPOCH) + seconds(k * 1800)).alias("created_at"))


@query("f9_missed_catalysts", f"""
WITH {SYMBOLS}, {REVIEWS_SQL},
strong AS (SELECT * FROM moves WHERE win = '1d' AND move_score >= 70
           AND symbol NOT IN (SELECT symbol FROM reviews WHERE move_window = '1d')),
hits AS (SELECT m.move_id, arg_min(s.cluster_id, (s.created_at, s.cluster_id)) AS c FROM strong m JOIN syms s ON s.symbol = m.symbol
         AND s.created_at BETWEEN m.ts - INTERVAL 4 HOUR AND m.ts + INTERVAL 24 HOUR GROUP BY 1)
SELECT m.move_id, m.symbol, m.win AS move_window, m.price_change_pct, m.volume_change_pct, h.c AS detected_cluster_id,
       CASE WHEN h.c IS NULL THEN 'pending' ELSE 'resolved' END AS status FROM strong m LEFT JOIN hits h USING (move_id)""")
def f9(desk: Desk) -> DataFrame:
    return market.missed_catalysts(desk.moves, reviews(desk), desk.clusters, "1d")


@query("f10_expire_reviews", f"""
WITH {REVIEWS_SQL} SELECT review_id, CASE WHEN detected_cluster_id IS NULL AND status IN ('pending', 'investigating')
  AND created_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR THEN 'expired' ELSE status END AS status FROM reviews""")
def f10(desk: Desk) -> DataFrame:
    return market.expire_reviews(reviews(desk), wall(NOW)).select("review_id", "status")


@query("f11_latest_alert", """
SELECT cluster_id, alert_id, decision FROM alert_decisions
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, alert_id DESC) = 1""")
def f11_alert(desk: Desk) -> DataFrame:
    return alerts.latest_per_key(desk.alert_decisions, ["cluster_id"], "alert_id").select("cluster_id", "alert_id", "decision")


LATEST_RUN = """
SELECT {cols} FROM model_runs WHERE status = 'succeeded' AND prompt_version = 'v1' AND analysis_type = '{kind}'
QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, run_id DESC) = 1"""


def latest_runs(desk: Desk, kind: str) -> DataFrame:
    good = (F.col("status") == "succeeded") & (F.col("prompt_version") == "v1") & (F.col("analysis_type") == kind)
    return alerts.latest_per_key(desk.model_runs, ["target_id"], "run_id", good)


@query("f11_latest_model_run", LATEST_RUN.format(cols="target_id, run_id, model, score_modifier", kind="click"))
def f11_run(desk: Desk) -> DataFrame:
    return latest_runs(desk, "click").select("target_id", "run_id", "model", "score_modifier")


@query("f12_candidate_clusters", f"""
SELECT cluster_id, status FROM clusters c WHERE status NOT IN ('stale', 'merged') AND compacted_at IS NULL
 AND (cluster_id NOT IN (SELECT cluster_id FROM alert_decisions) OR last_updated_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)""")
def f12(desk: Desk) -> DataFrame:
    return alerts.candidate_clusters(desk.clusters, desk.alert_decisions, wall(NOW)).select("cluster_id", "status")


@query("f13_model_modifiers", f"""
WITH a AS ({LATEST_RUN.format(cols="target_id AS cluster_id, score_modifier AS m", kind="click")}),
i AS ({LATEST_RUN.format(cols="target_id AS cluster_id, CASE WHEN confidence >= 70 THEN score_modifier ELSE 0 END AS m", kind="view")}),
s1 AS (SELECT c.cluster_id, c.final_score, least(10, greatest(-10, coalesce(a.m, 0))) AS u1, coalesce(i.m, 0) AS m2
       FROM clusters c LEFT JOIN a USING (cluster_id) LEFT JOIN i USING (cluster_id)),
s2 AS (SELECT *, least(100, greatest(0, final_score + u1)) AS f1,
       least(10 - greatest(0, u1), greatest(-(10 + least(0, u1)), m2)) AS d2 FROM s1)
SELECT cluster_id, final_score, CAST(least(100, greatest(0, f1 + d2)) AS INT) AS adjusted_score, CAST(u1 + d2 AS INT) AS used_modifier FROM s2""")
def f13(desk: Desk) -> DataFrame:
    def runs(kind: str) -> DataFrame:
        return latest_runs(desk, kind).select(F.col("target_id").alias("cluster_id"), "score_modifier", "confidence")

    return alerts.apply_modifiers(desk.clusters.select("cluster_id", "final_score"), runs("click"), runs("view"))


def replay(desk: Desk) -> DataFrame:
    score = F.least(F.lit(100), F.floor("value").cast("int"))
    return desk.table("events").select(
        "event_id", F.col("user_id").alias("cluster_id"), "ts", score.alias("score"),
        scoring.decide(score).alias("decision"))


@query("f14_escalation_log", f"""
WITH r AS (SELECT event_id, user_id AS cluster_id, ts, CAST(least(100, floor(value)) AS INT) AS score FROM events),
d AS (SELECT *, {decision_sql('score')} AS decision,
        CASE WHEN score >= 80 THEN 3 WHEN score >= 55 THEN 2 WHEN score >= 30 THEN 1 ELSE 0 END AS rk FROM r),
w AS (SELECT *, coalesce(max(rk) OVER (PARTITION BY cluster_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM d)
SELECT event_id, cluster_id, ts, score, decision FROM w WHERE rk > top""")
def f14(desk: Desk) -> DataFrame:
    return alerts.escalations(replay(desk))


RULES_SQL = f"""
rules AS (SELECT n_nationkey AS rule_id, n_nationkey % 9 <> 8 AS enabled, TIMESTAMP '2024-01-01' + to_hours(CAST((n_nationkey * 7) % 25 AS INT)) AS made,
   n_nationkey AS k, CASE WHEN n_nationkey > 12 THEN n_nationkey % 4 ELSE 23 END AS s,
   CASE WHEN n_nationkey > 12 THEN n_nationkey % 7 ELSE n_nationkey % 3 + 1 END AS t FROM nation),
now AS (SELECT TIMESTAMP '2024-01-20 20:30:00' AS t),
fires AS (
  SELECT e.cluster_id, r.rule_id, r.made, CASE r.k % 5
    WHEN 0 THEN CASE WHEN r.k > 0 AND (SELECT t FROM now) - to_hours(CAST(r.k * 6 AS INT)) <= e.last_alerted_at
                THEN 'cooldown: repeated alert inside ' || (r.k * 6) || 'h' END
    WHEN 1 THEN CASE WHEN CASE WHEN s < t THEN 3 >= s AND 3 < t ELSE 3 >= s OR 3 < t END
                THEN 'quiet_hours: ' || s || ':00-' || t || ':00' END
    WHEN 2 THEN CASE WHEN list_contains(e.regions, ['crypto', 'vietnam'][r.k // 5 % 2 + 1])
                THEN 'region_filter: ' || ['crypto, mars', 'mars, vietnam'][r.k // 5 % 2 + 1]
                WHEN list_contains(e.asset_classes, 'equity') THEN 'region_filter: equity' END
    WHEN 3 THEN CASE WHEN r.k <> 3 AND (list_contains(e.affected_entities, 'NATION_' || r.k) OR list_contains(e.affected_tickers, 'N' || (r.k - 1)))
                THEN 'entity_mute: muted entity' END END AS reason
  FROM clusters e, rules r WHERE r.enabled),
first_rule AS (SELECT cluster_id, arg_min(rule_id, (made, rule_id)) AS rule_id, arg_min(reason, (made, rule_id)) AS reason
  FROM fires WHERE reason IS NOT NULL GROUP BY 1)"""
RULES_NOW = "2024-01-20 20:30:00"  # a Saturday; 03:30 of the next day in the default zone


def suppression_rules(desk: Desk) -> DataFrame:
    k = F.col("n_nationkey")
    none = F.lit(None)
    region = F.when(F.floor(k / 5) % 2 == 0, "crypto").otherwise("vietnam")
    config = F.struct(
        F.when(k % 5 == 0, k * 6).alias("hours"),
        F.when(k % 5 == 1, F.when(k > 12, k % 4).otherwise(none)).alias("start_hour"),
        F.when(k % 5 == 1, F.when(k > 12, k % 7).otherwise(k % 3 + 1)).alias("end_hour"),
        F.when(k % 5 == 2, F.array(F.lit("mars"), region)).alias("regions"),
        F.when(k % 5 == 2, F.array(F.lit("equity"))).alias("categories"),
        F.when(k % 5 == 2, k % 2 == 0).alias("weekend_only"),
        F.when(k % 5 == 3, F.array(F.concat(F.lit("Nation_"), k), F.concat(F.lit("n"), k - 1))).alias("entities"),
        F.when(k == 3, "2024-01-20T20:00:00Z").when(k == 8, "2024-02-01T00:00:00+07:00").alias("until"))
    kind = (F.when(k % 5 == 0, "cooldown").when(k % 5 == 1, "quiet_hours").when(k % 5 == 2, "region_filter")
            .when(k % 5 == 3, "entity_mute").otherwise("other"))
    return desk.table("nation").select(
        k.alias("rule_id"), kind.alias("rule_type"), F.to_json(config).alias("config"), (k % 9 != 8).alias("enabled"),
        (wall(EPOCH) + F.make_dt_interval(F.lit(0), ((k * 7) % 25).cast("int"))).alias("created_at"))


@query("f15_suppression", f"WITH {RULES_SQL} SELECT * FROM first_rule")
def f15(desk: Desk) -> DataFrame:
    return alerts.suppression(desk.clusters, suppression_rules(desk), wall(RULES_NOW))


@query("f16_dispatch_queue", f"""
WITH {RULES_SQL} SELECT a.alert_id, a.cluster_id, a.created_at, c.headline, coalesce(a.suppression_reason, f.reason) AS reason,
  CASE WHEN coalesce(a.suppression_reason, f.reason) IS NULL THEN 'pending' ELSE 'skipped' END AS state
FROM alert_decisions a JOIN clusters c USING (cluster_id) LEFT JOIN first_rule f USING (cluster_id)
WHERE a.sent_at IS NULL AND a.decision = 'immediate_alert'""")
def f16(desk: Desk) -> DataFrame:
    return alerts.dispatch_queue(desk.alert_decisions, desk.clusters, suppression_rules(desk), wall(RULES_NOW))


@query("f17_delivery_retries", """
SELECT delivery_id, channel, attempt_count + 1 AS attempt_count, TIMESTAMP '1998-06-01' AS attempted_at,
  CASE WHEN delivery_id % 5 = 0 THEN 'sent' WHEN attempt_count + 1 >= 3 THEN 'permanently_failed' ELSE 'failed' END AS status,
  CASE WHEN delivery_id % 5 <> 0 AND attempt_count + 1 < 3 THEN TIMESTAMP '1998-06-01' + INTERVAL 5 MINUTE END AS next_attempt_at
FROM deliveries WHERE status = 'failed' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '1998-06-01')""")
def f17(desk: Desk) -> DataFrame:
    now = wall("1998-06-01 00:00:00")
    outcomes = desk.deliveries.select("delivery_id", (F.col("delivery_id") % 5 == 0).alias("succeeded"))
    return alerts.apply_delivery_outcomes(alerts.retryable_deliveries(desk.deliveries, now), outcomes, now)


@query("f18_rescore", f"""
WITH {FULL_SCORE} SELECT cluster_id, {COMPONENTS}, {decision_sql('score')} AS alert_level, TIMESTAMP '{NOW}' AS created_at FROM scored""")
def f18(desk: Desk) -> DataFrame:
    return market.rescore(desk.clusters, desk.moves, desk.watchlist, wall(NOW))


@query("f19_analysis_gate", f"""
WITH {FULL_SCORE} SELECT cluster_id, score >= 80 OR (n = 1 AND top >= 90) OR (coalesce(move, 0) >= 70 AND score >= 55)
  OR (rel >= 80 AND n <= 1 AND score >= 55) AS needs_analysis FROM scored""")
def f19(desk: Desk) -> DataFrame:
    scored = market.score_clusters(desk.clusters, desk.moves, desk.watchlist)
    return scored.select("cluster_id", alerts.needs_analysis(
        F.col("breakdown.final_score"), F.col("source_count"), F.col("top_source_score"),
        F.col("breakdown.relevance_score"), F.col("move_score")).alias("needs_analysis"))


INVESTIGATIONS_SQL = """
investigations AS (SELECT s_suppkey AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN 'event_cluster' ELSE 'missed_catalyst_review' END AS target_type,
   s_suppkey * 2 AS target_id, ['pending', 'running', 'succeeded', 'failed'][s_suppkey % 4 + 1] AS status,
   TIMESTAMP '2024-01-01' + to_hours(CAST(s_suppkey AS INT)) AS created_at FROM supplier)"""


def investigations(desk: Desk) -> DataFrame:
    k = F.col("s_suppkey")
    return desk.table("supplier").select(
        k.alias("run_id"), F.when(k % 2 == 0, "event_cluster").otherwise("missed_catalyst_review").alias("target_type"),
        (k * 2).alias("target_id"),
        F.element_at(F.array(*[F.lit(s) for s in ("pending", "running", "succeeded", "failed")]), (k % 4 + 1).cast("int")).alias("status"),
        (wall(EPOCH) + F.make_dt_interval(F.lit(0), k.cast("int"))).alias("created_at"))


@query("f20_investigation_queue", f"""
WITH {REVIEWS_SQL}, {INVESTIGATIONS_SQL},
w AS (SELECT 'event_cluster' AS target_type, cluster_id AS target_id, 'auto_event_uncertain' AS trigger_reason FROM clusters
      WHERE final_score >= 80 OR (source_count <= 1 AND top_source_score >= 90 AND final_score >= 55)
         OR (status IN ('rumor', 'reported') AND final_score >= 70)
      UNION ALL SELECT 'missed_catalyst_review', review_id, 'auto_missed_catalyst' FROM reviews
      WHERE status = 'pending' AND detected_cluster_id IS NULL)
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM investigations i WHERE i.target_type = w.target_type AND i.target_id = w.target_id
   AND i.status IN ('pending', 'running', 'succeeded'))""")
def f20(desk: Desk) -> DataFrame:
    return alerts.queue_investigations(desk.clusters, reviews(desk), investigations(desk))


@query("f21_local_evidence", rf"""
WITH recent AS (SELECT news_id, created_at, source_score, lower(title || ' ' || coalesce(snippet, '')) AS body FROM news WHERE created_at >= TIMESTAMP '2024-01-02'),
t AS (SELECT cluster_id AS target_id, affected_tickers AS s, affected_entities AS e, list_filter(list_distinct(list_transform(
     regexp_extract_all(headline || ' ' || array_to_string(affected_entities, ' '), '[A-Za-z0-9][A-Za-z0-9.-]{{2,}}'), lambda w: lower(w))),
     lambda w: NOT list_contains({sql_list(alerts.EVIDENCE_STOPWORDS)}, w)) AS c FROM clusters),
p AS (SELECT target_id, news_id, created_at, least(10, greatest(0, source_score // 10))
   + 20 * len(list_filter(s, lambda v: contains(body, lower(v)))) + 25 * len(list_filter(e, lambda v: contains(body, lower(v))))
   + least(30, 5 * len(list_filter(c, lambda v: contains(body, v)))) AS score FROM t, recent)
SELECT target_id, news_id, CAST(score AS INT) AS relevance_score FROM p WHERE score >= 30
QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, news_id) <= 10""")
def f21(desk: Desk) -> DataFrame:
    targets = desk.clusters.select(
        F.col("cluster_id").alias("target_id"), F.col("affected_tickers").alias("symbols"),
        F.col("affected_entities").alias("entities"),
        alerts.context_terms(F.col("headline"), F.array_join("affected_entities", " ")).alias("context"))
    return alerts.local_evidence(targets, desk.news, wall("2024-01-02 00:00:00"))


@query("f22_evidence_rank", rf"""
WITH r AS (SELECT CAST(floor(page_id / 10) AS BIGINT) AS target_id, page_id AS position, url,
    regexp_replace(lower(regexp_extract(url, '{text.URL_PATTERN}', 4)), '^www\.', '') AS domain FROM pages),
q AS (SELECT *, CASE WHEN domain = 'example.org' OR domain LIKE '%.example.org' THEN 'official'
     WHEN domain = 'example.net' OR domain LIKE '%.example.net' THEN 'high_quality' WHEN domain <> '' THEN 'media' ELSE 'unknown' END AS source_quality FROM r),
u AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY target_id, domain ORDER BY position) = 1)
SELECT target_id, position, url, domain, source_quality, rank FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY
   CASE source_quality WHEN 'official' THEN 0 WHEN 'high_quality' THEN 1 WHEN 'media' THEN 2 ELSE 3 END, position) AS rank FROM u) WHERE rank <= 5""")
def f22(desk: Desk) -> DataFrame:
    results = desk.table("pages").select(F.floor(F.col("page_id") / 10).alias("target_id"),
                                         F.col("page_id").alias("position"), "url")
    return alerts.rank_evidence(results, 5, official=("example.org",), high_quality=("example.net",))
