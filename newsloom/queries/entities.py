"""Entities and watchlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import entities, reports
from newsloom.queries.base import query
from newsloom.queries.oracle_tables import fold
from newsloom.sources.tables import EPOCH, Desk, seconds, wall

NOW = "2024-01-20 00:00:00"


def classification_json(d: Column) -> Column:
    """A stored classification for document number ``d``."""
    nation, firm = F.concat(F.lit("NATION_"), d % 25), F.concat(F.lit("Firm "), d % 40)
    code = F.concat(F.lit("F."), d % 40)

    def mention(name: Column, ticker: Column, exchange: Column, primary: Column) -> Column:
        return F.struct(name.alias("name"), ticker.alias("ticker"), exchange.alias("exchange"),
                        primary.alias("is_primary"))

    none = F.lit(None).cast("string")
    mentions = F.array(
        mention(nation, F.concat(F.lit("n"), d % 25), F.lit("hose"), F.lit(True)),
        mention(firm, F.when(d % 3 != 0, code).otherwise("bad ticker!"), F.lit(" nyse "), d % 2 == 0),
        mention(F.lower(nation), none, none, F.lit(False)),
        mention(F.lit("  "), none, none, F.lit(False)))
    tickers = F.array(F.concat(F.lit("N"), d % 25), F.concat(F.lit("x"), d % 9), F.lit("?? no code"), code)
    return F.to_json(F.struct(mentions.alias("entities"), tickers.alias("tickers"),
                              (40 + d % 60).alias("confidence")))


def classification_runs(desk: Desk) -> DataFrame:
    rows = desk.table("documents").select(F.col("doc_id").alias("news_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("a"))
    d = F.col("news_id")
    return rows.select(
        "news_id", (d * 2 + F.col("a")).alias("run_id"), "a",
        F.when((d + F.col("a")) % 4 != 0, "succeeded").otherwise("failed").alias("status"),
        F.when((d + F.col("a")) % 9 != 0, classification_json(d + F.col("a") * 7)).alias("result"),
        F.when(d % 13 == 0, "v0").otherwise("v1").alias("prompt_version"),
        (wall(EPOCH) + seconds(d * 2400 + F.col("a") * 60)).alias("created_at"))


RUNS_SQL = """
class_runs AS (SELECT doc_id AS news_id, doc_id * 2 + a AS run_id, a,
    CASE WHEN (doc_id + a) % 4 <> 0 THEN 'succeeded' ELSE 'failed' END AS status,
    (doc_id + a) % 9 <> 0 AS has_result, doc_id + a * 7 AS d,
    CASE WHEN doc_id % 13 = 0 THEN 'v0' ELSE 'v1' END AS prompt_version,
    TIMESTAMP '2024-01-01' + to_seconds(doc_id * 2400 + a * 60) AS created_at
  FROM documents, (VALUES (0), (1)) t(a))"""
# the same mentions as rows; watch symbols come from enabled entries named in the mention
ENTITY_SQL = """
mentions AS (
  SELECT r.news_id, r.d, 0 AS part, p.pos, p.name, p.ticker, p.exchange, p.is_primary FROM picked r,
    LATERAL (SELECT unnest([
      {'pos': 0, 'name': 'NATION_' || (r.d % 25), 'ticker': 'N' || (r.d % 25), 'exchange': 'HOSE', 'is_primary': TRUE},
      {'pos': 1, 'name': 'Firm ' || (r.d % 40), 'ticker': CASE WHEN r.d % 3 <> 0 THEN 'F.' || (r.d % 40) END,
       'exchange': 'NYSE', 'is_primary': r.d % 2 = 0},
      {'pos': 2, 'name': 'nation_' || (r.d % 25), 'ticker': NULL, 'exchange': NULL, 'is_primary': FALSE}], recursive := true)) p),
named AS (
  SELECT m.news_id, m.d, 0 AS part, m.pos, m.name, coalesce(w.symbol, m.ticker) AS ticker,
         CASE WHEN w.symbol IS NULL THEN m.exchange END AS exchange, m.is_primary, lower(m.name) AS key
  FROM mentions m LEFT JOIN watchlist w ON w.enabled AND lower(w.name) = lower(m.name)),
bare AS (
  SELECT r.news_id, r.d, 1 AS part, p.pos, p.raw, p.ticker FROM picked r,
    LATERAL (SELECT unnest([
      {'pos': 0, 'raw': 'N' || (r.d % 25), 'ticker': 'N' || (r.d % 25)}, {'pos': 1, 'raw': 'x' || (r.d % 9), 'ticker': 'X' || (r.d % 9)},
      {'pos': 2, 'raw': '?? no code', 'ticker': NULL}, {'pos': 3, 'raw': 'F.' || (r.d % 40), 'ticker': 'F.' || (r.d % 40)}], recursive := true)) p),
all_rows AS (
  SELECT news_id, d, part, pos, name, ticker, exchange, is_primary, key FROM named
  UNION ALL
  SELECT news_id, d, part, pos, coalesce(ticker, raw), ticker, NULL, TRUE, lower(raw) FROM bare b
  WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.news_id = b.news_id AND n.ticker = b.ticker)),
made AS (
  SELECT news_id, CASE WHEN ticker IS NULL THEN 'market_entity' ELSE 'ticker' END AS entity_type, name, ticker, exchange,
         CAST(40 + d % 60 AS INT) AS confidence, is_primary
  FROM (SELECT *, row_number() OVER (PARTITION BY news_id, key, ticker ORDER BY part, pos) AS rn FROM all_rows) WHERE rn = 1)"""


@query("c1_classification_entities", f"""
WITH {RUNS_SQL}, picked AS (SELECT * FROM class_runs WHERE a = 0 AND has_result), {ENTITY_SQL} SELECT * FROM made""")
def c1(desk: Desk) -> DataFrame:
    first = classification_runs(desk).filter((F.col("a") == 0) & F.col("result").isNotNull())
    return entities.classification_entities(first.select("news_id", "result"), desk.watchlist)


@query("c2_rebuild_entities", f"""
WITH {RUNS_SQL}, picked AS (
  SELECT * FROM class_runs WHERE status = 'succeeded' AND prompt_version = 'v1' AND has_result
  QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY created_at DESC, run_id DESC) = 1), {ENTITY_SQL}
SELECT * FROM made""")
def c2(desk: Desk) -> DataFrame:
    return entities.rebuild_entities(classification_runs(desk), desk.watchlist, "v1")


@query("c3_extraction_plan", f"""
WITH {RUNS_SQL}, has AS (SELECT DISTINCT news_id FROM news_entities WHERE ticker IS NOT NULL AND ticker <> 'N3'),
cached AS (SELECT DISTINCT news_id FROM class_runs WHERE status = 'succeeded' AND prompt_version = 'v1'),
f AS (SELECT news_id IN (SELECT news_id FROM has) AS h, news_id IN (SELECT news_id FROM cached) AS c FROM news)
SELECT count(*) AS candidates, count(*) FILTER (h) AS skipped_existing, count(*) FILTER (NOT h AND c) AS would_reuse_cached,
       count(*) FILTER (NOT h AND NOT c) AS would_extract FROM f""")
def c3(desk: Desk) -> DataFrame:
    has = desk.news_entities.filter(F.col("ticker") != "N3")
    news = desk.news.withColumn("status", F.lit("normalized"))
    return entities.extraction_plan(news, has, classification_runs(desk), "v1")


WATCH_TERMS_SQL = """
terms AS (SELECT watch_id, symbol, tier, unnest([lower(name), lower(symbol)] || list_transform(aliases, lambda a: lower(a))) AS term
          FROM watchlist WHERE enabled)"""
TEXT_MATCH_SQL = rf"""
{WATCH_TERMS_SQL},
bodies AS (SELECT news_id, {fold("title || ' ' || coalesce(snippet, '')")} AS body FROM news),
words AS (SELECT news_id, unnest(list_distinct(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+'))) AS word FROM bodies),
firsts AS (SELECT *, regexp_extract(term, '[\p{{L}}\p{{N}}_]+') AS word FROM terms),
matched AS (SELECT w.news_id, f.watch_id, f.symbol FROM words w JOIN firsts f USING (word) WHERE f.word = f.term
  UNION SELECT b.news_id, f.watch_id, f.symbol FROM words w JOIN firsts f USING (word) JOIN bodies b USING (news_id)
  WHERE f.word <> f.term AND contains(b.body, f.term) AND regexp_matches(b.body, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(f.term) || '($|[^\p{{L}}\p{{N}}_])'))"""


@query("c4_watchlist_text_match", f"WITH {TEXT_MATCH_SQL} SELECT * FROM matched")
def c4(desk: Desk) -> DataFrame:
    return entities.match_watchlist(desk.news, desk.watchlist)


@query("c5_symbols_for_entities", """
SELECT e.news_id, array_to_string(list_sort(list(DISTINCT w.symbol)), ',') AS symbols
FROM news_entities e JOIN watchlist w ON w.enabled AND lower(w.name) = lower(e.name) GROUP BY 1""")
def c5(desk: Desk) -> DataFrame:
    found = entities.symbols_for_entities(desk.news_entities, desk.watchlist)
    return found.select("news_id", F.array_join("symbols", ",").alias("symbols"))


TIER_SQL = """
tier_terms AS (SELECT news_id, lower(name) AS term FROM news_entities
               UNION SELECT news_id, lower(ticker) FROM news_entities WHERE ticker IS NOT NULL),
tiers AS (SELECT t.news_id, arg_max(w.tier, CASE w.tier WHEN 'S' THEN 5 WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 ELSE 1 END) AS tier
          FROM tier_terms t LEFT JOIN watchlist w ON w.enabled AND (lower(w.name) = t.term OR lower(w.symbol) = t.term
               OR list_contains(list_transform(w.aliases, lambda a: lower(a)), t.term)) GROUP BY 1)"""


def mention_terms(mentions: DataFrame) -> DataFrame:
    return mentions.select("news_id", F.explode(F.array("name", "ticker")).alias("term")).filter(F.col("term").isNotNull())


@query("c6_tier_for_entities", f"WITH {TIER_SQL} SELECT * FROM tiers")
def c6(desk: Desk) -> DataFrame:
    return entities.tier_for(mention_terms(desk.news_entities), desk.watchlist, "news_id")


@query("c7_item_candidates", f"""
WITH {TEXT_MATCH_SQL}, stored AS (SELECT * FROM news_entities WHERE ticker IS DISTINCT FROM 'N4' AND name <> 'NATION_6'),
mapped AS (SELECT s.*, w.symbol FROM stored s LEFT JOIN watchlist w ON w.enabled AND lower(w.name) = lower(s.name)),
g AS (SELECT news_id, list_sort(list(DISTINCT name)) AS e,
        list_sort(list_distinct(list(ticker) FILTER (ticker IS NOT NULL) || coalesce(list(symbol) FILTER (symbol IS NOT NULL), []))) AS t,
        list_sort(list(DISTINCT name) FILTER (is_primary)) AS pe,
        list_sort(list_distinct(coalesce(list(ticker) FILTER (is_primary AND ticker IS NOT NULL), [])
                  || coalesce(list(symbol) FILTER (is_primary AND symbol IS NOT NULL), []))) AS pt,
        list_sort(list_distinct(coalesce(list(ticker) FILTER (ticker IS NOT NULL), []) || coalesce(list(symbol) FILTER (symbol IS NOT NULL), []))) AS tt
      FROM mapped GROUP BY 1),
f AS (SELECT m.news_id, list_sort(list(DISTINCT w.name)) AS names FROM matched m JOIN watchlist w USING (watch_id) GROUP BY 1)
SELECT n.news_id, array_to_string(coalesce(g.e, f.names, []), ',') AS entities,
       array_to_string(coalesce(g.tt, []), ',') AS tickers,
       array_to_string(CASE WHEN g.e IS NOT NULL THEN coalesce(g.pe, []) ELSE coalesce(f.names, []) END, ',') AS primary_entities,
       array_to_string(coalesce(g.pt, []), ',') AS primary_tickers
FROM news n LEFT JOIN g USING (news_id) LEFT JOIN f USING (news_id)""")
def c7(desk: Desk) -> DataFrame:
    stored = desk.news_entities.filter(~F.col("ticker").eqNullSafe("N4") & (F.col("name") != "NATION_6"))
    made = entities.item_candidates(desk.news, stored, desk.watchlist)
    return made.select("news_id", *[F.array_join(c, ",").alias(c) for c in made.columns if c != "news_id"])


@query("c8_recompute_affected", """
WITH p AS (SELECT l.cluster_id, e.name, e.ticker, w.symbol FROM cluster_items l JOIN news_entities e USING (news_id)
           LEFT JOIN watchlist w ON w.enabled AND lower(w.name) = lower(e.name) WHERE e.is_primary),
g AS (SELECT cluster_id, list_sort(list(DISTINCT name)) AS e,
       list_sort(list_distinct(coalesce(list(ticker) FILTER (ticker IS NOT NULL), []) || coalesce(list(symbol) FILTER (symbol IS NOT NULL), []))) AS t
      FROM p GROUP BY 1)
SELECT c.cluster_id, array_to_string(g.e, ',') AS new_entities, array_to_string(g.t, ',') AS new_tickers,
       g.e <> c.affected_entities OR g.t <> list_filter(c.affected_tickers, lambda t: t <> 'N3') AS changed
FROM clusters c JOIN g USING (cluster_id)""")
def c8(desk: Desk) -> DataFrame:
    stored = desk.clusters.withColumn("affected_tickers", F.array_remove("affected_tickers", "N3"))
    made = entities.recompute_affected(stored, desk.cluster_items, desk.news_entities, desk.watchlist)
    return made.select("cluster_id", F.array_join("new_entities", ",").alias("new_entities"),
                       F.array_join("new_tickers", ",").alias("new_tickers"), "changed")


@query("c9_watchlist_spotlight", f"""
WITH wl AS (SELECT *, CASE WHEN watch_id % 2 = 0 THEN symbol END AS sym FROM watchlist WHERE enabled AND tier IN ('S', 'A')),
ev AS (SELECT c.cluster_id, c.final_score, c.last_updated_at, c.created_at, c.affected_entities, c.affected_tickers, r.t AS event_time
       FROM clusters c JOIN (SELECT l.cluster_id, max(n.eff) AS t FROM cluster_items l JOIN news n USING (news_id) GROUP BY 1) r USING (cluster_id)
       WHERE r.t >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR),
m AS (SELECT w.watch_id, e.* FROM wl w JOIN ev e ON CASE WHEN w.sym IS NOT NULL THEN list_contains(e.affected_tickers, w.sym)
       ELSE list_contains(e.affected_entities, w.name) END)
SELECT * FROM (SELECT watch_id, row_number() OVER (PARTITION BY watch_id ORDER BY event_time DESC, final_score DESC, last_updated_at DESC,
       created_at DESC, cluster_id) AS position, cluster_id, event_time, final_score, count(*) OVER (PARTITION BY watch_id) AS total FROM m)
WHERE position <= 3""")
def c9(desk: Desk) -> DataFrame:
    watch = desk.watchlist.withColumn("symbol", F.when(F.col("watch_id") % 2 == 0, F.col("symbol")))
    ranges = reports.report_ranges(desk.cluster_items, desk.news)
    return entities.spotlight(desk.clusters, ranges, watch, wall(NOW), since_hours=240, per_entry=3)
