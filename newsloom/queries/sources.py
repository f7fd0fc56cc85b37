"""Scans, sources, sinks, ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.plans.lineage import checkpoint_folder
from newsloom.queries.base import query
from newsloom.queries.oracle_tables import fold, norm, sql_list
from newsloom.queries.quality import CANONICAL, split_url
from newsloom.sources import feeds, pages, quotes, registry, sinks
from newsloom.sources.tables import Desk, pick, wall

NOW = "2024-01-20 00:00:00"


def xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def feed_documents(desk: Desk) -> DataFrame:
    """One feed document per news row: mostly RSS, some Atom with several links, some RDF, with wrong encoding labels."""
    n = F.col("news_id")
    stamp = F.date_format("fetched_at", "EEE, dd MMM yyyy HH:mm:ss")
    title, body = xml_text(F.concat(F.col("title"), F.lit(" <b>&amp;</b> x"))), xml_text(F.col("content"))
    link = xml_text(F.col("url"))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), F.when(n % 10 != 9, link).otherwise(""),
                    F.lit("</link><description>"), body, F.lit("</description><pubDate>"), stamp,
                    F.lit(" GMT</pubDate><guid>g"), n, F.lit("</guid></item>"))
    rss = F.concat(F.lit("<?xml version=\"1.0\" encoding=\"utf-16\"?><rss><channel><title>feed</title>"), item, F.lit("</channel></rss>"))
    rdf = F.concat(F.lit("<rdf:RDF><channel><title>feed</title></channel><item><title>"), title, F.lit("</title><link>"), link,
                   F.lit("</link><description>"), body, F.lit("</description><dc:date>"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss"),
                   F.lit("Z</dc:date><guid>g"), n, F.lit("</guid></item></rdf:RDF>"))
    entry = F.concat(F.lit("<feed><title>feed</title><entry><title>"), title, F.lit("</title><link rel=\"self\" href=\"http://feed/self\"/><link href=\""),
                     link, F.lit("\"/><link rel=\"enclosure\" href=\"http://feed/file\"/><summary>"), body, F.lit("</summary><updated>"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss"),
                     F.lit("Z</updated><id>g"), n, F.lit("</id></entry></feed>"))
    return desk.news.select(n.alias("feed_id"), F.when(n % 7 == 3, entry).when(n % 7 == 5, rdf).otherwise(rss).alias("body"))


@query("a1_feed_items", rf"""
SELECT news_id AS feed_id, {norm('title')} || ' & x' AS title, url, {norm('content')} AS description, fetched_at AS published_at, 'g' || news_id AS guid
FROM news WHERE news_id % 10 <> 9 OR news_id % 7 IN (3, 5)""")
def a1(desk: Desk) -> DataFrame:
    return feeds.parse_feeds(feed_documents(desk))


@query("a2_aggregator_snippets", rf"""
SELECT news_id, CASE WHEN regexp_replace({fold('content')}, '[^\p{{L}}\p{{N}}]+', '', 'g') = regexp_replace({fold('title')}, '[^\p{{L}}\p{{N}}]+', '', 'g')
  OR len(regexp_extract_all(content, '[.!?](\s|$)')) < 2 THEN '' ELSE content END AS snippet FROM news""")
def a2(desk: Desk) -> DataFrame:
    return desk.news.select("news_id", feeds.aggregator_snippet(F.col("title"), F.col("content")).alias("snippet"))


LINKS_SQL = r"""
hrefs AS (SELECT page_id, url, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS h FROM pages),
flat AS (SELECT page_id, unnest(h) AS h, unnest(range(len(h))) AS pos, regexp_extract(url, '^(https?)://', 1) || '://' || regexp_extract(url, '://([^/?#]+)', 1)
  || '/article/' AS base FROM hrefs),
firsts AS (SELECT page_id, base || h AS link, min(pos) AS pos FROM flat WHERE h <> '' GROUP BY 1, 2),
outs AS (SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS position FROM firsts)"""


def linked_pages(desk: Desk) -> DataFrame:
    return desk.table("pages").withColumn("html", F.replace("html", F.lit('<a href="/'), F.lit('<a href="/article/')))


@query("a3_outlinks", f"WITH {LINKS_SQL} SELECT page_id, position, link FROM outs")
def a3(desk: Desk) -> DataFrame:
    return pages.outlinks(linked_pages(desk))


def marked_pages(desk: Desk) -> DataFrame:
    """The pages, two thirds of them with structured data or meta tags ahead of their markup."""
    n = F.col("page_id")
    data = F.concat(F.lit('<script type="application/ld+json">[{"@graph": [{"@type": "Thing", "headline": "no"}, {"@type": ["Thing", "NewsArticle"], '
                          '"headline": "Page &amp; '), n, F.lit('", "description": {"name": "told"}, "dateModified": "2024-01-02"}]}]</script>'))
    tags = F.concat(F.lit('<meta name="twitter:title" content="Later"><!-- <meta property="og:title" content="no"> -->'
                          "<META content='Page > "), n, F.lit("' property='og:title'/><meta name=description content=brief><time></time>"
                                                              '<time datetime="2024-02-03">x</time>'))
    return desk.table("pages").withColumn("html", F.concat(
        F.when(n % 3 == 1, data).when(n % 3 == 2, tags).otherwise(""), F.col("html")))


@query("a4_page_metadata", rf"""
SELECT page_id, CASE page_id % 3 WHEN 1 THEN 'Page & ' || page_id WHEN 2 THEN 'Page > ' || page_id
    ELSE trim(regexp_replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&'), '&quot;', '"'), '\s+', ' ', 'g')) END AS title,
  CASE page_id % 3 WHEN 1 THEN 'told' WHEN 2 THEN 'brief' ELSE '' END AS description,
  CASE page_id % 3 WHEN 1 THEN '2024-01-02' WHEN 2 THEN '2024-02-03' END AS published FROM pages""")
def a4(desk: Desk) -> DataFrame:
    return pages.page_metadata(marked_pages(desk))


TEXTS_SQL = r"""
texts AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&amp;', '&'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '\s*\n\s*', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages)"""


@query("a5_article_text", f"WITH {TEXTS_SQL} SELECT page_id, host, text FROM texts")
def a5(desk: Desk) -> DataFrame:
    return pages.article_text(desk.table("pages")).select("page_id", "host", "text")


@query("a6_unseen_links", f"""
WITH c AS (SELECT s.news_id, {CANONICAL} AS canonical_url FROM ({split_url('news', 'news_id')}) u JOIN news s USING (news_id)),
known AS (SELECT source_id, url FROM news WHERE created_at < TIMESTAMP '2024-01-12' UNION SELECT n.source_id, c.canonical_url FROM news n JOIN c USING (news_id)
   WHERE n.created_at < TIMESTAMP '2024-01-12')
SELECT DISTINCT source_id, url FROM news n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source_id = n.source_id AND k.url = n.url)""")
def a6(desk: Desk) -> DataFrame:
    old = desk.news.filter(F.col("created_at") < wall("2024-01-12 00:00:00"))
    known = old.select("source_id", "url", text.canonical_url(F.col("url")).alias("canonical_url"))
    return feeds.unseen_links(desk.news, old, known)


@query("a7_new_raw_items", f"""
WITH h AS (SELECT *, sha256({fold(norm("title || ' ' || content || ' ' || url"))}) AS content_hash FROM news)
SELECT DISTINCT source_id, content_hash FROM h WHERE (source_id, content_hash) NOT IN (SELECT source_id, content_hash FROM h WHERE created_at < TIMESTAMP '2024-01-12')""")
def a7(desk: Desk) -> DataFrame:
    items = feeds.with_content_hash(desk.news.withColumn("description", F.col("content")))
    stored = items.filter(F.col("created_at") < wall("2024-01-12 00:00:00"))
    return feeds.new_raw_items(items, stored).select("source_id", "content_hash")


def quote_payloads(desk: Desk) -> DataFrame:
    """Price events rendered as the payloads of four providers."""
    e, v = F.col("event_id"), F.col("value")
    none = F.lit(None).cast("double")
    symbol = F.concat(F.lit("n"), F.col("user_id") % 25)
    ticker = F.to_json(F.struct(F.concat(symbol, pick(("usdt", "usdc", "busd", "usd", ""), e % 5)).alias("symbol"),
                                v.cast("string").alias("priceChangePercent"), (F.lit(1704067200000) + e * 1000).alias("closeTime")))
    markets = F.to_json(F.array(F.struct(F.when(e % 3 != 0, v).alias("price_change_percentage_24h"))))
    stocks = F.to_json(F.struct(F.array(
        F.struct(symbol.alias("ticker"), F.when(e % 3 == 0, "HOSE").alias("exchange"), v.alias("price_change_24h"), (v * 2).alias("price_change_1w")),
        F.struct(F.concat(symbol, F.lit("b")).alias("ticker"), F.lit("").alias("exchange"), none.alias("price_change_24h"), (v + 1).alias("price_change_1w")),
    ).alias("stocks")))
    quote = F.struct(F.array(none, v + 10, v, v + 12.5, none).alias("close"), F.array(v, none, v * 3).alias("volume"))
    result = F.struct(F.struct(F.when(e % 2 == 0, "NMS").alias("exchangeName")).alias("meta"),
                      F.array(F.lit(1704067200) + e, F.lit(1704067300) + e).alias("timestamp"),
                      F.struct(F.array(quote).alias("quote")).alias("indicators"))
    chart = F.to_json(F.struct(F.struct(F.when(e % 8 == 7, "not found").alias("error"), F.array(result).alias("result")).alias("chart")))
    kind = pick(("ticker", "markets", "stocks", "chart"), e % 4)
    return desk.table("events").select(
        e.alias("payload_id"), kind.alias("kind"), symbol.alias("symbol"), F.lit("equity").alias("asset_class"), F.lit("1d").alias("win"),
        F.col("ts").alias("received_at"),
        F.when(e % 4 == 0, ticker).when(e % 4 == 1, markets).when(e % 4 == 2, stocks).otherwise(chart).alias("body"))


@query("a8_quote_moves", """
WITH e AS (SELECT *, 'N' || (user_id % 25) AS s FROM events)
SELECT event_id AS payload_id, s AS symbol, 'crypto' AS asset_class, 'BINANCE' AS exchange,
   TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts, '1d' AS win, value AS price_change_pct, CAST(NULL AS DOUBLE) AS volume_change_pct FROM e WHERE event_id % 4 = 0
UNION ALL SELECT event_id, s, 'crypto', 'COINGECKO', ts, '1d', CASE WHEN event_id % 3 <> 0 THEN value ELSE 0 END, NULL FROM e WHERE event_id % 4 = 1
UNION ALL SELECT event_id, s, 'equity', CASE WHEN event_id % 3 = 0 THEN 'HOSE' END, ts, '1d', value, NULL FROM e WHERE event_id % 4 = 2
UNION ALL SELECT event_id, s, 'equity', CASE WHEN event_id % 3 = 0 THEN 'HOSE' END, ts, '1w', value * 2, NULL FROM e WHERE event_id % 4 = 2
UNION ALL SELECT event_id, s || 'B', 'equity', NULL, ts, '1w', value + 1, NULL FROM e WHERE event_id % 4 = 2
UNION ALL SELECT event_id, s, 'equity', CASE WHEN event_id % 2 = 0 THEN 'NMS' ELSE 'YAHOO' END, TIMESTAMP '2024-01-01' + to_seconds(event_id + 100), '1d',
   round_even(((value + 12.5::DOUBLE) - (value + 10::DOUBLE)) / (value + 10::DOUBLE) * 100, 2), CASE WHEN value <> 0 THEN round_even((value * 3 - value) / value * 100, 2) END
   FROM e WHERE event_id % 4 = 3 AND event_id % 8 <> 7""")
def a8(desk: Desk) -> DataFrame:
    return quotes.normalize_quotes(quote_payloads(desk))


def gate_inputs(desk: Desk) -> tuple[DataFrame, DataFrame]:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    names = F.array(*[F.struct(F.lit(n).alias("name"), d.alias("isDelisted")) for n, d in (
        ("aaa", F.lit(False)), ("bbb", k % 5 == 0), ("ccc", F.lit(None).cast("boolean")), ("ddd", F.lit(False)))])

    def context(mark: Column, prev: Column, volume: Column) -> Column:
        return F.struct(mark.cast("string").alias("markPx"), prev.cast("string").alias("prevDayPx"), volume.cast("string").alias("dayNtlVlm"))

    contexts = F.array(context(price, price / 2, price * 10), context(price + 1, price, price), context(price, F.when(k % 3 == 0, 0.0).otherwise(price + 5), price),
                       context(F.when(k % 2 == 0, F.lit("n/a")).otherwise("7.5"), F.lit(5.0), F.lit(None)))
    payloads = desk.table("orders").select(k.alias("payload_id"), F.to_json(F.struct(names.alias("universe"))).alias("universe"),
                                           F.to_json(contexts).alias("contexts"))
    coins = F.explode(F.array(*[F.lit(c) for c in ("AAA", "bbb", "Ccc", "DDD", "eee")])).alias("coin")
    requests = desk.table("orders").select(k.alias("payload_id"), coins).select(
        "payload_id", "coin", F.concat(F.lit("s"), F.lower("coin")).alias("symbol"), F.when(F.col("coin") != "Ccc", "ETF").alias("asset_class"))
    return payloads, requests


@query("a9_gated_quotes", """
WITH r AS (SELECT o_orderkey AS payload_id, c AS coin, 'S' || upper(c) AS symbol, CASE WHEN c <> 'Ccc' THEN 'etf' ELSE 'equity' END AS asset_class,
    o_totalprice AS p, o_orderkey AS k FROM orders, (VALUES ('AAA'), ('bbb'), ('Ccc'), ('DDD'), ('eee')) t(c)),
q AS (SELECT *, CASE coin WHEN 'AAA' THEN p WHEN 'bbb' THEN p + 1 WHEN 'Ccc' THEN p WHEN 'DDD' THEN CASE WHEN k % 2 <> 0 THEN 7.5 END END AS mark,
    CASE coin WHEN 'AAA' THEN p / 2 WHEN 'bbb' THEN p WHEN 'Ccc' THEN CASE WHEN k % 3 = 0 THEN 0 ELSE p + 5 END WHEN 'DDD' THEN 5 END AS prev,
    CASE coin WHEN 'AAA' THEN p * 10 WHEN 'bbb' THEN p WHEN 'Ccc' THEN p WHEN 'DDD' THEN 0 END AS vol FROM r),
o AS (SELECT *, CASE WHEN coin = 'eee' THEN 'not found' WHEN coin = 'bbb' AND k % 5 = 0 THEN 'is delisted' WHEN mark IS NULL THEN 'has invalid prices'
    WHEN prev = 0 THEN 'prevDayPx is zero' WHEN vol < 100000 THEN 'gate' END AS why FROM q)
SELECT payload_id, symbol, asset_class, '1d' AS win, CASE WHEN why IS NULL THEN 'move' WHEN why = 'gate' THEN 'skipped' ELSE 'unavailable' END AS outcome,
  CASE WHEN why = 'gate' THEN 'gate' ELSE 'Hyperliquid instrument ' || coin || ' ' || why END AS reason,
  CASE WHEN why IS NULL THEN round_even((mark - prev) / prev * 100, 2) END AS price_change_pct FROM o""")
def a9(desk: Desk) -> DataFrame:
    rows = quotes.gated_quotes(*gate_inputs(desk), window="1d", min_notional=100000)
    # the skip reason quotes a raw float; its text form is checked in the tests
    return rows.withColumn("reason", F.when(F.col("outcome") == "skipped", "gate").otherwise(F.col("reason")))


SYMBOL_MAP_SQL = "smap AS (SELECT 'n' || n_nationkey AS map_symbol, CASE WHEN n_nationkey % 2 = 0 THEN 'xyz:N' || n_nationkey ELSE 'coin-' || n_nationkey END AS mapped FROM nation WHERE n_nationkey % 3 <> 0)"


def symbol_map(desk: Desk) -> DataFrame:
    k = F.col("n_nationkey")
    return desk.table("nation").filter(k % 3 != 0).select(
        F.concat(F.lit("n"), k).alias("map_symbol"), F.when(k % 2 == 0, F.concat(F.lit("xyz:N"), k)).otherwise(F.concat(F.lit("coin-"), k)).alias("mapped"))


@query("a10_symbol_routes", f"""
WITH {SYMBOL_MAP_SQL}, r AS (SELECT c_custkey, 'N' || (c_custkey % 25) AS symbol, ['crypto', 'equity', 'Vietnam_Equity', 'bond', NULL][c_custkey % 5 + 1] AS asset_class,
   ['global', 'crypto', 'us', 'vietnam', 'eu', NULL, 'asia'][c_custkey % 7 + 1] AS region FROM customer)
SELECT c_custkey, CASE WHEN asset_class = 'crypto' OR region = 'crypto' THEN 'crypto' WHEN lower(asset_class) = 'vietnam_equity' OR region = 'vietnam' THEN 'vietnam_market'
  WHEN m.mapped IS NOT NULL AND (m.mapped LIKE 'xyz:%' OR asset_class = 'equity' OR region IN ('global', 'us')) THEN 'hyperliquid' ELSE 'unrouted' END AS route
FROM r LEFT JOIN smap m ON upper(m.map_symbol) = r.symbol""")
def a10(desk: Desk) -> DataFrame:
    k = F.col("c_custkey")
    requests = desk.table("customer").select(
        "c_custkey", F.concat(F.lit("N"), k % 25).alias("symbol"),
        F.when(k % 5 == 0, "crypto").when(k % 5 == 1, "equity").when(k % 5 == 2, "Vietnam_Equity").when(k % 5 == 3, "bond").alias("asset_class"),
        F.when(k % 7 == 0, "global").when(k % 7 == 1, "crypto").when(k % 7 == 2, "us").when(k % 7 == 3, "vietnam").when(k % 7 == 4, "eu")
        .when(k % 7 == 6, "asia").alias("region"))
    return quotes.route_symbols(requests, symbol_map(desk)).select("c_custkey", "route")


ATTEMPTS_SQL = """
att AS (SELECT 'C' || c_custkey AS symbol, p AS priority, ['binance', 'coingecko', 'yahoo'][CAST((c_custkey + p) % 3 AS INT) + 1] AS provider,
   CASE WHEN (c_custkey * (p + 2)) % 5 < 2 THEN c_acctbal / 100 END AS price_change_pct FROM customer, (VALUES (0), (1), (2)) t(p))"""


def attempts(desk: Desk) -> DataFrame:
    k = F.col("c_custkey")
    rows = desk.table("customer").select(k, "c_acctbal", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("priority"))
    return rows.select(F.concat(F.lit("C"), k).alias("symbol"), "priority", pick(("binance", "coingecko", "yahoo"), (k + F.col("priority")) % 3).alias("provider"),
                       F.when((k * (F.col("priority") + 2)) % 5 < 2, F.col("c_acctbal") / 100).alias("price_change_pct"))


@query("a11_fallback_moves", f"""
WITH {ATTEMPTS_SQL} SELECT symbol, provider, priority, price_change_pct FROM att WHERE price_change_pct IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY priority) = 1""")
def a11(desk: Desk) -> DataFrame:
    return quotes.merge_fallbacks(attempts(desk))[0].select("symbol", "provider", "priority", "price_change_pct")


@query("a11_provider_states", f"""
WITH {ATTEMPTS_SQL}, c AS (SELECT symbol, min(priority) FILTER (price_change_pct IS NOT NULL) AS chosen, max(priority) AS last FROM att GROUP BY 1)
SELECT provider, max(CAST(priority = last AS INT)) = 1 AS failed, max(CAST(priority < last AS INT)) = 1 AS degraded, count(*) AS failures
FROM att JOIN c USING (symbol) WHERE price_change_pct IS NULL AND (chosen IS NULL OR priority < chosen) GROUP BY 1""")
def a11_states(desk: Desk) -> DataFrame:
    return quotes.merge_fallbacks(attempts(desk))[1]


@query("a12_symbol_resolution", f"""
WITH {SYMBOL_MAP_SQL},
w AS (SELECT c_custkey AS watch_id, CASE WHEN c_custkey % 11 <> 0 THEN 'N' || (c_custkey % 25) END AS symbol,
   ['us', 'vietnam', 'crypto', 'global', NULL][c_custkey % 5 + 1] AS region, ['equity', 'crypto', 'etf', NULL][c_custkey % 4 + 1] AS asset_class FROM customer WHERE c_custkey % 13 <> 0),
o AS (SELECT *, c_fresh AND symbol IS NOT NULL AS reused FROM (SELECT *, watch_id % 6 = 0 AS c_fresh FROM w)),
u AS (SELECT n_nationkey AS pos, CASE WHEN n_nationkey % 2 = 1 THEN 'xyz:n' || n_nationkey ELSE 'N' || n_nationkey END AS instrument FROM nation WHERE n_nationkey < 20),
k AS (SELECT o.*, u.instrument, CASE WHEN m.mapped LIKE 'xyz:%' THEN m.mapped END AS perp, CASE WHEN symbol IS NULL THEN 'none' WHEN region = 'vietnam' THEN 'vietnam'
   WHEN region = 'crypto' OR asset_class = 'crypto' THEN 'crypto' WHEN asset_class IN ('equity', 'etf') AND region IN ('global', 'us') THEN 'world' ELSE 'other' END AS kind
  FROM o LEFT JOIN u ON upper(replace(u.instrument, 'xyz:', '')) = o.symbol LEFT JOIN smap m ON upper(m.map_symbol) = o.symbol),
p AS (SELECT *, CASE kind WHEN 'vietnam' THEN lower(symbol) WHEN 'crypto' THEN symbol || 'USDT' WHEN 'world' THEN coalesce(perp, instrument) END AS ps FROM k)
SELECT watch_id, symbol, CASE WHEN reused THEN 'stored' WHEN kind = 'vietnam' THEN 'vietnam_market' WHEN kind = 'crypto' THEN 'binance' WHEN kind = 'world' THEN 'hyperliquid' END AS provider,
  CASE WHEN reused THEN 'old' ELSE ps END AS provider_symbol, CASE WHEN reused THEN 'resolved' WHEN kind = 'none' THEN 'skipped' WHEN ps IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status,
  CASE WHEN reused THEN NULL WHEN kind = 'none' THEN 'watchlist entry has no symbol' WHEN ps IS NOT NULL THEN NULL WHEN kind = 'world' THEN 'No Hyperliquid instrument matched ' || symbol
   ELSE 'No resolver for region=' || coalesce(region, 'unknown') || ' asset_class=' || coalesce(asset_class, 'unknown') END AS reason, reused FROM p""")
def a12(desk: Desk) -> DataFrame:
    k = F.col("c_custkey")
    watch = desk.table("customer").select(
        k.alias("watch_id"), F.when(k % 11 != 0, F.concat(F.lit(" n"), k % 25)).alias("symbol"),
        F.when(k % 5 == 0, "US").when(k % 5 == 1, "vietnam").when(k % 5 == 2, "crypto").when(k % 5 == 3, "global").alias("region"),
        F.when(k % 4 == 0, "Equity").when(k % 4 == 1, "crypto").when(k % 4 == 2, "etf").alias("asset_class"), (k % 13 != 0).alias("enabled"))
    # every sixth stored row is fresh; of the rest some are too old and some belong to another region
    w = F.col("watch_id")
    stored = watch.select(
        "watch_id", F.upper(F.trim("symbol")).alias("symbol"), F.when(w % 6 == 1, "elsewhere").otherwise(F.lower("region")).alias("region"),
        F.lower("asset_class").alias("asset_class"), F.lit("stored").alias("provider"), F.lit("old").alias("provider_symbol"),
        F.when(F.col("symbol").isNotNull(), "resolved").otherwise("skipped").alias("status"), F.lit(None).cast("string").alias("reason"),
        F.when(w % 6 <= 1, wall("2024-01-19 12:00:00")).otherwise(wall("2024-01-19 00:00:00")).alias("resolved_at"))
    n = F.col("n_nationkey")
    universe = desk.table("nation").filter(n < 20).select(n.alias("pos"), F.when(n % 2 == 1, F.concat(F.lit("xyz:n"), n)).otherwise(F.concat(F.lit("N"), n)).alias("instrument"))
    made = registry.resolve_symbols(watch, stored, universe, symbol_map(desk), wall(NOW))
    return made.select("watch_id", "symbol", "provider", "provider_symbol", "status", "reason", "reused")


@query("a13_watchlist_import", """
WITH RECURSIVE r AS (SELECT c_custkey AS idx, CASE WHEN c_custkey % 7 <> 0 THEN upper('n' || (c_custkey * 13 % 400)) END AS s,
    lower('Name ' || (c_custkey * 7 % 333)) AS n, c_custkey % 19 <> 0 AS whole, row_number() OVER (ORDER BY c_custkey) AS k FROM customer),
known AS (SELECT list(DISTINCT upper(symbol)) AS ss, list(DISTINCT lower(name)) AS ns FROM watchlist),
walk(k, idx, outcome, ss, ns) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), ss, ns FROM known UNION ALL
  SELECT k, idx, outcome, CASE WHEN outcome = 'imported' AND s IS NOT NULL THEN list_append(ss, s) ELSE ss END,
    CASE WHEN outcome = 'imported' THEN list_append(ns, n) ELSE ns END
  FROM (SELECT r.k, r.idx, r.s, r.n, w.ss, w.ns, CASE WHEN NOT r.whole THEN 'skipped_incomplete' WHEN r.s IS NOT NULL AND list_contains(w.ss, r.s) THEN 'skipped_symbol'
      WHEN list_contains(w.ns, r.n) THEN 'skipped_name' ELSE 'imported' END AS outcome FROM walk w JOIN r ON r.k = w.k + 1))
SELECT idx, outcome FROM walk WHERE k > 0""")
def a13(desk: Desk) -> DataFrame:
    k = F.col("c_custkey")
    rows = desk.table("customer").select(
        k.alias("idx"), F.when(k % 7 != 0, F.concat(F.lit("n"), k * 13 % 400)).alias("symbol"), F.concat(F.lit("Name "), k * 7 % 333).alias("name"),
        F.when(k % 19 != 0, "us").alias("region"), F.lit("equity").alias("asset_class"))
    return registry.import_watchlist(rows, desk.watchlist.select("symbol", "name"))


def source_rows(desk: Desk) -> DataFrame:
    return desk.sources.select("source_id", "name", "url", "region", F.col("asset_class").alias("category"), "source_type", F.lit("en").alias("language"),
                               "source_score", "polling_interval_s", "enabled")


@query("a14_source_upsert", """
WITH cur AS (SELECT * FROM sources WHERE source_id NOT IN ('src1', 'src2')),
inc AS (SELECT name, CASE WHEN source_id = 'src2' THEN 'https://src5.example.com/feed' ELSE url END AS url, CASE WHEN source_id IN ('src6', 'src7') THEN 99 ELSE source_score END AS source_score
  FROM sources WHERE source_id <> 'src9')
SELECT coalesce(c.name, i.name) AS name, c.source_id, coalesce(i.url, c.url) AS url, coalesce(i.source_score, c.source_score) AS source_score,
  CASE WHEN c.name IS NOT NULL AND (i.name IS NULL OR (i.url = c.url AND i.source_score = c.source_score)) THEN 'same' WHEN c.name IS NOT NULL THEN 'updated'
   WHEN i.url IN (SELECT url FROM cur) THEN 'url_conflict' ELSE 'inserted' END AS change FROM cur c FULL JOIN inc i ON i.name = c.name""")
def a14(desk: Desk) -> DataFrame:
    rows, s = source_rows(desk), F.col("source_id")
    current = rows.filter(~s.isin("src1", "src2"))
    incoming = rows.filter(s != "src9").withColumn("url", F.when(s == "src2", "https://src5.example.com/feed").otherwise(F.col("url"))).withColumn(
        "source_score", F.when(s.isin("src6", "src7"), 99).otherwise(F.col("source_score")))
    return registry.upsert_sources(current, incoming).select("name", "source_id", "url", "source_score", "change")


@query("a15_source_union", """
WITH a AS (SELECT name, url || '/' AS url, 'starter' AS origin, 0 AS r FROM sources WHERE source_id <> 'src1' UNION ALL
  SELECT name || ' again', upper(replace(url, '/feed', '')) || '/feed?x=1', 'db', 1 FROM sources)
SELECT name, url, origin FROM a QUALIFY row_number() OVER (PARTITION BY regexp_replace(regexp_replace(lower(url), '\\?.*$', ''), '/+$', '') ORDER BY r, name, url) = 1""")
def a15(desk: Desk) -> DataFrame:
    rows = desk.sources.select("name", "url", "source_type", "source_id")
    starter = rows.filter(F.col("source_id") != "src1").withColumn("url", F.concat("url", F.lit("/")))
    stored = rows.withColumn("name", F.concat("name", F.lit(" again"))).withColumn(
        "url", F.concat(F.upper(F.replace("url", F.lit("/feed"), F.lit(""))), F.lit("/feed?x=1")))
    return registry.union_sources(("starter", starter), ("db", stored)).select("name", "url", "origin")


PATTERNS = ("Ist der", "the of", "que la", "Nicht")


@query("a16_boilerplate_audit", f"""
WITH {TEXTS_SQL} SELECT page_id, host, CAST(length(text) AS INT) AS text_length, 'success' AS status,
  array_to_string(list_filter({sql_list(PATTERNS)}, lambda p: contains(text, p)), '|') AS hits FROM texts""")
def a16(desk: Desk) -> DataFrame:
    audited = pages.boilerplate_audit(pages.article_text(desk.table("pages")), PATTERNS)
    return audited.withColumn("hits", F.array_join("hits", "|"))


@query("a16_audit_by_host", f"""
WITH {TEXTS_SQL} SELECT host, count(*) AS pages, count(*) AS with_text, count(*) FILTER ({' OR '.join(f"contains(text, '{p}')" for p in PATTERNS)}) AS suspicious_pages,
  CAST(sum(length(text)) AS BIGINT) AS text_length FROM texts GROUP BY 1""")
def a16_hosts(desk: Desk) -> DataFrame:
    return pages.audit_by_host(pages.boilerplate_audit(pages.article_text(desk.table("pages")), PATTERNS))


@query("a17_append_moves", "SELECT CAST(ts AS DATE) AS date, count(*) AS moves, CAST(sum(move_id) AS BIGINT) AS id_sum FROM moves GROUP BY 1")
def a17(desk: Desk) -> DataFrame:
    path = f"{checkpoint_folder(desk.spark)}/moves-{uuid.uuid4().hex}"
    sinks.append_by_date(desk.moves, path, "ts")
    stored = desk.spark.read.parquet(path)
    return stored.groupBy("date").agg(F.count(F.lit(1)).alias("moves"), F.sum("move_id").alias("id_sum"))
