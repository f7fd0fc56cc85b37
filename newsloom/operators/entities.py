"""Entity mentions and watchlist matching."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.plans.intervals import interval
from newsloom.plans.keys import top_per_key
from newsloom.plans.lineage import cut_lineage

# Fixed values of stored entity rows.
TICKER_PATTERN = r"^[A-Z0-9][A-Z0-9.\-:/]{0,31}$"
SPOTLIGHT_TIERS = ("S", "A", "TIER-1", "TIER1", "1")
CLASSIFICATION = (
    "struct<entities:array<struct<name:string,ticker:string,exchange:string,is_primary:boolean>>,"
    "tickers:array<string>,confidence:int>")


def watch_terms(watchlist: DataFrame, *, with_symbol: bool) -> DataFrame:
    """One row per enabled entry and folded match term."""
    extra = F.array("symbol") if with_symbol else F.array().cast("array<string>")
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), extra)
    return watchlist.filter("enabled").select(
        "watch_id", "symbol", F.upper(F.coalesce("tier", F.lit("D"))).alias("tier"),
        F.explode(F.array_distinct(F.transform(names, lambda t: F.trim(text.casefold(t))))).alias("term"),
    ).filter(F.col("term") != "")


def match_terms(texts: DataFrame, terms: DataFrame, row_id: str, body: str) -> DataFrame:
    """Distinct ``(row_id, watch_id, symbol)`` where a term occurs as a whole token of ``body``.

    Texts and terms meet on the term's longest word, the one that is likely the rarest. A one-word term is settled by that
    equality; longer ones are verified by pattern against the text, for the surviving pairs only. The few terms
    without any word are tried on every text, as they have nothing to meet on.
    """
    words = F.transform(F.regexp_extract_all("term", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    anchor = F.array_max(words)["w"]
    keyed = terms.select("watch_id", "symbol", "term", anchor.alias("_token"), (anchor == F.col("term")).alias("_single"))
    tokens = texts.select(row_id, F.explode(text.word_tokens(F.coalesce(F.col(body), F.lit("")))).alias("_token"))
    hits = tokens.join(keyed.filter(F.col("_token").isNotNull()), "_token")
    sure = hits.filter("_single").select(row_id, "watch_id", "symbol")
    folded = text.casefold(F.col(body))
    checked = (
        hits.filter(~F.col("_single")).select(row_id, "watch_id", "symbol", "term").distinct()
        .join(texts.select(row_id, body), row_id)
        .filter(F.regexp_like(folded, text.whole_token_pattern(F.col("term"))))
        .select(row_id, "watch_id", "symbol"))
    found = sure.unionByName(checked)
    bare = keyed.filter(F.col("_token").isNull()).select("watch_id", "symbol", "term")
    if not bare.isEmpty():
        listed = bare.agg(F.collect_list(F.struct("watch_id", "symbol", "term"))).scalar()
        tried = texts.select(row_id, folded.alias("_folded"), F.explode(listed).alias("_t")).filter(
            F.regexp_like("_folded", text.whole_token_pattern(F.col("_t.term"))))
        found = found.unionByName(tried.select(row_id, "_t.watch_id", "_t.symbol"))
    return found.distinct()


def match_watchlist(news: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Watchlist entries whose name, alias or symbol occurs in title and snippet."""
    texts = news.select("news_id", F.concat_ws(" ", "title", F.coalesce("snippet", F.lit(""))).alias("_text"))
    return match_terms(texts, watch_terms(watchlist, with_symbol=True), "news_id", "_text")


def symbols_by_name(names: DataFrame, watchlist: DataFrame, name: str = "name") -> DataFrame:
    """Watch symbols per distinct entity name; the symbol itself is not a match term."""
    distinct = names.select(name).filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct()
    terms = watch_terms(watchlist, with_symbol=False).filter(F.coalesce("symbol", F.lit("")) != "")
    return match_terms(distinct, terms, name, name).select(name, "symbol").distinct()


def symbols_for_entities(mentions: DataFrame, watchlist: DataFrame, row_id: str = "news_id") -> DataFrame:
    """Sorted watch symbols per item, resolved once per distinct entity name."""
    lookup = symbols_by_name(mentions, watchlist)
    return mentions.select(row_id, "name").distinct().join(lookup, "name").groupBy(row_id).agg(
        F.array_sort(F.collect_set("symbol")).alias("symbols"))


def tier_for(terms: DataFrame, watchlist: DataFrame, row_id: str, term: str = "term") -> DataFrame:
    """Best tier per row among entries equal to one of its terms.

    With an empty watchlist every row that has a term gets tier A.
    """
    wanted = terms.select(row_id, text.casefold(F.col(term)).alias("term")).filter(F.col("term") != "").distinct()
    entries = watch_terms(watchlist, with_symbol=True).select("term", "tier").distinct()
    any_entry = watchlist.filter("enabled").agg(F.count(F.lit(1))).scalar() > 0
    rank = scoring.ranked(F.col("tier"), scoring.TIER_RANK, 0)
    best = wanted.join(entries, "term", "left").groupBy(row_id).agg(
        F.max_by("tier", F.when(F.col("tier").isNotNull(), F.struct(rank, "tier"))).alias("tier"))
    return best.select(row_id, F.when(any_entry, F.col("tier")).otherwise(F.lit("A")).alias("tier"))


def _ticker(value: Column) -> Column:
    code = F.upper(F.trim(value))
    return F.when(code.rlike(TICKER_PATTERN), code)


def _name(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def classification_entities(results: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Entity rows from ``(news_id, result)`` classification JSON."""
    parsed = results.select("news_id", F.from_json("result", CLASSIFICATION).alias("r"))
    confidence = F.coalesce("r.confidence", F.lit(0)).alias("confidence")
    mentions = parsed.select("news_id", confidence, F.posexplode("r.entities").alias("pos", "m")).select(
        "news_id", "confidence", "pos", _name(F.col("m.name")).alias("name"), _ticker(F.col("m.ticker")).alias("own"),
        F.upper(F.trim("m.exchange")).alias("exchange"), F.coalesce("m.is_primary", F.lit(False)).alias("is_primary"),
    ).filter(F.col("name") != "")
    lookup = symbols_by_name(mentions, watchlist).groupBy("name").agg(F.min("symbol").alias("watch"))
    named = mentions.join(lookup, "name", "left").select(
        "news_id", "confidence", F.lit(0).alias("part"), "pos", "name", F.coalesce("watch", "own").alias("ticker"),
        F.when(F.col("watch").isNull() & (F.col("exchange") != ""),
               F.col("exchange")).alias("exchange"),
        "is_primary", text.casefold(F.col("name")).alias("key"))
    bare = parsed.select("news_id", confidence, F.posexplode("r.tickers").alias("pos", "t")).select(
        "news_id", "confidence", F.lit(1).alias("part"), "pos", _name(F.col("t")).alias("raw"),
        _ticker(F.col("t")).alias("ticker")).filter(F.col("raw") != "")
    attached = named.filter(F.col("ticker").isNotNull()).select("news_id", "ticker").distinct()
    bare = bare.join(attached, ["news_id", "ticker"], "left_anti").select(
        "news_id", "confidence", "part", "pos", F.coalesce("ticker", "raw").alias("name"), "ticker",
        F.lit(None).cast("string").alias("exchange"), F.lit(True).alias("is_primary"),
        text.casefold(F.col("raw")).alias("key"))
    kept = top_per_key(named.unionByName(bare), ["news_id", "key", "ticker"], (F.col("part"), F.col("pos")))
    return kept.select(
        "news_id", F.when(F.col("ticker").isNotNull(), "ticker").otherwise("market_entity").alias("entity_type"),
        "name", "ticker", "exchange", "confidence", "is_primary")


def latest_classifications(runs: DataFrame, prompt_version: str) -> DataFrame:
    """Newest succeeded run with a result per item."""
    good = runs.filter((F.col("status") == "succeeded") & (F.col("prompt_version") == prompt_version)
                       & F.col("result").isNotNull())
    return top_per_key(good, ["news_id"], (F.col("created_at").desc(), F.col("run_id").desc()))


def rebuild_entities(runs: DataFrame, watchlist: DataFrame, prompt_version: str) -> DataFrame:
    return classification_entities(latest_classifications(runs, prompt_version).select("news_id", "result"), watchlist)


def extraction_plan(news: DataFrame, entities: DataFrame, runs: DataFrame, prompt_version: str) -> DataFrame:
    """How many items already have entities, can reuse a stored run, or must be classified."""
    has = entities.select("news_id", F.lit(True).alias("_has")).distinct()
    cached = runs.filter((F.col("status") == "succeeded") & (F.col("prompt_version") == prompt_version)).select(
        "news_id", F.lit(True).alias("_cached")).distinct()
    rows = news.filter(F.col("status").isin("normalized", "deduped")).select("news_id").join(has, "news_id", "left").join(
        cached, "news_id", "left")
    skipped = F.coalesce("_has", F.lit(False))
    reuse = ~skipped & F.coalesce("_cached", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(skipped).alias("skipped_existing"),
        F.count_if(reuse).alias("would_reuse_cached"), F.count_if(~skipped & ~reuse).alias("would_extract"))


def item_candidates(news: DataFrame, mentions: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Entities, tickers and their primary subsets per item, with the fallback to title matches.

    Only the texts of items without a stored name are matched; the fallback of all others would not be looked at.
    """
    lookup = symbols_by_name(mentions, watchlist)
    rows = cut_lineage(mentions.join(lookup, "name", "left").groupBy("news_id").agg(
        F.collect_set("name").alias("stored"),
        F.collect_set("ticker").alias("own"), F.collect_set("symbol").alias("mapped"),
        F.collect_set(F.when(F.col("is_primary"), F.col("name"))).alias("p_names"),
        F.collect_set(F.when(F.col("is_primary"), F.col("ticker"))).alias("p_own"),
        F.collect_set(F.when(F.col("is_primary"), F.col("symbol"))).alias("p_mapped")))
    bare = cut_lineage(news.select("news_id").join(rows.filter(F.size("stored") > 0).select("news_id"), "news_id", "left_anti"))
    joined = news.select("news_id").join(rows, "news_id", "left")
    if bare.isEmpty():
        joined = joined.withColumn("title_names", F.lit(None).cast("array<string>"))
    else:
        names = watchlist.select("watch_id", F.col("name").alias("_watch_name"))
        fallback = match_watchlist(news.join(bare, "news_id", "left_semi"), watchlist).join(names, "watch_id").groupBy("news_id").agg(
            F.collect_set("_watch_name").alias("title_names"))
        joined = joined.join(fallback, "news_id", "left")
    empty = F.array().cast("array<string>")
    has = F.coalesce(F.size("stored"), F.lit(0)) > 0

    def tidy(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.coalesce(c, empty)))

    entities = tidy(F.when(has, F.col("stored")).otherwise(F.col("title_names")))
    return joined.select(
        "news_id", entities.alias("entities"),
        tidy(F.when(has, F.array_union("own", "mapped"))).alias("tickers"),
        F.when(has, tidy(F.col("p_names"))).otherwise(entities).alias("primary_entities"),
        tidy(F.when(has, F.array_union("p_own", "p_mapped"))).alias("primary_tickers"))


def affected_sets(links: DataFrame, mentions: DataFrame, watchlist: DataFrame, primary_only: bool = True) -> DataFrame:
    """Affected entities and tickers per cluster from its members' mentions."""
    used = mentions.filter("is_primary") if primary_only else mentions
    lookup = symbols_by_name(used, watchlist)
    # distinct (cluster, name, ticker) before the symbol join keeps a huge cluster small
    rows = links.select("cluster_id", "news_id").join(used, "news_id").select("cluster_id", "name", "ticker").distinct()
    symbols = rows.join(lookup, "name", "left")
    return symbols.groupBy("cluster_id").agg(
        F.array_sort(F.collect_set("name")).alias("affected_entities"),
        F.array_sort(F.array_union(F.collect_set("ticker"), F.collect_set("symbol"))).alias("affected_tickers"))


def recompute_affected(clusters: DataFrame, links: DataFrame, mentions: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Clusters with their recomputed sets and whether they differ from the stored ones."""
    fresh = affected_sets(links, mentions, watchlist).select(
        "cluster_id", F.col("affected_entities").alias("_e"), F.col("affected_tickers").alias("_t"))
    empty = F.array().cast("array<string>")
    joined = clusters.select("cluster_id", "affected_entities", "affected_tickers").join(fresh, "cluster_id", "left")
    new_e, new_t = F.coalesce("_e", empty), F.coalesce("_t", empty)
    return joined.select(
        "cluster_id", new_e.alias("new_entities"), new_t.alias("new_tickers"),
        ((new_e != F.col("affected_entities")) | (new_t != F.col("affected_tickers"))).alias("changed"))


def spotlight(clusters: DataFrame, ranges: DataFrame, watchlist: DataFrame, now: Column, since_hours: int,
              per_entry: int, tiers: Sequence[str] = SPOTLIGHT_TIERS) -> DataFrame:
    """Latest events per top-tier watchlist entry, with the entry's total."""
    when = F.coalesce("report_end_at", "last_updated_at", "created_at")
    events = clusters.join(ranges, "cluster_id", "left").select(
        "cluster_id", "final_score", "last_updated_at", "created_at", "affected_entities", "affected_tickers",
        when.alias("event_time")).filter(F.col("event_time") >= now - interval(timedelta(hours=since_hours)))
    fields = ["cluster_id", "final_score", "last_updated_at", "created_at", "event_time"]

    def terms(column: str) -> DataFrame:
        folded = F.transform(column, lambda v: F.trim(text.casefold(v)))
        return events.select(*fields, F.explode(F.array_distinct(folded)).alias("term")).filter("term <> ''")

    entries = watchlist.filter("enabled").filter(F.upper(F.trim("tier")).isin(*tiers))
    symbol = F.trim(text.casefold(F.coalesce("symbol", F.lit(""))))
    by_symbol = terms("affected_tickers").join(
        entries.filter(symbol != "").select("watch_id", symbol.alias("term")), "term")
    names = watch_terms(entries.filter(symbol == ""), with_symbol=False).select("watch_id", "term")
    by_name = terms("affected_entities").join(names, "term")
    matched = by_symbol.unionByName(by_name).drop("term").distinct()
    totals = matched.groupBy("watch_id").agg(F.count(F.lit(1)).alias("total"))
    top = top_per_key(matched, ["watch_id"], (
        F.col("event_time").desc(), F.col("final_score").desc(), F.col("last_updated_at").desc(),
        F.col("created_at").desc(), F.col("cluster_id")), per_entry, rank="position")
    return top.join(totals, "watch_id").select("watch_id", "position", "cluster_id", "event_time", "final_score", "total")
