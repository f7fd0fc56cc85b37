"""Dimension tables: symbol resolution, watchlist import, source upsert and de-duplication."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.plans.intervals import interval
from newsloom.plans.keys import top_per_key
from newsloom.plans.lineage import cut_lineage
from newsloom.sources.quotes import GLOBAL_ASSET_CLASSES, PERP_PREFIX

# Fixed value: how long a stored resolution is trusted.
RESOLUTION_TTL = timedelta(hours=24)
SOURCE_FIELDS = ("url", "region", "category", "source_type", "language", "source_score", "polling_interval_s", "enabled")


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def resolve_symbols(watchlist: DataFrame, stored: DataFrame, universe: DataFrame, symbol_map: DataFrame, now: Column,
                    crypto_provider: str = "binance", crypto_fallback: str | None = None,
                    global_provider: str = "hyperliquid") -> DataFrame:
    """Provider symbol per enabled entry; a fresh matching resolution is reused, others are derived.

    ``universe`` is ``(pos, instrument)``; ``symbol_map`` is ``(map_symbol, mapped)``. Instruments
    meet symbols on their upper-case name, with and without the perpetuals prefix.
    """
    entries = watchlist.filter("enabled").select(
        "watch_id", F.upper(_blank_to_null(F.col("symbol"))).alias("symbol"),
        F.lower(_blank_to_null(F.col("region"))).alias("region"), F.lower(_blank_to_null(F.col("asset_class"))).alias("asset_class"))
    old = stored.select("watch_id", *[F.col(c).alias(f"old_{c}") for c in (
        "symbol", "region", "asset_class", "provider", "provider_symbol", "status", "reason", "resolved_at")])
    upper = F.upper("instrument")
    short = F.when(F.startswith(upper, F.lit(PERP_PREFIX)), F.substr(upper, F.lit(len(PERP_PREFIX) + 1)))
    aliases = universe.select("pos", "instrument", F.explode(F.array_compact(F.array(upper, short))).alias("symbol"))
    listed = top_per_key(aliases, ["symbol"], (F.col("pos"),)).select("symbol", "instrument")
    mapped = symbol_map.select(F.upper("map_symbol").alias("symbol"), "mapped")
    coins = symbol_map.select(F.upper("map_symbol").alias("_coin"), F.col("mapped").alias("coin_id"))
    rows = (entries.join(old, "watch_id", "left").join(listed, "symbol", "left").join(mapped, "symbol", "left")
            .withColumn("_coin", F.regexp_replace("symbol", "USDT$", "")).join(coins, "_coin", "left").drop("_coin"))
    same = (F.col("symbol").eqNullSafe(F.col("old_symbol")) & F.col("region").eqNullSafe(F.col("old_region"))
            & F.col("asset_class").eqNullSafe(F.col("old_asset_class")))
    reuse = F.coalesce(same & (F.col("old_status") == "resolved") & (F.col("old_resolved_at") > now - interval(RESOLUTION_TTL)), F.lit(False))
    symbol = F.col("symbol")
    none = symbol.isNull()
    vietnam = F.coalesce((F.col("region") == "vietnam") | (F.col("asset_class") == "vietnam_equity"), F.lit(False)) | (
        F.col("region").eqNullSafe("vietnam") | F.col("asset_class").eqNullSafe("vietnam_equity"))
    crypto = F.col("region").eqNullSafe("crypto") | F.col("asset_class").eqNullSafe("crypto")
    world = F.col("asset_class").isin(*GLOBAL_ASSET_CLASSES) & F.col("region").isin("global", "us")
    world = F.coalesce(world, F.lit(False))
    perp = F.when(F.startswith(F.upper("mapped"), F.lit(PERP_PREFIX)), F.col("mapped"))
    instrument = F.coalesce(perp, F.col("instrument"))
    kind = F.when(none, "none").when(vietnam, "vietnam").when(crypto, "crypto").when(world, "world").otherwise("other")
    rows = rows.select("*", reuse.alias("reused"), kind.alias("_kind"), instrument.alias("_instrument"))
    k = F.col("_kind")
    if crypto_provider == "binance":
        coin, coin_reason = F.when(F.endswith(symbol, F.lit("USDT")), symbol).otherwise(F.concat(symbol, F.lit("USDT"))), F.lit(None)
    elif crypto_provider == "coingecko":
        coin, coin_reason = F.col("coin_id"), F.concat(F.lit("CoinGecko coin id is not configured for "), symbol)
    else:
        coin, coin_reason = F.lit(None).cast("string"), F.lit(f"Unsupported crypto market data provider: {crypto_provider}")
    known = global_provider == "hyperliquid"
    quoted = F.col("_instrument") if known else F.lit(None).cast("string")
    world_reason = (F.concat(F.lit("No Hyperliquid instrument matched "), symbol) if known
                    else F.lit(f"Unsupported global market data provider: {global_provider}"))
    provider_symbol = F.when(k == "vietnam", F.lower("symbol")).when(k == "crypto", coin).when(k == "world", quoted)
    provider = (F.when(k == "vietnam", "vietnam_market").when(k == "crypto", crypto_provider)
                .when(k == "world", global_provider))
    status = F.when(k == "none", "skipped").when(provider_symbol.isNotNull(), "resolved").otherwise("unresolved")
    reason = (F.when(k == "none", "watchlist entry has no symbol").when(provider_symbol.isNotNull(), F.lit(None))
              .when(k == "crypto", coin_reason).when(k == "world", world_reason).otherwise(F.concat(
                  F.lit("No resolver for region="), F.coalesce("region", F.lit("unknown")), F.lit(" asset_class="),
                  F.coalesce("asset_class", F.lit("unknown")))))

    def keep(column: str, fresh: Column) -> Column:
        return F.when(F.col("reused"), F.col(f"old_{column}")).otherwise(fresh).alias(column)

    fallback = F.when(k == "crypto", F.lit(crypto_fallback)).alias("fallback_provider")
    return rows.select("watch_id", "symbol", "region", "asset_class", keep("provider", provider),
                       keep("provider_symbol", provider_symbol), keep("status", status), keep("reason", reason), fallback, "reused")


def import_watchlist(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome of every file row: imported, incomplete, or skipped by symbol or name.

    ``rows`` carry ``idx`` (file order). A row is skipped when its symbol, else its name, belongs
    to an existing entry or to an earlier *imported* row; a skipped row claims nothing. Rows are
    settled in rounds: a row that comes first among the open rows of both its keys is imported,
    then rows sharing a key with it are closed.
    """
    tidy = rows.filter(F.trim(F.coalesce("name", F.lit(""))) != "").select(
        "idx", F.upper(_blank_to_null(F.col("symbol"))).alias("s"), F.lower(F.trim("name")).alias("n"),
        (_blank_to_null(F.col("region")).isNotNull() & _blank_to_null(F.col("asset_class")).isNotNull()).alias("whole"))
    symbols = existing.select(F.upper("symbol").alias("s")).filter("s IS NOT NULL").distinct()
    names = existing.select(F.lower("name").alias("n")).distinct()
    start = tidy.filter("whole").join(symbols, "s", "left_anti").join(names, "n", "left_anti").select("idx", "s", "n")
    pending, imported = cut_lineage(start), None
    while True:  # every round settles at least the first open row
        by_symbol = pending.filter("s IS NOT NULL").groupBy("s").agg(F.min("idx").alias("_fs"))
        by_name = pending.groupBy("n").agg(F.min("idx").alias("_fn"))
        rated = pending.join(by_symbol, "s", "left").join(by_name, "n")
        wins = cut_lineage(rated.filter((F.col("idx") == F.coalesce("_fs", "idx")) & (F.col("idx") == F.col("_fn"))).select("idx", "s", "n"))
        imported = wins if imported is None else cut_lineage(imported.unionByName(wins))
        pending = cut_lineage(pending.join(wins.select("idx"), "idx", "left_anti").join(
            wins.select("s").filter("s IS NOT NULL"), "s", "left_anti").join(wins.select("n"), "n", "left_anti"))
        if pending.isEmpty():
            break
    # per key the earliest imported row; -1 marks an entry that existed before the import
    claims_s = symbols.withColumn("idx", F.lit(-1).cast("bigint")).unionByName(
        imported.filter("s IS NOT NULL").select("s", F.col("idx").cast("bigint"))).groupBy("s").agg(F.min("idx").alias("_cs"))
    claims_n = names.withColumn("idx", F.lit(-1).cast("bigint")).unionByName(
        imported.select("n", F.col("idx").cast("bigint"))).groupBy("n").agg(F.min("idx").alias("_cn"))
    judged = tidy.join(claims_s, "s", "left").join(claims_n, "n", "left").join(
        imported.select("idx", F.lit(True).alias("_in")), "idx", "left")
    return judged.select("idx", F.when(~F.col("whole"), "skipped_incomplete").when(F.col("_in"), "imported").when(
        F.col("_cs") < F.col("idx"), "skipped_symbol").otherwise("skipped_name").alias("outcome"))


def upsert_sources(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sources after an upsert by name, with ``change``: same, updated, inserted, url_conflict.

    ``incoming`` has unique names; a new name whose URL is taken is left out as a conflict.
    """
    theirs = incoming.select("name", F.struct(*SOURCE_FIELDS).alias("new"))
    mine = current.select("name", "source_id", F.struct(*SOURCE_FIELDS).alias("old"))
    joined = mine.join(theirs, "name", "full_outer")
    taken = current.select(F.col("url").alias("_url")).distinct().withColumn("_taken", F.lit(True))
    fresh = F.col("old").isNull()
    rows = joined.withColumn("_url", F.when(fresh, F.col("new.url"))).join(taken, "_url", "left")
    first = top_per_key(rows.filter(fresh & F.col("_taken").isNull()), ["_url"], (F.col("name"),)).select(
        "name", F.lit(True).alias("_first"))
    rows = rows.join(first, "name", "left")
    change = (F.when(~fresh & (F.col("new").isNull() | F.col("old").eqNullSafe(F.col("new"))), "same").when(~fresh, "updated")
              .when(F.col("_first"), "inserted").otherwise("url_conflict"))
    value = F.coalesce("new", "old")
    return rows.select("name", "source_id", change.alias("change"), *[value[c].alias(c) for c in SOURCE_FIELDS])


def union_sources(*origins: tuple[str, DataFrame]) -> DataFrame:
    """Sources of several origins, one per page address; the first origin wins, then the name."""
    rows = None
    for rank, (origin, df) in enumerate(origins):
        part = df.select("name", "url", "source_type", F.lit(origin).alias("origin"), F.lit(rank).alias("_rank")).filter(
            (F.trim(F.coalesce("name", F.lit(""))) != "") & (F.trim(F.coalesce("url", F.lit(""))) != ""))
        rows = part if rows is None else rows.unionByName(part)
    keyed = rows.withColumn("page", text.page_key(F.col("url")))
    return top_per_key(keyed, ["page"], (F.col("_rank"), F.col("name"), F.col("url"))).drop("_rank")
