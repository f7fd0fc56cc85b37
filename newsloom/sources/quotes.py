"""Price payloads of several providers to one move schema, and the routing between providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.keys import top_per_key

# Fixed values of the provider formats and routes.
QUOTE_SUFFIXES = ("USDT", "USDC", "BUSD", "USD")
PERP_PREFIX = "XYZ:"
GLOBAL_ASSET_CLASSES = ("equity", "us_equity", "etf", "index", "commodity", "fx", "rates")
TICKER = "struct<symbol:string,priceChangePercent:string,closeTime:bigint>"
MARKETS = "array<struct<price_change_percentage_24h:double>>"
STOCKS = "struct<stocks:array<struct<ticker:string,exchange:string,price_change_24h:double,price_change_1w:double>>>"
CHART = ("struct<chart:struct<error:string,result:array<struct<meta:struct<exchangeName:string>,timestamp:array<bigint>,"
         "indicators:struct<quote:array<struct<close:array<double>,volume:array<double>>>>>>>>")
UNIVERSE = "struct<universe:array<struct<name:string,isDelisted:boolean>>>"
CONTEXTS = "array<struct<markPx:string,prevDayPx:string,dayNtlVlm:string>>"


def base_symbol(symbol: Column) -> Column:
    """Upper-case ticker without the first quote suffix that fits."""
    out = F.upper(symbol)
    stripped = out
    for suffix in reversed(QUOTE_SUFFIXES):
        fits = F.endswith(out, F.lit(suffix)) & (F.length(out) > len(suffix))
        stripped = F.when(fits, F.substr(out, F.lit(1), F.length(out) - len(suffix))).otherwise(stripped)
    return stripped


def from_epoch(seconds: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def pct_change(first: Column, last: Column) -> Column:
    """Percent change rounded half-even to two places."""
    return F.bround((last - first) / first * 100, 2)


def _move(symbol: Column, asset_class: Column, exchange: Column, ts: Column, win: Column, price: Column,
          volume: Column | None = None) -> list[Column]:
    return [F.col("payload_id"), symbol.alias("symbol"), asset_class.alias("asset_class"), exchange.alias("exchange"), ts.alias("ts"),
            win.alias("win"), price.alias("price_change_pct"),
            (F.lit(None).cast("double") if volume is None else volume).alias("volume_change_pct")]


def ticker_moves(payloads: DataFrame) -> DataFrame:
    p = payloads.withColumn("p", F.from_json("body", TICKER)).filter(F.col("p.symbol").isNotNull())
    ts = F.coalesce(from_epoch(F.col("p.closeTime") / 1000), F.col("received_at"))
    price = F.coalesce(F.col("p.priceChangePercent").try_cast("double"), F.lit(0.0))
    return p.select(*_move(base_symbol(F.col("p.symbol")), F.lit("crypto"), F.lit("BINANCE"), ts, F.col("win"), price))


def market_list_moves(payloads: DataFrame) -> DataFrame:
    p = payloads.withColumn("p", F.from_json("body", MARKETS)).filter(F.size("p") > 0)
    price = F.coalesce(F.col("p")[0]["price_change_percentage_24h"], F.lit(0.0))
    return p.select(*_move(F.upper("symbol"), F.lit("crypto"), F.lit("COINGECKO"), F.col("received_at"), F.col("win"), price))


def stock_list_moves(payloads: DataFrame) -> DataFrame:
    """A daily and a weekly row per stock that has the figure."""
    s = payloads.select("payload_id", "received_at", F.explode(F.from_json("body", STOCKS).getField("stocks")).alias("s"))
    rows = s.select("payload_id", "received_at", "s.ticker", "s.exchange", F.explode(F.array(
        F.struct(F.lit("1d").alias("win"), F.col("s.price_change_24h").alias("pct")),
        F.struct(F.lit("1w").alias("win"), F.col("s.price_change_1w").alias("pct")))).alias("m"))
    return rows.filter(F.col("m.pct").isNotNull() & F.col("ticker").isNotNull()).select(
        *_move(F.upper("ticker"), F.lit("equity"), F.nullif("exchange", F.lit("")), F.col("received_at"), F.col("m.win"), F.col("m.pct")))


def chart_moves(payloads: DataFrame) -> DataFrame:
    """First against last close and volume of a chart with at least two points."""
    c = payloads.withColumn("c", F.from_json("body", CHART).getField("chart")).filter(
        F.coalesce("c.error", F.lit("")).eqNullSafe("")).withColumn("r", F.try_element_at("c.result", F.lit(1)))
    q = F.try_element_at(F.col("r.indicators.quote"), F.lit(1))
    series = c.select(
        "payload_id", "symbol", "asset_class", "win", "r", F.filter(q["close"], lambda v: v.isNotNull()).alias("close"),
        F.coalesce(F.filter(q["volume"], lambda v: v.isNotNull()), F.array().cast("array<double>")).alias("volume")).filter(
        (F.size("r.timestamp") >= 2) & (F.size("close") >= 2))

    def ends(name: str) -> tuple[Column, Column]:
        return F.try_element_at(name, F.lit(1)), F.try_element_at(name, F.lit(-1))

    (c0, c1), (v0, v1) = ends("close"), ends("volume")
    return series.select(*_move(
        F.upper("symbol"), F.col("asset_class"), F.coalesce(F.nullif("r.meta.exchangeName", F.lit("")), F.lit("YAHOO")),
        from_epoch(F.try_element_at("r.timestamp", F.lit(-1))), F.col("win"), pct_change(c0, c1),
        F.when(v0 != 0, pct_change(v0, v1))))


def normalize_quotes(payloads: DataFrame) -> DataFrame:
    """Moves of all payloads; ``kind`` says which shape a payload has."""
    shapes = {"ticker": ticker_moves, "markets": market_list_moves, "stocks": stock_list_moves, "chart": chart_moves}
    parts = [parse(payloads.filter(F.col("kind") == kind)) for kind, parse in shapes.items()]
    return reduce(DataFrame.unionByName, parts)


def gated_quotes(payloads: DataFrame, requests: DataFrame, window: str, min_notional: float,
                 provider: str = "Hyperliquid") -> DataFrame:
    """Requested instruments priced from universe and context lists, with an outcome per request.

    ``payloads``: ``payload_id, universe, contexts`` JSON; ``requests``: ``payload_id, coin, symbol,
    asset_class``. Outcome is move, skipped (volume gate) or unavailable, always with its reason.
    """
    zipped = payloads.select("payload_id", F.posexplode(F.arrays_zip(
        F.from_json("universe", UNIVERSE).getField("universe").alias("i"), F.from_json("contexts", CONTEXTS).alias("x"))).alias("pos", "z"))
    named = zipped.filter(F.col("z.i").isNotNull() & F.col("z.x").isNotNull() & (F.coalesce("z.i.name", F.lit("")) != ""))
    quotes = top_per_key(named.select("payload_id", "pos", F.upper("z.i.name").alias("_coin"), "z.i.isDelisted", "z.x"),
                         ["payload_id", "_coin"], (F.col("pos").desc(),))
    rows = requests.withColumn("_coin", F.upper("coin")).join(quotes, ["payload_id", "_coin"], "left")
    mark, prev = F.col("x.markPx").try_cast("double"), F.col("x.prevDayPx").try_cast("double")
    volume = F.when(F.coalesce("x.dayNtlVlm", F.lit("")) == "", F.lit(0.0)).otherwise(F.col("x.dayNtlVlm").try_cast("double"))
    rows = rows.select("payload_id", "coin", "symbol", "asset_class", F.col("x").isNotNull().alias("found"), "isDelisted",
                       mark.alias("mark"), prev.alias("prev"), volume.alias("volume"))
    name = F.concat(F.lit(f"{provider} instrument "), F.col("coin"))
    bad = F.col("mark").isNull() | F.col("prev").isNull() | F.col("volume").isNull()
    reason = (
        F.when(~F.col("found"), F.concat(name, F.lit(" not found")))
        .when(F.coalesce("isDelisted", F.lit(False)), F.concat(name, F.lit(" is delisted")))
        .when(bad, F.concat(name, F.lit(" has invalid prices")))
        .when(F.col("prev") == 0, F.concat(name, F.lit(" prevDayPx is zero")))
        .when(F.col("volume") < min_notional, F.concat(name, F.lit(" dayNtlVlm "), F.col("volume"), F.lit(f" below {min_notional:g}"))))
    gate = F.coalesce(F.col("volume") < min_notional, F.lit(False)) & F.contains(reason, F.lit(" dayNtlVlm "))
    rated = rows.withColumn("reason", reason).withColumn(
        "outcome", F.when(F.col("reason").isNull(), "move").when(gate, "skipped").otherwise("unavailable"))
    return rated.select(
        "payload_id", F.upper("symbol").alias("symbol"), F.lower(F.coalesce(F.nullif("asset_class", F.lit("")), F.lit("equity"))).alias("asset_class"),
        F.lit(window).alias("win"), "outcome", "reason",
        F.when(F.col("outcome") == "move", pct_change(F.col("prev"), F.col("mark"))).alias("price_change_pct"))


def route_symbols(requests: DataFrame, symbol_map: DataFrame) -> DataFrame:
    """Provider family per requested symbol; ``symbol_map`` is ``(map_symbol, mapped)``."""
    asset, region = F.lower(F.coalesce("asset_class", F.lit(""))), F.lower(F.coalesce("region", F.lit("")))
    mapping = symbol_map.select(F.upper("map_symbol").alias("_s"), "mapped")
    rows = requests.withColumn("_s", F.upper("symbol")).join(mapping, "_s", "left").drop("_s")
    perp = F.coalesce("mapped", F.lit("")) != ""
    perp = perp & (F.startswith(F.upper("mapped"), F.lit(PERP_PREFIX)) | asset.isin(*GLOBAL_ASSET_CLASSES) | region.isin("global", "us"))
    return rows.withColumn("route", F.when((asset == "crypto") | (region == "crypto"), "crypto")
                           .when((asset == "vietnam_equity") | (region == "vietnam"), "vietnam_market")
                           .when(perp, "hyperliquid").otherwise("unrouted"))


def route_resolved(requests: DataFrame) -> DataFrame:
    """Route of resolved requests; skipped and unresolved ones carry their reason."""
    symbol, provider = F.upper("symbol"), F.lower(F.coalesce("provider", F.lit("")))
    resolved = (F.col("status") == "resolved") & (F.coalesce("provider_symbol", F.lit("")) != "")
    given = F.nullif("reason", F.lit(""))
    route = (F.when(F.col("status") == "skipped", "skipped").when(~resolved, "unavailable")
             .when(provider.isin("binance", "coingecko"), "crypto").when(provider == "hyperliquid", "hyperliquid")
             .when(provider == "vietnam_market", "vietnam_market").otherwise("unavailable"))
    note = (F.when(F.col("status") == "skipped", F.coalesce(given, F.lit("Market data resolution skipped")))
            .when(~resolved, F.coalesce(given, F.concat(F.lit("No market data resolution for "), symbol)))
            .when(route == "unavailable", F.concat(F.lit("Unsupported resolved market data provider: "),
                                                   F.coalesce(F.nullif(provider, F.lit("")), F.lit("unknown")))))
    return requests.withColumn("route", route).withColumn("route_reason", note)


def merge_fallbacks(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First valid provider row per symbol, and the state of every provider.

    ``attempts``: ``symbol, provider, priority, price_change_pct`` (null when the provider failed).
    A provider is failed when it was some symbol's last resort and failed, degraded when another
    provider had to step in.
    """
    valid = F.col("price_change_pct").isNotNull()
    chosen = top_per_key(attempts.filter(valid), ["symbol"], (F.col("priority"),))
    per = attempts.groupBy("symbol").agg(F.max("priority").alias("_last"), F.min(F.when(valid, F.col("priority"))).alias("_chosen"))
    tried = attempts.join(per, "symbol").filter(~valid & (F.col("_chosen").isNull() | (F.col("priority") < F.col("_chosen"))))
    failed = F.max((F.col("priority") == F.col("_last")).cast("int")) == 1
    degraded = F.max((F.col("priority") < F.col("_last")).cast("int")) == 1
    states = tried.groupBy("provider").agg(failed.alias("failed"), degraded.alias("degraded"), F.count(F.lit(1)).alias("failures"))
    return chosen, states

