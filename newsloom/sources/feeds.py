"""Feed documents, discovered links and raw-item ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text

ITEM_FIELDS = ("title", "link", "description", "summary", "pubDate", "published", "updated", "dc:date", "guid", "id")
ITEMS = "array<struct<" + ",".join(f"`{f}`:string" for f in ITEM_FIELDS) + ">>"
RSS_SCHEMA = f"channel struct<item:{ITEMS}>, item {ITEMS}"  # RDF feeds hold their items beside the channel
ATOM_SCHEMA = ("entry array<struct<title:string,link:array<struct<_href:string,_rel:string,_VALUE:string>>,summary:string,"
               "published:string,updated:string,`dc:date`:string,id:string>>")
EMPTY_DC = r"(?i)<dc:description\s*/>|<dc:description\s*>\s*</dc:description\s*>"


def clean_feed_xml(body: Column) -> Column:
    """Drop empty dc:description elements and a wrong utf-16 label on text that is already decoded."""
    relabelled = F.regexp_replace(body, r"(?i)^(\s*<\?xml[^>]+encoding=)[\"']utf-16[\"']", '$1"utf-8"')
    return F.regexp_replace(relabelled, EMPTY_DC, "")


def _feed_rows(items: DataFrame, keys: list[str]) -> DataFrame:
    title, url = text.clean_feed_text(F.col("title")), F.trim(F.coalesce("link", F.lit("")))
    return items.select(
        *keys, title.alias("title"), url.alias("url"), text.clean_feed_text(F.col("summary")).alias("description"),
        F.coalesce(text.parse_datetime(F.col("published")), text.parse_datetime(F.col("updated"))).alias("published_at"),
        "guid").filter((F.col("title") != "") & (F.col("url") != ""))


def _entry_link(links: Column) -> Column:
    """The article's own link: the first that is an alternate (no ``rel`` means one), else the first at all."""
    own = F.filter(links, lambda k: F.coalesce(F.lower(k["_rel"]), F.lit("alternate")) == "alternate")
    link = F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at(links, F.lit(1)))
    return F.coalesce(link["_href"], link["_VALUE"])


def parse_feeds(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Items of RSS, RDF and Atom documents held in a text column; other columns ride along."""
    keys = [c for c in feeds.columns if c != body]
    xml = clean_feed_xml(F.col(body))
    is_atom = xml.rlike(r"(?is)<feed[\s>]")
    nothing = F.array().cast(ITEMS)
    document = feeds.filter(~is_atom).select(*keys, F.from_xml(xml, RSS_SCHEMA).alias("d"))
    rss = document.select(*keys, F.explode(F.concat(
        F.coalesce("d.channel.item", nothing), F.coalesce("d.item", nothing))).alias("i")).select(
        *keys, "i.title", "i.link", F.coalesce("i.description", "i.summary").alias("summary"),
        F.coalesce("i.pubDate", "i.published").alias("published"), F.coalesce("i.updated", "i.dc:date").alias("updated"),
        F.coalesce("i.guid", "i.id").alias("guid"))
    atom = feeds.filter(is_atom).select(*keys, F.explode(F.from_xml(xml, ATOM_SCHEMA).getField("entry")).alias("i")).select(
        *keys, "i.title", _entry_link(F.col("i.link")).alias("link"), "i.summary", "i.published",
        F.coalesce("i.updated", "i.dc:date").alias("updated"), F.col("i.id").alias("guid"))
    return _feed_rows(rss.unionByName(atom), keys)


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files; Spark splits large files at the item tag."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(
        ", ".join(f"`{f}` string" for f in ITEM_FIELDS)).load(path)
    return _feed_rows(raw.select(
        "title", "link", F.coalesce("description", "summary").alias("summary"),
        F.coalesce("pubDate", "published").alias("published"), F.coalesce("updated", "`dc:date`").alias("updated"),
        F.coalesce("guid", "id").alias("guid")), [])


def aggregator_snippet(title: Column, description: Column) -> Column:
    """The description, blank when it only repeats the title or has fewer than two sentence ends."""
    def key(c: Column) -> Column:
        return F.regexp_replace(text.casefold(c), r"[^\p{L}\p{N}]+", "")

    ends = F.regexp_count(description, F.lit(r"[.!?](?=(?U)\s|$)"))
    return F.when((key(description) == key(title)) | (ends < 2), "").otherwise(description)


def unseen_links(found: DataFrame, raw: DataFrame, news: DataFrame) -> DataFrame:
    """Discovered ``(source_id, url)`` not yet known as a raw, news or canonical URL of the source."""
    known = (raw.select("source_id", "url").unionByName(news.select("source_id", "url"))
             .unionByName(news.select("source_id", F.col("canonical_url").alias("url")))).filter(F.col("url").isNotNull())
    return found.select("source_id", "url").distinct().join(known.distinct(), ["source_id", "url"], "left_anti")


def with_content_hash(items: DataFrame) -> DataFrame:
    whole = text.normalize_text(F.concat_ws(" ", "title", F.coalesce("description", F.lit("")), "url"))
    return items.withColumn("content_hash", text.folded_hash(whole))


def new_raw_items(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append: one per ``(source_id, content_hash)`` that is not stored yet."""
    key = ["source_id", "content_hash"]
    return items.dropDuplicates(key).join(stored.select(*key), key, "left_anti")
