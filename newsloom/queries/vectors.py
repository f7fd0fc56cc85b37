"""Embeddings and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import embedding
from newsloom.queries.base import query
from newsloom.queries.oracle_tables import fold, norm
from newsloom.sources.tables import Desk, wall

DIMS = 256
SINCE = "2024-01-02 00:00:00"
ATTACH, GRAY, PAIR = 0.30, 0.22, 0.33  # the inputs are random unit vectors: thresholds that leave rows to compare

TEXT_SQL = rf"""
texts AS (SELECT n.news_id, 'Title: ' || {norm('n.title')} || chr(10) || 'Snippet: ' || {norm("coalesce(n.snippet, '')")} || chr(10)
   || 'Source: ' || n.source_name || chr(10) || 'Entities: ' || (SELECT array_to_string(list_sort(list(DISTINCT e.name)), ', ')
      FROM news_entities e WHERE e.news_id = n.news_id) || chr(10) || 'Region: ' || n.region || chr(10)
   || 'Asset classes: ' || n.asset_class AS text FROM news n)"""


@query("d1_item_texts", f"WITH {TEXT_SQL} SELECT news_id, sha256(text) AS text_sha, sha256({fold(norm('text'))}) AS text_hash FROM texts")
def d1_items(desk: Desk) -> DataFrame:
    return embedding.item_texts(desk.news, desk.news_entities).select("news_id", F.sha2("text", 256).alias("text_sha"), "text_hash")


CLUSTER_TEXT_SQL = rf"""
ctexts AS (SELECT cluster_id, 'Title: ' || {norm('headline')} || chr(10) || 'Snippet: ' || chr(10) || 'Source: event_cluster' || chr(10)
   || 'Entities: ' || array_to_string(affected_entities, ', ') || chr(10) || 'Region: ' || array_to_string(regions, ',') || chr(10)
   || 'Asset classes: ' || array_to_string(asset_classes, ', ') AS text FROM clusters)"""


def cluster_texts(desk: Desk) -> DataFrame:
    return embedding.cluster_texts(desk.clusters.withColumn("summary", F.lit(None).cast("string")))


@query("d1_cluster_texts", f"WITH {CLUSTER_TEXT_SQL} SELECT cluster_id, text, sha256({fold(norm('text'))}) AS text_hash FROM ctexts")
def d1_clusters(desk: Desk) -> DataFrame:
    return cluster_texts(desk)


@query("d2_hashing_embedding", f"""
WITH w AS (SELECT news_id, sha256(unnest(string_split({fold(norm('content'))}, ' '))) AS h FROM news),
s AS (SELECT news_id, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % {DIMS} AS INT) AS idx,
        CAST(sum(CASE WHEN CAST('0x' || substr(h, 10, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS total FROM w GROUP BY 1, 2 HAVING total <> 0)
SELECT news_id, idx, round(total / sqrt(sum(total * total) OVER (PARTITION BY news_id)), 9) AS value FROM s""")
def d2(desk: Desk) -> DataFrame:
    sparse = embedding.hashing_embedding(desk.news.select("news_id", "content"), "news_id", "content", DIMS)
    return sparse.select("news_id", "idx", F.round("value", 9).alias("value"))


@query("d2_dense_embedding")
def d2_dense(desk: Desk) -> DataFrame:
    return embedding.dense_embedding(desk.news.select("news_id", "content"), "news_id", "content", DIMS)


@query("d3_pending_vectors", "SELECT news_id FROM news WHERE news_id % 10 <> 9 AND news_id NOT IN (SELECT news_id FROM news_vectors)")
def d3(desk: Desk) -> DataFrame:
    news = desk.news.withColumn("status", F.when(F.col("news_id") % 10 == 9, "ignored").otherwise("normalized"))
    return embedding.pending_items(news, desk.news_vectors).select("news_id")


@query("d3_vector_coverage", """
SELECT (SELECT count(*) FROM news) AS total, (SELECT count(*) FROM news_vectors) AS embedded,
  (SELECT count(DISTINCT provider) FROM news_vectors) AS providers, (SELECT count(DISTINCT model) FROM news_vectors) AS models,
  (SELECT count(*) FROM news_vectors) / (SELECT count(*) FROM news) * 100 AS coverage_pct""")
def d3_coverage(desk: Desk) -> DataFrame:
    return embedding.coverage(desk.news, desk.news_vectors, "news_id")


@query("d4_stale_vectors", f"""
WITH {CLUSTER_TEXT_SQL} SELECT cluster_id, sha256({fold(norm('text'))}) AS text_hash FROM ctexts WHERE cluster_id % 4 = 0""")
def d4(desk: Desk) -> DataFrame:
    now = cluster_texts(desk)
    old = now.withColumn("text_hash", F.when(F.col("cluster_id") % 4 == 0, F.lit("outdated")).otherwise(F.col("text_hash")))
    return embedding.stale_vectors(now, old, "cluster_id").select("cluster_id", "text_hash")


NEAREST_SQL = f"""
near AS (SELECT n.news_id, c.cluster_id, list_cosine_similarity(n.v, c.v) AS similarity,
    row_number() OVER (PARTITION BY n.news_id ORDER BY list_cosine_similarity(n.v, c.v) DESC, c.cluster_id) AS rank
  FROM news_vectors n CROSS JOIN cluster_vectors c JOIN clusters k USING (cluster_id) WHERE k.last_updated_at >= TIMESTAMP '{SINCE}' QUALIFY rank <= 20),
mine AS (SELECT n.news_id, n.region, n.asset_class, (SELECT list(DISTINCT lower(e.name)) FROM news_entities e WHERE e.news_id = n.news_id) AS ents FROM news n),
ctx AS (SELECT t.news_id, t.cluster_id, t.similarity, t.rank,
    (list_contains(k.regions, m.region) OR list_contains(k.regions, 'global') OR m.region = 'global')
      AND list_contains(k.asset_classes, m.asset_class) AS context,
    list_has_any(m.ents, list_transform(k.affected_entities, lambda e: lower(e))) AS shared
  FROM near t JOIN mine m USING (news_id) JOIN clusters k USING (cluster_id)),
judged AS (SELECT news_id, cluster_id, similarity, rank, similarity >= {ATTACH} AND context AND shared AS is_attachable,
    rank <= 3 AND similarity >= {GRAY} AND similarity < {ATTACH} AND context AS is_gray FROM ctx)"""


def nearest_clusters(desk: Desk) -> DataFrame:
    return embedding.cluster_candidates(desk.news_vectors, desk.cluster_vectors, desk.clusters, wall(SINCE))


def item_context(desk: Desk) -> DataFrame:
    names = desk.news_entities.groupBy("news_id").agg(F.collect_set("name").alias("entities"))
    return desk.news.select("news_id", "region", F.array("asset_class").alias("asset_classes")).join(names, "news_id", "left")


@query("d5_nearest_clusters", f"WITH {NEAREST_SQL} SELECT news_id, cluster_id, rank, round(similarity, 6) AS similarity FROM near")
def d5(desk: Desk) -> DataFrame:
    return nearest_clusters(desk).withColumn("similarity", F.round("similarity", 6))


def other_model(vectors: DataFrame, foreign: Column) -> DataFrame:
    """The vectors, some of them as a second model would give them: shorter."""
    return vectors.withColumn("model", F.when(foreign, "m0").otherwise(F.col("model"))).withColumn(
        "vector", F.when(foreign, F.slice("vector", 1, 8)).otherwise(F.col("vector"))).withColumn("dims", F.size("vector"))


IN_SPACE_SQL = NEAREST_SQL.replace(
    "FROM news_vectors n CROSS JOIN cluster_vectors c",
    "FROM (SELECT * FROM news_vectors WHERE news_id % 4 <> 0) n CROSS JOIN (SELECT * FROM cluster_vectors WHERE cluster_id % 3 <> 0) c")


@query("d5_nearest_in_space", f"WITH {IN_SPACE_SQL} SELECT news_id, cluster_id, rank, round(similarity, 6) AS similarity FROM near")
def d5_space(desk: Desk) -> DataFrame:
    found = embedding.cluster_candidates(
        other_model(desk.news_vectors, F.col("news_id") % 4 == 0), other_model(desk.cluster_vectors, F.col("cluster_id") % 3 == 0),
        desk.clusters, wall(SINCE), space={"provider": "local", "model": "m1"})
    return found.withColumn("similarity", F.round("similarity", 6))


PAIRS_SQL = f"""
pairs AS (SELECT a.news_id AS src, b.news_id AS dst, list_cosine_similarity(a.v, b.v) AS cosine FROM news_vectors a JOIN news_vectors b
   ON a.news_id < b.news_id AND list_cosine_similarity(a.v, b.v) >= {PAIR})"""


@query("d6_similar_items", f"WITH {PAIRS_SQL} SELECT src, dst, round(cosine, 6) AS cosine FROM pairs")
def d6(desk: Desk) -> DataFrame:
    from newsloom.plans.similarity import similar_pairs

    return similar_pairs(desk.news_vectors, "news_id", "vector", PAIR, folded=False).withColumn("cosine", F.round("cosine", 6))


def judged(desk: Desk) -> DataFrame:
    return embedding.judge_candidates(nearest_clusters(desk), item_context(desk), desk.clusters, attach_min=ATTACH, gray_min=GRAY)


@query("d7_attachable_clusters", f"WITH {NEAREST_SQL} SELECT news_id, cluster_id, rank, is_attachable FROM judged")
def d7(desk: Desk) -> DataFrame:
    return judged(desk).select("news_id", "cluster_id", "rank", "is_attachable")


@query("d8_gray_zone", f"WITH {NEAREST_SQL} SELECT news_id, cluster_id, rank FROM judged WHERE is_gray")
def d8(desk: Desk) -> DataFrame:
    return judged(desk).filter("is_gray").select("news_id", "cluster_id", "rank")


@query("d9_invalid_vectors", """
SELECT count(*) AS vectors, 0 AS missing, count(*) FILTER (news_id % 20 = 0) AS empty, count(*) FILTER (news_id % 20 = 1) AS wrong_dims FROM news_vectors""")
def d9(desk: Desk) -> DataFrame:
    kind = F.col("news_id") % 20
    broken = F.when(kind == 0, F.array().cast("array<float>")).when(kind == 1, F.slice("vector", 2, 64)).otherwise(F.col("vector"))
    return embedding.invalid_vectors(desk.news_vectors.withColumn("vector", broken), 64)
