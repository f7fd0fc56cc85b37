"""Event clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import clustering, embedding, entities, retention, same_event
from newsloom.plans.components import connected_components
from newsloom.plans.keys import number_rows
from newsloom.plans.lineage import cut_lineage, cut_sized
from newsloom.plans.similarity import similar_pairs
from newsloom.queries.base import query
from newsloom.queries.entities import mention_terms
from newsloom.queries.market import TIERS, decision_sql, reviews, score_sql
from newsloom.queries.oracle_tables import fold, sql_list
from newsloom.queries.vectors import NEAREST_SQL, PAIR, PAIRS_SQL, item_context, judged
from newsloom.sources.tables import Desk, wall

SUFFIX = text.SUFFIX_PATTERN.replace("'", "''")
TOKENS_SQL = rf"""
clean AS (SELECT news_id, trim(regexp_replace(title, '(?i){SUFFIX}', '')) AS clean_title FROM news),
tokens AS (SELECT news_id, list_sort(list_distinct(list_filter(regexp_extract_all({fold('clean_title')}, '[\p{{L}}\p{{N}}]+'),
    lambda w: length(w) > 3 AND NOT list_contains({sql_list(text.TITLE_STOPWORDS)}, w)))) AS toks FROM clean)"""


@query("e1_title_tokens", f"WITH {TOKENS_SQL} SELECT news_id, clean_title, array_to_string(toks, ' ') AS tokens FROM clean JOIN tokens USING (news_id)")
def e1(desk: Desk) -> DataFrame:
    title = F.col("title")
    return desk.news.select("news_id", text.clean_title(title).alias("clean_title"),
                            F.array_join(text.title_tokens(title), " ").alias("tokens"))


def candidates(desk: Desk, newest_first: bool = True) -> DataFrame:
    """Numbered item candidates with match sets."""
    sets = entities.item_candidates(desk.news, desk.news_entities, desk.watchlist)
    tiers = entities.tier_for(mention_terms(desk.news_entities), desk.watchlist, "news_id").withColumnRenamed("tier", "watch_tier")
    at, key = F.col("at"), F.col("news_id")
    order = (at.desc(), key.desc()) if newest_first else (at, key)
    # only ids and times are numbered; the wide columns join the numbers afterwards
    numbered = number_rows(desk.news.select("news_id", desk.effective_time.alias("at")), order, "seq")
    rows = desk.news.select(
        "news_id", "title", "source_score", "region", F.array("asset_class").alias("asset_classes")).join(
        numbered, "news_id").join(sets, "news_id").join(tiers, "news_id", "left")
    return cut_sized(same_event.with_match_sets(rows))


BLOCK_SQL = f"""{TOKENS_SQL},
sym AS (SELECT e.news_id, lower(e.name) AS ent, lower(e.ticker) AS tic, lower(w.symbol) AS sy FROM news_entities e
   LEFT JOIN watchlist w ON w.enabled AND lower(w.name) = lower(e.name)),
keyed AS (SELECT DISTINCT news_id, key, strong FROM (
   SELECT news_id, ent AS key, TRUE AS strong FROM sym WHERE NOT list_contains({sql_list(text.PUBLISHER_ENTITIES + text.BROAD_ENTITIES)}, ent)
   UNION ALL SELECT news_id, tic, TRUE FROM sym WHERE tic IS NOT NULL
   UNION ALL SELECT news_id, sy, TRUE FROM sym WHERE sy IS NOT NULL UNION ALL SELECT news_id, unnest(toks), FALSE FROM tokens)),
timed AS (SELECT k.*, n.eff FROM keyed k JOIN news n USING (news_id)),
pairs AS (SELECT x.news_id AS src, y.news_id AS dst FROM timed x JOIN timed y ON y.key = x.key AND y.strong = x.strong
   AND (y.eff < x.eff OR (y.eff = x.eff AND y.news_id < x.news_id)) AND x.eff - y.eff <= INTERVAL 7 DAY
   GROUP BY 1, 2 HAVING bool_or(x.strong) OR count(*) >= 2)"""


@query("e2_candidate_pairs", f"WITH {BLOCK_SQL} SELECT * FROM pairs")
def e2(desk: Desk) -> DataFrame:
    return same_event.candidate_pairs(candidates(desk))


@query("e2_candidate_components", f"""
WITH RECURSIVE {BLOCK_SQL}, edges AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs),
walk(node, component) AS (SELECT src, src FROM (SELECT DISTINCT src FROM edges) UNION
  SELECT e.dst, min(w.component) FROM walk w JOIN edges e ON e.src = w.node GROUP BY e.dst)
SELECT node, min(component) AS component FROM walk GROUP BY 1""")
def e2_components(desk: Desk) -> DataFrame:
    return connected_components(same_event.candidate_pairs(candidates(desk)))


@query("e3_title_similarity")
def e3(desk: Desk) -> DataFrame:
    rows = candidates(desk)
    rated = same_event.classify_pairs(same_event.candidate_pairs(rows), rows)
    return rated.select("src", "dst", F.bround("similarity", 4).alias("similarity"))


@query("e4_same_event_pairs")
def e4(desk: Desk) -> DataFrame:
    rows = candidates(desk)
    judged_pairs = same_event.judge_pairs(same_event.candidate_pairs(rows), rows)
    return judged_pairs.select("src", "dst", "shared_tokens", "shared_entities", "shared_tickers", "context", "kind", "reason")


def ladder_sql(s: float) -> str:
    """The rules of a pair at one similarity; between its thresholds they do not change."""
    return f"""CASE WHEN shared_tickers > 0 AND context AND ({s} >= 0.55 OR ({s} >= 0.38 AND (shared_entities > 0 OR shared_tokens >= 2)))
      THEN 'strong_same_event/ticker_overlap_with_title_support'
    WHEN {s} >= 0.45 AND shared_tokens >= 2 AND shared_entities = 0 AND shared_tickers = 0 AND shared_tokens < 3 THEN 'ambiguous/title_topic_overlap_requires_arbitration'
    WHEN {s} >= 0.45 AND shared_tokens >= 2 THEN 'strong_same_event/strong_title_topic_overlap'
    WHEN context AND shared_entities > 0 AND ({s} >= 0.45 OR shared_tokens > 0) THEN 'strong_same_event/specific_entity_overlap_with_title_support'
    WHEN context AND shared_entities > 0 THEN 'ambiguous/specific_entity_overlap_without_title_support'
    WHEN context AND shared_broad > 0 THEN 'ambiguous/weak_entity_overlap_requires_arbitration' ELSE 'reject/insufficient_same_event_signal' END"""


LEVELS = {"below_038": 0.0, "from_038": 0.38, "from_045": 0.45, "from_055": 0.55}


@query("e4_rules_by_similarity", f"""
WITH {BLOCK_SQL},
names AS (SELECT news_id, list(DISTINCT ent) FILTER (NOT list_contains({sql_list(text.PUBLISHER_ENTITIES + text.BROAD_ENTITIES)}, ent)) AS specific,
   list(DISTINCT ent) FILTER (list_contains({sql_list(text.BROAD_ENTITIES)}, ent)) AS broad FROM sym GROUP BY 1),
codes AS (SELECT news_id, list(DISTINCT c) AS codes FROM (SELECT news_id, tic AS c FROM sym UNION ALL SELECT news_id, sy FROM sym) WHERE c IS NOT NULL GROUP BY 1),
side AS (SELECT n.news_id, n.asset_class, n.region, t.toks, coalesce(s.specific, []) AS specific, coalesce(s.broad, []) AS broad, coalesce(c.codes, []) AS codes
   FROM news n JOIN tokens t USING (news_id) LEFT JOIN names s USING (news_id) LEFT JOIN codes c USING (news_id)),
signals AS (SELECT p.src, p.dst, CAST(len(list_intersect(a.toks, b.toks)) AS INT) AS shared_tokens, CAST(len(list_intersect(a.specific, b.specific)) AS INT) AS shared_entities,
   CAST(len(list_intersect(a.codes, b.codes)) AS INT) AS shared_tickers, CAST(len(list_intersect(a.broad, b.broad)) AS INT) AS shared_broad,
   (a.asset_class = b.asset_class AND a.asset_class <> 'global_macro') OR (a.region = b.region AND a.region <> 'global') AS context
  FROM pairs p JOIN side a ON a.news_id = p.src JOIN side b ON b.news_id = p.dst)
SELECT *, {", ".join(f"{ladder_sql(s)} AS {name}" for name, s in LEVELS.items())} FROM signals""")
def e4_rules(desk: Desk) -> DataFrame:
    """The signals of every pair, and what the rules say at each level of similarity."""
    rows = candidates(desk)
    signals = same_event.pair_signals(same_event.candidate_pairs(rows), rows).drop("title", "seed_title")
    return signals.select("*", *[F.concat_ws("/", *same_event.ruled(F.lit(s))).alias(name) for name, s in LEVELS.items()])


@query("e5_greedy_drafts")
def e5(desk: Desk) -> DataFrame:
    return same_event.greedy_drafts(candidates(desk))


@query("e6_cluster_summary", """
SELECT l.cluster_id, arg_max(n.title, (n.eff, n.news_id)) AS headline, max(n.fetched_at) AS last_updated_at,
  array_to_string(list_sort(list(DISTINCT n.region)), ',') AS regions, array_to_string(list_sort(list(DISTINCT n.asset_class)), ',') AS asset_classes,
  CAST(count(*) AS INT) AS source_count, CAST(count(*) FILTER (n.source_score >= 75) AS INT) AS hq_source_count, max(n.source_score) AS top_source_score
FROM cluster_items l JOIN news n USING (news_id) GROUP BY 1""")
def e6(desk: Desk) -> DataFrame:
    made = clustering.summarize_clusters(desk.cluster_items, desk.news)
    return made.withColumn("regions", F.array_join("regions", ",")).withColumn("asset_classes", F.array_join("asset_classes", ","))


@query("e7_vector_merge", f"""
WITH RECURSIVE {PAIRS_SQL},
good AS (SELECT DISTINCT a.cluster_id AS x, b.cluster_id AS y FROM pairs p JOIN cluster_items a ON a.news_id = p.src
   JOIN cluster_items b ON b.news_id = p.dst JOIN clusters ca ON ca.cluster_id = a.cluster_id JOIN clusters cb ON cb.cluster_id = b.cluster_id
   WHERE a.cluster_id <> b.cluster_id AND list_has_any(ca.affected_entities, cb.affected_entities)
   AND ((len(list_intersect(ca.asset_classes, cb.asset_classes)) > 0 AND list_intersect(ca.asset_classes, cb.asset_classes) <> ['global_macro'])
        OR (ca.regions[1] = cb.regions[1] AND ca.regions[1] <> 'global'))),
edges AS (SELECT x, y FROM good UNION SELECT y, x FROM good),
walk(node, component) AS (SELECT cluster_id, cluster_id FROM clusters UNION
  SELECT e.y, w.component FROM walk w JOIN edges e ON e.x = w.node WHERE w.component < e.y),
parts AS (SELECT node, min(component) AS component FROM walk GROUP BY 1),
base AS (SELECT p.component, arg_max(c.cluster_id, (c.source_count, c.top_source_score, -c.cluster_id)) AS merged_id
  FROM parts p JOIN clusters c ON c.cluster_id = p.node GROUP BY 1)
SELECT p.node AS draft_id, b.merged_id FROM parts p JOIN base b USING (component)""")
def e7(desk: Desk) -> DataFrame:
    members = desk.cluster_items.select("news_id", F.col("cluster_id").alias("draft_id"))
    drafts = desk.clusters.select(F.col("cluster_id").alias("draft_id"), F.col("affected_entities").alias("primary_entities"),
                                  "asset_classes", "regions", "source_count", "top_source_score")
    vectors = clustering.with_drafts(desk.news_vectors, members, drafts)
    # all pairs are compared, copies too; written once, as the merge reads them twice
    edges = cut_lineage(similar_pairs(vectors, "news_id", "vector", PAIR, folded=False, about="draft", choose=clustering.MergingPairs))
    return clustering.merge_drafts(members, drafts, edges)


OUTLIER_SQL = f"""
pc AS (SELECT a.cluster_id, a.news_id AS x, b.news_id AS y, list_cosine_similarity(va.v, vb.v) AS c FROM cluster_items a JOIN cluster_items b
   ON a.cluster_id = b.cluster_id AND a.news_id <> b.news_id JOIN news_vectors va ON va.news_id = a.news_id JOIN news_vectors vb ON vb.news_id = b.news_id),
bestc AS (SELECT cluster_id, x AS news_id, max(c) AS best_cosine FROM pc GROUP BY 1, 2),
per AS (SELECT l.cluster_id, count(*) AS size, max(b.best_cosine) AS cluster_max FROM cluster_items l LEFT JOIN bestc b USING (cluster_id, news_id) GROUP BY 1),
outliers AS (SELECT l.cluster_id, l.news_id, l.reason, b.best_cosine, p.cluster_max FROM cluster_items l JOIN bestc b USING (cluster_id, news_id) JOIN per p USING (cluster_id)
   WHERE p.size >= 3 AND list_contains({sql_list(clustering.WEAK_REASONS)}, l.reason) AND b.best_cosine < 0.70 AND b.best_cosine < p.cluster_max - 0.15)"""


@query("e8_coherence_outliers", f"""
WITH {OUTLIER_SQL} SELECT cluster_id, news_id, round(best_cosine, 6) AS best_cosine, round(cluster_max, 6) AS cluster_max FROM outliers""")
def e8(desk: Desk) -> DataFrame:
    found = clustering.coherence_outliers(desk.cluster_items, desk.news_vectors)
    return found.select("cluster_id", "news_id", F.round("best_cosine", 6).alias("best_cosine"), F.round("cluster_max", 6).alias("cluster_max"))


@query("e9_outlier_split", f"""
WITH {OUTLIER_SQL}, ej AS (SELECT cluster_id, news_id FROM outliers WHERE news_id % 2 = 0)
SELECT CASE WHEN e.news_id IS NOT NULL THEN -l.news_id - 1 ELSE l.cluster_id END AS cluster_id, l.news_id, l.reason,
  CASE WHEN e.news_id IS NOT NULL THEN 'split' ELSE 'kept' END AS decision FROM cluster_items l LEFT JOIN ej e USING (cluster_id, news_id)""")
def e9(desk: Desk) -> DataFrame:
    outliers = clustering.coherence_outliers(desk.cluster_items, desk.news_vectors)
    verdicts = outliers.select("cluster_id", "news_id", F.when(F.col("news_id") % 2 == 0, "reject").otherwise("keep").alias("verdict"))
    return clustering.split_outliers(desk.cluster_items, outliers, verdicts)


AUDIT_SQL = f"""{OUTLIER_SQL},
al AS (SELECT *, news_id % 3 = 0 AS has, CASE WHEN news_id % 2 = 0 THEN 'strong_same_event' ELSE 'seed' END AS decision FROM cluster_items),
pe AS (SELECT news_id, lower(name) AS name FROM news_entities WHERE is_primary),
audited AS (SELECT l.cluster_id, l.news_id, round_even(CASE WHEN b.best_cosine IS NOT NULL THEN greatest(0, b.best_cosine) END, 4) AS best_neighbor_cosine,
  decision = 'strong_same_event' AND reason = 'strong_title_topic_overlap' AND NOT has AS f1, has AND pe.name <> 'nation_3' AS f2,
  coalesce(greatest(0, b.best_cosine) < 0.70 AND b.best_cosine IS NOT NULL, FALSE) AS f3
  FROM al l LEFT JOIN bestc b USING (cluster_id, news_id) LEFT JOIN pe USING (news_id))"""


def audit_links(desk: Desk) -> DataFrame:
    n = F.col("news_id")
    return desk.cluster_items.select(
        "cluster_id", "news_id", "reason", F.when(n % 2 == 0, "strong_same_event").otherwise("seed").alias("decision"),
        F.when(n % 3 == 0, F.array(F.lit("Nation_3"))).alias("entity_overlap"), F.array().cast("array<string>").alias("ticker_overlap"))


@query("e10_member_audit", f"""
WITH {AUDIT_SQL} SELECT cluster_id, news_id, best_neighbor_cosine, array_to_string(list_filter([CASE WHEN f1 THEN 'title_only_strong_join' END,
  CASE WHEN f2 THEN 'non_primary_overlap_join' END, CASE WHEN f3 THEN 'low_best_neighbor_cosine' END], lambda f: f IS NOT NULL), ',') AS flags FROM audited""")
def e10_members(desk: Desk) -> DataFrame:
    links = audit_links(desk)
    made = clustering.audit_members(links, desk.news_entities, clustering.member_cosines(links, desk.news_vectors))
    return made.withColumn("flags", F.array_join("flags", ","))


@query("e10_cluster_audit", f"""
WITH {AUDIT_SQL}, m AS (SELECT cluster_id, bool_or(f1) AS f1, bool_or(f2) AS f2, bool_or(f3) AS f3 FROM audited GROUP BY 1)
SELECT p.cluster_id, p.size AS member_count, round_even(p.cluster_max, 4) AS max_pairwise_cosine, array_to_string(list_filter([
  CASE WHEN p.size >= 3 AND (p.cluster_max IS NULL OR round_even(p.cluster_max, 4) < 0.70) THEN 'diffuse_incoherence' END,
  CASE WHEN f3 THEN 'low_best_neighbor_cosine' END, CASE WHEN f2 THEN 'non_primary_overlap_join' END, CASE WHEN f1 THEN 'title_only_strong_join' END],
  lambda f: f IS NOT NULL), ',') AS flags FROM per p JOIN m USING (cluster_id)""")
def e10_clusters(desk: Desk) -> DataFrame:
    links = audit_links(desk)
    rated = cut_lineage(clustering.member_cosines(links, desk.news_vectors))
    audited = clustering.audit_members(links, desk.news_entities, rated)
    return clustering.audit_clusters(audited, rated).withColumn("flags", F.array_join("flags", ","))


@query("e11_identity_match")
def e11(desk: Desk) -> DataFrame:
    members = cut_lineage(same_event.greedy_drafts(candidates(desk)))
    drafts = members.groupBy("draft_id").agg(F.count(F.lit(1)).alias("source_count"))
    return clustering.match_identities(members, drafts, desk.cluster_items, desk.clusters)


GROUPS_SQL = """
members AS (SELECT news_id, CASE WHEN news_id % 5 = 0 THEN 100000 + news_id // 30 ELSE news_id // 6 END AS draft_id FROM news),
sizes AS (SELECT draft_id, count(*) AS n FROM members GROUP BY 1)"""


@query("e11_identity_of_groups", f"""
WITH RECURSIVE {GROUPS_SQL},
liked AS (SELECT m.draft_id, l.cluster_id, count(*) AS shared FROM members m JOIN cluster_items l USING (news_id) GROUP BY 1, 2),
ordered AS (SELECT l.draft_id, list(l.cluster_id ORDER BY l.shared DESC, c.last_updated_at DESC, l.cluster_id) AS likes FROM liked l JOIN clusters c USING (cluster_id) GROUP BY 1),
turns AS (SELECT s.draft_id, coalesce(o.likes, []) AS likes, row_number() OVER (ORDER BY s.n DESC, s.draft_id) AS k FROM sizes s LEFT JOIN ordered o USING (draft_id)),
walk(k, draft_id, cluster_id, claimed) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT t.k, t.draft_id, list_filter(t.likes, lambda c: NOT list_contains(w.claimed, c))[1], list_append(w.claimed, list_filter(t.likes, lambda c: NOT list_contains(w.claimed, c))[1])
  FROM walk w JOIN turns t ON t.k = w.k + 1)
SELECT draft_id, cluster_id FROM walk WHERE k > 0""")
def e11_groups(desk: Desk) -> DataFrame:
    """Identities of drafts that SQL can make too: runs of items, some of them dealt to larger groups."""
    n = F.col("news_id")
    members = cut_lineage(desk.news.select("news_id", F.when(n % 5 == 0, 100000 + F.floor(n / 30)).otherwise(F.floor(n / 6)).alias("draft_id")))
    drafts = members.groupBy("draft_id").agg(F.count(F.lit(1)).alias("source_count"))
    return clustering.match_identities(members, drafts, desk.cluster_items, desk.clusters)


def reclustered(desk: Desk) -> dict[str, DataFrame]:
    live = clustering.recluster_scope(desk.clusters)
    links = desk.cluster_items.join(live.select("cluster_id"), "cluster_id", "left_semi")
    rows = candidates(desk, newest_first=False).join(links.select("news_id"), "news_id", "left_semi")
    edges = embedding.item_neighbours(desk.news_vectors)
    return clustering.recluster(rows, edges, links, live, vectors=desk.news_vectors, guard_verdicts=guard_verdicts(rows),
                                cluster_vectors=desk.cluster_vectors)


def guard_verdicts(rows: DataFrame) -> DataFrame:
    """A stand-in for the arbiter: it may reject every second item, whatever draft it is in."""
    return rows.filter(F.col("news_id") % 2 == 0).select("news_id", F.lit("reject").alias("verdict"))


@query("e12_recluster_links")
def e12(desk: Desk) -> DataFrame:
    return reclustered(desk)["links"]


@query("e12_recluster_counts")
def e12_counts(desk: Desk) -> DataFrame:
    return reclustered(desk)["counts"]


ATTACH_SQL = f"""{NEAREST_SQL},
sure AS (SELECT news_id, cluster_id, similarity, 'vector' AS decision_source FROM judged WHERE is_attachable
   QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY rank) = 1),
gray AS (SELECT news_id, cluster_id, similarity, 'llm' AS decision_source FROM judged WHERE is_gray AND news_id NOT IN (SELECT news_id FROM sure)
   AND (news_id + cluster_id) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY rank) = 1),
attached AS (SELECT * FROM sure UNION ALL SELECT * FROM gray)"""


def attach_verdicts(rows: DataFrame) -> DataFrame:
    return rows.select("news_id", "cluster_id", F.when((F.col("news_id") + F.col("cluster_id")) % 2 == 0, "attach").otherwise("reject").alias("verdict"))


def attached(desk: Desk) -> DataFrame:
    rows = judged(desk)
    return clustering.attach_items(rows, attach_verdicts(rows))


def built(desk: Desk) -> dict[str, DataFrame]:
    rows, pending = cut_lineage(judged(desk)), candidates(desk)
    return clustering.build_events(rows, pending, attach_verdicts(rows), vectors=desk.news_vectors, guard_verdicts=guard_verdicts(pending),
                                   watchlist=desk.watchlist)


@query("e13_new_events")
def e13_new(desk: Desk) -> DataFrame:
    return built(desk)["links"]


@query("e13_scored_events")
def e13_scored(desk: Desk) -> DataFrame:
    made = built(desk)["events"]
    return made.select("cluster_id", "headline", *[F.array_join(c, ",").alias(c) for c in ("regions", "asset_classes", "affected_entities", "affected_tickers")],
                       "source_count", "hq_source_count", "top_source_score", "tier", "final_score", "alert_level")


@query("e13_attach_items", f"WITH {ATTACH_SQL} SELECT news_id, cluster_id, round(similarity, 6) AS similarity, decision_source FROM attached")
def e13(desk: Desk) -> DataFrame:
    return attached(desk).withColumn("similarity", F.round("similarity", 6))


@query("e13_attached_clusters", f"""
WITH {ATTACH_SQL}, g AS (SELECT a.cluster_id, list(DISTINCT n.region) AS r, list(DISTINCT n.asset_class) AS ac, list(DISTINCT e.name) AS en, list(DISTINCT e.ticker) AS tk,
   count(DISTINCT n.news_id) AS k, count(DISTINCT n.news_id) FILTER (n.source_score >= 75) AS hq, max(n.source_score) AS top
  FROM attached a JOIN news n USING (news_id) JOIN news_entities e ON e.news_id = n.news_id AND e.is_primary GROUP BY 1),
grown AS (SELECT c.cluster_id, array_to_string(list_sort(list_distinct(c.regions || g.r)), ',') AS regions, array_to_string(list_sort(list_distinct(c.asset_classes || g.ac)), ',') AS asset_classes,
  list_sort(list_distinct(c.affected_entities || g.en)) AS ents, list_sort(list_distinct(c.affected_tickers || g.tk)) AS ticks,
  CAST(c.source_count + g.k AS INT) AS n, CAST(c.hq_source_count + g.hq AS INT) AS hq, greatest(c.top_source_score, g.top) AS top
  FROM clusters c JOIN g USING (cluster_id)),
syms AS (SELECT cluster_id, unnest(list_distinct(ticks || ents)) AS symbol FROM grown), {TIERS},
inp AS (SELECT g.*, t.tier, 'reported' AS status, CAST(NULL AS INT) AS move, FALSE AS dup, FALSE AS stale FROM grown g LEFT JOIN ctiers t USING (cluster_id)), {score_sql('inp')}
SELECT cluster_id, regions, asset_classes, array_to_string(ents, ',') AS affected_entities, array_to_string(ticks, ',') AS affected_tickers,
  n AS source_count, hq AS hq_source_count, top AS top_source_score, tier, score AS final_score, {decision_sql('score')} AS alert_level FROM scored""")
def e13_clusters(desk: Desk) -> DataFrame:
    primary = desk.news_entities.filter("is_primary").groupBy("news_id").agg(
        F.collect_set("name").alias("primary_entities"), F.collect_set("ticker").alias("primary_tickers"))
    items = item_context(desk).join(primary, "news_id").join(desk.news.select("news_id", "source_score"), "news_id")
    grown = clustering.apply_attachments(desk.clusters, attached(desk), items, desk.watchlist)
    return grown.select("cluster_id", *[F.array_join(c, ",").alias(c) for c in ("regions", "asset_classes", "affected_entities", "affected_tickers")],
                        "source_count", "hq_source_count", "top_source_score", "tier", "final_score", "alert_level")


def doubled_links(desk: Desk) -> DataFrame:
    """Links where some items belong to the next cluster too."""
    links = desk.cluster_items.select("cluster_id", "news_id")
    return links.unionByName(links.filter(F.col("news_id") % 8 == 0).withColumn("cluster_id", F.col("cluster_id") + 1))


def merge_mapping(desk: Desk) -> DataFrame:
    return desk.cluster_items.filter(F.col("cluster_id") % 6 == 0).select(
        F.col("cluster_id").alias("source_id"), (F.col("cluster_id") + 1).alias("target_id")).distinct()


MERGE_SQL = """
links AS (SELECT cluster_id, news_id FROM cluster_items UNION ALL SELECT cluster_id + 1, news_id FROM cluster_items WHERE news_id % 8 = 0),
m AS (SELECT DISTINCT cluster_id AS source_id, cluster_id + 1 AS target_id FROM cluster_items WHERE cluster_id % 6 = 0),
r AS (SELECT coalesce(m.target_id, l.cluster_id) AS cluster_id, l.news_id, m.target_id IS NOT NULL AS moved, l.cluster_id AS was_in FROM links l LEFT JOIN m ON m.source_id = l.cluster_id),
after AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cluster_id, news_id ORDER BY moved, was_in) = 1)"""


@query("e14_merge_clusters", f"WITH {MERGE_SQL} SELECT * FROM after")
def e14(desk: Desk) -> DataFrame:
    return clustering.merge_clusters(doubled_links(desk), merge_mapping(desk))


CHANGED_SQL = f"""
syms AS (SELECT cluster_id, unnest(list_distinct(affected_tickers || affected_entities)) AS symbol FROM clusters), {TIERS},
sums AS (SELECT a.cluster_id, arg_max(n.title, (n.eff, n.news_id)) AS headline, CAST(count(*) AS INT) AS n,
   CAST(count(*) FILTER (n.source_score >= 75) AS INT) AS hq, max(n.source_score) AS top
  FROM after a JOIN news n USING (news_id) WHERE a.cluster_id IN (SELECT cluster_id FROM touched) GROUP BY 1),
inp AS (SELECT s.*, t.tier, coalesce(c.status, 'reported') AS status, CAST(NULL AS INT) AS move, FALSE AS dup, coalesce(c.status = 'stale', FALSE) AS stale
  FROM sums s LEFT JOIN clusters c USING (cluster_id) LEFT JOIN ctiers t USING (cluster_id)), {score_sql('inp')},
fresh AS (SELECT cluster_id, headline, n AS source_count, hq AS hq_source_count, top AS top_source_score, tier, status, score AS final_score,
  {decision_sql('score')} AS alert_level FROM scored)"""


@query("e14_merged_events", f"""
WITH {MERGE_SQL}, touched AS (SELECT target_id AS cluster_id FROM m), {CHANGED_SQL}
SELECT * FROM fresh UNION ALL SELECT cluster_id, headline, source_count, hq_source_count, top_source_score, NULL, 'merged', final_score, alert_level
FROM clusters WHERE cluster_id IN (SELECT source_id FROM m)""")
def e14_events(desk: Desk) -> DataFrame:
    return clustering.merged_events(doubled_links(desk), merge_mapping(desk), desk.clusters, desk.news, desk.watchlist)


@query("e9_ejected_events", f"""
WITH {OUTLIER_SQL}, ej AS (SELECT cluster_id, news_id FROM outliers WHERE news_id % 2 = 0),
after AS (SELECT CASE WHEN e.news_id IS NOT NULL THEN -l.news_id - 1 ELSE l.cluster_id END AS cluster_id, l.news_id FROM cluster_items l LEFT JOIN ej e USING (cluster_id, news_id)),
touched AS (SELECT cluster_id FROM ej UNION SELECT -news_id - 1 FROM ej), {CHANGED_SQL}
SELECT * FROM fresh""")
def e9_events(desk: Desk) -> DataFrame:
    outliers = cut_lineage(clustering.coherence_outliers(desk.cluster_items, desk.news_vectors))
    verdicts = outliers.select("cluster_id", "news_id", F.when(F.col("news_id") % 2 == 0, "reject").otherwise("keep").alias("verdict"))
    return clustering.ejected_events(desk.cluster_items, outliers, verdicts, desk.clusters, desk.news, desk.watchlist)


SPLIT_SQL = """
after AS (SELECT CASE WHEN news_id % 4 = 3 OR cluster_id % 9 = 0 THEN cluster_id + 1000000 ELSE cluster_id END AS cluster_id, news_id FROM cluster_items)"""


def split_selection(desk: Desk) -> DataFrame:
    return desk.cluster_items.filter((F.col("news_id") % 4 == 3) | (F.col("cluster_id") % 9 == 0)).select(
        "cluster_id", "news_id", (F.col("cluster_id") + 1000000).alias("new_id"))


@query("e15_split_clusters", f"WITH {SPLIT_SQL} SELECT * FROM after")
def e15(desk: Desk) -> DataFrame:
    return clustering.split_clusters(desk.cluster_items.select("cluster_id", "news_id"), split_selection(desk))


@query("e15_split_events", f"""
WITH {SPLIT_SQL}, chosen AS (SELECT DISTINCT cluster_id FROM cluster_items WHERE news_id % 4 = 3 OR cluster_id % 9 = 0),
touched AS (SELECT cluster_id FROM chosen UNION SELECT cluster_id + 1000000 FROM chosen), {CHANGED_SQL}
SELECT * FROM fresh UNION ALL SELECT cluster_id, headline, 0, hq_source_count, 0, NULL, 'stale', 0, NULL
FROM clusters WHERE cluster_id IN (SELECT cluster_id FROM chosen) AND cluster_id NOT IN (SELECT cluster_id FROM after)""")
def e15_events(desk: Desk) -> DataFrame:
    return clustering.split_events(desk.cluster_items.select("cluster_id", "news_id"), split_selection(desk), desk.clusters, desk.news, desk.watchlist)


@query("e15_emptied_clusters", "SELECT DISTINCT cluster_id FROM cluster_items WHERE cluster_id % 9 = 0")
def e15_emptied(desk: Desk) -> DataFrame:
    return clustering.emptied_clusters(desk.cluster_items, e15(desk))


COMPACT_SQL = """
done AS (SELECT * FROM clusters WHERE alert_level = 'archive_only' AND created_at < TIMESTAMP '2024-01-15' AND compacted_at IS NULL)"""


def compacted(desk: Desk) -> DataFrame:
    return clustering.compact_archived(desk.clusters, wall("2024-01-15 00:00:00"))


@query("e16_compact_archived", f"""
WITH {COMPACT_SQL} SELECT cluster_id, headline, array_to_string(regions, ',') AS regions, source_count, final_score FROM done""")
def e16(desk: Desk) -> DataFrame:
    s = "archive_summary"
    return compacted(desk).select("cluster_id", f"{s}.headline", F.array_join(f"{s}.regions", ",").alias("regions"), f"{s}.source_count", f"{s}.final_score")


@query("e16_vectors_left", f"""
WITH {COMPACT_SQL} SELECT 'cluster_vectors' AS "table", count(*) AS rows FROM cluster_vectors WHERE cluster_id NOT IN (SELECT cluster_id FROM done)
UNION ALL SELECT 'news_vectors', count(*) FROM news_vectors WHERE news_id NOT IN (SELECT l.news_id FROM cluster_items l JOIN done USING (cluster_id))""")
def e16_vectors(desk: Desk) -> DataFrame:
    of_clusters, of_news = clustering.drop_compacted_vectors(compacted(desk), desk.cluster_items, desk.cluster_vectors, desk.news_vectors)
    return retention.census({"cluster_vectors": of_clusters, "news_vectors": of_news})


GONE = ("src3", "src4", "src8")
PURGE_SQL = f"""
gone_news AS (SELECT news_id FROM news WHERE source_id IN ('src3', 'src4', 'src8')),
left_links AS (SELECT * FROM cluster_items WHERE news_id NOT IN (SELECT news_id FROM gone_news)),
touched AS (SELECT DISTINCT cluster_id FROM cluster_items WHERE news_id IN (SELECT news_id FROM gone_news)),
orphans AS (SELECT cluster_id FROM touched WHERE cluster_id NOT IN (SELECT cluster_id FROM left_links))"""


def purged(desk: Desk) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    tables = {
        "sources": desk.sources, "fetch_logs": desk.fetch_logs, "raw_items": desk.news.select("source_id", "news_id"),
        "news": desk.news, "news_vectors": desk.news_vectors, "news_entities": desk.news_entities, "cluster_items": desk.cluster_items,
        "clusters": desk.clusters, "alert_decisions": desk.alert_decisions, "score_history": desk.score_history,
        "cluster_vectors": desk.cluster_vectors, "reviews": reviews(desk)}
    gone = desk.sources.filter(F.col("source_id").isin(*GONE))
    return tables, clustering.purge_sources(tables, gone, desk.watchlist)


@query("b19_purge_counts", f"""
WITH {PURGE_SQL} SELECT 'sources' AS "table", count(*) AS deleted FROM sources WHERE source_id IN ('src3', 'src4', 'src8')
UNION ALL SELECT 'fetch_logs', count(*) FROM fetch_logs WHERE source_id IN ('src3', 'src4', 'src8')
UNION ALL SELECT 'raw_items', count(*) FROM gone_news UNION ALL SELECT 'news', count(*) FROM gone_news
UNION ALL SELECT 'news_vectors', count(*) FROM news_vectors WHERE news_id IN (SELECT news_id FROM gone_news)
UNION ALL SELECT 'news_entities', count(*) FROM news_entities WHERE news_id IN (SELECT news_id FROM gone_news)
UNION ALL SELECT 'cluster_items', count(*) FROM cluster_items WHERE news_id IN (SELECT news_id FROM gone_news)
UNION ALL SELECT 'clusters', count(*) FROM orphans
UNION ALL SELECT 'alert_decisions', count(*) FROM alert_decisions WHERE cluster_id IN (SELECT cluster_id FROM orphans)
UNION ALL SELECT 'score_history', count(*) FROM score_history WHERE cluster_id IN (SELECT cluster_id FROM orphans)
UNION ALL SELECT 'cluster_vectors', count(*) FROM cluster_vectors WHERE cluster_id IN (SELECT cluster_id FROM touched) UNION ALL SELECT 'reviews', 0""")
def b19(desk: Desk) -> DataFrame:
    before, after = purged(desk)
    return retention.deleted_counts(before, {name: after[name] for name in before})


@query("b19_refreshed_clusters", f"""
WITH {PURGE_SQL}, rem AS (SELECT l.cluster_id, l.news_id FROM left_links l JOIN touched USING (cluster_id)),
s AS (SELECT r.cluster_id, arg_max(n.title, (n.eff, n.news_id)) AS headline, CAST(count(*) AS INT) AS source_count, max(n.source_score) AS top_source_score
  FROM rem r JOIN news n USING (news_id) GROUP BY 1),
a AS (SELECT r.cluster_id, array_to_string(list_sort(list(DISTINCT e.name)), ',') AS affected_entities, array_to_string(list_sort(list(DISTINCT e.ticker)
  FILTER (e.ticker IS NOT NULL)), ',') AS affected_tickers FROM rem r JOIN news_entities e USING (news_id) GROUP BY 1)
SELECT * FROM s JOIN a USING (cluster_id)""")
def b19_refreshed(desk: Desk) -> DataFrame:
    made = purged(desk)[1]["refreshed_clusters"]
    return made.select("cluster_id", "headline", "source_count", "top_source_score", F.array_join("affected_entities", ",").alias("affected_entities"),
                       F.array_join("affected_tickers", ",").alias("affected_tickers"))
