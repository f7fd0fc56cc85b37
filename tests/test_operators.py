"""Operators without a SQL form, against small independent models."""

import hashlib
import math
import random
import re
import unicodedata
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.operators import alerts, clustering, embedding, entities, same_event
from newsloom.plans import similarity
from newsloom.sources import feeds, pages, quotes, registry
from newsloom.sources.tables import Desk
from newsloom.streaming import files, jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_nfkc_safe_characters_do_not_change():
    ranges = text.NFKC_SAFE.encode().decode("unicode_escape")
    chars, i = [], 0
    while i < len(ranges):
        if i + 2 < len(ranges) and ranges[i + 1] == "-":
            chars += [chr(c) for c in range(ord(ranges[i]), ord(ranges[i + 2]) + 1)]
            i += 3
        else:
            chars.append(ranges[i])
            i += 1
    assert all(unicodedata.normalize("NFKC", c) == c for c in chars)


def test_text_cleaning(spark):
    assert one(spark, text.normalize_text(F.lit(" A&amp;B <b>ﬁne</b>\n ½ "))) == "A&B fine 1⁄2"
    assert one(spark, text.canonical_url(F.lit(" HTTPS://Ex.com?b=2&UTM_source=x&a=&a=1#f"))) == "https://ex.com/?a=&a=1&b=2"
    assert one(spark, text.clean_title(F.lit("Oil jumps – Reuters"))) == "Oil jumps"
    assert one(spark, text.title_tokens(F.lit("Giá vàng tăng mạnh hôm nay | Bloomberg.com"))) == ["mạnh", "vàng"]
    assert one(spark, text.parse_datetime(F.lit("2024-02-30"))) is None


def test_scores_on_edges(spark):
    def final(**k):
        args = dict(top_source_score=F.lit(70), source_count=F.lit(1), tier=F.lit("S"), hq_source_count=F.lit(0),
                    status=F.lit("reported"), move_score=F.lit(None).cast("int")) | k
        return one(spark, scoring.score_event(**args)["final_score"])

    assert final() == round((70 * .25 + 100 * .35 + 50 * .25) / .85)
    assert final(top_source_score=F.lit(47)) == round((47 * .25 + 100 * .35 + 50 * .25) / .85 * (.85 + 7 / 15 * .15))
    assert one(spark, scoring.move_score(F.lit(-5.0), F.lit(50.0), F.lit(2.0))) == 100
    assert one(spark, scoring.decide(F.lit(80))) == "immediate_alert" and one(spark, scoring.decide(F.lit(29))) == "archive_only"


def make_candidates(spark, n, seed, hours=6):
    rng = random.Random(seed)
    words = ["inflation", "surges", "bank", "rates", "merger", "chipmaker", "profit", "falls", "exports", "dollar", "tanker", "strike", "harvest", "copper"]
    rows = []
    for i in range(n):
        entity = rng.choice(["Acme", "Globex", "markets", "Initech", "Umbra", "Vostok"])
        rows.append((i, i + 1, datetime(2024, 1, 1) + timedelta(hours=hours * i), " ".join(rng.sample(words, rng.randint(3, 6))), [entity], [f"T{rng.randrange(12)}"],
                     rng.choice(["us", "global", "vietnam"]), [rng.choice(["equity", "global_macro"])], rng.randrange(30, 99), "A"))
    df = spark.createDataFrame(rows, "news_id long, seq long, at timestamp_ntz, title string, entities array<string>, tickers array<string>, "
                               "region string, asset_classes array<string>, source_score int, watch_tier string")
    full = df.withColumn("primary_entities", F.col("entities")).withColumn("primary_tickers", F.col("tickers"))
    return rows, same_event.with_match_sets(full)


def ladder(s, t, e, k, w, ctx):
    if k and ctx and (s >= .55 or (s >= .38 and (e or t >= 2))):
        return "strong_same_event", "ticker_overlap_with_title_support"
    if s >= .45 and t >= 2:
        return (("ambiguous", "title_topic_overlap_requires_arbitration") if not e and not k and t < 3
                else ("strong_same_event", "strong_title_topic_overlap"))
    if ctx and e and (s >= .45 or t):
        return "strong_same_event", "specific_entity_overlap_with_title_support"
    if ctx and e:
        return "ambiguous", "specific_entity_overlap_without_title_support"
    return ("ambiguous", "weak_entity_overlap_requires_arbitration") if ctx and w else ("reject", "insufficient_same_event_signal")


def verdict(item, title, specific, broad, codes, regions, classes):
    """item against a draft given by its parts."""
    tokens = {w for w in item[3].split() if len(w) > 3}
    mine = {v.lower() for v in item[4]}
    shared = set(item[7]) & classes
    place = min(regions)
    ctx = bool(shared and shared != {"global_macro"}) or (item[6] == place != "global")
    s = SequenceMatcher(None, item[3], title).ratio()
    return s, ladder(s, len(tokens & {w for w in title.split() if len(w) > 3}), bool((mine - {"markets"}) & specific),
                     bool({v.lower() for v in item[5]} & codes), bool(mine & {"markets"} & broad), ctx)


def greedy_model(rows, window=same_event.EVENT_WINDOW):
    """Items one by one, each compared with every draft whose seed is not too far away in time."""
    out, drafts = {}, []
    for r in rows:
        best = None
        for d in (d for d in drafts if r[2] - d["at"] <= window):
            s, (kind, _) = verdict(r, d["title"], d["e"] - {"markets"}, d["e"], d["k"], d["r"], d["c"])
            if kind == "strong_same_event" and (best is None or s > best[0]):
                best = (s, d)
        d = best[1] if best else {"id": r[0], "title": r[3], "at": r[2], "e": set(), "k": set(), "r": set(), "c": set()}
        if not best:
            drafts.append(d)
        d["e"] |= {v.lower() for v in r[4]}
        d["k"] |= {v.lower() for v in r[5]}
        d["r"].add(r[6])
        d["c"] |= set(r[7])
        out[r[0]] = d["id"]
    return out


@pytest.mark.parametrize(("seed", "hours"), [(0, 9), (1, 1)])
def test_greedy_drafts_equal_the_sequential_model(spark, seed, hours):
    rows, candidates = make_candidates(spark, 20, seed, hours)
    got = {r["news_id"]: r["draft_id"] for r in same_event.greedy_drafts(candidates).collect()}
    assert got == greedy_model(rows)


def test_greedy_drafts_in_blocks_equal_the_sequential_model(spark, monkeypatch):
    """Blocks of a few items and links: choices change across blocks."""
    rows, candidates = make_candidates(spark, 16, 1, 1)
    monkeypatch.setattr(same_event, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(same_event, "BLOCK_LINKS", 12)
    got = {r["news_id"]: r["draft_id"] for r in same_event.greedy_drafts(candidates).collect()}
    assert got == greedy_model(rows)


def test_drafts_of_many_rounds_have_a_real_size(spark, monkeypatch, capsys):
    """The estimate of a placement grew fourfold in digits with every round, until planning with it took minutes."""
    _, candidates = make_candidates(spark, 16, 1, 1)
    monkeypatch.setattr(same_event, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(same_event, "BLOCK_LINKS", 12)
    same_event.greedy_drafts(candidates).explain(mode="cost")
    text = capsys.readouterr().out
    assert "sizeInBytes=" in text and "E+" not in text


def test_changes_inside_a_block_cost_no_rounds(spark, monkeypatch):
    rows, candidates = make_candidates(spark, 30, 1, 1)
    written, cut = [], same_event.cut_lineage
    monkeypatch.setattr(same_event, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    got = {r["news_id"]: r["draft_id"] for r in same_event.greedy_drafts(candidates).collect()}
    assert got == greedy_model(rows)
    assert sum("moved" in columns for columns in written) == 1


def test_sets_of_both_items_meet_across_packs(spark, monkeypatch):
    """The sets of an item travel once per pack of consecutive items, not once per pair."""
    _, candidates = make_candidates(spark, 40, 4, hours=3)
    monkeypatch.setattr(same_event, "PACK_ITEMS", 4)
    sets = {r["news_id"]: r for r in candidates.collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and (a * b) % 3]
    rows = same_event._with_both(spark.createDataFrame(pairs, "src long, dst long"), candidates, {"a": F.col("tokens")}, {"b": F.col("codes"), "c": F.col("place")})
    assert sorted((r["src"], r["dst"], r["a"], r["b"], r["c"]) for r in rows.collect()) == sorted(
        (a, b, sets[a]["tokens"], sets[b]["codes"], sets[b]["place"]) for a, b in pairs)


def test_titles_are_read_without_shuffling_texts(spark, capsys):
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        Desk(spark, "/root/testdata/sf0.001").news.select("news_id", "title", "source_score").explain(mode="formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    parts = [part.strip().splitlines() for part in capsys.readouterr().out.split("\n\n")]
    moved = [part[1] for part in parts if part and part[0].endswith(" Exchange")]
    assert any("title#" in line for line in moved) and not any("text#" in line for line in moved)


def test_pairs_equal_brute_force_whatever_their_position(spark):
    rows, candidates = make_candidates(spark, 120, 4, hours=3)
    def words(r):
        return {w for w in r[3].split() if len(w) > 3}
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1:] if b[2] - a[2] <= timedelta(days=7) and (
        ({v.lower() for v in a[4]} & {v.lower() for v in b[4]}) - {"markets"} or set(a[5]) & set(b[5]) or len(words(a) & words(b)) >= 2)}
    assert {(r["src"], r["dst"]) for r in same_event.candidate_pairs(candidates).collect()} == want
    short = {(a, b) for a, b in want if rows[b][2] - rows[a][2] <= timedelta(hours=10)}
    assert {(r["src"], r["dst"]) for r in same_event.candidate_pairs(candidates, timedelta(hours=10)).collect()} == short


def test_equal_headlines_pair_at_any_row(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, i, at + timedelta(minutes=i), "harbour dredging contract" if i in (500, 501) else f"title{i:04d}", [], [], "us", ["equity"], 50, "A") for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "news_id long, seq long, at timestamp_ntz, title string, entities array<string>, tickers array<string>, region string, "
                                     "asset_classes array<string>, source_score int, watch_tier string")
    candidates = same_event.with_match_sets(df.withColumn("primary_entities", F.col("entities")).withColumn("primary_tickers", F.col("tickers")))
    assert [tuple(r) for r in same_event.candidate_pairs(candidates).collect()] == [(500, 501)]
    drafts = {r["news_id"]: r["draft_id"] for r in same_event.greedy_drafts(candidates).collect()}
    assert drafts == {i: 500 if i == 501 else i for i in range(1, 1001)}


def test_items_without_any_key_or_time_stay_alone(spark):
    rows = [(1, 1, None, "harbour dredging contract", ["Acme"], ["T1"]), (2, 2, datetime(2024, 1, 1), "harbour dredging contract", ["Acme"], ["T1"]),
            (3, 3, datetime(2024, 1, 2), "", [], []), (4, 4, datetime(2024, 1, 2), "", [], []), (5, 5, datetime(2024, 1, 2), "harbour dredging contract", [], [])]
    rows = [(*r, "us", ["equity"], 50, "A") for r in rows] + [(6, 6, datetime(2024, 1, 2), None, None, None, None, None, None, None),
            (7, 7, datetime(2024, 1, 2), "harbour dredging contract", None, ["T1"], None, None, 50, None)]
    df = spark.createDataFrame(rows, "news_id long, seq long, at timestamp_ntz, title string, entities array<string>, "
                               "tickers array<string>, region string, asset_classes array<string>, source_score int, watch_tier string")
    candidates = same_event.with_match_sets(df.withColumn("primary_entities", F.col("entities")).withColumn("primary_tickers", F.col("tickers")))
    got = {r["news_id"]: r["draft_id"] for r in same_event.greedy_drafts(candidates).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2, 6: 6, 7: 2}
    assert same_event.greedy_drafts(candidates.limit(0)).collect() == []


def test_pairs_of_a_key_that_all_items_share(spark):
    """The one key holds all rows of its stretches and is salted there."""
    rows, candidates = make_candidates(spark, 200, 8, hours=1)
    same = candidates.withColumn("codes", F.array(F.lit("t1"))).withColumn("primary_tickers", F.array(F.lit("T1")))
    pairs = same_event.candidate_pairs(same)
    assert pairs.count() == sum(b[2] - a[2] <= timedelta(days=7) for i, a in enumerate(rows) for b in rows[i + 1:])


def regroup(spark, candidates, **more):
    none = spark.createDataFrame([], "cluster_id long, news_id long, src long, dst long, last_updated_at int")
    return clustering.recluster(candidates, none.select("src", "dst"), none.select("cluster_id", "news_id"),
                                none.select("cluster_id", "last_updated_at"), **more)


def test_recluster_places_the_whole_window(spark):
    rows, candidates = make_candidates(spark, 14, 4)
    drafts, got = {}, {}
    for news, draft in greedy_model(rows).items():
        drafts.setdefault(draft, set()).add(news)
    for r in regroup(spark, candidates)["links"].collect():
        got.setdefault(r["cluster_id"], set()).add(r["news_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, drafts.values()))


def test_recluster_and_build_split_rejected_outliers_and_place_what_does_not_attach(spark):
    rows, candidates = make_candidates(spark, 20, 0)
    plain = regroup(spark, candidates)["links"].collect()
    of = {}
    for r in plain:
        of.setdefault(r["cluster_id"], []).append(r)
    far = next(r["news_id"] for c in of.values() if len(c) >= 3 for r in c if r["reason"] in clustering.WEAK_REASONS)
    vectors = spark.createDataFrame([(r[0], [0.0, 1.0] if r[0] == far else [1.0, 0.0]) for r in rows], "news_id long, vector array<double>")
    for said in ("reject",):
        verdicts = spark.createDataFrame([(r[0], said) for r in rows], "news_id long, verdict string")
        got = {r["news_id"]: r for r in regroup(spark, candidates, vectors=vectors, guard_verdicts=verdicts)["links"].collect()}
        assert len(got) == len(rows)
        for r in plain:
            if said == "reject" and r["news_id"] == far:
                assert (got[far]["cluster_id"], got[far]["decision_source"], got[far]["reason"]) == (-far - 1, "coherence_guard", "embedding_outlier")
            else:
                assert got[r["news_id"]] == r
    judged = spark.createDataFrame([(i, 900, 1, 0.9, i % 3 == 0, i % 3 == 1) for i in range(20)],
                                   "news_id long, cluster_id long, rank int, similarity double, is_attachable boolean, is_gray boolean")
    ruled = judged.select("news_id", "cluster_id", F.when(F.col("news_id") < 10, "attach").otherwise("reject").alias("verdict"))
    made = clustering.build_events(judged, candidates, ruled)
    attached = {r["news_id"] for r in made["attached"].collect()}
    assert attached == {i for i in range(20) if i % 3 == 0 or i % 3 == 1 and i < 10}
    want = greedy_model([r for r in rows if r[0] not in attached])
    assert {r["news_id"]: -r["cluster_id"] - 1 for r in made["links"].collect()} == want
    assert {r["draft_id"] for r in made["drafts"].collect()} == set(want.values())


def test_new_events_are_scored(spark):
    rows, candidates = make_candidates(spark, 12, 3)
    plain = candidates.withColumn("watch_tier", F.when(F.col("news_id") % 2 == 0, "D").otherwise(F.lit(None).cast("string")))
    watchlist = spark.createDataFrame([(1, "Acme", "T1", "A", True, []), (2, "Globex", "T9", "C", True, [])],
                                      "watch_id long, name string, symbol string, tier string, enabled boolean, aliases array<string>")
    drafts = clustering.summarize_drafts(spark.createDataFrame([(i // 4 * 4, i) for i in range(12)], "draft_id long, news_id long"), plain)
    got = {r["cluster_id"]: r for r in clustering.new_events(drafts, watchlist).collect()}
    assert set(got) == {-1, -5, -9}
    for k in range(3):
        part = rows[4 * k:4 * k + 4]
        terms = {v.lower() for r in part for v in [*r[4], *r[5]]}
        tier = "A" if terms & {"acme", "t1"} else "C" if terms & {"globex", "t9"} else None
        top, hq = max(r[8] for r in part), sum(r[8] >= 75 for r in part)
        conf = min(100, 80 + min(15, 5 * hq))
        conf = max(conf, 85) if hq >= 2 else conf
        base = (.25 * top + .35 * {"A": 90, "C": 55}.get(tier, 35) + .25 * conf) / .85
        noise = .85 if top <= 40 else 1 if top >= 55 else .85 + (top - 40) / 15 * .15
        row = got[-4 * k - 1]
        assert (row["tier"], row["final_score"], row["source_count"]) == (tier, round(base * noise), 4)
        assert row["headline"] == part[0][3] and row["alert_level"] == one(spark, scoring.decide(F.lit(row["final_score"])))


def test_recluster_reports_links_and_vectors_and_scopes_to_an_event(spark):
    rows, candidates = make_candidates(spark, 16, 1)
    links = spark.createDataFrame([(i // 2, i) for i in range(16)], "cluster_id long, news_id long")
    clusters = spark.createDataFrame([(c, c, "stale" if c == 7 else "reported") for c in range(8)], "cluster_id long, last_updated_at int, status string")
    stored = spark.createDataFrame([(c, [1.0, float(c)]) for c in (0, 1, 2, 7, 50)], "cluster_id long, vector array<double>")
    none = spark.createDataFrame([], "src long, dst long")
    live = clustering.recluster_scope(clusters)
    inside = links.join(live, "cluster_id", "left_semi")
    mine = candidates.join(inside.select("news_id"), "news_id", "left_semi")
    made = clustering.recluster(mine, none, inside, live, cluster_vectors=stored)
    counts = made["counts"].first()
    assert (counts["affected_clusters"], counts["news_items"], counts["links_deleted"], counts["vectors_deleted"]) == (7, 14, 14, 3)
    assert counts["new_clusters"] == counts["vectors_to_write"] == made["to_embed"].count() == counts["reused_clusters"] + counts["created_clusters"]
    assert counts["stale_clusters"] == 7 - counts["reused_clusters"]
    assert {r["cluster_id"] for r in made["cluster_vectors"].collect()} == {7, 50}
    assert [r["cluster_id"] for r in clustering.recluster_scope(clusters, cluster_id=3).collect()] == [3]
    assert clustering.recluster_scope(clusters, cluster_id=7).collect() == []
    assert {r["cluster_id"] for r in clustering.recluster_scope(clusters, since=F.lit(5)).collect()} == {5, 6}


def test_local_evidence_equals_rating_all_rows(spark):
    rng = random.Random(3)
    words = ["oil", "turmoil", "north", "northern", "sea", "rig", "n1", "n12", "acme", "field", "ties", "Ünder", "x"]
    news = [(i, " ".join(rng.choices(words, k=4)), None if i % 4 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 8))), rng.choice([None, 20, 95, 140]), i % 17)
            for i in range(60)] + [(90, "y" * 300 + "north" + "z" * 300, "N1 North Sea", 90, 30), (91, "", "", 90, 31), (92, None, None, None, 32)]
    targets = [(1, ["N1"], ["North Sea", "Acme"], ["oil", "rig"]), (2, ["N12", "n1"], [], []), (3, [], [], []), (4, [""], [" "], ["oil", "sea", "field", "ties", "north"]),
               (5, [], ["absent entity"], ["turmoil"]), (6, None, ["Ünder"], None), (7, ["x"], ["north  sea"], ["ern"])]
    made = spark.createDataFrame(news, "news_id long, title string, snippet string, source_score int, created_at int")
    wanted = spark.createDataFrame(targets, "target_id long, symbols array<string>, entities array<string>, context array<string>")

    def rate(target, row):
        body = f"{row[1] or ''} {row[2] or ''}".lower()
        found = [sum(v.strip() != "" and v.lower() in body for v in values or []) for values in target[1:]]
        score = min(10, max(0, (row[3] or 0) // 10)) + 20 * found[0] + 25 * found[1] + min(30, 5 * found[2])
        return score if any(found) and score >= (30 if target[2] or target[3] else 20) else None

    every = {(t[0], r[0], rate(t, r)) for t in targets for r in news if r[4] >= 2 and rate(t, r) is not None}
    assert len({e[0] for e in every}) >= 5
    assert {tuple(r) for r in alerts.local_evidence(wanted, made, F.lit(2), limit=None).collect()} == every
    at = {r[0]: r[4] for r in news}
    newest = {e for t in targets for e in sorted((e for e in every if e[0] == t[0]), key=lambda e: (-at[e[1]], e[1]))[:3]}
    assert {tuple(r) for r in alerts.local_evidence(wanted, made, F.lit(2), limit=3).collect()} == newest


def test_structured_data_is_found_at_any_depth(spark):
    def nested(depth, inner):
        for k in range(depth):
            inner = f'[{{"@type": "Thing"}}, {inner}]' if k % 2 else f'{{"@type": "WebPage", "headline": "outer", "@graph": [{inner}, 7]}}'
        return f'<script type="application/ld+json">{inner}</script>'

    story = '{"@type": ["Thing", "NewsArticle"], "headline": "deep story"}'
    html = [nested(d, story) for d in (0, 1, 3, 4, 7, 12)] + [nested(7, '{"@type": "Thing"}') + "<h1>heading</h1>", nested(5, story)[:60] + "<h1>cut off</h1>"]
    # a member comes before the node that holds it, whatever the depth
    html.append('<script type="application/ld+json">{"@type": "Article", "headline": "outside", "@graph": [[[{"@type": "Article", "headline": "inside"}]]]}</script>')
    rows = spark.createDataFrame([(i, f"https://x.example/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r["title"] for r in pages.page_metadata(rows).collect()}
    assert got == dict(enumerate(["deep story"] * 6 + ["heading", "cut off", "inside"]))


def test_pair_verdicts_equal_the_ladder(spark):
    rows, candidates = make_candidates(spark, 40, 9)
    got = same_event.classify_pairs(same_event.candidate_pairs(candidates), candidates).collect()
    assert got
    for p in got:
        a, b = rows[p["src"]], rows[p["dst"]]
        names = {v.lower() for v in a[4]}
        s, want = verdict(b, a[3], names - {"markets"}, names, {v.lower() for v in a[5]}, {a[6]}, set(a[7]))
        assert abs(p["similarity"] - s) < 1e-12 and (p["kind"], p["reason"]) == want


def test_arbitrated_pairs_join(spark):
    _, candidates = make_candidates(spark, 14, 1)
    base = {r["news_id"]: r["draft_id"] for r in same_event.greedy_drafts(candidates).collect()}
    pairs = same_event.classify_pairs(same_event.candidate_pairs(candidates), candidates).filter("kind = 'ambiguous'").collect()
    hit = next(p for p in pairs if base[p["dst"]] == p["dst"] and base[p["src"]] == p["src"])
    verdicts = spark.createDataFrame([(hit["dst"], hit["src"])], "news_id long, seed_id long")
    got = {r["news_id"]: (r["draft_id"], r["decision_source"]) for r in same_event.greedy_drafts(candidates, verdicts).collect()}
    assert got[hit["dst"]][1] in ("llm", "seed")


def test_identity_matching_equals_turn_taking(spark):
    rng = random.Random(5)
    links = [(rng.randrange(12), i) for i in range(150)]
    members = [(rng.randrange(100, 120), i) for i in range(150)]
    updated = {c: rng.randrange(5) for c in range(12)}
    sizes = {}
    for d, _ in members:
        sizes[d] = sizes.get(d, 0) + 1
    old, want, claimed = {n: c for c, n in links}, {}, set()
    for d in sorted(sizes, key=lambda d: (-sizes[d], d)):
        shared = {}
        for dd, n in members:
            if dd == d and old[n] not in claimed:
                shared[old[n]] = shared.get(old[n], 0) + 1
        want[d] = min(shared, key=lambda c: (-shared[c], -updated[c], c)) if shared else None
        claimed.add(want[d])
    got = clustering.match_identities(
        spark.createDataFrame(members, "draft_id long, news_id long"), spark.createDataFrame(list(sizes.items()), "draft_id long, source_count long"),
        spark.createDataFrame(links, "cluster_id long, news_id long"), spark.createDataFrame(list(updated.items()), "cluster_id long, last_updated_at int"))
    assert {r["draft_id"]: r["cluster_id"] for r in got.collect()} == want


def test_watchlist_import_equals_row_by_row(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, f"s{rng.randrange(30)}"]), f"n{rng.randrange(40)}", rng.choice(["us", "us", "us", None]), "equity") for i in range(120)]
    known_s, known_n, want = {"S1", "S2"}, {"n1"}, {}
    for i, s, n, region, _ in rows:
        if not region:
            want[i] = "skipped_incomplete"
        elif s and s.upper() in known_s:
            want[i] = "skipped_symbol"
        elif n in known_n:
            want[i] = "skipped_name"
        else:
            want[i] = "imported"
            known_n.add(n)
            known_s |= {s.upper()} if s else set()
    existing = spark.createDataFrame([("s1", "x"), ("S2", "n1")], "symbol string, name string")
    got = registry.import_watchlist(spark.createDataFrame(rows, "idx int, symbol string, name string, region string, asset_class string"), existing)
    assert {r["idx"]: r["outcome"] for r in got.collect()} == want


def test_outlinks(spark):
    html = ('<a href="/2024/01/02/x">1</a><!-- <a href="/article/hidden"> --><a class=k href=\'news/a/b-c\'>2</a><a href="https://sub.ex.com/markets/y.html#f">3</a>'
            '<a href="https://other.com/article/z">4</a><a href="/article/p.pdf">5</a><a href="mailto:a@ex.com">6</a><a href="/video/article/b-c">7</a>'
            '<a href="../article/up?x=1">8</a><a href="/2024/01/02/x?again">9</a>')
    page = spark.createDataFrame([(1, "https://ex.com/section/", html)], "page_id long, url string, html string")
    got = [r["link"] for r in pages.outlinks(page).orderBy("position").collect()]
    assert got == ["https://ex.com/2024/01/02/x", "https://ex.com/section/news/a/b-c", "https://sub.ex.com/markets/y.html", "https://ex.com/article/up"]


def test_page_metadata_and_text(spark):
    ld = '<script type="application/ld+json">{"@graph": [{"@type": ["Thing"]}, {"@type": "NewsArticle", "headline": "LD &amp; title", "datePublished": "2024-01-01"}]}</script>'
    body = "Câu chuyện dài về thị trường chứng khoán. " * 3
    promo = "\nThời gian: 8h\nĐịa điểm: Hà Nội\nĐặt vé Early Bird"
    a = f'<html>{ld}<h1>H <b>one</b></h1><div class="x Ads">gone<div>too</div></div><p>kept</p></html>'
    b = f'<meta property="og:title" content="OG"><p>{body}{promo}</p>'
    df = spark.createDataFrame([(1, "https://a.com/", a), (2, "https://www.vietnambiz.vn/x", b)], "page_id long, url string, html string")
    meta = {r["page_id"]: r for r in pages.page_metadata(df).collect()}
    assert (meta[1]["title"], meta[1]["published"], meta[2]["title"]) == ("LD & title", "2024-01-01", "OG")
    texts = {r["page_id"]: r["text"] for r in pages.article_text(df).collect()}
    assert texts[1] == "H one kept" and texts[2] == body.strip()


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T &amp;amp; x</title><link>http://a/1</link><updated>2024-01-01T00:00:00Z</updated></item>"
                                    "<item><title></title><link>http://a/2</link></item></channel></rss>")
    rows = feeds.read_feed_files(spark, str(tmp_path)).collect()
    assert [(r["title"], r["url"], str(r["published_at"])) for r in rows] == [("T & x", "http://a/1", "2024-01-01 00:00:00")]


def test_page_metadata_picks_the_best_source(spark):
    def script(data, kind="application/ld+json"):
        return f'<script type="{kind}">{data}</script>'

    rows = [
        ("graph before its holder", script('{"@type": "Article", "headline": "outer", "@graph": [[{"@type": "newsarticle", "headline": ["", {"name": "inner"}]}]]}'), ("inner", "", None)),
        ("broken block is passed over", script("{no") + script('[{"@type": "Article", "headline": "second", "datePublished": 5, "dateModified": "m"}]'), ("second", "", "m")),
        ("value of an object", script('{"@type": "Article", "headline": {"name": "", "@value": "v"}, "description": 7}'), ("v", "", None)),
        ("other kinds of script", script('{"@type": "Article", "headline": "x"}', "text/plain") + "<h1> </h1><h1>A&amp;amp; <i>b</i></h1>", ("A& b", "", None)),
        ("last of equal tags, empty ones ignored", '<meta name="TITLE" content="one"><meta content=\'two > 1\' name="title"><meta name="title" content="">', ("two > 1", "", None)),
        ("attribute names inside values", '<meta name="description" content="say content=no name=title">', ("", "say content=no name=title", None)),
        ("first time with a value", "<time>x</time><time datetime=2024-05-06><time datetime=2025-01-01>", ("", "", "2024-05-06")),
        ("empty", "", ("", "", None)),
        ("null", None, ("", "", None)),
    ]
    df = spark.createDataFrame([(i, "https://a.com/", r[1]) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["title"], r["description"], r["published"]) for r in pages.page_metadata(df).collect()}
    assert {rows[i][0]: v for i, v in got.items()} == {r[0]: r[2] for r in rows}


def test_feed_shapes(spark):
    rdf = ("<rdf:RDF xmlns:rdf='r' xmlns:dc='d'><channel/><item rdf:about='u'><title>R</title><link>http://a/r</link>"
           "<dc:date>2024-01-02T00:00:00Z</dc:date></item></rdf:RDF>")
    atom = ("<feed><entry><title>A</title><link rel='self' href='http://a/self'/><link rel='alternate' href='http://a/1'/>"
            "<updated>2024-01-03T00:00:00Z</updated></entry><entry><title>B</title><link rel='self' href='http://a/2'/></entry></feed>")
    df = spark.createDataFrame([(1, rdf), (2, atom), (3, "<rss><channel/></rss>"), (4, "no feed"), (5, None)], "feed_id long, body string")
    got = {r["title"]: (r["feed_id"], r["url"], r["published_at"] and str(r["published_at"])) for r in feeds.parse_feeds(df).collect()}
    assert got == {"R": (1, "http://a/r", "2024-01-02 00:00:00"), "A": (2, "http://a/1", "2024-01-03 00:00:00"), "B": (2, "http://a/2", None)}


def test_poll_state_goes_on_after_a_restart(spark, tmp_path):
    folder, logs = str(tmp_path / "job"), str(tmp_path / "logs")
    schema = "log_id long, source_id string, status string, fetched_at timestamp_ntz, inserted int"

    def run():
        stream = spark.readStream.schema(schema).parquet(logs)
        return {r["source_id"]: r["consecutive_failures"] for r in jobs.run_poll_state(stream, folder).collect()}

    def log(*rows):
        made = spark.createDataFrame(list(rows), "log_id long, source_id string, status string, at string, inserted int")
        made.select("log_id", "source_id", "status", F.col("at").cast("timestamp_ntz").alias("fetched_at"), "inserted").coalesce(1).write.mode("append").parquet(logs)

    log()
    assert run() == {}
    log((1, "a", "failed", "2024-01-01 00:00:00", 0), (2, "b", "success", "2024-01-01 00:00:00", 1))
    assert run() == {"a": 1, "b": 0}
    assert run() == {"a": 1, "b": 0}
    log((3, "a", "failed", "2024-01-01 01:00:00", 0), (4, "b", "failed", "2024-01-01 01:00:00", 0))
    assert run() == {"a": 2, "b": 1}


def test_quote_gate_reason(spark):
    payload = spark.createDataFrame([(1, '{"universe": [{"name": "abc"}]}', '[{"markPx": "2", "prevDayPx": "1", "dayNtlVlm": "12.5"}]')],
                                    "payload_id long, universe string, contexts string")
    request = spark.createDataFrame([(1, "ABC", "abc", None)], "payload_id long, coin string, symbol string, asset_class string")
    row = quotes.gated_quotes(payload, request, "1d", 1000).first()
    assert (row["outcome"], row["reason"]) == ("skipped", "Hyperliquid instrument ABC dayNtlVlm 12.5 below 1000")


def test_a_stream_reads_a_table_of_one_file_or_of_many(spark, tmp_path):
    from newsloom.streaming import files

    spark.range(30).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(7).toPandas().to_parquet(tmp_path / "one.parquet")
    for name, want in (("many", 30), ("one", 7)):
        stream = files.stream_parquet(spark, str(tmp_path), name)
        assert files.run_to_table(stream, files.new_folder(spark, "rows")).count() == want


def test_title_ratio_is_that_of_difflib():
    rng = random.Random(11)

    def drawn(letters, most):
        return "".join(rng.choices(letters, k=rng.randrange(most)))

    pairs = [(drawn("ab c", 60), drawn("abc d", 60)) for _ in range(300)]
    pairs += [(drawn("aaaabbc xyzqwé%&", 500), drawn("aaaabbc xyzqwv&", 700)) for _ in range(60)]
    pairs += [(drawn("abc", 400), drawn("abd", 400)) for _ in range(40)]
    pairs += [(a, a[len(a) // 3:] + a[:len(a) // 2]) for a, _ in pairs[:350]] + [("", ""), ("", "a"), ("a", "")]
    assert [same_event._ratio(*p) for p in pairs] == [SequenceMatcher(None, *p).ratio() for p in pairs]


def test_judged_pairs_are_classified_pairs_without_the_similarity(spark):
    rng, words = random.Random(12), ["growth", "prices", "banks", "rally", "slump", "rates"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(4))), [f"e{j}" for j in rng.sample(range(4), rng.randrange(3))],
             [f"t{j}" for j in rng.sample(range(4), rng.randrange(2))], [rng.choice(["equity", "crypto", "global_macro"])], rng.choice(["us", "global", "vn"]))
            for i in range(40)]
    rows = same_event.with_match_sets(spark.createDataFrame(
        rows, "news_id long, title string, entities array<string>, tickers array<string>, asset_classes array<string>, region string"))
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40)], "src long, dst long")
    full = same_event.classify_pairs(pairs, rows).drop("similarity")
    got = same_event.judge_pairs(pairs, rows).select(full.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))


def test_local_evidence_finds_older_rows_stretch_by_stretch(spark, monkeypatch):
    monkeypatch.setattr(alerts, "FIRST_STRETCH", 2)
    news = spark.createDataFrame([(i, i, 90, "copper rises" if i % 7 == 0 else "quiet day", "") for i in range(60)],
                                 "news_id long, created_at int, source_score int, title string, snippet string")
    targets = spark.createDataFrame([(1, ["copper"], [], []), (2, ["quiet"], [], []), (3, ["zinc"], [], [])],
                                    "target_id long, symbols array<string>, entities array<string>, context array<string>")
    found = {(r["target_id"], r["news_id"]) for r in alerts.local_evidence(targets, news, F.lit(1), limit=4).collect()}
    assert found == {(1, 56), (1, 49), (1, 42), (1, 35), (2, 59), (2, 58), (2, 57), (2, 55)}


def test_texts_are_matched_only_for_items_without_a_stored_name(spark, monkeypatch):
    news = spark.createDataFrame([(1, "Bolt"), (2, "Acme and Bolt rise"), (3, "nothing")], "news_id long, title string").withColumn(
        "snippet", F.lit(None).cast("string"))
    mentions = spark.createDataFrame([(1, "Acme", "ACM", True), (3, None, "X", False)], "news_id long, name string, ticker string, is_primary boolean")
    watchlist = spark.createDataFrame([(7, "Acme", "ACM", "A", True, []), (8, "Bolt", "BLT", "B", True, [])],
                                      "watch_id long, name string, symbol string, tier string, enabled boolean, aliases array<string>")
    matched, read = entities.match_watchlist, []

    def watched(rows, terms):
        read.append(sorted(r["news_id"] for r in rows.collect()))
        return matched(rows, terms)

    monkeypatch.setattr(entities, "match_watchlist", watched)
    made = {r["news_id"]: (r["entities"], r["tickers"], r["primary_entities"])
            for r in entities.item_candidates(news, mentions, watchlist).collect()}
    assert made == {1: (["Acme"], ["ACM"], ["Acme"]), 2: (["Acme", "Bolt"], [], ["Acme", "Bolt"]), 3: ([], [], [])}
    assert [r["entities"] for r in entities.item_candidates(news.filter("news_id = 1"), mentions, watchlist).collect()] == [["Acme"]]
    assert read == [[2, 3]]


def test_embeddings_count_words_where_the_text_is(spark):
    bodies = {1: "Oil rises, oil rises &amp; gold", 2: "", 3: None, 4: "Straße STRASSE strasse " * 700, 5: "a"}
    rows = spark.createDataFrame(list(bodies.items()), "news_id long, content string")

    def model(body, dims=16):
        total = [0] * dims
        for word in (body or "").replace("&amp;", "&").lower().replace("ß", "ss").split():
            digest = hashlib.sha256(word.encode()).hexdigest()
            total[int(digest[:8], 16) % dims] += 1 if int(digest[9], 16) % 2 == 0 else -1
        norm = math.sqrt(sum(t * t for t in total))
        return {i: t / norm for i, t in enumerate(total) if t}

    sparse = embedding.hashing_embedding(rows, "news_id", "content", 16)
    assert "Exchange" not in sparse._jdf.queryExecution().executedPlan().toString()
    made: dict = {}
    for r in sparse.collect():
        made.setdefault(r["news_id"], {})[r["idx"]] = r["value"]
    assert made == {k: m for k, b in bodies.items() if (m := model(b))}
    dense = {r["news_id"]: list(r["vector"]) for r in embedding.dense_embedding(rows, "news_id", "content", 16).collect()}
    assert dense == {r["news_id"]: list(r["vector"]) for r in embedding.densify(sparse, "news_id", 16).collect()}
    assert dense.keys() == made.keys() and all(dense[k][i] == pytest.approx(v, rel=1e-6) for k, m in made.items() for i, v in m.items())


def test_unescaping_leaves_all_but_the_text_at_hand_in_arrow(spark):
    assert [text._each(text.pa.array(["a", None, ""]), str.upper).to_pylist()] == [["A", None, ""]]
    rows = spark.createDataFrame([("&amp;lt;b&amp;gt; ﬁ",), (None,), ("plain",)], "t string")
    assert [r["x"] for r in rows.select(text.unescape_nfkc(F.col("t")).alias("x")).collect()] == ["&lt;b&gt; fi", None, "plain"]
    assert [r["x"] for r in rows.select(text.unescape_nfkc(F.col("t"), passes=3).alias("x")).collect()] == ["<b> fi", None, "plain"]


def test_patterns_that_tell_common_characters_first_match_the_same(spark):
    points = spark.range(1, 0x110000).filter("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    wrong = (F.col("c").rlike(text.UNSAFE) != F.col("c").rlike(f"[^{text.NFKC_SAFE}]")) | (F.col("c").rlike(text.BLANK) != F.col("c").rlike(f"[{text.BLANKS}]"))
    assert points.filter(wrong).isEmpty()


def _drafts(spark, rows):
    return spark.createDataFrame(rows, "draft_id long, primary_entities array<string>, asset_classes array<string>, regions array<string>, source_count int, top_source_score int")


def _merged(spark, vectors, members, drafts, threshold):
    rows = clustering.with_drafts(vectors, members, drafts)
    edges = similarity.similar_pairs(rows, "news_id", "vector", threshold, folded=False, about="draft", choose=clustering.MergingPairs).localCheckpoint()
    return edges, {r["draft_id"]: r["merged_id"] for r in clustering.merge_drafts(members, drafts, edges).collect()}


def test_copies_merge_their_drafts_though_the_smallest_fits_with_none(spark):
    """Three equal vectors; the first one's draft shares no entity with the others, which merge."""
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in (1, 2, 3)], "news_id long, vector array<float>")
    members = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "news_id long, draft_id long")
    drafts = _drafts(spark, [(10, ["A"], ["equity"], ["us"], 1, 50), (20, ["B"], ["equity"], ["us"], 1, 50), (30, ["b"], ["equity"], ["us"], 2, 50)])
    assert _merged(spark, vectors, members, drafts, 0.9)[1] == {10: 10, 20: 30, 30: 30}


def test_chosen_pairs_merge_what_all_pairs_merge(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20)
    monkeypatch.setattr(similarity, "PIVOT_ROWS", 20)
    monkeypatch.setattr(similarity, "STRIP_ROWS", 8)
    rng = np.random.default_rng(11)
    points = rng.normal(size=(160, 6))
    points[:40] = points[0]
    vectors = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "news_id long, vector array<double>")
    members = spark.createDataFrame([(i, i // 2) for i in range(160)] + [(7, 70), (150, 3)], "news_id long, draft_id long")
    names = [None, "Reuters", *"ABCDEFGHIJKLMNOP"]
    drafts = _drafts(spark, [
        (d, None if d == 5 else [str(names[k]) for k in rng.integers(0, len(names), 2)], [str(rng.choice(["equity", "crypto", "global_macro"]))] if d % 7 else [],
         None if d % 11 == 0 else [str(rng.choice(["us", "global", "vietnam"]))], int(rng.integers(1, 5)), int(rng.integers(30, 90))) for d in range(80)])
    edges, got = _merged(spark, vectors, members, drafts, 0.8)
    every = similarity.similar_pairs(vectors, "news_id", "vector", 0.8, folded=False).localCheckpoint()
    assert got == {r["draft_id"]: r["merged_id"] for r in clustering.merge_drafts(members, drafts, every).collect()}
    assert 1 < len(set(got.values())) < 80 and edges.count() < every.count() / 3


def test_moves_meet_events_by_symbol_and_stretch_of_time(spark, tmp_path):
    """Edges of the window and null symbols; and no row meets all rows of its symbol."""
    start, hour = datetime(2024, 1, 1), timedelta(hours=1)
    moves = [(i, f"S{i % 2}", start + i * hour / 2) for i in range(80)] + [(80, None, start), (81, "S0", start + 200 * hour)]
    events = [(100 + i, f"S{i % 2}", start + i * 7 * hour) for i in range(8)] + [(200, None, start), (201, "S1", start + 10 * hour), (202, "S9", start + 200 * hour)]
    spark.createDataFrame(moves, "move_id long, symbol string, ts timestamp").write.parquet(str(tmp_path / "moves.parquet"))
    spark.createDataFrame(events, "cluster_id long, symbol string, created_at timestamp").write.parquet(str(tmp_path / "events.parquet"))

    def joined(before, after):
        left, right = (files.stream_parquet(spark, str(tmp_path), n) for n in ("moves", "events"))
        return jobs.moves_with_events(left, right, "1 hour", timedelta(hours=before), timedelta(hours=after))

    for before, after in ((2, 2), (4, 24), (0, 0)):
        rows = files.run_to_table(joined(before, after), str(tmp_path / f"out{before}{after}")).collect()
        want = {(m, c) for m, s, at in moves for c, t, made in events if s is not None and s == t and at - before * hour <= made <= at + after * hour}
        assert sorted((r["move_id"], r["cluster_id"]) for r in rows if r["cluster_id"] is not None) == sorted(want)
        closed = start + 199 * hour
        assert {r["move_id"] for r in rows if r["cluster_id"] is None} == {m for m, _, at in moves if at + after * hour < closed} - {m for m, _ in want}
    keys = joined(4, 24)._jdf.queryExecution().analyzed().toString()
    assert re.search(r"Join LeftOuter.*_stretch#\d+L? = _event_stretch#\d+", keys)


def test_local_evidence_meets_no_more_than_blocks_and_slices(spark, monkeypatch):
    """Many blocks, slices and held sums give what one of each does; terms inside words, with blanks and of odd blanks count."""
    rng = random.Random(8)
    words = ["oil", "turmoil", "north", "sea", "n1", "n12", "acme", "ab", "x", "über", "far east"]
    news = spark.createDataFrame([(i, i // 3, rng.choice([None, 40, 95]), " ".join(rng.choices(words, k=5)), rng.choice([None, "a b  c", "oil rig"]))
                                  for i in range(90)], "news_id long, created_at int, source_score int, title string, snippet string")
    targets = spark.createDataFrame(
        [(t, rng.choices(["n1", "x", " ", " ", None], k=2), rng.choices(["far east", "north sea", "Über", "b  c"], k=2), rng.choices(words, k=7)) for t in range(25)],
        "target_id long, symbols array<string>, entities array<string>, context array<string>")

    def found(limit):
        return sorted(tuple(r) for r in alerts.local_evidence(targets, news, F.lit(0), limit=limit).collect())

    rows = {r["news_id"]: (r, f"{r['title']} {r['snippet'] or ''}".lower()) for r in news.collect()}
    want = []
    for t in targets.collect():
        for r, body in rows.values():
            hits = [sum(v is not None and v.strip(" ") != "" and v.lower() in body for v in t[k]) for k in ("symbols", "entities", "context")]
            score = min(10, (r["source_score"] or 0) // 10) + 20 * hits[0] + 25 * hits[1] + min(30, 5 * hits[2])
            if any(hits) and score >= 30:
                want.append((t["target_id"], r["news_id"], score))
    assert found(None) == sorted(want)
    monkeypatch.setattr(alerts, "FIRST_STRETCH", 10)
    one = found(4)
    for name, value in (("BLOCK_TERMS", 40), ("SLICE_ROWS", 7), ("HELD_SUMS", 60), ("KNOWN_WORDS", 3)):
        monkeypatch.setattr(alerts, name, value)
    assert found(4) == one and one


def test_placement_leaves_only_its_last_state(spark, monkeypatch):
    """States of earlier rounds, links and blocks are removed; what was given stays."""
    import os

    from newsloom.plans.lineage import checkpoint_folder, cut_sized

    rows, candidates = make_candidates(spark, 16, 1, 1)
    monkeypatch.setattr(same_event, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(same_event, "BLOCK_LINKS", 12)
    given = cut_sized(candidates)
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("copy-")}
    placed = same_event.greedy_drafts(given)
    after = {f for f in os.listdir(folder) if f.startswith("copy-")}
    assert before <= after and len(after - before) == 1
    assert {r["news_id"]: r["draft_id"] for r in placed.collect()} == greedy_model(rows)


def test_repeated_ids_of_evidence_share_their_texts(spark):
    news = spark.createDataFrame([(1, 5, 90, "acme oil", None), (1, 5, 90, "acme oil", None), (2, 4, 90, "acme rig", None)],
                                 "news_id long, created_at int, source_score int, title string, snippet string")
    targets = spark.createDataFrame([(7, [], [], ["acme", "oil", "rig", "absent"]), (8, ["acme"], [], [])],
                                    "target_id long, symbols array<string>, entities array<string>, context array<string>")
    found = sorted(tuple(r) for r in alerts.local_evidence(targets, news, F.lit(0), limit=5).collect())
    assert found == [(8, 1, 49), (8, 1, 49), (8, 2, 29)]
