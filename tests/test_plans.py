"""Plan helpers against brute force, with one key holding a large share of the rows."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.plans import components, intervals, similarity
from newsloom.plans.components import connected_components
from newsloom.plans.keys import flag_first, number_rows, previous_window_mean, spread


def test_number_rows_is_a_total_order(spark):
    values = random.Random(1).sample(range(10_000), 500)
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r["v"]: r["n"] for r in number_rows(rows, (F.col("v").desc(),), "n").collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(values, reverse=True))}


def test_flag_first_with_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", rng.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, t int")
    got = {r["id"] for r in flag_first(df, ["k"], (F.col("t"), F.col("id")), "id", "first").filter("first").collect()}
    best = {}
    for i, k, t in rows:
        best[k] = min(best.get(k, (t, i)), (t, i))
    assert got == {i for _, i in best.values()}


def test_previous_window_mean_crosses_spans(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), p, rng.randrange(1000)) for p in range(1, 200) for _ in range(rng.randrange(3))]
    df = spark.createDataFrame(rows, "k string, p long, v int").withColumn("id", F.monotonically_increasing_id())
    got = previous_window_mean(df, ["k"], "p", "v", 20, "m", span=25).collect()
    assert len(got) == len(rows)
    for r in got:
        prior = [v for k, p, v in rows if k == r["k"] and r["p"] - 20 <= p < r["p"]]
        assert r["m_n"] == len(prior)
        assert r["m"] == (sum(prior) // len(prior) if prior else None)


def test_components_of_chain_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 400), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 0 for i in range(31)} | {100 + i: 100 for i in range(40)} | {400: 400, 500: 400}
    assert got == want


def _clouds(n, dims=8, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    points = centres[rng.integers(0, 6, n)] + 0.25 * rng.normal(size=(n, dims))
    points[: n // 3] = points[0]  # a third of the rows are copies
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _vectors(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")


def test_similar_pairs_are_exact_and_fold_copies(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 15)
    monkeypatch.setattr(similarity, "PIVOT_ROWS", 10)
    points = _clouds(120)
    got = {(r["src"], r["dst"]) for r in similarity.similar_pairs(_vectors(spark, points), "id", "v", 0.9).collect()}
    copies = range(1, 40)
    distinct = [0, *range(40, 120)]
    cosines = points @ points.T
    want = {(0, c) for c in copies} | {(a, b) for a in distinct for b in distinct if a < b and cosines[a, b] >= 0.9}
    assert got == want


def test_nearest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 15)
    monkeypatch.setattr(similarity, "PIVOT_ROWS", 10)
    queries, corpus = _clouds(40, seed=5), _clouds(90, seed=6)
    found = similarity.nearest(_vectors(spark, queries), "id", "v", _vectors(spark, corpus), "id", "v", 7).collect()
    cosines = queries @ corpus.T
    for q in range(40):
        got = sorted((r["cosine"] for r in found if r["query"] == q), reverse=True)
        assert np.allclose(got, np.sort(cosines[q])[::-1][:7])


def test_vectors_without_clusters_stay_in_bounded_blocks(spark, monkeypatch):
    """Random vectors: nothing can be pruned, yet a row is sent once per block and not once per pivot."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 40)
    monkeypatch.setattr(similarity, "PIVOT_ROWS", 1)
    monkeypatch.setattr(similarity, "BLOCK_VALUES", 16 * 50)
    monkeypatch.setattr(similarity, "STRIP_ROWS", 16)
    points = np.random.default_rng(9).normal(size=(300, 16))
    points /= np.linalg.norm(points, axis=1)[:, None]
    cosines = points @ points.T
    rows = _vectors(spark, points)
    sent, deal = [], similarity._dealt
    monkeypatch.setattr(similarity, "_dealt", lambda df, *keys: sent.append(df) or deal(df, *keys))
    got = {(r["src"], r["dst"]): r["cosine"] for r in similarity.similar_pairs(rows, "id", "v", 0.3).collect()}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if cosines[i, j] >= 0.3}
    assert got.keys() == want and all(abs(c - cosines[p]) < 1e-9 for p, c in got.items())
    blocks = [r["count"] for r in sent[0].groupBy("lo", "hi").count().collect()]
    assert max(blocks) <= 2 * 70 and sum(blocks) <= 300 * 20
    found = similarity.nearest(rows, "id", "v", rows, "id", "v", 5).collect()
    for q in range(300):
        near = sorted((r["rank"], r["neighbour"]) for r in found if r["query"] == q)
        assert [n for _, n in near] == sorted(range(300), key=lambda j: (-cosines[q, j], j))[:5]


def test_vectors_with_infinite_or_missing_parts_match_nothing(spark):
    bad = [[float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], [None, 1.0]]
    rows = spark.createDataFrame([*enumerate(bad), (7, [1.0, 1.0]), (8, [1.0, 0.9])], "id long, v array<double>")
    assert [(r["src"], r["dst"]) for r in similarity.similar_pairs(rows, "id", "v", -1.0).collect()] == [(7, 8)]
    found = similarity.nearest(rows, "id", "v", rows, "id", "v", 9).collect()
    assert {(r["query"], r["neighbour"]) for r in found} == {(7, 7), (7, 8), (8, 7), (8, 8)}


def test_best_in_group_with_hot_group(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 12)
    points = _clouds(80, seed=7)
    groups = [0 if i < 30 else i % 9 + 1 for i in range(80)]
    rows = spark.createDataFrame([(g, i, [float(x) for x in p]) for i, (g, p) in enumerate(zip(groups, points))], "g int, id long, v array<double>")
    got = {r["id"]: r["best_cosine"] for r in similarity.best_in_group(rows, "g", "id", "v").collect()}
    for i in range(80):
        others = [points[i] @ points[j] for j in range(80) if j != i and groups[j] == groups[i]]
        assert abs(got[i] - max(others)) < 1e-9


def _timed(spark, seed, left=60, right=400):
    """Intervals and instants, two thirds of the instants of one key, many of them equal."""
    rng, start = random.Random(seed), datetime(2024, 1, 1)

    def when(days):
        return start + timedelta(seconds=rng.randrange(int(days * 86400)), microseconds=rng.choice([0, 0, 250_000, 999_999]))

    lows = [(i, "hot" if i % 2 else rng.choice("ab"), when(4)) for i in range(left)]
    spans = [timedelta(0), timedelta(seconds=1), timedelta(milliseconds=300), timedelta(seconds=9), timedelta(minutes=7), timedelta(hours=28), timedelta(days=9)]
    rows = [(i, k, t, t + rng.choice(spans)) for i, k, t in lows]
    same = when(4)
    points = [(j, "hot" if j % 3 else rng.choice("abc"), same if j % 5 == 0 else rng.choice([t for _, _, t in lows]) if j % 5 == 1 else when(8), rng.randrange(1000), j % 2)
              for j in range(right)]
    return (rows, points, spark.createDataFrame(rows, "row long, k string, lo timestamp_ntz, hi timestamp_ntz"),
            spark.createDataFrame(points, "id long, k string, ts timestamp_ntz, v int, part int"))


@pytest.mark.parametrize("largest", [True, False])
def test_interval_extreme_equals_brute_force(spark, largest):
    rows, points, left, right = _timed(spark, 1)
    found = intervals.interval_extreme(left, right, row_id=["row"], keys=["k"], low=F.col("lo"), high=F.col("hi"), right_ts="ts", value=F.col("v"),
                                       largest=largest, out="best", right_group=["part"])
    want = {}
    for i, k, lo, hi in rows:
        for _, kk, ts, v, part in points:
            if k == kk and lo <= ts <= hi:
                want[i, part] = (max if largest else min)(v, want.get((i, part), v))
    assert want and {(r["row"], r["part"]): r["best"] for r in found.collect()} == want


def test_stretches_are_few_and_cover_each_second_once(spark):
    rng = random.Random(9)
    spans = [(a, a + n) for n in (-1, 0, 1, 6, 7, 8, 63, 64, 65, 3600, 100_800, 400_000) for a in (0, 1, 7, 8, 63, 1_700_000_000 + rng.randrange(10**6))]
    got = spark.createDataFrame(spans, "a long, b long").select("a", "b", intervals._stretches(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        pieces = sorted((s["at"] * 8 ** s["level"], (s["at"] + 1) * 8 ** s["level"]) for s in r["s"])
        assert len(pieces) <= 2 * 7 * 6 + 2
        assert [p[0] for p in pieces[1:]] == [p[1] for p in pieces[:-1]]
        assert (pieces[0][0], pieces[-1][1]) == (r["a"], r["b"] + 1) if r["b"] >= r["a"] else not pieces


def test_interval_join_equals_brute_force_with_a_hot_key(spark):
    rows, points, left, right = _timed(spark, 2)
    found = intervals.interval_join(left, right, keys=["k"], low=F.col("lo"), high=F.col("hi"), right_ts="ts")
    want = sorted((i, j) for i, k, lo, hi in rows for j, kk, ts, _, _ in points if k == kk and lo <= ts <= hi)
    assert want and sorted((r["row"], r["id"]) for r in found.collect()) == want
    assert set(found.columns) == {"row", "k", "lo", "hi", "id", "ts", "v", "part"}


def test_moved_edges_are_joined_once_per_pair_of_ends(spark, monkeypatch):
    sizes, joined = [], components.join_hot

    def watched(many, few, key):
        if key == "dst":
            sizes.append(many.count())
        return joined(many, few, key)

    monkeypatch.setattr(components, "join_hot", watched)
    edges = spark.createDataFrame([(a, b) for a in range(40) for b in range(a)], "src long, dst long")
    assert {tuple(r) for r in components.connected_components(edges).collect()} == {(n, 0) for n in range(40)}
    assert max(sizes) < 40  # of 780 edges


def test_components_of_many_rounds_have_a_real_size(spark, capsys):
    """Each join multiplies the sizes that Spark estimates; kept from round to round they had thousands of digits."""
    chain = spark.createDataFrame([(n * 7919 % 1000, (n + 1) * 7919 % 1000) for n in range(999)], "src long, dst long")
    found = connected_components(chain)
    assert {tuple(r) for r in found.collect()} == {(n, 0) for n in range(1000)}
    found.explain(mode="cost")
    text = capsys.readouterr().out
    assert "sizeInBytes=" in text and "E+" not in text


def test_long_work_on_few_keys_is_dealt_in_waves(spark):
    rows = spark.range(26).withColumnRenamed("id", "block")
    held = [spread(rows, "block", **more).groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0] for more in ({}, {"waves": 4})]
    assert held[1] < held[0]


def test_similar_pairs_without_folding_are_all_pairs(spark, monkeypatch):
    """Copies pair with each other and with all that is near them; rows of one id never pair."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 15)
    monkeypatch.setattr(similarity, "PIVOT_ROWS", 10)
    monkeypatch.setattr(similarity, "BATCH_PAIRS", 100)
    points = _clouds(120)
    ids = [*range(118), 117, 3]
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in zip(ids, points)], "id long, v array<double>")
    got = Counter((r["src"], r["dst"]) for r in similarity.similar_pairs(rows, "id", "v", 0.9, folded=False).collect())
    cosines = points @ points.T
    want = Counter((min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(120) for j in range(i) if cosines[i, j] >= 0.9 and ids[i] != ids[j])
    assert got == want
