"""The operators that return whole documents: clashing names, shared ids, equal results of reruns."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import exact_dedup, mixing, pieces, simhash, tables, toxicity
from tests.llm.helpers import documents, sample_rows
from tests.llm.test_operators import components, plain_fingerprint

HELPERS = ("__id", "__nth", "__copy", "__keep", "__copies", "__rows", "__digest", "key_0", "rows_of_key", "order_in_key", "marked_0", "place_in_key",
           "id_of_row", "copies", "rows", "order_of_row", "nth_of_id", "copy", "n", "id", "fp", "digest", "kept", "ids", "decoded", "n_byte_pieces")


def with_helpers(docs):
    """``docs`` with a column of each name the operators might use, all with a value of the row."""
    return docs.withColumns({name: F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for name in HELPERS})


def untouched(rows):
    return all(r[name] == f"{name}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for name in HELPERS)


def unrelated(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


ROWS = [(5, unrelated(1), "a"), (5, unrelated(2), "a"), (9, unrelated(1) + " tail", "a"), (12, unrelated(2), "b"), (None, unrelated(3), "b"),
        (None, unrelated(3), "b"), (7, "", "a"), (7, None, "a"), (7, "", "a"), (20, unrelated(4), None), (20, unrelated(4), None)]


def test_simhash_keeps_unrelated_texts_of_one_id(spark):
    docs = with_helpers(documents(spark, ROWS))
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_groups(docs).collect() if r["doc_id"] is not None}
    fps = sorted({plain_fingerprint(t) for i, t, _ in ROWS if i is not None})
    low = components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    lowest = {}
    for i, t, _ in ROWS:
        if i is not None:
            of = low[plain_fingerprint(t)]
            lowest[of] = min(i, lowest.get(of, i))
    assert got == {(i, f"{plain_fingerprint(t):016x}"): lowest[low[plain_fingerprint(t)]] for i, t, _ in ROWS if i is not None}
    kept = simhash.drop_near_copies(docs).collect()
    assert untouched(kept) and len([r for r in kept if r["doc_id"] is None]) == 2
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(lowest.values())
    # no text is gone without a near one that stays
    left = [plain_fingerprint(r["text"]) for r in kept if r["doc_id"] is not None]
    assert {low[f] for f in left} == set(low.values()) and len(left) == len(set(low.values()))
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []


def test_exact_dedup_keeps_other_columns(spark):
    docs = with_helpers(documents(spark, ROWS))
    kept = exact_dedup.drop_copies(docs).collect()
    assert untouched(kept) and len(kept) == len({t or "" for _, t, _ in ROWS})
    assert {r["text"] or "" for r in kept} == {t or "" for _, t, _ in ROWS}


def test_mix_keeps_other_columns_and_counts(spark):
    rows = ROWS + [(30 + i, t, s) for i, t, s in sample_rows(40)]
    docs = with_helpers(documents(spark, rows))
    mixed = mixing.mix(docs)
    want = {}
    for r in mixed.collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    taken, got = mixing.take(docs, mixed).collect(), {}
    for r in taken:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert untouched(taken) and got == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("stage", ["exact", "near", "take"])
def test_reruns_pick_the_same_rows(spark, stage):
    """Rows with one id and equal texts up to white space; only an extra column tells which one stays."""
    rows = [(i % 4, f"same  text {i % 2}" if i % 3 else f"same text {i % 2}", f"s{i}") for i in range(40)]

    def run(order):
        docs = documents(spark, [rows[k] for k in order]).repartition(1 + len(order) % 3)
        made = {"exact": exact_dedup.drop_copies, "near": simhash.drop_near_copies, "take": lambda d: mixing.take(d, mixing.mix(d))}[stage](docs)
        return sorted((r["doc_id"], r["text"], r["source"]) for r in made.collect())

    order = list(range(40))
    first = run(order)
    random.Random(2).shuffle(order)
    assert run(order) == first


def test_pieces_rename_clashing_columns(spark):
    docs = with_helpers(documents(spark, ROWS))
    encoded = pieces.encode_pieces(docs, keep=("doc_id", "ids", "decoded", "text"))
    assert encoded.columns == ["doc_id", "ids_", "decoded", "text", "ids"]
    decoded = pieces.decode_pieces(encoded)
    assert decoded.columns == ["doc_id", "ids_", "decoded_", "text", "ids", "decoded", "n_byte_pieces"]
    for r in decoded.collect():
        assert r["decoded"] == (r["text"] or "") and r["ids_"] == f"ids:{'none' if r['doc_id'] is None else r['doc_id']}"


def test_fresh_names(spark):
    df = spark.range(1).toDF("n").withColumn("_N", F.lit(1))
    assert tables.fresh_names(df, "n", "m", "m") == ["__n", "m", "_m"]


def test_toxicity_takes_one_text_per_id_and_all_features(spark):
    words = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + (k * 7) % 26)}qu" for k in range(600)]
    rows = [(i, " ".join(words[(i * 7 + k) % 600] for k in range(150)) if i % 2 else "calm harbour day", "a") for i in range(400)]
    docs = documents(spark, rows + [(1, f"copy {k}", "a") for k in range(50)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, toxic int, quality int")
    sample = toxicity._sample(docs, labels, "doc_id", "text", 1000)
    assert sample.count() == sample.select("id").distinct().count()
    weights = toxicity.train(docs, labels).weights
    assert len(weights) > 512 and not set(weights) & {"calm", "harbour", "day"}
