"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.llm.helpers import DOC, sample_rows
from tests.llm.test_operators import components, plain_fingerprint


def test_registered():
    assert {"pipeline", *(n for n in queries() if n.startswith("op"))} <= set(queries())
    assert sum(n.startswith("op") and n[2].isdigit() for n in queries()) == 13 and "pipeline" not in oracle_sql()


def test_stages(spark, tmp_path):
    rows = [(i, t if t is None or i % 6 else t + " grubber here", "en", s, 0) for i, t, s in sample_rows(240)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("grubber" in (t or ""))) for i, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sentence_pieces":
            assert docs.columns == before.columns
        seen.append({r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()})
    clean, unique, apart, mixed = ({i: t for i, t in s.items()} for s in seen[1:5])
    assert all("grubber" not in (t or "") for t in clean.values()) and len(clean) > 150
    assert {i for i, t, *_ in rows if "grubber" not in (t or "")} == set(clean)
    first = {}
    for i in sorted(clean):
        first.setdefault(" ".join((clean[i] or "").split(" ")), i)
    assert set(unique) <= set(clean) and len({t or "" for t in unique.values()}) == len(unique)
    fp = {i: plain_fingerprint(t) for i, t in unique.items()}
    low = components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert set(apart) == set(low.values())
    assert set(mixed) <= set(apart)
    last = docs.collect()
    assert max(Counter(r["doc_id"] for r in last).values()) <= 2 and all(r["n_tokens"] == len(r["ids"]) for r in last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)
