"""The WARC archive, the Merkle manifest and the filter audit against brute force."""

import base64
import hashlib
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from newsloom.llm import audit, manifest, warc
from tests.llm.helpers import DOC, documents, sample_rows

PAGE = "page_id long, url string, html string, payload string, address string, record int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash", 1) for i, u, h in rows], PAGE)


def sample_pages():
    rows = [(k, f"https://x.example/{k}", f"<p>{'page' if k % 4 else 'copy'} {k if k % 4 else 0}</p>") for k in range(40)]
    return rows + [(100, None, None), (101, "https://x.example/\r\nSet: 1", ""), (None, "https://x.example/n", "<p>copy 0</p>"),
                   (102, "u", "é日本\r\n\r\nWARC/1.1\r\n"), (103, "v", "x" * 300_000), (104, "w", "x" * 300_000), (7, "again", "<p>page 7</p>")]


def plain_archive(rows, least=0):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        top = max(same, default=None)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = len(body) >= least and i != top
        out.append((i, len(body), digest, "revisit" if revisit else "response", top if revisit else None))
    return out


def by_text(rows):
    return sorted(rows, key=repr)


def test_archive_against_brute_force(spark):
    rows = sample_pages()
    unique = [r for r in rows if r[1] != "again"]
    assert by_text(map(tuple, warc.archived(pages(spark, unique)).collect())) == by_text(plain_archive(unique))
    kept = warc.archived(pages(spark, unique), revisit_from=14).collect()
    assert by_text(map(tuple, kept)) == by_text(plain_archive(unique, 14))


def test_archive_of_rows_that_repeat_an_id(spark):
    rows = [(7, "a", "same"), (7, "b", "same"), (7, "c", "same"), (7, "d", "other"), (None, "e", "none"), (None, "f", "none")]
    got = warc.archived(pages(spark, rows)).collect()
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got) == sorted(
        [(7, "response", None), (7, "response", None), (7, "revisit", 7), (7, "revisit", 7), (-1, "response", None), (-1, "revisit", None)], key=repr)


def test_archive_keeps_exact_records(spark, tmp_path):
    rows = sample_pages()
    archive = warc.write_archive(pages(spark, rows), str(tmp_path / "archive"))
    payloads = spark.read.parquet(archive.payloads).collect()
    assert sorted(zlib.decompress(p["packed"]) for p in payloads) == sorted({(h or "").encode() for _, _, h in rows})
    assert all(hashlib.sha256(zlib.decompress(p["packed"])).hexdigest() == p["address"] for p in payloads)
    records = warc.read_archive(spark, archive).collect()
    assert len(records) == len(rows) and len({r["record_id"] for r in records}) == len(rows)
    assert sorted(bytes(r["payload"]) for r in records) == sorted((h or "").encode() for _, _, h in rows)
    responses = {r["record_id"]: bytes(r["payload"]) for r in records if r["record_type"] == "response"}
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert block.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(block) - 4
        assert ("WARC-Refers-To" in fields) == (r["record_type"] == "revisit")
        if r["record_type"] == "revisit":
            assert responses[fields["WARC-Refers-To"]] == bytes(r["payload"])
        else:
            assert block[:-4].partition(b"\r\n\r\n")[2] == bytes(r["payload"])
    assert {r["url"] for r in records} >= {None, "https://x.example/%0D%0ASet: 1"}


def test_damaged_payload_stops_reading(spark, tmp_path):
    archive = warc.write_archive(pages(spark, sample_pages()[:5]), str(tmp_path / "archive"))
    broken = str(tmp_path / "broken")
    stored = spark.read.parquet(archive.payloads)
    swapped = stored.agg(F.min("packed").alias("packed")).crossJoin(stored.select("address"))
    swapped.select("address", "packed").write.parquet(broken)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, warc.Archive(archive.headers, broken)).collect()


def test_archive_of_a_hot_payload_and_of_nothing(spark):
    rows = [(k, None, "hot" if k % 3 else f"own {k}") for k in range(300)]
    assert by_text(map(tuple, warc.archived(pages(spark, rows)).collect())) == by_text(plain_archive(rows))
    assert warc.archived(pages(spark, [])).collect() == []


# --- manifest ---------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def fold(nodes, at, digest=None):
    """Root of a list, proof of node ``at``, and the root after replacing that node."""
    proof, now = "", nodes[at] if digest is None else digest
    while len(nodes) > 1:
        run = at - at % 3
        before, after = "".join(nodes[run:at]), "".join(nodes[at + 1:run + 3])
        proof, now = proof + before + after, sha(before + now + after)
        nodes, at = [sha("".join(nodes[k:k + 3])) for k in range(0, len(nodes), 3)], at // 3
    return nodes[0], proof, now


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0], leaf_of(*row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subroots = [fold([leaf for _, leaf, _ in trees[s]], 0)[0] for s in order]
    out = []
    for at, s in enumerate(order):
        leaves = [leaf for _, leaf, _ in trees[s]]
        for k, (doc_id, leaf, (_, source, lang, n_chars, text)) in enumerate(trees[s]):
            now = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                now = leaf_of(doc_id, source, lang, n_chars, None if text is None else text.replace("\n", ""))
            subroot, low, top = fold(leaves, k, now)
            root, high, folded = fold(subroots, at, top)
            out.append((doc_id, leaf, subroot, root, sha(low + high), folded, folded == root))
    return by_text(out)


def manifest_rows(spark, rows, height=manifest.LEVELS):
    docs = spark.createDataFrame([(i, t, lang, s, n, "x", 1, "y") for i, s, lang, n, t in rows], DOC + ", leaf string, position int, tree string")
    got = manifest.verify(docs, height=height).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return by_text(map(tuple, got.collect()))


def manifest_sample():
    rows = [(i, s, None if i % 7 == 3 else "en", None if i % 5 == 2 else len(t or ""), None if t is None else t.replace(" ", "\n", i % 4))
            for i, t, s in sample_rows(90)]
    return rows + [(500, "", "en", 1, "a\nb"), (501, "ü", "en", 1, "c\n"), (502, "z", "en", 1, "\n" * 5), (503, "big", "en", 9, "w\n" * 200_000)]


def test_manifest_against_brute_force(spark):
    rows = manifest_sample()
    got = manifest_rows(spark, rows)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_of_many_blocks(spark, height):
    """Small blocks: several tiers inside a source and above the sources."""
    rows = [(i, f"s{i % 11 if i % 3 else 0}", "en", i, f"text\n{i}") for i in range(200)] + [(1000 + i, f"t{i}", "en", i, "x\ny") for i in range(20)]
    assert manifest_rows(spark, rows, height) == plain_manifest(rows)


def test_manifest_of_a_hot_source_over_blocks(spark):
    rows = [(i, "hot", "en", i, f"a\n{i}") for i in range(3 * 729 + 17)] + [(9000 + i, f"s{i:02d}", "en", i, "b\n") for i in range(30)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_ties_and_missing_ids(spark):
    rows = [(5, "s", "en", 1, "a\n"), (5, "s", "en", 1, "b\n"), (5, "s", "en", 1, "b\n"), (None, "s", "en", 1, "c\n"), (None, "s", None, None, None),
            (None, None, None, None, None), (None, None, None, None, None)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)
    assert manifest_rows(spark, [(1, "s", "en", 1, "a\nb")]) == plain_manifest([(1, "s", "en", 1, "a\nb")])
    assert manifest_rows(spark, []) == []


def test_versions_copy_only_their_path(spark):
    rows = [(i, "s", "en", 1, "a\nb") for i in range(100)]
    docs = spark.createDataFrame([(i, t, lang, s, n) for i, s, lang, n, t in rows], DOC)
    copied = {r["doc_id"]: r["copied_nodes"] for r in manifest.verify(docs).collect()}
    # 100 leaves need five levels of runs of three
    assert set(copied.values()) == {0, 6}
    assert all((n > 0) == (zlib.crc32(str(i).encode()) % 2 == 0) for i, n in copied.items())


# --- filter audit -----------------------------------------------------------------------------

WHITE = "\t\n\x0b\x0c\r "


def plain_fails(text, doc_id, lowest):
    words = [w for w in "".join(" " if c in WHITE else c for c in text).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return {f for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text),
                                          any(c in "#$%&*|" for c in text), doc_id is not None and lowest is not None and doc_id > lowest), strict=True) if bad}


def plain_interactions(rows, labels):
    lowest, good, toxic = {}, set(), set()
    for i, text, _ in rows:
        if i is not None:
            lowest[text or ""] = min(i, lowest.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    parts = {}
    for i, text, source in rows:
        parts.setdefault(source or "", []).append((i, plain_fails(text or "", i, lowest.get(text or ""))))
    out = []
    for part, members in parts.items():
        made, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                removed = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(removed)
                failing = sum(f in m[1] for m in members)
                made.append((part, "".join(order), step, len(left), len(removed), failing - len(removed), sum(m[1] == {f} for m in members),
                             sum(m[0] in good for m in removed), sum(m[0] in toxic for m in removed), f))
        out += [(*row[:-1], shapley[row[-1]]) for row in made]
    return by_text(out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(spark, rows, labels):
    said = spark.createDataFrame([(i, q, t, "x") for i, q, t in labels], "doc_id long, quality int, toxic int, part string")
    docs = documents(spark, rows).withColumns({"mask": F.lit("x"), "hash": F.lit(1), "segment": F.lit(2), "part": F.lit("y")})
    return by_text(map(tuple, audit.interactions(docs, said).select(*COLUMNS).collect()))


def audit_rows():
    rows = [(i, (t or "") + " ".join(f"w{k % (31 if i % 2 else 400)}" for k in range(i % 3 * 150)) + ("$" if i % 5 == 1 else "") + "ABC" * (i % 4 == 2) * 5,
             s) for i, t, s in sample_rows(80)]
    rows += [(200 + k, rows[k][1], "s1" if k % 2 else "") for k in range(0, 40, 3)]
    return rows + [(300, None, None), (301, "", "s0"), (302, "word " * 30_000, "s2"), (303, "A\x85B c", "s0"), (304, " \t\n", "s0")]


def test_audit_against_brute_force(spark):
    rows = audit_rows()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 310, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, rows, labels) == plain_interactions(rows, labels)


def test_audit_of_repeated_ids_and_missing_ids(spark):
    rows = [(5, "same", "a"), (5, "same", "a"), (5, "other", "b"), (7, "same", "b"), (None, "same", "a"), (None, "lone", "a"), (None, "lone", None),
            (8, "lone", "")] + [(None, "same", "a")] * 30
    assert audited(spark, rows, [(5, 1, 0), (7, 1, 1)]) == plain_interactions(rows, [(5, 1, 0), (7, 1, 1)])


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == []
    assert audited(spark, [(1, "x", "s")], []) == plain_interactions([(1, "x", "s")], [])


def test_sketch_clears_only_unique_texts(spark):
    values = [k % 700 for k in range(1000)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v long").select("id", "v", F.xxhash64("v").alias("hash"))
    segments = audit.segments_for(rows.count())
    marked = {r["id"] for r in audit.may_repeat(rows, audit.sketch(rows, segments), segments).collect()}
    repeated = {k for k, v in enumerate(values) if values.count(v) > 1}
    assert repeated <= marked
    assert len(marked - repeated) < 0.2 * (len(values) - len(repeated))
    assert audit.segments_for(10**15) == audit.MOST_SEGMENTS
