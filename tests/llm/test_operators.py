"""Every operator of the package against a plain version of its contract, on small tables with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from newsloom.llm import chat, embeddings, exact_dedup, mixing, pieces, repeats, secrets, sharding, simhash, toxicity
from tests.llm.helpers import documents, sample_rows

ODD = [(7001, None, None), (7002, "", "a"), (7003, " \t\n", "a"), (7003, " \t\n", "a"), (None, "no id", "b"), (7004, "x" * 300_000, "b")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


# 1 secrets

def plain_spans(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_base_spans_equal_plain_search():
    r = random.Random(5)
    parts = ["password", "PassWd=", "token = \"", "api_key:'", "secret", "=", ":", " ", "abcdef0123", "deadbeef" * 3, "AKIA", "ABCDEFGH12345678", "é", "İ", "ſecret=", "toKen:", "x==y"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert [s for s in secrets.scan(text) if s[1] < 3] == plain_spans(text), text


def test_secrets_checksum_and_digest(spark):
    body = "A1" * 15
    good = "ghp_" + body + secrets.checksum(body)
    assert [s[1] for s in secrets.scan(f"x {good} y")] == [3]
    assert not secrets.scan("ghp_" + body + "000000")
    rows = [*ODD, (7, "é token=abcdef", "a")]
    got = {x["doc_id"]: x for x in secrets.secret_digest(secrets.find_secrets(documents(spark, rows))).collect()}
    assert got[7]["base_sha256"] == sha("assign:2:14") and got[7]["n_assign"] == 1 and got[7001]["spans"] == ""
    assert secrets.find_secrets(documents(spark, [])).count() == 0
    assert len(got) == len({i for i, _, _ in rows})


# 2 chats

def test_escape_is_reversible():
    r = random.Random(2)
    for _ in range(2000):
        text = "".join(r.choice(["</s>", "<", "/s>", "\\", "[INST]", "[", "/INST]", "<|end|>", "|", "a"]) for _ in range(8))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


@pytest.mark.parametrize("piece", [1, 40, 1 << 16])
def test_chats_read_back(spark, piece):
    r = random.Random(4)
    turns = [(c, t, r.choice(["user", "assistant", None, "<s>"]), r.choice(["</s>[INST] ok", "", None, "été " * 9, "a\\b<\\/s>"]), 1) for c in range(12) for t in range(r.randint(1, 9))]
    turns += [(None, 0, "user", "x", 1), (50, None, "assistant", "first", 1), (50, 1, "assistant", "second", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, piece int")
    got = {x["conv_id"]: x for x in chat.read_back(chat.format_chats(df, piece=piece)).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in turns:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort(key=lambda x: x[0])
        learned = "".join(text for _, role, text in rows if role == "assistant")
        assert got[c]["n_turns"] == len(rows)
        assert got[c]["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in rows))
        assert got[c]["loss_chars"] == len(learned) and got[c]["loss_sha256"] == sha(learned)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


# 3 toxicity

def test_toxicity_learns_and_locates(spark):
    r = random.Random(1)
    calm = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(r.choice(calm) for _ in range(8)) for _ in range(r.randint(1, 8))]
        toxic = int(i % 5 == 0)
        if toxic:
            sentences[r.randrange(len(sentences))] += " " + r.choice(["vileling", "vilemost", "grubber"])
        rows.append((i, ". ".join(sentences) + ".", "a"))
        labels.append((i, toxic, 0))
    rows += [(9000, None, "a"), (9001, "", "a"), (None, "word1 grubber.", "b")]
    docs = documents(spark, rows)
    given = spark.createDataFrame([*labels, (None, 1, 1), (7, None, 1), (99999, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, given)
    got = {x["doc_id"]: x for x in toxicity.score_documents(docs, model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i]["score"] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.97
    text = dict((i, t) for i, t, _ in rows)
    assert any(w in text[5][s["start"]:s["end"]] for s in got[5]["offending"] for w in ("vile", "grubber"))
    assert got[9000]["score"] == got[9001]["score"] == model.leak
    kept = {x["doc_id"] for x in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, x in got.items() if x["score"] < toxicity.THRESHOLD}
    assert toxicity.train(docs, given.limit(0)).leak == 0.0
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


# 4 mixing

def test_mix_hits_targets(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), ["big", "mid", "small", None][min(3, int(r.expovariate(1)))]) for i in range(900)]
    rows += [(5000, None, "big"), (None, "w w w", "mid"), (7, "w w", "big"), (7, "w w", "big")]
    docs = documents(spark, rows)
    first = mixing.mix(docs).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect())) and len(first) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free, left, target = set(order), 1.5 * sum(size.values()), {}
    while True:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = Counter()
    for x in first:
        taken[x["source"]] += x["taken"]
        assert x["taken"] in (0, x["size"], 2 * x["size"]) and x["target"] == pytest.approx(target[x["source"]])
    for s in order:
        assert abs(taken[s] - target[s]) <= 30, s
    counts = Counter(x["doc_id"] for x in mixing.take(docs, mixing.mix(docs)).collect())
    want = Counter()
    for x in first:
        want[x["doc_id"]] += x["copies"]
    assert counts == Counter({k: v for k, v in want.items() if v})
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flight_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    docs = documents(spark, [(i, "w " * (i % 23), "abc"[i % 3]) for i in range(700)])
    taken, target = Counter(), {}
    rows = mixing.mix(docs).collect()
    for x in rows:
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    assert len(rows) == 700 and all(abs(taken[s] - target[s]) <= 12 for s in target)


# 5 simhash

def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_every_pair_in_the_radius():
    masks = simhash.covering_masks()
    r = random.Random(3)
    for _ in range(3000):
        places = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not m & places for m in masks)
    free = sum(1 << b for b in r.sample(range(64), 11))
    inner = simhash.covering_masks(free)
    for four in itertools.combinations([b for b in range(64) if free >> b & 1], 4):
        assert any(not m & sum(1 << b for b in four) for m in inner)


@pytest.mark.parametrize("bucket", [2, simhash.BUCKET])
def test_simhash_links_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = {}
    for k in range(150):
        x = r.choice(base)
        for b in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << b
        fps.setdefault(simhash._signed(x), k)
    nodes = spark.createDataFrame(list(fps.items()), "fp long, node long")
    got = {(x["src"], x["dst"]) for x in simhash.near_edges(nodes).collect()}
    linked = [(a, b) for (f, a), (g, b) in itertools.combinations(fps.items(), 2) if ((f ^ g) & simhash.FULL).bit_count() <= 4]
    assert components(fps.values(), got) == components(fps.values(), linked)


@pytest.mark.parametrize("bits", [*range(5, 17), 23, 31, 32])
def test_masks_of_few_free_bits_all_fix_a_bit(bits):
    places = random.Random(bits).sample(range(64), bits)
    masks = simhash.covering_masks(sum(1 << b for b in places))
    assert all(masks)
    for four in itertools.combinations(places, 4):
        at = sum(1 << b for b in four)
        assert any(not m & at for m in masks)


@pytest.mark.parametrize(("bits", "count", "bucket"), [(15, 250, 16), (12, 3900, None)])
def test_simhash_deals_dense_buckets_to_an_end(spark, bits, count, bucket):
    assert all(simhash.covering_masks((1 << bits) - 1))  # or near_edges would never return
    r = random.Random(bits)
    high = r.getrandbits(63 - bits) << bits
    fps = [high | low for low in r.sample(range(1 << bits), count)] + [high ^ 0x3F << 40]
    nodes = spark.createDataFrame([(simhash._signed(x), k) for k, x in enumerate(fps)], "fp long, node long")
    got = {(x["src"], x["dst"]) for x in simhash.near_edges(nodes, bucket).distinct().collect()}
    x = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    group, whole = np.zeros(len(x), dtype=bool), 0
    group[0] = True
    while group.sum() > whole:
        whole = group.sum()
        group = near[group].any(axis=0)
    assert not group[-1] and not near[-1, :-1].any() and whole == count  # all near but the last
    assert set(components(range(len(x)), got).values()) == {0, count}


def test_simhash_groups(spark):
    rows = [*sample_rows(), *ODD, (2000, "ONE two", "a"), (2001, "one TWO", "a")]
    got = simhash.near_groups(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {i: plain_fingerprint(t) for i, t, _ in rows if i is not None}
    low = components(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    for x in got:
        if x["doc_id"] is None:
            assert x["component_id"] is None
        else:
            assert x["fingerprint"] == f"{fp[x['doc_id']]:016x}" and x["component_id"] == low[x["doc_id"]]
    kept = sorted(x["doc_id"] for x in simhash.drop_near_copies(documents(spark, rows)).collect() if x["doc_id"] is not None)
    assert kept == sorted(set(low.values()))
    assert simhash.near_groups(documents(spark, [])).count() == 0


# 6 shards

@pytest.mark.parametrize("slice_rows", [7, 50_000])
def test_shards_match_the_mixture(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(sharding, "SLICE_ROWS", slice_rows)
    rows = [(i, f"t{i % 17}", None if i % 5 == 0 else "hot" if i % 3 else "cold") for i in range(333)] + [(None, None, "cold")]
    got = sharding.interleave(documents(spark, rows)).collect()
    shards = defaultdict(list)
    for x in got:
        shards[x["shard"]].append(x)
        assert x["law"] == "rows" and x["grown_shard"] is None
    sizes = [len(v) for v in shards.values()]
    assert len(shards) == 16 and max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    totals = Counter(x["source"] for x in got)
    for v in shards.values():
        assert sorted(x["slot"] for x in v) == list(range(len(v)))
        for s, n in totals.items():
            assert abs(sum(x["source"] == s for x in v) - n / 16) <= 1.5
    text = {i: t for i, t, _ in rows}
    assert all(x["size"] == len((text[x["doc_id"]] or "").encode()) + 1 and x["text_crc32"] == zlib.crc32((text[x["doc_id"]] or "").encode()) for x in got)
    assert sharding.interleave(documents(spark, [])).count() == 0


# 7 repeats

def plain_repeats(rows):
    seen, out = {}, {}
    for doc, text in rows:
        raw = (text or "").encode()
        covered = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if seen.setdefault(raw[s:s + 100], (doc, s)) != (doc, s):
                covered[s:s + 100] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        out[doc] = (len(raw), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot,chunk", [(20_000, 1 << 20), (1, 128)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    r = random.Random(9)
    pool = ["".join(r.choice("abcé ") for _ in range(r.randint(60, 400))) for _ in range(12)]
    rows = []
    for i in range(40):
        text = "".join(r.choice(pool)[r.randint(0, 40):] if r.random() < 0.7 else "".join(r.choice("xyz ") for _ in range(r.randint(1, 150))) for _ in range(r.randint(0, 5)))
        rows.append((i * 3, text if i % 11 else None, "a"))
    rows += [(500, "ab" * 400, "a"), (501, "b" * 99, "a"), (502, "b" * 100, "a"), (503, "b" * 101, "a")]
    table = [*rows, rows[5], (None, "b" * 300, "a")]
    got = repeats.remove_repeats(documents(spark, table)).collect()
    want = plain_repeats([(i, t) for i, t, _ in rows])
    assert len(got) == len(table)
    for x in got:
        if x["doc_id"] is None:
            assert x["n_removed"] == 0
        else:
            assert tuple(x)[1:] == want[x["doc_id"]], x["doc_id"]
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


# 8 exact dedup

def test_exact_dedup(spark):
    rows = [*sample_rows(), (100, "a  b", "x"), (101, "a\tb", "x"), (102, "a b", "x"), (100, "a  b", "x"), (None, "a\n\nb", "x"), (None, "alone", "x")]
    got = exact_dedup.group_copies(documents(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(rows)
    by_hash = {sha(t): ids for t, ids in groups.items()}
    for x in got:
        ids = by_hash[x["text_sha256"]]
        assert x["group_size"] == len(ids) and x["keep_id"] == min((i for i in ids if i is not None), default=None)
    kept = Counter(x["text_sha256"] for x in got if x["kept"])
    assert set(kept) == set(by_hash) and set(kept.values()) == {1}
    left = exact_dedup.drop_copies(documents(spark, rows))
    assert left.columns == documents(spark, rows).columns and left.count() == len(by_hash)
    assert exact_dedup.group_copies(documents(spark, [])).count() == 0


# 9 embeddings

@pytest.mark.parametrize("block", [5, embeddings.BLOCK])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    g = np.random.default_rng(12)
    base = g.standard_normal((30, 16))
    rows = [(k, (base[k % 30] * g.uniform(0.1, 9) + g.standard_normal(16) * 0.12 * g.random()).tolist()) for k in range(240)]
    rows += [(300 + k, base[0].tolist()) for k in range(12)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in [*rows, *odd, (None, base[0].tolist())]], "vec_id long, embedding array<double>, label int, n_links int")
    got = {x["vec_id"]: x for x in embeddings.near_links(df).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found, there = sum(got[i]["n_links"] for i, _ in rows), int(near.sum())
    assert all(got[i]["n_links"] <= near[k].sum() for k, (i, _) in enumerate(rows))
    assert found >= 0.97 * there
    low = components([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert np.mean([got[i]["component_id"] == low[i] for i, _ in rows]) > 0.95
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in odd) and got[None]["component_id"] is None
    assert embeddings.near_links(df.limit(0)).count() == 0


def test_chance_of_a_miss_falls_with_distance():
    k, tables = embeddings.plan_tables(50_000)
    for cosine, recall in ((0.95, 0.97), (0.98, 0.999)):
        met = embeddings.meeting_chance((2 - 2 * cosine) ** 0.5) ** k
        assert 1 - (1 - met) ** tables > recall


# 10 pieces

def as_unigram_model():
    """The library's own unigram search over the same pieces: the model file with its type field set to 1."""
    import public_tokenizers
    import sentencepiece

    def number(b, i):
        value = shift = 0
        while True:
            value, shift, i = value | (b[i] & 127) << shift, shift + 7, i + 1
            if b[i - 1] < 128:
                return value, i

    def size_of(n):
        return bytes([n & 127 | 128]) + size_of(n >> 7) if n > 127 else bytes([n])

    def fields(b):
        i = 0
        while i < len(b):
            tag, i = number(b, i)
            if tag & 7 == 0:
                _, j = number(b, i)
            elif tag & 7 == 2:
                n, i = number(b, i)
                j = i + n
            else:
                j = i + 4
            yield tag, b[i:j]
            i = j

    def joined(parts):
        return b"".join(size_of(t) + (size_of(len(v)) if t & 7 == 2 else b"") + v for t, v in parts)

    raw = open(public_tokenizers.path(pieces.MODEL), "rb").read()
    trainer = lambda v: joined((t, b"\x01" if t >> 3 == 3 else x) for t, x in fields(v))
    return sentencepiece.SentencePieceProcessor(model_proto=joined((t, trainer(v) if t >> 3 == 2 else v) for t, v in fields(raw)))


def test_pieces_equal_the_library():
    model, library, r = pieces.load_pieces(), as_unigram_model(), random.Random(7)
    for _ in range(300):
        text = " ".join("".join(r.choice("thenadiorsgl") for _ in range(r.randint(1, 14))) for _ in range(r.randint(1, 12)))
        assert model.encode(text).tolist() == library.encode(text), text


def test_pieces_round_trip(spark):
    texts = ["", None, " ", "  two  spaces ", "line\n\nbreak\t", "▁ literal ▁▁", "日本語 😀 \x00 é", "x" * 5000, "a " * 3000]
    docs = documents(spark, [(k, t, "a") for k, t in enumerate(texts)] + [(0, "", "a"), (None, "no id", "a")])
    got = {x["doc_id"]: x for x in pieces.decode_pieces(pieces.encode_pieces(docs, keep=("doc_id", "text"))).collect()}
    for k, t in enumerate(texts):
        assert got[k]["decoded"] == (t or "")
    assert list(got[0]["ids"]) == [] and got[6]["n_byte_pieces"] > 0
    assert pieces.encode_pieces(docs.limit(0)).count() == 0
