"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import audit, chat, embeddings, exact_dedup, manifest, mixing, pieces, repeats, sharding, simhash, toxicity, warc
from newsloom.llm import secrets as secret_scan
from newsloom.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_secret_scan")
def secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.find_secrets(table(spark, folder, "documents")))


@query("op2_chat_format")
def formatted_chats(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and conversation -1 whose two texts spell control strings."""
    own = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_chats(turns))


@query("op3_toxicity")
def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"),
        F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("offending"))


@query("op4_mix_sources")
def mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op5_simhash")
def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@query("op6_shards")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.interleave(table(spark, folder, "documents"))


@query("op7_repeated_passages")
def without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


@query("op8_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents),
g AS (SELECT plain, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY plain)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.plain) AS text_sha256 FROM t JOIN g USING (plain)
""")
def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, folder, "documents"))


@query("op9_embedding_dedup", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  WITH RECURSIVE r(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, p.b FROM r JOIN pairs p ON p.a = r.other)
  SELECT id, min(other) AS low FROM r GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = v.vec_id) AS n_links, reach.low AS component_id, v.vec_id = reach.low AS kept
FROM v JOIN reach ON reach.id = v.vec_id
""")
def embedding_links(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_links(table(spark, folder, "embeddings"))


@query("op10_sentence_pieces")
def encoded_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text as count and hash, and whether they decode to the very same text."""
    encoded = pieces.encode_pieces(table(spark, folder, "documents"), keep=("doc_id", "text"))
    return pieces.decode_pieces(encoded).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_byte_pieces", F.xxhash64("ids").alias("ids_xxh64"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


@query("op11_warc_archive", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT body, max(page_id) AS top FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}',
   1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (body)""")
def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def _value_sql(expression: str) -> str:
    return f"coalesce(strlen(CAST({expression} AS VARCHAR)) || ':' || {expression}, '-')"


_OTHERS_SQL = " || ".join(_value_sql(c) for c in manifest.FIELDS[:-1])
#: CRC-32 of a text of plain ASCII, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(d) + 1), lambda i: CAST(ascii(substr(d, i, 1)) AS UBIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""


@query("op12_merkle_manifest", f"""
WITH RECURSIVE d0 AS (SELECT *, CAST(doc_id AS VARCHAR) AS d, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree FROM documents),
leaves AS (SELECT doc_id, tree, sha256({_OTHERS_SQL} || {_value_sql("text")}) AS leaf,
   CASE WHEN {_CRC_SQL} % 2 = 0 THEN sha256({_OTHERS_SQL} || {_value_sql("replace(text, chr(10), '')")}) END AS changed,
   row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d0),
nodes(level, tree, pos, n, digest) AS (SELECT 0, tree, pos, n, leaf FROM leaves UNION ALL
   SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 3, n),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes(level, pos, n, digest) AS (SELECT 0, pos, n, digest FROM subroots UNION ALL
   SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 3, n),
beside AS (SELECT l.doc_id, x.level AS step, x.pos AS other, l.pos // CAST(3 ** x.level AS BIGINT) AS own, x.digest FROM leaves l
    JOIN nodes x ON x.tree = l.tree AND x.n > 1 AND x.pos // 3 = l.pos // CAST(3 ** (x.level + 1) AS BIGINT)
  UNION ALL SELECT l.doc_id, 1000 + x.level, x.pos, s.pos // CAST(3 ** x.level AS BIGINT), x.digest FROM leaves l JOIN subroots s ON s.tree = l.tree
    JOIN upper_nodes x ON x.n > 1 AND x.pos // 3 = s.pos // CAST(3 ** (x.level + 1) AS BIGINT)),
path AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k, coalesce(string_agg(digest, '' ORDER BY other) FILTER (other < own), '') AS before,
   coalesce(string_agg(digest, '' ORDER BY other) FILTER (other > own), '') AS after FROM beside GROUP BY doc_id, step),
folded(doc_id, k, digest) AS (SELECT doc_id, 0, coalesce(changed, leaf) FROM leaves UNION ALL
   SELECT f.doc_id, f.k + 1, sha256(p.before || f.digest || p.after) FROM folded f JOIN path p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
proofs AS (SELECT doc_id, string_agg(before || after, '' ORDER BY k) AS proof, count(*) AS steps FROM path GROUP BY 1),
last AS (SELECT doc_id, digest AS folded_root FROM folded QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.digest AS verified,
  CASE WHEN changed <> leaf THEN coalesce(steps, 0) + 1 ELSE 0 END AS copied_nodes
FROM leaves l JOIN subroots s USING (tree) JOIN last USING (doc_id) LEFT JOIN proofs USING (doc_id) JOIN (SELECT digest FROM upper_nodes WHERE n = 1) r ON TRUE
""")
def dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify(table(spark, folder, "documents"))


@query("op13_filter_interactions", r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[ 	-]+'), lambda v: v <> '') AS words, min(doc_id) OVER (PARTITION BY x) AS low FROM t),
flags AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
   + CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 2 * length(x) THEN 4 ELSE 0 END
   + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > low THEN 16 ELSE 0 END AS mask FROM w),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
masks AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flags LEFT JOIN said USING (doc_id) GROUP BY 1, 2),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
steps AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
    unnest([{'step': 1, 'before': 0, 'own': a.bit}, {'step': 2, 'before': a.bit, 'own': b.bit}, {'step': 3, 'before': a.bit + b.bit, 'own': c.bit},
      {'step': 4, 'before': a.bit + b.bit + c.bit, 'own': d.bit}, {'step': 5, 'before': a.bit + b.bit + c.bit + d.bit, 'own': e.bit}]) AS s
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
rows AS (SELECT part, filter_order, s.step, s.own AS own, sum(n) FILTER (mask & (s.before + s.own) = 0) AS kept, sum(n) FILTER (mask & s.before = 0 AND mask & s.own > 0) AS removed,
    sum(n) FILTER (mask & s.before > 0 AND mask & s.own > 0) AS redundant, sum(n) FILTER (mask = s.own) AS unique_fails,
    sum(good) FILTER (mask & s.before = 0 AND mask & s.own > 0) AS good_lost, sum(toxic) FILTER (mask & s.before = 0 AND mask & s.own > 0) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM rows""")
def filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return audit.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))
