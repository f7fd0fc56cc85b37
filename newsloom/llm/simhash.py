"""SimHash near-duplicates by covering locality-sensitive hashing.

The fingerprint takes a majority vote per bit over the XXH64 values of the 4-word shingles. To find all pairs within
``RADIUS`` = 4 bits, bit ``i`` is given the code ``1 + i mod 31`` in five binary digits, and for each of the 31
non-zero vectors ``v`` a table keeps the bits whose code has odd parity with ``v`` (32 to 34 of 64). For any four
differing bits some ``v`` is orthogonal to their four codes, so the pair agrees on everything that table looks at:
every pair within the radius meets in some bucket, with certainty.

Equal fingerprints are folded before that. Buckets are compared inside a task; a bucket of more than ``BUCKET``
different fingerprints is not compared but dealt anew by a covering of the bits it does not fix yet, as often as
needed. Down to 16 free bits that is the same covering; fewer are cut into five parts, each of them one mask, as four
differing bits leave a part untouched. Every mask fixes at least one more bit, and a bucket never holds a fingerprint
twice, so dealing ends before four bits are free: these have 16 values, and the limit is never below that. So no bucket
is capped and no task holds more than ``BUCKET`` fingerprints at once. Tasks return a spanning forest of the links they
verify, not the pairs.

Null text: as empty; no words: fingerprint zero, linked like any other. Rows that share a
text share their result; rows that share an id only do not. A row without id has a fingerprint, takes no part in linking and gets a null component. Empty table: empty
result. Other columns are ignored by ``near_groups`` and returned unchanged by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.links import components_of, sorted_runs
from newsloom.llm.tables import keep_one, type_of, with_rows
from newsloom.plans.components import connected_components, join_hot
from newsloom.plans.lineage import cut_lineage

SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET = 2048
BLOCK = 1 << 16
FULL = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """64 majority bits as an unsigned number."""
    words = (text or "").encode().lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > SHINGLE:
        starts, ends = starts[:len(words) - SHINGLE + 1], ends[SHINGLE - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist())], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def covering_masks(free: int = FULL, radius: int = RADIUS) -> list[int]:
    """Masks within the ``free`` bits such that any ``radius`` of these bits are all outside one of the masks.

    No mask is zero while more than ``radius`` bits are free.
    """
    places = [i for i in range(64) if free >> i & 1]
    codes = (1 << radius + 1) - 1
    if len(places) < 1 << radius:  # their codes would be orthogonal to the highest vector
        return [sum(1 << place for place in places[part::radius + 1]) for part in range(radius + 1)]
    masks = []
    for v in range(1, codes + 1):
        masks.append(sum(1 << place for k, place in enumerate(places) if (v & 1 + k % codes).bit_count() % 2))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, digest, fp)`` for every row; ``fp`` holds the 64 bits as a signed long, ``digest`` is XXH64 of the text as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_rows(batches):
            fps = [_signed(fingerprint(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["id", "digest", "fp"])

    rows = docs.select(F.col(id_column).alias("id"), text_digest(F.col(text_column)).alias("digest"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {type_of(docs, id_column)}, digest bigint, fp bigint")


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _link_buckets(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """(fixed, key, fp, node) sorted by bucket to edges (null, node, node), or to rows (fixed, fp, node) to deal anew.

    A bucket above ``limit`` (16 or more) has at least five free bits, so each of its masks fixes one of them.
    """
    names = ["fixed", "a", "b"]
    for rows, starts, part in sorted_runs(batches, 2, limit):
        if part:
            fixed = int(rows[0, 0]) & FULL
            for mask in covering_masks(FULL & ~fixed):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), _signed(fixed | mask))), pa.array(rows[:, 2]), pa.array(rows[:, 3])], names=names)
            continue
        edges = []
        ends = np.append(starts[1:], len(rows))
        for at in np.flatnonzero(ends - starts > 1):
            a, b = starts[at], ends[at]
            fps, nodes = np.ascontiguousarray(rows[a:b, 2]).view(np.uint64), rows[a:b, 3]
            low = components_of(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS)
            linked = np.flatnonzero(low != np.arange(b - a))
            if len(linked):
                edges.append(np.column_stack([nodes[linked], nodes[low[linked]]]))
        if edges:
            edges = np.concatenate(edges)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(edges), pa.int64()), pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=names)


def near_edges(nodes: DataFrame, bucket: int | None = None) -> DataFrame:
    """``(fp, node)`` with one row per fingerprint to edges ``(src, dst)`` that connect all pairs within the radius.

    Buckets of more than ``bucket`` fingerprints (``BUCKET`` if not given) are dealt anew.
    """
    limit = max(BUCKET if bucket is None else bucket, 1 << RADIUS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _link_buckets(batches, limit)  # an argument, as a worker imports the module afresh

    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in covering_masks()])
    level = nodes.select(F.explode(masks).alias("fixed"), "fp", "node")
    found = None
    while True:
        key = F.col("fp").bitwiseAND(F.col("fixed")).alias("key")
        dealt = level.select("fixed", key, "fp", "node").repartition("fixed", "key")
        if found is not None:  # two buckets may come to fix the same bits by different masks
            dealt = dealt.dropDuplicates(["fixed", "key", "fp"])
        out = cut_lineage(
            dealt.sortWithinPartitions("fixed", "key").mapInArrow(run, "fixed bigint, a bigint, b bigint"))
        edges = out.filter("fixed IS NULL").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        found = edges if found is None else found.unionByName(edges)
        level = out.filter("fixed IS NOT NULL").select("fixed", F.col("a").alias("fp"), F.col("b").alias("node"))
        if level.isEmpty():
            return found


def _components(rows: DataFrame) -> DataFrame:
    """``(fp, component, component_id)`` of every fingerprint that a row with an id has; ``component`` is a fingerprint.

    Fingerprints are linked as such, and ids come in afterwards, so rows that share an id link nothing.
    """
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low")).filter("low IS NOT NULL"))
    parts = connected_components(near_edges(nodes.select("fp", F.col("fp").alias("node"))))
    placed = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    return cut_lineage(join_hot(placed, lows, "component").select("fp", "component", "component_id"))


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, ``fingerprint`` in 16 hex digits, ``component_id``."""
    rows = cut_lineage(fingerprints(docs, id_column, text_column).drop("digest"))
    return join_hot(rows, _components(rows), "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each component, all columns kept; rows without id stay.

    The one is a row with the component's smallest id; where several rows of the component have that id, the one with
    the smallest digest. Components are decided on narrow rows; texts move once.
    """
    rows = cut_lineage(fingerprints(docs, id_column, text_column).filter("id IS NOT NULL"))
    first = join_hot(rows, _components(rows), "fp").filter("id = component_id")
    texts = first.groupBy("component", "id", "digest").agg(F.count(F.lit(1)).alias("n"))
    marked = texts.groupBy("component").agg(F.min(F.struct("id", "digest", "n")).alias("one")).select("one.*")
    left = keep_one(docs.filter(F.col(id_column).isNotNull()), marked, {"id": F.col(id_column), "digest": text_digest(F.col(text_column))})
    return left.unionByName(docs.filter(F.col(id_column).isNull()))
