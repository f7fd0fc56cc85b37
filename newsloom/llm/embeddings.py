"""Near-duplicate embeddings by Euclidean p-stable hashing, then exact cosine checks.

For unit vectors cosine ``c`` is distance ``sqrt(2 - 2c)``. A table hashes a vector to ``floor((a.v + b) / WIDTH)`` for
``k`` Gaussian directions. ``k`` grows with the logarithm of the number of vectors, so that chance meetings per vector
stay constant, and the number of tables follows so that a pair just at the threshold is missed by all of them with
probability ``MISS``; nearer pairs are missed far less often.

Identical vectors are folded into a class first. Only buckets with two or more classes get the vectors; a bucket of more
than ``BLOCK`` classes is cut into blocks that are compared two by two in different tasks, so it is neither capped nor
held whole. Tasks verify cosines in double precision and return, per class, the number of vectors linked and one edge
of a spanning forest, not pairs; a pair that meets in several tables is counted in the first of them only, which every
task can tell because it can hash both vectors itself.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
length do not link. A row without id has no links and no component. Rows that repeat an id are vectors of their own,
linked if equal or near. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.links import components_of
from newsloom.llm.tables import type_of, with_rows
from newsloom.plans.components import connected_components, join_hot
from newsloom.plans.lineage import cut_lineage

COSINE = 0.95
WIDTH = 2.0
MISS = 0.02
BLOCK = 1024
SEED = 9


def meeting_chance(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection of two points at ``distance`` agrees."""
    r = width / distance
    below = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(projections per table, tables) for ``n`` vectors."""
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(meeting_chance(math.sqrt(2)))))
    met = meeting_chance(math.sqrt(2 - 2 * cosine)) ** k
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - met)))


@lru_cache(maxsize=16)
def _projections(dims: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets and key factors; the same in every task."""
    random = np.random.default_rng([SEED, dims, k, tables])
    directions, offsets = random.standard_normal((dims, tables * k)), random.random(tables * k) * WIDTH
    return directions, offsets, random.integers(1, 1 << 63, (tables, k), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table_keys(unit: np.ndarray, k: int, tables: int, first: int | None = None) -> np.ndarray:
    """One 64-bit key per row and table, of the ``first`` tables only if given. Sums run in a fixed order, so every
    task gets the same keys."""
    dims = unit.shape[1]
    directions, offsets, factors = _projections(dims, k, tables)
    some = tables if first is None else first
    sums = np.tile(offsets[: some * k], (len(unit), 1))
    for d in range(dims):
        sums += unit[:, d, None] * directions[d, : some * k]
    cells = np.floor(sums / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), some, k)
    mixed = (cells * factors[:some]).sum(axis=2, dtype=np.uint64) ^ np.uint64(dims)
    return (mixed * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _unit(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors by length."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = {}
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        at = column.offsets.to_numpy()[rows][:, None] + np.arange(dims)
        found = values[at]
        found = found / np.abs(found).max(axis=1, keepdims=True)  # keeps squares finite
        out[int(dims)] = rows, found / np.sqrt((found**2).sum(axis=1, keepdims=True))
    return out


def _block_links(unit: np.ndarray, k: int, tables: int, sizes: np.ndarray, table: int, side: np.ndarray | None, cosine: float):
    """Links of a block of one bucket: (vectors newly linked to each row, smallest row reachable from each)."""
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    if side is not None:  # two blocks: only pairs between them
        near &= side[:, None] != side[None, :]
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):  # a chance meeting; nothing to hash again
        return np.zeros(len(unit), np.int64), np.arange(len(unit))
    keys, fresh = table_keys(unit[some], k, tables, table), near[np.ix_(some, some)]
    for earlier in range(table):
        fresh &= keys[:, earlier, None] != keys[None, :, earlier]
    near[np.ix_(some, some)] = fresh
    return near @ sizes, components_of(near)


def near_links(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``."""
    x = F.col("v")
    sound = F.coalesce(
        (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    rows = rows.withColumn("sound", sound & F.col("id").isNotNull())
    key = F.when(F.col("sound"), F.concat_ws(":", F.xxhash64(F.lit(1), "v"), F.xxhash64(F.lit(2), "v"))).alias("vector")
    keyed = cut_lineage(rows.select("id", key))
    unique = rows.filter("sound").select("id", key, "v").groupBy("vector").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    classes = cut_lineage(unique)
    k, tables = plan_tables(classes.count(), cosine)
    longs = pa.list_(pa.int64())

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_rows(batches):
            for rows_of, unit in _unit(batch.column(1)).values():
                found = table_keys(unit, k, tables)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_of)), pa.array(list(found), longs)], names=["cls", "keys"])

    hashed = classes.select("cls", "v").mapInArrow(hash_all, "cls long, keys array<long>")
    dealt = cut_lineage(hashed.select("cls", F.posexplode("keys").alias("table", "key")))
    counts = dealt.groupBy("table", "key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = dealt.join(counts, ["table", "key"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    # a bucket of one block is compared with itself; of several, each two blocks meet once, and each meets itself once
    met = met.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("other", other).select(
        "table", "key", "cls", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    group = ["table", "key", "p", "q"]
    full = met.join(classes.select("cls", "n", "v"), "cls").select(*group, "block", "cls", "n", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in with_rows(batches):
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            cut = _last_group(rest)
            if cut:
                yield from _compared(rest.slice(0, cut).combine_chunks())
                rest = rest.slice(cut)
        if rest is not None and len(rest):
            yield from _compared(rest.combine_chunks())

    def _groups(rows_of: pa.Table) -> np.ndarray:
        return np.column_stack([rows_of.column(c).to_numpy() for c in group])

    def _last_group(rows_of: pa.Table) -> int:
        found = _groups(rows_of)
        return int(len(found) - np.argmax(np.append(np.any(found[::-1] != found[-1], axis=1), True)))

    def _compared(rows_of: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _groups(rows_of)
        starts = np.concatenate([[0], np.flatnonzero(np.any(found[1:] != found[:-1], axis=1)) + 1, [len(found)]])
        cls, n, block = (rows_of.column(c).to_numpy() for c in ("cls", "n", "block"))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            table, _, p, q = found[a]
            vector = rows_of.column("v").slice(a, b - a).combine_chunks()
            vector = vector.chunk(0) if isinstance(vector, pa.ChunkedArray) else vector
            for places, unit in _unit(vector).values():
                at = a + places
                linked, low = _block_links(unit, k, tables, n[at], int(table), None if p == q else block[at], cosine)
                some = np.flatnonzero((linked > 0) | (low != np.arange(len(low))))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(cls[at][some]), pa.array(cls[at][low[some]]), pa.array(linked[some].astype(np.int64))], names=["cls", "low", "links"])

    linked = cut_lineage(full.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "cls long, low long, links long"))
    parts = connected_components(linked.select(F.col("cls").alias("src"), F.col("low").alias("dst")))
    per_class = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select("vector", "cls", "n").join(per_class, "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    return join_hot(keyed, known, "vector").select(
        F.col("id").cast(type_of(vectors, id_column)).alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))
