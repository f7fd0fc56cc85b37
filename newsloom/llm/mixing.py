"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is ``r`` times its size takes each of its documents ``floor(r)`` times, and once more with
probability ``r - floor(r)``. These probabilities are moved through the null space of two constraints, the number of
words and the number of documents taken: of any three undecided documents, one direction leaves both totals as they
are, and a random step to either end of it decides at least one of the three. So both totals stay exactly on target
until fewer documents are left than constraints need; that small landing problem is solved by trying all outcomes of
the last ``LANDING`` documents of a source and taking the one nearest to the target.

The flight runs over blocks of a source dealt by a seeded hash, each streamed with three documents in memory, then
over what the blocks left undecided, and so on until a source is one block. Chance comes from hashes of the ids, and
blocks from counts, so a rerun, a retry and another number of tasks give the same result. A source of any size is
spread over all tasks.

Null text: size 0, decided like any other. Null source: a source of its own, last in order. Null id: a row like any
other. Rows that repeat an id are drawn one by one by ``mix``; ``take`` gives each of them an even part of what the id
takes. Empty table: empty result. A source of size 0 has target 0. Other columns are ignored by ``mix`` and returned
unchanged by ``take``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import fresh_names, row_order, type_of, with_rows
from newsloom.plans.keys import number_rows
from newsloom.plans.lineage import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20
BLOCK_ROWS = 4096
LANDING = 8
EPS = 1e-9
_MASK = (1 << 64) - 1


def word_sizes(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, rows, source_size, target)``: targets by weight, none above ``most`` times the source's size.

    The targets are ``min(most * size, level * weight)``; the level is raised until they add up, from one row of sums
    at a time.
    """
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    ranked = number_rows(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut_lineage(ranked.select("source", "rows", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    sums = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, free = (sums[0] or 0) * share, sums[1] or 1.0
    level = total / free
    while total:
        above = F.col("weight") * level > F.col("cap")
        capped, free = ranked.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        higher = (total - (capped or 0.0)) / free if free else level
        if higher <= level:
            break
        level = higher
    return ranked.select("source", "rows", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def _flight(held: list[list], chance: float) -> list[list]:
    """Move the probabilities of the three largest of ``held`` [row, size, p]; gives the decided ones back, removed."""
    held.sort(key=lambda x: -x[1])
    (_, s1, _), (_, s2, _), (_, s3, _) = three = held[:3]
    u = (s2 - s3, s3 - s1, s1 - s2) if s1 != s3 else (1.0, -1.0, 0.0)
    most = [min((1 - x[2]) / d if d > 0 else x[2] / -d for x, d in zip(three, v, strict=True) if d) for v in (u, [-d for d in u])]
    step = most[0] if chance * sum(most) < most[1] else -most[1]
    done = []
    for x, d in zip(three, u, strict=True):
        x[2] += step * d
        if x[2] < EPS or x[2] > 1 - EPS:
            x[2] = float(x[2] > 0.5)
            done.append(x)
    held[:] = [x for x in held if not any(x is y for y in done)]
    return done


def _land(held: list[list]) -> list[list]:
    """The outcome of a few documents nearest to their expected words, then to their expected number."""
    best = min(itertools.product((0, 1), repeat=len(held)), key=lambda out: (
        abs(sum(x[1] * (k - x[2]) for x, k in zip(held, out, strict=True))), abs(sum(k - x[2] for x, k in zip(held, out, strict=True)))))
    for x, k in zip(held, best, strict=True):
        x[2] = float(k)
    return held


def _fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, source, size, base, p, chance, block, last) in order of source and block; decides p to 0 or 1."""
    group, held, ready, schema = None, [], [], None

    def close():
        if group is not None:
            ready.extend(_land(held) if group[2] else held)
            held.clear()

    def out():
        rows = [{**x[0], "p": x[2]} for x in ready]
        ready.clear()
        return pa.RecordBatch.from_pylist(rows, schema)

    for batch in with_rows(batches):
        schema = batch.schema
        for row in batch.to_pylist():
            here = (row["source"], row["block"], row["last"])
            if here != group:
                close()
                group = here
            held.append([row, row["size"], row["p"]])
            turn = 0
            while len(held) > (LANDING if row["last"] else 2):
                turn += 1
                mixed = (row["chance"] + turn * 0x9E3779B97F4A7C15 & _MASK) * 0xBF58476D1CE4E5B9 & _MASK
                ready.extend(_flight(held, (mixed ^ mixed >> 31) / 2.0**64))
        if ready:
            yield out()
    close()
    if ready:
        yield out()


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row per input row: id, source, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` words."""
    sizes = cut_lineage(word_sizes(docs, id_column, text_column, source_column))
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.select(
        F.col("source").alias("of"), F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"),
        F.floor(rate + EPS).cast("int").alias("base"), rate.alias("rate"))
    chance = F.xxhash64(F.lit(seed), "id", "size")
    units = sizes.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "source", "size", "base", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")).alias("p"), chance.alias("chance"), "blocks")
    decided = [units.filter(F.col("p") < EPS).withColumn("p", F.lit(0.0)).drop("chance", "blocks")]
    units = units.filter(F.col("p") >= EPS)
    most_blocks = targets.agg(F.ceil(F.max("rows") / BLOCK_ROWS)).first()[0] or 0
    schema = f"id {type_of(sizes, 'id')}, source string, size bigint, base int, p double, chance bigint, block bigint, last boolean, blocks bigint"
    turn = 0
    while most_blocks:
        dealt = units.select(
            "id", "source", "size", "base", "p", "chance", F.pmod(F.xxhash64(F.lit(turn), "chance"), F.col("blocks")).alias("block"),
            (F.col("blocks") == 1).alias("last"), "blocks")
        flown = cut_lineage(dealt.repartition("source", "block").sortWithinPartitions("source", "block", "chance", "id", "size").mapInArrow(_fly, schema))
        over = F.col("p").isin(0.0, 1.0)
        decided.append(flown.filter(over).select("id", "source", "size", "base", "p"))
        if most_blocks == 1:
            break
        units = flown.filter(~over).withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK_ROWS))
        most_blocks, turn = -(-most_blocks * 2 // BLOCK_ROWS), turn + 1
    rows = decided[0]
    for more in decided[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("copies", F.col("base") + F.col("p").cast("int"))
    named = targets.select(F.col("source").alias("of"), "source_size", "target")
    return rows.join(named, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_column), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with every document as often as the mix takes it, all columns kept; texts are shuffled once, twice if copies do not divide.

    The copies of an id are shared out evenly among its rows, what is left over in the order of a digest of the row. Only
    rows of an id whose copies do not divide evenly are ranked for that.
    """
    own_id, copies, rows, order, nth, copy = fresh_names(docs, "id_of_row", "copies", "rows", "order_of_row", "nth_of_id", "copy")
    per_id = mixed.groupBy(F.col(id_column).alias(own_id)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    per_id = cut_lineage(per_id.filter(F.col(copies) > 0))
    same = F.col(id_column).eqNullSafe(F.col(own_id))
    even = F.col(copies) % F.col(rows) == 0
    share = F.floor(F.col(copies) / F.col(rows))

    def repeated(part: DataFrame, times: Column) -> DataFrame:
        return part.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*[f"`{c}`" for c in docs.columns])

    plain = repeated(docs.join(per_id.filter(even), same), share)
    if per_id.filter(~even).isEmpty():
        return plain
    ranked = docs.withColumn(order, row_order(docs)).join(per_id.filter(~even), same).withColumn(
        nth, F.row_number().over(Window.partitionBy(id_column).orderBy(order)))
    return plain.unionByName(repeated(ranked, share + (F.col(nth) <= F.col(copies) % F.col(rows)).cast("long")))
