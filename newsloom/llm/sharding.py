"""Sharding by proportional stratified interleaving.

Rows of a source are ranked in the order of a seeded hash; rank ``k`` of ``n`` gets the fraction ``(k - 1/2) / n``.
Sorted by fraction, every stretch of the result holds every source in proportion, so cutting it into equal stretches
gives shards that match the mixture, each source to one row, with row counts at most one apart (law ``rows``).

No sort passes through one task: hashes and fractions are even, so equal slices of their range hold about
``SLICE_ROWS`` rows or fewer each whatever the source; a row's position is its place in its slice plus the rows of the slices
before, which come from a running sum over one row per slice. A source of any size is spread over its slices.

Null text: no bytes. Null source: a source of its own. Null ids and repeated rows: rows like any other; order among
equal rows does not matter, as they are equal. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.plans.lineage import cut_lineage

SHARDS = 16
SEED = 6
SLICE_ROWS = 50_000


def _before(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``before``, the rows of the slices before this one."""
    past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0)))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text",
               source_column: str = "source") -> DataFrame:
    """One row per input row: id, source, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    # a null source would not meet itself in a join
    rows = cut_lineage(rows.select(
        "id", "size", "crc", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "crc", "size"), 1).alias("draw")))
    total = rows.count()
    slices = max(1, -(-total // SLICE_ROWS))
    width = -(-(1 << 63) // slices)
    key = ["none", "name", "slice"]
    rows = rows.withColumn("slice", F.expr(f"draw div {width}L") if slices > 1 else F.lit(0).cast("long"))
    counts = _before(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), ["none", "name"], "slice")
    counts = counts.withColumn("of", F.sum("n").over(Window.partitionBy("none", "name"))).drop("n")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("draw", "id", "crc", "size"))
    ranked = rows.withColumn("place", place).join(counts, key)
    fraction = ((F.col("before") + F.col("place") - 0.5) / F.col("of")).alias("fraction")
    ranked = cut_lineage(ranked.select("id", "size", "crc", "none", "name", "draw", fraction))
    ranked = ranked.withColumn("part", F.floor(F.col("fraction") * slices).cast("long"))
    parts = _before(ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")), [], "part").drop("n")  # total / SLICE_ROWS rows
    order = F.row_number().over(Window.partitionBy("part").orderBy("fraction", "none", "name", "draw", "id", "crc", "size"))
    at = (F.col("before") + F.col("place") - 1).cast("long")
    placed = ranked.withColumn("place", order).join(parts, "part").withColumn("at", at)
    placed = placed.withColumn("shard", F.expr(f"CAST(at * {shards}L div {max(1, total)}L AS INT)"))
    first = F.expr(f"(CAST(shard AS LONG) * {total}L + {shards - 1}L) div {shards}L")
    return placed.select(
        F.col("id").alias(id_column), F.when(~F.col("none"), F.col("name")).alias("source"), "size", F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
