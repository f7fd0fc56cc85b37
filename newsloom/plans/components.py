"""Connected components by repeated contraction, and the join that stays even under a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.lineage import cut_lineage, cut_sized


def join_hot(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Left join of ``many`` (a key may hold most of its rows) with ``few`` (one row per key).

    Keys with more than 1/parts of the rows are split off: by count there are fewer than ``parts`` of them, so
    their side is broadcast with a proven bound and their rows stay where they are. All others are shuffled. The
    union of both has twice the partitions; it is brought back to ``parts``, or a loop of such joins would double
    them every time.
    """
    spark = many.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = many.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = counts.filter(F.col("_rows") > many.count() / parts).select(key)
    heavy = cut_lineage(heavy)
    if heavy.isEmpty():
        return many.join(few, key, "left")
    heavy_few = F.broadcast(few.join(F.broadcast(heavy), key, "left_semi"))
    hot = many.join(F.broadcast(heavy), key, "left_semi").join(heavy_few, key, "left")
    cold = many.join(F.broadcast(heavy), key, "left_anti").join(few, key, "left")
    return hot.unionByName(cold).coalesce(parts)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` edges to ``(node, component)``; the component is the smallest node id.

    Each round every node moves to the smallest node next to it, from there on to that one's, and so to the end of the
    chain; the edges are rewritten to the nodes moved to, until no edge is left. The smallest node of a component
    never moves, so it is the one that remains. Rounds are written to the checkpoint folder, with their real sizes; none is skipped or
    capped. Nodes without an edge are absent.
    """
    links = cut_sized(
        edges.select("src", "dst").filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    labels = links.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    first = True
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        moves = cut_sized(both.groupBy("src").agg(F.min("dst").alias("_low")).select(
            "src", F.least("src", "_low").alias("to")))
        settled = False
        while not settled:  # to the end of each chain of moves, twice as far every time
            ends = moves.select(F.col("src").alias("to"), F.col("to").alias("_next"))
            further = cut_sized(join_hot(moves, ends, "to").select("src", F.col("_next").alias("to"), (F.col("_next") < F.col("to")).alias("_on")))
            settled, moves = further.filter("_on").isEmpty(), further.select("src", "to")
        if first:
            labels, first = moves.select(F.col("src").alias("node"), F.col("to").alias("component")), False
        else:
            step = moves.select(F.col("src").alias("component"), F.col("to").alias("_to"))
            labels = join_hot(labels, step, "component").select("node", F.coalesce("_to", "component").alias("component"))
            labels = cut_sized(labels)
        # edges whose one end has moved are few, as most ends meet; written once, for the join reads its rows several times
        half = cut_sized(join_hot(links, moves, "src").select(F.col("to").alias("_a"), "dst").filter("_a <> dst").distinct())
        ends = moves.select(F.col("src").alias("dst"), F.col("to").alias("_b"))
        links = cut_sized(
            join_hot(half, ends, "dst").filter(F.col("_a") != F.col("_b"))
            .select(F.greatest("_a", "_b").alias("src"), F.least("_a", "_b").alias("dst")).distinct())
    return labels
