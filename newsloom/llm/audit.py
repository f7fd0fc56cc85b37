"""How quality filters interact: what each removes in every order they can be applied in.

Which filters a text fails is one number of five bits. Everything a report on any order needs follows from the number of
rows per part and mask, which add up: rows left after a set of filters are those whose mask avoids the set.

The last filter, exact copies, starts with a counting Bloom filter: each text adds to ``PROBES`` slots of one segment, tasks
count their own slots and the counts are merged by slot. A text with a slot that nothing else added to is
unique for certain. Slots of two or more are kept as bits and broadcast, at most ``MOST_SEGMENTS`` segments of one KB; beyond
that the filter gets denser and clears fewer texts, but results stay the same. Only texts that may repeat are
shuffled, whole, to find the smallest id per text; copies in a task are one row before they leave it. A row fails
if it may repeat and is not the first of its text, which a join on id and digest tells, so no key holds a group.
Labels are joined to rows counted per id, and the flags add up to counts per part and mask.

Null text: empty. Null or empty part: the empty string. Null id: never fails as a copy, is no one's original. Rows that
repeat an id and a text are not copies of each other, as neither id is smaller. Labels that repeat an id: it has a label if
one of them says so. Very long texts: rows like any other. Empty table: empty result. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.lineage import cut_lineage

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
COPY = MASKS >> 1
# Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
# The sketch.
PROBES, SLOT_BITS, SLOTS_PER_TEXT, MOST_SEGMENTS = 4, 13, 8, 1 << 16
WORDS = (1 << SLOT_BITS) // 64


def text_flags(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    total, distinct = F.size(words), F.size(F.array_distinct(words))
    length = F.length(text)
    capitals = length - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (total < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * total, 100 * capitals > MOST_CAPITAL_PERCENT * length,
             text.rlike(SYMBOLS))
    bits = [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)]
    return sum(bits[1:], bits[0])


# --- copies -----------------------------------------------------------------------------------

def segments_for(texts: int) -> int:
    """A power of two that gives every text about ``SLOTS_PER_TEXT`` slots, as far as the broadcast allows."""
    wanted = math.ceil(max(1, texts) * SLOTS_PER_TEXT / (1 << SLOT_BITS))
    return min(MOST_SEGMENTS, 1 << (wanted - 1).bit_length())


def _segment(hashed: Column, segments: int) -> Column:
    return F.pmod(hashed, F.lit(segments)).cast("int")


def _slots(hashed: Column) -> Column:
    """The slots of a text in its segment: slices of a second hash."""
    second = F.xxhash64(hashed, F.lit(PROBES))
    return F.array(*[F.shiftrightunsigned(second, SLOT_BITS * k).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int") for k in range(PROBES)])


def sketch(hashes: DataFrame, segments: int) -> DataFrame:
    """``(segment, bits)`` of a column ``hash``, one per row: the slots that at least two rows added to."""
    slots = hashes.select(_segment(F.col("hash"), segments).alias("segment"), F.explode(F.array_distinct(_slots(F.col("hash")))).alias("slot"))
    shared = slots.groupBy("segment", "slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    words = shared.groupBy("segment", F.expr("slot div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits"))
    listed = words.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of"))
    return listed.select("segment", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.col("of")[w], F.lit(0).cast("long"))).alias("bits"))


def may_repeat(rows: DataFrame, shared: DataFrame, segments: int) -> DataFrame:
    """Rows whose ``hash`` has no slot of its own. ``shared`` has a proven size: at most ``MOST_SEGMENTS`` KB."""
    slots = _slots(F.col("hash"))
    in_all = F.lit(True)
    for k in range(PROBES):
        in_all = in_all & (F.getbit(F.get("bits", F.shiftright(slots[k], 6)), slots[k] % 64) == 1)
    return rows.withColumn("segment", _segment(F.col("hash"), segments)).join(F.broadcast(shared), "segment").filter(in_all).drop("segment", "bits")


# --- report -----------------------------------------------------------------------------------

def flag_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """``(id, part, mask)`` of every row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text_flags(text).alias("mask"),
        F.xxhash64(text).alias("hash"), F.unhex(F.sha2(text, 256)).alias("digest")))
    segments = segments_for(rows.count())
    shared = cut_lineage(sketch(rows.select("hash"), segments))
    texts = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    firsts = may_repeat(texts, shared, segments).groupBy("text").agg(F.min("id").alias("low")).select(
        F.col("low").alias("id"), F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(True).alias("first"))
    marked = may_repeat(rows, shared, segments).groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = marked.join(firsts, ["id", "digest"], "left")
    fails = F.col("first").isNull() & F.col("id").isNotNull()
    # counts add up: a copy leaves its mask and enters the one with the bit of the copies
    everyone = rows.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    copies = cut_lineage(marked.filter(fails).select("id", "part", "mask", "n"))
    both = everyone.unionByName(copies.withColumn("n", -F.col("n"))).unionByName(copies.withColumn("mask", F.col("mask") + COPY))
    return both.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).filter("n > 0")


def mask_counts(flagged: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows, good rows and toxic rows per part and mask, as arrays over all masks."""
    said = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    labelled = flagged.join(said, "id", "left")
    counts = labelled.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    per = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in ("n", "good", "toxic")])

    def over_masks(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.col(c)[m], F.lit(0).cast("long"))).alias(c)

    return per.select("part", *[over_masks(c) for c in ("n", "good", "toxic")])


def _left_by(counts: str) -> Column:
    """For every set of filters, the rows that pass them all."""
    masks = F.sequence(F.lit(0), F.lit(MASKS - 1))
    return F.transform(masks, lambda s: F.aggregate(
        F.filter(masks, lambda m: m.bitwiseAND(s) == 0), F.lit(0).cast("long"), lambda a, m: a + F.col(counts)[m]))


def orders() -> Column:
    """Every step of every order: letters of the order, step, filters before it, its own filter."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            steps.append({"filter_order": name, "step": step, "before": before, "own": 1 << k})
            before |= 1 << k
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,own:int>>")


def interactions(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    counts = mask_counts(flag_rows(docs, id_column, text_column, part_column), labels, id_column)
    sets = counts.select("part", "n", *[_left_by(c).alias(f"{c}_left") for c in ("n", "good", "toxic")])
    masks = F.sequence(F.lit(0), F.lit(MASKS - 1))
    # in how many orders a row counts for one of the filters it fails: each is first equally often
    share = F.lit(math.factorial(len(FILTERS)))
    sets = sets.withColumn("shapley", F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda k: F.aggregate(
        F.filter(masks, lambda m: F.getbit(m, k) == 1), F.lit(0).cast("long"),
        lambda a, m: a + F.col("n")[m] * (share / F.bit_count(m)).cast("long"))))
    sets = cut_lineage(sets)  # a few narrow rows per part, before they are multiplied
    rows = sets.withColumn("at", F.explode(orders())).select("*", "at.*")
    after = F.col("before").bitwiseOR(F.col("own"))
    fails = F.col("n_left")[0] - F.col("n_left")[F.col("own")]
    removed = F.col("n_left")[F.col("before")] - F.col("n_left")[after]
    letter = F.log2(F.col("own")).cast("int")
    return rows.select(
        "part", "filter_order", "step", F.col("n_left")[after].alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        F.col("n")[F.col("own")].alias("unique_fails"), (F.col("good_left")[F.col("before")] - F.col("good_left")[after]).alias("good_lost"),
        (F.col("toxic_left")[F.col("before")] - F.col("toxic_left")[after]).alias("toxic_lost"), F.col("shapley")[letter].alias("shapley"))
