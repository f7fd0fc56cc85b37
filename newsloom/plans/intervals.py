"""Joins of a row with the rows of the same key inside a time interval of its own."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.keys import heavy_groups
from newsloom.plans.lineage import cut_lineage


def seconds_of(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp, read as wall time."""
    wall = ts.cast("timestamp_ntz")
    whole = F.date_diff(wall.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return whole + F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)


def interval(span: timedelta) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(span.total_seconds())))


def interval_join(left: DataFrame, right: DataFrame, *, keys: Sequence[str], low: Column, high: Column,
                  right_ts: str, bucket_hours: int = 24) -> DataFrame:
    """Pairs with equal keys and ``low <= right_ts <= high``; ``low`` and ``high`` are left columns.

    The time axis is cut into buckets that become part of the join key: a left row visits only the
    buckets its interval touches, and a hot key is spread over its buckets. Column names of the two
    sides (other than the keys) must differ.
    """
    width = bucket_hours * 3600
    on = [*keys, "_bucket"]
    visits = left.select(
        "*", low.alias("_low"), high.alias("_high"),
        F.explode(F.sequence(F.floor(seconds_of(low) / width), F.floor(seconds_of(high) / width))).alias("_bucket"))
    placed = right.withColumn("_bucket", F.floor(seconds_of(F.col(right_ts)) / width))
    if not right.isStreaming and not left.isStreaming:
        # a key and bucket with more than a partition's share of the right rows is salted by that share
        heavy = F.broadcast(cut_lineage(heavy_groups(placed, on).drop("rows")))
        salts = F.coalesce("salts", F.lit(1))
        placed = placed.join(heavy, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in right.columns]), salts).cast("int")).drop("salts")
        visits = visits.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        on.append("_salt")
    same = [visits[k] == placed[k] for k in on]
    same += [placed[right_ts] >= visits["_low"], placed[right_ts] <= visits["_high"]]
    pairs = visits.join(placed, reduce(and_, same))
    for k in on:
        pairs = pairs.drop(placed[k])
    return pairs.drop("_bucket", "_salt", "_low", "_high")


LEVEL, LEVELS = 8, 7  # stretches of 8^0 to 8^6 seconds (three days); longer ones are several of the last


def _stretches(first: Column, last: Column) -> Column:
    """Aligned stretches ``(level, at)`` that make up the whole seconds from ``first`` to ``last``, both included.

    At each level the stretches that fit lie between two bounds; those that a stretch of the next level holds are left out.
    """
    low = [F.ceil(first / LEVEL**k) for k in range(LEVELS)]
    high = [F.floor((last + 1) / LEVEL**k) for k in range(LEVELS)]

    def run(start: Column, end: Column, level: int) -> Column:
        some = F.when(end > start, F.sequence(start, F.greatest(end - 1, start))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(some, lambda at: F.struct(F.lit(level).alias("level"), at.alias("at")))

    found = [run(low[-1], high[-1], LEVELS - 1)]
    for k in range(LEVELS - 1):
        held = low[k + 1] <= high[k + 1]
        found += [run(low[k], F.when(held, low[k + 1] * LEVEL).otherwise(high[k]), k),
                  run(F.when(held, high[k + 1] * LEVEL).otherwise(high[k]), high[k], k)]
    return F.concat(*found)


def interval_extreme(left: DataFrame, right: DataFrame, *, row_id: Sequence[str], keys: Sequence[str], low: Column,
                     high: Column, right_ts: str, value: Column, largest: bool, out: str,
                     right_group: Sequence[str] = ()) -> DataFrame:
    """Per left row the largest or smallest ``value`` of matching right rows; rows without a match are absent.

    ``right_group`` adds right columns to the grouping. The right side is folded once, by instant and by aligned stretches of
    1, 8, 64 ... seconds. The whole seconds of an interval are a few dozen such stretches, one row each whatever the key
    holds; only the two seconds the interval cuts through are looked at by instant. No row meets all rows of a hot key.
    """
    best = F.max if largest else F.min
    group = [*row_id, *right_group]
    probe = left.select(*dict.fromkeys([*row_id, *keys]), low.alias("_low"), high.alias("_high")).withColumn(
        "_first", seconds_of(F.col("_low"))).withColumn("_last", seconds_of(F.col("_high")))
    instants = cut_lineage(right.select(*keys, *right_group, F.col(right_ts).alias("_ts"), value.alias("_value")).groupBy(
        *keys, *right_group, "_ts").agg(best("_value").alias("_value")).withColumn("_second", seconds_of(F.col("_ts"))))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("_second") / LEVEL**k).alias("at")) for k in range(LEVELS)])
    folded = instants.select(*keys, *right_group, "_value", F.explode(levels).alias("_s")).select(
        *keys, *right_group, "_value", F.col("_s.level").alias("_level"), F.col("_s.at").alias("_at")).groupBy(
        *keys, *right_group, "_level", "_at").agg(best("_value").alias("_value"))
    inner = (
        probe.withColumn("_s", F.explode(_stretches(F.col("_first") + 1, F.col("_last") - 1)))
        .withColumn("_level", F.col("_s.level")).withColumn("_at", F.col("_s.at")).drop("_s")
        .join(folded, [*keys, "_level", "_at"]).groupBy(*group).agg(best("_value").alias("_value")))
    edges = (
        probe.withColumn("_second", F.explode(F.array_distinct(F.array("_first", "_last"))))
        .join(instants, [*keys, "_second"])
        .filter((F.col("_ts") >= F.col("_low")) & (F.col("_ts") <= F.col("_high")))
        .groupBy(*group).agg(best("_value").alias("_value")))
    # each branch is folded on its own, so the map-side combine runs right after its join
    return inner.unionByName(edges).groupBy(*group).agg(best("_value").alias(out))
