"""Per-key selection and numbering that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.plans.lineage import cut_lineage

Order = Sequence[Column]


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Order, k: int = 1,
                rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per key.

    ``row_number() <= k`` makes Spark keep k rows per key in every input partition before the
    shuffle, so a hot key sends k rows per map task, not its whole group.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def flag_first(df: DataFrame, keys: Sequence[str], order: Order, row_id: str, flag: str,
               among: Column | None = None) -> DataFrame:
    """Mark the first row of every key (``among`` restricts the rows that compete).

    The keepers are joined back on the unique row id, so no task ever holds a whole key group.
    """
    rows = df if among is None else df.filter(among)
    keepers = top_per_key(rows, keys, order).select(row_id, F.lit(True).alias(flag))
    return df.join(keepers, row_id, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def number_rows(df: DataFrame, order: Order, name: str) -> DataFrame:
    """Global 1-based row numbers in ``order`` (which must be total) without a single-task sort.

    Rows are range-partitioned and sorted, the sorted copy is written out so that partition ids
    and positions are frozen, and partition offsets (one row per partition) are joined back.
    """
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    # one row per partition, so an unpartitioned running sum is bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_seq") - F.col("_first") + F.col("_offset") + 1)
        .drop("_part", "_seq", "_first", "_offset")
    )


def previous_window_mean(df: DataFrame, keys: Sequence[str], position: str, value: str, width: int,
                         out: str, span: int = 1000) -> DataFrame:
    """Floor of the mean of ``value`` over positions [p - width, p - 1] of the same key.

    Positions are cut into spans; the last ``width`` positions of a span are also sent to the next
    one, so a window over (key, span) sees everything it needs and a hot key spreads over spans.
    """
    if width > span:
        raise ValueError("width must not exceed span")
    home = F.floor(F.col(position) / span)
    copies = F.when(F.col(position) % span >= span - width, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_span", F.explode(copies)).withColumn("_home", F.col("_span") == home)
    frame = Window.partitionBy(*keys, "_span").orderBy(position).rangeBetween(-width, -1)
    return (
        spread.withColumn(out, F.floor(F.avg(value).over(frame)))
        .withColumn(f"{out}_n", F.count(value).over(frame))
        .filter("_home").drop("_span", "_home")
    )


def spread(df: DataFrame, *keys: str, waves: int = 1) -> DataFrame:
    """Hash-partition by ``keys`` over all cores, for work that is heavy per row and light in bytes.

    Left to itself, adaptive execution would merge such small partitions into a few slow tasks. Where keys are few and each
    is long work, several ``waves`` of tasks keep those that fall together few.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(waves * tasks, *keys)


def heavy_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with more than one partition's share of the rows: the keys, ``rows`` and the number of ``salts`` that evens them.

    There are fewer such groups than partitions, which bounds a broadcast of them.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    share = df.count() / parts
    return counts.filter(F.col("rows") > share).withColumn("salts", F.ceil(F.col("rows") / max(share, 1)).cast("int"))


def split_hot_group(group_size: Column, block_rows: int) -> Column:
    """How many blocks a group of this size is cut into."""
    return F.greatest(F.lit(1), F.ceil(group_size / F.lit(block_rows))).cast("int")
