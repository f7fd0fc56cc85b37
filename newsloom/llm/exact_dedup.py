"""Exact dedup by a tree merge of digest runs, with DataFrame operations only.

Rows are dealt by id into leaf runs of (digest, second digest, bytes). In each round ``FAN_IN`` neighbouring runs
exchange their entries by digest and are merged: of equal entries the smallest id and the number of rows stay. After
the last round one run is left, still spread over all tasks by digest. The smallest ids then travel back down the
same tree, so a group that holds a third of all rows is never one join key: it is one key per leaf run.

Two texts count as equal when SHA-256, 64-bit XXH64 and length of the normalised text all agree; a merge verifies all
three, because all three are its key.

Null text: as empty. Null id: a row like any other that never becomes the smallest id while a group has another; if
it has none, ``keep_id`` is null. Rows that repeat an id and a text: the first is kept, the others not. Empty table:
empty result. Other columns are ignored by ``group_copies`` and returned unchanged by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import keep_one
from newsloom.plans.lineage import cut_lineage

FAN_IN = 8
KEY = ("digest", "second", "bytes")


def _digests(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    plain = docs.select(
        F.col(id_column).alias("id"),
        F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), r"[\x20\x09-\x0D]+", " ").alias("plain"))
    return plain.select("id", F.sha2("plain", 256).alias("digest"), F.xxhash64("plain").alias("second"),
                        F.octet_length("plain").alias("bytes"))


def leaf_runs(tasks: int) -> int:
    """A power of the fan-in, at least one run per task, so that a hot digest meets every task once."""
    runs = FAN_IN * FAN_IN
    while runs < tasks:
        runs *= FAN_IN
    return runs


def group_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    runs = leaf_runs(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut_lineage(_digests(docs, id_column, text_column).withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int")))
    levels = [cut_lineage(rows.groupBy("run", *KEY).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))]
    while runs > 1:
        runs //= FAN_IN
        step = levels[-1].withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
        levels.append(step.groupBy("run", *KEY).agg(F.min("low").alias("low"), F.sum("n").alias("n")))
        if runs > 1:
            levels[-1] = cut_lineage(levels[-1])
    down = levels.pop().filter("n > 1")  # a text of its own needs no message
    while levels:
        below = levels.pop().select("run", *KEY)
        above = down.withColumnRenamed("run", "up")
        down = below.withColumn("up", F.floor(F.col("run") / FAN_IN).cast("int")).join(above, ["up", *KEY]).drop("up")
    first = F.row_number().over(Window.partitionBy("run", *KEY, "id").orderBy("id"))
    return rows.join(down, ["run", *KEY], "left").withColumn("nth", first).select(
        F.col("id").alias(id_column),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("low")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("low"))) & (F.col("nth") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without its copies, all columns kept. Of rows equal in id and text the first by a digest of the row stays.

    Rows are matched to their group by id and digest; groups are decided on digests, texts move once.
    """
    groups = group_copies(docs, id_column, text_column).groupBy(F.col(id_column).alias("id"), F.col("text_sha256").alias("digest")).agg(
        F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("kept")
    plain = F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return keep_one(docs, groups, {"id": F.col(id_column), "digest": F.sha2(plain, 256)})
