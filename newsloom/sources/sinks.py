"""Writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_by_date(rows: DataFrame, path: str, ts: str) -> None:
    """Append rows to Parquet partitioned by day.

    Rows are spread by day and a hash bucket first: few files per day, and a hot day is written by
    several tasks.
    """
    dated = rows.withColumn("date", F.col(ts).cast("date")).withColumn("_b", F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
    dated.repartition("date", "_b").drop("_b").write.mode("append").partitionBy("date").parquet(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
