"""File streams in and out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.plans.lineage import checkpoint_folder


def stream_parquet(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the Parquet table called ``name`` in ``folder``, be it one file or a folder of files."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a stream's plain path must be a folder; a pattern stands for either
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def zoned(df: DataFrame, *columns: str) -> DataFrame:
    """Event-time columns as zoned timestamps, which watermarks need."""
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def wall(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint area."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Process everything available into an append-only Parquet table and read it."""
    spark = stream.sparkSession
    (stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/table")
     .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str) -> None:
    """Process everything available, one ``handle(batch, batch_id)`` per micro-batch."""
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/progress")
     .trigger(availableNow=True).start().awaitTermination())


class VersionedTable:
    """A small keyed state table with one version per micro-batch.

    Batch n reads version n-1 and overwrites version n, so a retried batch writes the same version
    again and a lost executor costs nothing but that batch. The newest version is found in the folder,
    so a later run goes on from it, with or without new files.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder, schema
        self.store(spark.createDataFrame([], schema), -1)

    def before(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/version={batch_id - 1}")

    def store(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/version={batch_id}")

    def latest(self) -> DataFrame:
        versions = self.spark.read.schema(f"{self.schema}, version long").parquet(self.folder)
        newest = versions.agg(F.max("version")).scalar()
        return versions.filter(F.col("version") == F.lit(newest)).drop("version")
