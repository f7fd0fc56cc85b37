"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at the folder the session names; a local session without one gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-checkpoints-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_sized(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder and continue from the files; for states of loops.

    A checkpoint keeps the size that was estimated for its plan, and the estimate of a join is the product of its sides'. Round
    by round such numbers grow to millions of digits, and planning small tables with them takes minutes. Files have a real size. They stay until ``release``.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/copy-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*copies: DataFrame) -> None:
    """Remove the files of ``cut_sized`` copies that nothing reads any more, and the shuffles that led to them.

    A loop that keeps every round's state fills the disk with as many tables as it has rounds. Shuffle files go when the driver's JVM
    finds that nothing refers to them, which it is asked to look for.
    """
    if not copies:
        return
    spark = copies[0].sparkSession
    jvm, kept = spark._jvm, f"{checkpoint_folder(spark)}/copy-"
    for folder in {file.rpartition("/")[0] for copy in copies for file in copy.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(kept).toUri().getPath()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def checkpoint_folder(spark: SparkSession) -> str:
    use_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir()
