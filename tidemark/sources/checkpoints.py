"""Where lineage is cut: reliable checkpoints in the folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder for iterative jobs.")
        named = tempfile.mkdtemp(prefix="run-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored, without the plan that made them. Survives the loss of executors."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """The name of a new folder below the shared checkpoint folder."""
    ensure_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written below the shared checkpoint folder and read again.

    For loops: unlike after `cut`, sizes come from the files, and nothing the optimizer inferred in earlier rounds is carried
    along. The files stay until the folder is cleared.
    """
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
