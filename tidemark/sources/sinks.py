"""Add-only tables: keys once stored are never changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import fingerprint
from tidemark.sources.checkpoints import cut


class VintageClosed(Exception):
    """Rows may be added to a vintage only while it is being built."""


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def append_new(
    fresh: DataFrame, path: str, keys: Sequence[str], day: str, partition: str = "month"
) -> None:
    """Append the rows whose key is not stored yet, partitioned by month.

    Fresh rows must be unique per key. Only the partitions the fresh rows touch are read: their list
    is at most one entry per calendar month. The fresh side is stored first, so the read of the old
    rows and the write see one and the same input.
    """
    spark = fresh.sparkSession
    rows = cut(fresh.withColumn(partition, F.date_format(day, "yyyy-MM")))
    if exists(spark, path):
        months = [r[0] for r in rows.select(partition).distinct().collect()]
        stored = spark.read.schema(rows.schema).parquet(path).filter(F.col(partition).isin(*months)).select(*keys, partition)
        rows = rows.join(stored, [*keys, partition], "left_anti")
    rows.repartition(partition, *keys[:1]).sortWithinPartitions(partition, *keys).write.mode(
        "append"
    ).partitionBy(partition).parquet(path)


def register_version(data: DataFrame, text, dataset: str, source: str, registry: str) -> str:
    """Record the fingerprint and row count of a download; the first record of equal data stays.

    Returns the version label.
    """
    spark = data.sparkSession
    row = fingerprint(data, text).select(
        F.lit(dataset).alias("dataset"), "sha256",
        F.concat(F.lit(f"{dataset}@"), F.substring("sha256", 1, 12)).alias("version"),
        F.lit(source).alias("source"), "row_count", F.current_timestamp().alias("downloaded_at"),
    )
    row = cut(row)
    if exists(spark, registry):
        known = spark.read.parquet(registry).select("dataset", "sha256")
        row_new = row.join(known, ["dataset", "sha256"], "left_anti")
    else:
        row_new = row
    row_new.coalesce(1).write.mode("append").parquet(registry)
    return row.first()["version"]


def vintage_status(spark: SparkSession, registry: str, vintage_id: str) -> str | None:
    """building, complete, or None when unknown; the registry is a log, complete is final."""
    if not exists(spark, registry):
        return None
    log = spark.read.parquet(registry).filter(F.col("vintage_id") == vintage_id)
    return log.agg(F.max_by("status", F.col("status") == "complete").alias("s")).first()["s"]


def start_vintage(spark: SparkSession, registry: str, vintage_id: str, description: str) -> bool:
    """Register a vintage, or resume one still being built. True if it is new."""
    status = vintage_status(spark, registry, vintage_id)
    if status == "complete":
        raise VintageClosed(f"Vintage {vintage_id} is complete: no row can be added to it.")
    if status == "building":
        return False
    _log(spark, registry, vintage_id, description, "building", None, None)
    return True


def add_to_vintage(fresh: DataFrame, path: str, registry: str, vintage_id: str, keys: Sequence[str]) -> None:
    """Add rows not there yet to a vintage that is being built."""
    if vintage_status(fresh.sparkSession, registry, vintage_id) != "building":
        raise VintageClosed(f"Vintage {vintage_id} is not being built.")
    append_new(fresh, f"{path}/vintage_id={vintage_id}", keys, "price_date")


def finish_vintage(spark: SparkSession, path: str, registry: str, vintage_id: str) -> None:
    """Count the rows and close the vintage, once."""
    if vintage_status(spark, registry, vintage_id) != "building":
        raise VintageClosed(f"Vintage {vintage_id} is not being built.")
    rows = spark.read.parquet(f"{path}/vintage_id={vintage_id}").count()
    _log(spark, registry, vintage_id, None, "complete", rows, "now")


def _log(spark, registry, vintage_id, description, status, rows, finished) -> None:
    entry = spark.createDataFrame(
        [(vintage_id, description, status, rows)],
        "vintage_id string, description string, status string, stock_rows bigint",
    ).withColumn("finished_at", F.current_timestamp() if finished else F.lit(None).cast("timestamp"))
    entry.coalesce(1).write.mode("append").parquet(registry)
