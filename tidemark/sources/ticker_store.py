"""A stored ticker history that a batch of events changes only where it has to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.securities import ticker_history
from tidemark.operators.spread import spread
from tidemark.sources.checkpoints import cut

#: Securities are dealt to so many parts by hash; a part is what a batch rewrites.
BUCKETS = 256
_KEY = ["security_id", "kind", "effective"]


def apply_ticker_events(events: DataFrame, folder: str, batch: int, buckets: int = BUCKETS) -> list[int]:
    """Add a batch of events [security_id, kind, ticker, effective] and rebuild the parts of the history it touches.

    Below `folder`: `events` by part and batch, `history` (as `ticker_history` gives it) by part. Only the parts of the batch's
    securities are read and written; their numbers, at most `buckets`, are returned. Of events with the same security, kind
    and day the one of the latest batch counts, in a batch the one with the least ticker. A batch that is applied again replaces
    its own events (it must touch the same parts) and gives the same history. Events without security or day are left out.
    One writer at a time; `buckets` never changes.
    """
    spark = events.sparkSession
    known = events.filter("security_id IS NOT NULL AND effective IS NOT NULL")
    fresh = known.groupBy(*_KEY).agg(F.min("ticker").alias("ticker"))
    fresh = cut(fresh.withColumn("part", F.pmod(F.xxhash64(F.col("security_id").cast("long")), F.lit(buckets)).cast("int")).withColumn("batch", F.lit(batch)))
    touched = sorted(r.part for r in fresh.select("part").distinct().collect())  # at most `buckets`
    if not touched:
        return []
    _replace(fresh, f"{folder}/events", "part", "batch")
    stored = spread(spark.read.parquet(f"{folder}/events").filter(F.col("part").isin(touched)), "security_id")
    newest = stored.groupBy(*_KEY, "part").agg(F.max_by(F.struct("ticker"), "batch").alias("_t"))
    rows = ticker_history(newest.select(*_KEY, "_t.ticker"))
    _replace(rows.withColumn("part", F.pmod(F.xxhash64(F.col("security_id").cast("long")), F.lit(buckets)).cast("int")), f"{folder}/history", "part")
    return touched


def _replace(rows: DataFrame, path: str, *parts: str) -> None:
    """Write the parts that the rows have, leaving all others as they are."""
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def stored_history(spark: SparkSession, folder: str) -> DataFrame:
    """[security_id, ticker, valid_from, valid_to, refusal]: the history as the batches left it."""
    return spark.read.parquet(f"{folder}/history").drop("part")
