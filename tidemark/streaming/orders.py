"""Running views over order logs: latest state per order, positions from deduplicated fills, with bounded lateness or without."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.orders import signed_quantity
from tidemark.session import STATE_STORE


def running_states(events: DataFrame) -> DataFrame:
    """Latest state per order; the state kept is one row per order."""
    newest = F.max_by(F.struct("state", "created_at"), "id")
    return events.groupBy("order_id").agg(newest.alias("_n"), F.max("id").alias("id")).select(
        "order_id", "id", "_n.*"
    )


def running_positions(fills: DataFrame) -> DataFrame:
    """Signed position per symbol; an execution delivered again is counted once.

    The deduplication keeps the execution ids seen, on disk: `run_available` sets the RocksDB state store. A symbol
    whose quantity is 0 in the changed rows has no position any more.
    """
    once = fills.dropDuplicates(["order_id", "exec_id"])
    return once.groupBy("symbol").agg(F.sum(signed_quantity()).alias("quantity"))


def run_available(
    view: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Process what is there in update mode and stop; `sink` gets the changed rows per batch."""
    view.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = (
        view.writeStream.outputMode("update")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def count_fills(
    fills: DataFrame, folder: str, checkpoint: str, lateness: str = "2 days", time: str = "filled_at"
) -> StreamingQuery:
    """Count every execution of a stream once, looking back no further than `lateness`. Processes what is there and stops.

    The horizon of a micro-batch is the newest `time` of all batches before it, less `lateness` (an interval in SQL). A fill
    at or after it is counted unless its (order_id, exec_id) was counted since the horizon; of copies in one batch the
    earliest counts. A fill before it may be a copy of one that is not looked at any more, so it is not counted but set aside,
    like one without time or ids. So what a batch reads back is bounded by the fills of a `lateness`, however long the log is.

    Below `folder`: `counted` (by day and batch), `changes` [symbol, quantity] and `late` (with a reason) by batch, and `newest`, a row per
    batch. A batch that is repeated reads only batches before it and writes its own parts anew. One writer at a time.
    """
    spark = fills.sparkSession
    keys = ["order_id", "exec_id"]

    def store(batch: DataFrame, batch_id: int) -> None:
        mark = spark.createDataFrame([], "newest string, batch long") if batch_id == 0 else spark.read.parquet(f"{folder}/newest")
        before = mark.filter(F.col("batch") < batch_id).agg(F.max(F.col("newest").cast("timestamp")).alias("newest"))
        horizon = before.select((F.col("newest") - F.expr(f"INTERVAL {lateness}")).cast("string")).first()[0]  # one row
        at = F.col(time).cast("timestamp")
        early = F.lit(False) if horizon is None else at < F.lit(horizon).cast("timestamp")
        reason = (
            F.when(F.col(time).isNull(), "no time")
            .when(F.col("order_id").isNull() | F.col("exec_id").isNull(), "no id")
            .when(early, "before the horizon")
        )
        judged = batch.withColumn("reason", reason)
        others = F.struct(time, *(c for c in batch.columns if c not in (*keys, time)))
        fresh = judged.filter("reason IS NULL").groupBy(*keys).agg(F.min(others).alias("_f")).select(*keys, "_f.*")
        if horizon is not None:
            fresh = fresh.join(counted_since(spark, folder, horizon, batch_id, time).select(*keys), keys, "left_anti")
        dated = fresh.withColumn("day", F.to_date(time)).withColumn("batch", F.lit(batch_id))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{folder}/counted")
        judged.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        mine = dated if horizon is None else counted_since(spark, folder, horizon, batch_id + 1, time).filter(F.col("batch") == batch_id)
        change = mine.groupBy("symbol").agg(F.sum(signed_quantity()).alias("quantity"))
        change.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")
        newest = batch.agg(F.max(at).cast("string").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{folder}/newest/batch={batch_id}")

    query = (
        fills.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def counted_since(spark: SparkSession, folder: str, horizon: str, batch_id: int, time: str = "filled_at") -> DataFrame:
    """The fills counted by batches before `batch_id` that are not before the horizon; only the days since then are read."""
    day = F.lit(horizon).cast("timestamp").cast("date")
    rows = spark.read.parquet(f"{folder}/counted").filter((F.col("day") >= day) & (F.col("batch") < batch_id))
    return rows.filter(F.col(time).cast("timestamp") >= F.lit(horizon).cast("timestamp"))


def counted_positions(spark: SparkSession, folder: str) -> DataFrame:
    """[symbol, quantity]: the signed position per symbol from the changes of all batches; positions of 0 are left out."""
    changes = spark.read.parquet(f"{folder}/changes")
    return changes.groupBy("symbol").agg(F.sum("quantity").alias("quantity")).filter("quantity <> 0")
