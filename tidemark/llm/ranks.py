"""Places of rows in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.checkpoints import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition in these bits


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Adds each row's place (from 0) in the given order. Equal rows get neighbouring places.

    Rows are range-partitioned, sorted within partitions and stored; the places of a partition begin
    where those before it end. Only one count per partition reaches the driver.
    """
    spark = rows.sparkSession
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", _ROW_BITS)
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    begins, total = [], 0
    for number, n in sizes:
        begins.append((number, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(begins, "_part long, _begin long"))  # a row per partition
    joined = ordered.withColumn("_part", part).join(offsets, "_part")
    return joined.withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_part", "_begin", "_at")
